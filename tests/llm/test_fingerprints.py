"""Winnowing against plain Python."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from voxelith.llm import fingerprints as fp


def plain(text, k=fp.GRAM, w=fp.WINDOW):
    """[(place, hash)] kept."""
    values = [zlib.crc32(u.encode()) % fp.PRIME for u in re.findall(fp.UNIT, text)]
    grams = [values[i : i + k] for i in range(max(1, len(values) - k + 1))] if values else []
    hashes = []
    for g in grams:
        h = 0
        for v in g:
            h = (h * fp.BASE + v) % fp.PRIME
        hashes.append(h)
    kept = set()
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = hashes[i : i + w]
        least = min(window)
        kept.add((i + max(j for j, h in enumerate(window) if h == least), least))
    return sorted(kept)


def string(kept):
    return " ".join(f"{h:X}@{i}" for i, h in kept)


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    docs = sorted(set((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + n[:cut]
        a, b = plain(t), plain(edited)
        out[i, t] = (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), string(a), string(b), likeness(a, b), likeness(a, plain(n)))
    return [out[i, t or ""] for i, t in rows]


def words(rng, n):
    return "".join(rng.choice(["alpha", "beta", "überlänglich", "x", "𝒳𝒴", "the", "of", "a-very-long-unit-of-text"]) + rng.choice([" ", "\n", "\t", "  ", "\xa0"]) for _ in range(n))


def test_digests_row_by_row(spark):
    rng = random.Random(3)
    texts = ["", None, " ", "one", "a b c", "same " * 200, "-" * 3000, *(words(rng, rng.choice([3, 10, 30, 80, 400])) for _ in range(40))]
    rows = [(3 * k - 20, t) for k, t in enumerate(texts)] + [(None, "null id"), (400, texts[-1]), (401, texts[-1])]
    rows += rows[-2:] + rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash")).repartition(3)
    got = [tuple(r) for r in fp.digests(fp.edited_pairs(df)).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_of_one_and_of_no_document(spark):
    assert fp.digests(fp.edited_pairs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    row = [(5, words(random.Random(1), 50))]
    assert [tuple(r) for r in fp.digests(fp.edited_pairs(spark.createDataFrame(row, "doc_id long, text string"))).collect()] == expected(row)


def test_a_very_long_text(spark):
    text = words(random.Random(2), 60_000)
    rows = [(1, text), (2, text[:-100_000] + "z"), (3, "-" * 1_000_000)]
    got = {r["doc_id"]: tuple(r) for r in fp.digests(fp.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {r[0]: r for r in expected(rows)}


def test_shared_passages_are_met(spark):
    """Any window + gram - 1 units that two texts share leave a hash in both."""
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(fp.WINDOW + fp.GRAM - 1))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (0, 1, 7, 100)]
    df = spark.createDataFrame([(k, f"{t} {passage} {t}") for k, t in enumerate(texts)], "doc_id long, text string")
    kept = [set(r["h"]) for r in fp.fingerprinted(df, "text", "f").select(fp.hashes(F.col("f")).alias("h")).collect()]
    assert set.intersection(*kept)


def test_query_and_its_sql(spark, sf_dir):
    import duckdb

    from voxelith.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(expected(rows))
    assert sorted(tuple(r) for r in queries.op11_document_fingerprints(spark, sf_dir).collect()) == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(c.execute(queries.SQL["op11_document_fingerprints"]).fetchall()) == want
