"""Operators against brute force on small tables with odd rows."""

import hashlib
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelith.llm import chat, decontamination, neighbours, ngram_join, packing, secrets, sharding, suffix_dedup, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()
#: Extra columns whose names the operators use inside.
EXTRA = "h long, k string, t1 long, spans string, size long, content long, part int, rank long, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n))


def texts():
    a, b = prose(1, 120), prose(2, 90)
    near = a.split()
    near[60] = "changed"
    passage = prose(3, 60)
    return [
        (0, a), (1, a.upper()), (2, " ".join(near)), (3, b), (4, b), (4, b), (5, None), (6, ""), (7, " \t\n "), (8, "alpha"), (9, "Alpha"), (10, "alpha beta"),
        (11, prose(4, 50) + " " + passage), (12, prose(5, 70) + "\n" + passage + " " + prose(6, 20)), (13, "é　ü " * 80), (14, "x" * 1000), (15, prose(7, 20_000)),
        (None, prose(8, 40)), (None, None), (16, "a\x00b" * 120), (17, "a\x00b" * 119), (18, prose(7, 19_000)), (19, "one two  three\tfour\nfive six"), (20, "one two three four five six"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None, None if t is None else len(t), 1, "k", 2, "s", 3, 4, 5, 6, 0.5) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---------------------------------------------------------------- 1


def removal(pairs, width):
    data = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(b[k : k + width] for _, b in data for k in range(len(b) - width + 1))
    out = []
    for i, b in data:
        mark = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                mark[k : k + width] = b"\1" * width
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_suffix_dedup(docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    assert rows_of(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removal(texts(), 200)


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_LONGEST", 700)
    t = prose(9, 600)
    batch = pa.RecordBatch.from_arrays([pa.array([t])], ["text"])
    raw = np.frombuffer(t.encode(), np.uint8)
    got = sorted((s + base[0] + lo, s + base[0] + hi) for part, off, _, base in suffix_dedup.buffers(batch, 200) for _, _, los, his in [suffix_dedup.anchors(part, off, 200)] for s, lo, hi in ((0, x, y) for x, y in zip(los.tolist(), his.tolist(), strict=True)))
    starts = sorted(x for lo, hi in got for x in range(lo, hi))
    assert starts == list(range(len(raw) - 199))


def test_construction_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        width, m, sigma = int(rng.integers(3, 12)), int(rng.integers(1, 30)), int(rng.integers(1, 4))
        segments = []
        for _ in range(m):
            if segments and rng.random() < 0.5:
                body, before = segments[rng.integers(len(segments))]
                body = bytearray(body)
                body[rng.integers(len(body))] = int(rng.integers(0, sigma + 1))
                segments.append((bytes(body), before))
            else:
                before = int(rng.integers(0, width))
                tail = int(rng.integers(1, width + 1)) if rng.random() < 0.3 else width
                segments.append((bytes(rng.integers(0, sigma + 1, before + tail).astype(np.uint8)), before))
        size = np.array([len(s) for s, _ in segments])
        with tempfile.TemporaryDirectory() as folder:
            which, start = suffix_dedup.repeated_starts(np.frombuffer(b"".join(s for s, _ in segments), np.uint8), np.cumsum(size) - size, np.array([b for _, b in segments]), size, width, folder)
        groups = defaultdict(list)
        for i, (s, b) in enumerate(segments):
            for k in range(b + 1):
                if k + width <= len(s):
                    groups[b - k, s[k : k + width]].append((i, k))
        assert set(zip(which.tolist(), start.tolist(), strict=True)) == {x for g in groups.values() if len(g) > 1 for x in g}


# ---------------------------------------------------------------- 2


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi </turn> \\### <b> \\l"), (1, 1, "user", None), (1, 2, "assistant", "a:b\n### user: x"), (1, 600, "assistant", "late é"), (1, 601, None, "no role"),
        (2, 5, "assistant", ""), (2, 5, "assistant", ""), (3, None, "system", "s"), (3, 0, "we:ird#<role>\\", "t"), (None, 0, "user", "u"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    convs = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    one = formatted.filter("conv_id = 1").first()["formatted"]
    assert one.count("### ") == 3  # adjacent turns of one role share a header, across chunks as well
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 3


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 8).collect()
    n = Counter(r["shard"] for r in out)
    assert len(out) == len(texts()) and max(n.values()) - min(n[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_moves_little():
    rng = np.random.default_rng(0)
    counts = dict(enumerate(rng.poisson(20, sharding.SLOTS).tolist()))

    def owner(shards):
        return {(p, r): s for p, lo, hi, s, _ in sharding.plan(counts, shards) for r in range(lo, hi)}

    a, b = owner(8), owner(9)
    assert len(a) == sum(counts.values()) == len(b)
    assert sum(a[k] != b[k] for k in a) / len(a) < 1 / 9 + 0.25


# ---------------------------------------------------------------- 4


def jaccard(pairs):
    sets = []
    for i, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if find(b) == find(a) and sets[b][0] is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=str)


def test_ngram_join(docs, empty):
    assert rows_of(ngram_join.join_documents(docs), "doc_id", "n_shingles", "component_id") == jaccard(texts())
    assert ngram_join.join_documents(empty).count() == 0


def test_ngram_join_finds_chains(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for g in range(12):
        t = prose(100 + g, int(rng.integers(6, 300))).split()
        for k in range(8):
            t = list(t)
            t[rng.integers(len(t))] = f"w{g}x{k}"
            if rng.random() < 0.3:
                t = t[: max(5, int(len(t) * 0.9))]
            pairs.append((len(pairs), " ".join(t)))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows_of(ngram_join.join_documents(df), "doc_id", "n_shingles", "component_id") == jaccard(pairs)


def test_blocks_leave_room():
    """More non-empty blocks than changes, at every size that matters (see the docstring)."""
    rng = np.random.default_rng(2)
    for size in [*range(3, 300, 7), 511, 512, 1023, 1024, 1365, 5000, 20_000]:
        row, h = np.repeat(np.arange(20), size), rng.integers(0, 2**63, 20 * size).astype(np.uint64) * np.uint64(2)
        r, g, _, d = ngram_join.elements(row, h, 20)
        for part in set(zip(r.tolist(), g.tolist(), strict=True)):
            mine = (r == part[0]) & (g == part[1])
            assert mine.sum() > d[mine][0]


# ---------------------------------------------------------------- 5


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:420] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] + [1.0] * 7), (1300, [None] + [1.0] * 7), (None, x[1].tolist()), (1400, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, shard int")
    out = neighbours.search(neighbours.build_index(df), df.filter("vec_id % 100 = 0")).collect()
    hit = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        got = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], abs=1e-9) for r in got)
        hit, total = hit + len({r["vec_id"] for r in got} & set(order)), total + 10
    assert hit / total >= 0.95
    assert {r["query_id"] for r in out} == set(range(0, 900, 100))
    few = df.filter("vec_id < 4")
    assert neighbours.search(neighbours.build_index(few), few.filter("vec_id = 0")).count() == 3
    assert neighbours.search(neighbours.build_index(df.limit(0)), df.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(6)
    bad = ["vile", "scummy", "moronic", "idiotic"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.2
        t = rng.choice(WORDS, int(rng.integers(5, 200))).tolist()
        for _ in range(3 * toxic):
            t[rng.integers(len(t))] = str(rng.choice(bad)) + str(rng.choice(["", "ly", "ness"]))
        rows.append((i, " ".join(t)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    rows += [(None, None), (5000, ""), (5001, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, toxicity double")
    known = spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score_documents(docs, known, ["doc_id", "text"]).collect()
    score = {r["doc_id"]: r["toxicity"] for r in out}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in score.values())
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == y for i, y in test]) > 0.95
    none = toxicity.score_documents(docs, known.limit(0), ["doc_id", "text"]).collect()
    assert len(none) == len(rows) and max(r["toxicity"] for r in none) < 0.5


# ---------------------------------------------------------------- 8


def base_spans(s):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(s) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", s) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", s) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    hexes = "0123456789abcdef" * 3
    cases = [
        None, "", "é API_KEY = 'abcdefgh12' x", "secret: token: abcdefgh12", "password=token=abcdefghij", "PASSWORD=short", f"AKIA{'Z9' * 8} and AKIAX", f"{hexes}{hexes} deed {hexes}",
        f"token={hexes}", " ".join(f"apikey:{k:012d}" for k in range(300)), "aGVsbG8gd29ybGQ5c2VjcmV0MTIzNDU2Nzg5MA==", "the-quick-brown-fox-jumps-over-1", "İpassword=abcdefgh1",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, spans string")
    scanned = secrets.scan(df)
    got = {r["doc_id"]: r for r in secrets.digests(scanned).collect()}
    for i, t in enumerate(cases):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert "entropy" in got[10]["spans"] and "entropy" not in got[11]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(scanned).collect()}
    assert clean[0] is None and clean[2] == "é [secret]' x" and clean[5] == cases[5] and clean[9].count("[secret]") == 300
    assert secrets.digests(secrets.scan(df.limit(0))).count() == 0


def test_window_entropy(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-")
    cases = ["".join(rng.choice(alphabet[: int(rng.integers(2, 60))], int(rng.integers(20, 60)))) for _ in range(40)]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for r in df.select("s", secrets.window_entropy(F.split("s", ""), 20, 3.3).alias("e")).collect():
        hits = []
        for i in range(len(r["s"]) - 19):
            n = np.array(list(Counter(r["s"][i : i + 20]).values())) / 20
            if -(n * np.log2(n)).sum() >= 3.3 - 1e-9:
                hits.append(i)
        want = (hits[0], hits[-1] + 20) if hits else (-1, -1)
        assert (r["e"]["first"], r["e"]["last"]) == want


# ---------------------------------------------------------------- 9


def test_packing(docs, empty):
    out = packing.pack_documents(docs, 256).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, text in texts():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            want.append((i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty).count() == 0


def test_words_equal_the_tokenizer():
    words = packing.words_of(packing.tokenizer_path())
    plain = Tokenizer.from_file(packing.tokenizer_path())
    odd = ["", "x <|endoftext|> y", "x<|endoftext|>y.", "<|ENDOFTEXT|>", "U.S.A., (it's) IT'S, é., x<\u0338.", "don't. 'S. a'. Ａ., 12a.b, ., ...", "İ. ß, ﬁ;", None, "a b  c d", "İSTANBUL ΑΣ.", "é ́x", "don't it's　x", "<|endoftext|> a<|startoftext|>b", "a|b | c|", "a\x0bb\x1cc\x85d", "​ x", "| || |"]
    ids, sizes = words(pa.array(odd))
    at = 0
    for text, n in zip(odd, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == plain.encode(text or "", add_special_tokens=False).ids
        at += n


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 3)
    words, plain = packing.Words(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    for k in range(4):
        some = [f"word{k} Other. word{i} same, <|endoftext|>" for i in range(6)]
        ids, sizes = words(pa.array(some))
        assert ids.tolist() == [x for t in some for x in plain.encode(t, add_special_tokens=False).ids]
        assert sizes.sum() == len(ids)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ9.,'|<>&! \n\u0301\u0338é"), st.characters(codec="utf-8")), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text_has_the_tokenizers_ids(some):
    words, plain = packing.words_of(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    ids, sizes = words(pa.array(some, pa.string()))
    assert ids.tolist() == [x for t in some for x in plain.encode(t, add_special_tokens=False).ids]


def fewest(items, capacity):
    """Optimal number of bins by search."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for room in set(bins):
            if room >= items[k]:
                rest = list(bins)
                rest[rest.index(room)] -= items[k]
                go(k + 1, rest)
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(7)
    for _ in range(120):
        items = rng.integers(1, 21, int(rng.integers(1, 11))).tolist()
        left = dict(Counter(items))
        fixed = packing.reduce(left, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        used = [s for q, parts in fixed for s, e in parts for _ in range(q * e)]
        assert sorted(used + rest) == sorted(items)
        assert all(sum(s * e for s, e in parts) <= 20 for _, parts in fixed)
        assert sum(q for q, _ in fixed) + fewest(rest, 20) == fewest(items, 20)


# ---------------------------------------------------------------- 10


def distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        prev, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination(spark):
    rng = np.random.default_rng(9)
    items = [prose(200 + k, int(rng.integers(3, 40))) for k in range(8)] + ["tiny", "", None, "nineteen characters"]
    cases = [(0, None), (1, ""), (None, items[0])]
    for k in range(60):
        t = list(items[int(rng.integers(8))])
        for _ in range(int(rng.integers(0, 1 + len(t) // 7))):
            p, kind = int(rng.integers(len(t))), rng.integers(3)
            t[p] = "" if kind == 0 else "q" if kind == 1 else t[p] + "q"
        cases.append((k + 2, prose(300 + k, 10).upper() + " \n " + "".join(t).replace(" ", "  ") + " " + prose(400 + k, 10)))
    docs = spark.createDataFrame([(*c, 1) for c in cases], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, t, 2) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.find_items(docs, bench).collect()}
    want = {}
    for i, t in cases:
        t = re.sub(r"\s+", " ", (t or "").lower())
        for k, item in enumerate(items):
            if item and (e := distance_inside(item, t)) <= len(item) // 10:
                want[i, k] = e
    assert got == want
    assert decontamination.find_items(docs.limit(0), bench).count() == 0
    assert decontamination.find_items(docs, bench.limit(0)).count() == 0
