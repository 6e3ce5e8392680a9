"""Queries of the training-data operators, as registered by __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprints, licenses, neighbours, ngram_join, packing, quarantine, secrets, sharding, suffix_dedup, toxicity, trie
from .common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the fixed conversation -7 of the contract
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"), n=5, percent=75)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build_index(rows, k=10), rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), ["doc_id", "text"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digests(fingerprints.edited_pairs(table(spark, sf_dir, "documents")))


def op12_quarantine_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = quarantine.replay(quarantine.scheduled(table(spark, sf_dir, "conversations")))
    return released.select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.grafted(trie.turns_of(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_chat_formatting, op3_sharding, op4_ngram_jaccard_join, op5_nearest_neighbours, op6_toxicity, op7_license_scan, op8_secret_scan, op9_best_fit_packing, op10_benchmark_decontamination, op11_document_fingerprints, op12_quarantine_release, op13_prefix_trie)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: CRC-32 in SQL: the table of the reflected polynomial, and a fold over the bytes of a string.
_CRC_TABLE = "crc AS (SELECT list(c ORDER BY i) AS crc_table FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """CRC-32 of a string column; ``crc`` must be among the tables."""
    digit = "instr('123456789ABCDEF', substr(hex({0}), {1}, 1))"
    data = f"list_transform(range(0, strlen({text})), lambda i: CAST(16 * {digit.format(text, '2 * i + 1')} + {digit.format(text, '2 * i + 2')} AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


#: DuckDB twins.  The others have none: ring positions, floods of tokens, learned scores,
#: alignments, spans of matches and byte windows are tested against brute force instead.
SQL: dict[str, str] = {
    "op2_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     p AS (SELECT *, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
     l AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) + 7 AS piece,
                  length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) + 6 AS header FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(piece + CASE WHEN before IS NULL THEN header WHEN before <> role THEN header + 1 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id""",
    "op4_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
     e AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
     both_ AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     reach(root, doc_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.root, b FROM reach r JOIN both_ ON a = r.doc_id)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, min(root) AS component_id FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n""",
    "op11_document_fingerprints": rf"""
WITH {_CRC_TABLE},
     d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     n AS (SELECT doc_id, text, length(text) // 4 AS cut, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST), first(text) OVER (ORDER BY doc_id NULLS FIRST)) AS next FROM d),
     e AS (SELECT doc_id, text, next, concat(text[1:length(text) - cut], CASE WHEN cut > 0 THEN next[1:cut] ELSE '' END) AS edited FROM n),
     s AS (SELECT DISTINCT unnest([text, edited]) AS s FROM e),
     u AS (SELECT s, unnest(regexp_extract_all(s, '{fingerprints.UNIT}')) AS u, generate_subscripts(regexp_extract_all(s, '{fingerprints.UNIT}'), 1) AS i FROM s),
     c AS (SELECT u, {_crc("u")} % {fingerprints.PRIME} AS v FROM (SELECT DISTINCT u FROM u) q, crc),
     v AS (SELECT s, list(v ORDER BY i) AS v FROM u JOIN c USING (u) GROUP BY s),
     h AS (SELECT s, list_transform(range(1, greatest(len(v) - {fingerprints.GRAM - 1}, 1) + 1), lambda i: list_reduce(list_prepend(CAST(0 AS BIGINT), v[i:i + {fingerprints.GRAM - 1}]), lambda a, x: (a * {fingerprints.BASE} + x) % {fingerprints.PRIME})) AS h FROM v),
     w AS (SELECT s, unnest(list_transform(range(1, greatest(len(h) - {fingerprints.WINDOW - 1}, 1) + 1), lambda i: {{'i': i, 'w': h[i:i + {fingerprints.WINDOW - 1}]}})) AS g FROM h),
     m AS (SELECT DISTINCT s, list_min(g.w) AS h, g.i + len(g.w) - list_position(list_reverse(g.w), list_min(g.w)) - 1 AS place FROM w),
     f AS (SELECT s, coalesce(string_agg(concat(hex(h), '@', place), ' ' ORDER BY place), '') AS f, coalesce(list(DISTINCT h) FILTER (h IS NOT NULL), []) AS h FROM s LEFT JOIN m USING (s) GROUP BY s)
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       CASE WHEN len(a.h) + len(b.h) = 0 THEN 1.0 ELSE len(list_intersect(a.h, b.h)) / CAST(len(list_distinct(list_concat(a.h, b.h))) AS DOUBLE) END AS near_edited,
       CASE WHEN len(a.h) + len(z.h) = 0 THEN 1.0 ELSE len(list_intersect(a.h, z.h)) / CAST(len(list_distinct(list_concat(a.h, z.h))) AS DOUBLE) END AS near_next
FROM e JOIN f a ON a.s = text JOIN f b ON b.s = edited JOIN f z ON z.s = next""",
    "op12_quarantine_release": f"""
WITH RECURSIVE {_CRC_TABLE},
     r AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p FROM conversations),
     k AS (SELECT conv_id, turn, p, text, k, concat(k, ':', conv_id, ':', turn) AS s FROM r, range(8) n(k)),
     h AS (SELECT conv_id, turn, p, text, list(c ORDER BY k) AS h FROM (SELECT k.*, {_crc("s")} AS c FROM k, crc) q GROUP BY ALL),
     t AS (SELECT conv_id, turn, p, text, 7 * p AS arrives, list_transform(h[4:8], lambda x: x % 3 = 0) AS failing,
                  CASE WHEN h[1] % 3 > 0 AND p >= h[1] % 3 THEN p - h[1] % 3 END AS parent, CASE WHEN h[2] % 101 < 35 THEN 7 * p + h[3] % 101 END AS repaired FROM h),
     l(conv_id, p, status, attempts, first_at, last_at) AS (
       SELECT conv_id, p, CASE WHEN a IS NULL THEN 'dead' ELSE 'delivered' END, coalesce(a, 5), first_at, first_at + 10 * (2 ** (coalesce(a, 5) - 1) - 1)
       FROM (SELECT conv_id, p, arrives AS first_at, list_filter([1, 2, 3, 4, 5], lambda a: repaired IS NULL OR (arrives + 10 * (2 ** (a - 1) - 1) >= repaired AND NOT failing[a]))[1] AS a FROM t WHERE parent IS NULL) q
       UNION ALL
       SELECT conv_id, p, CASE WHEN above <> 'delivered' THEN 'blocked' WHEN a IS NULL THEN 'dead' ELSE 'delivered' END, CASE WHEN above = 'delivered' THEN coalesce(a, 5) ELSE 0 END,
              CASE WHEN above = 'delivered' THEN first_at END, CASE WHEN above = 'delivered' THEN first_at + 10 * (2 ** (coalesce(a, 5) - 1) - 1) END
       FROM (SELECT *, list_filter([1, 2, 3, 4, 5], lambda a: repaired IS NULL OR (first_at + 10 * (2 ** (a - 1) - 1) >= repaired AND NOT failing[a]))[1] AS a
             FROM (SELECT t.conv_id, t.p, t.repaired, t.failing, l.status AS above, greatest(t.arrives, l.last_at) AS first_at
                   FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.parent = l.p) x) q),
     n AS (SELECT t.conv_id, t.turn, t.text, l.*, CASE WHEN status = 'delivered' THEN row_number() OVER (PARTITION BY t.conv_id, status ORDER BY last_at, turn NULLS FIRST, t.p) END AS release_no
           FROM t JOIN l ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.p = l.p)
SELECT conv_id, turn, status, CAST(attempts AS INT) AS attempts, CAST(first_at AS BIGINT) AS first_at, CAST(last_at AS BIGINT) AS last_at, release_no,
       CASE WHEN status = 'delivered' THEN CAST(sum(release_no * {_crc("text")}) OVER (PARTITION BY conv_id, status ORDER BY release_no) AS BIGINT) END AS state FROM n, crc""",
    "op13_prefix_trie": f"""
WITH RECURSIVE {_CRC_TABLE},
     r AS (SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
     k AS (SELECT c, own, CAST(c AS VARCHAR) AS s FROM r), h AS (SELECT c, own, {_crc("s")} % 9 AS h FROM k, crc),
     b AS (SELECT a.c, list_concat(coalesce(z.own, [])[1:a.h], a.own[a.h + 1:]) AS way FROM h a LEFT JOIN r z ON z.c = a.c - a.c % 5),
     n AS (SELECT d, way[1:d] AS node, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(way) = d), '') AS ends
           FROM (SELECT c, way, unnest(range(0, len(way) + 1)) AS d FROM b) q GROUP BY 1, 2),
     f AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.d = n.d + 1 AND k.node[1:n.d] = n.node) AS n_children
           FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1])
SELECT CAST(a.conv_id AS BIGINT) AS conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count(*) FILTER (u.n_children = 0) AS BIGINT) AS n_leaves,
       CAST(sum(CASE WHEN u.d = 0 THEN 0 ELSE (u.n_convs - 1) * strlen(u.node[u.d][2]) END) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM f a JOIN f u ON u.d >= a.d AND u.node[1:a.d] = a.node GROUP BY a.d, a.node, a.conv_id, a.parent_conv_id, a.n_convs, a.n_children, a.ends""",
}
