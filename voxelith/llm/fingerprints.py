"""Winnowed fingerprints of documents, with Spark expressions only.

A text's units are its runs of characters other than space, tab and line ends, cut after
eight code points each.  A unit's value is its CRC-32; k units in a row have the Karp-Rabin
hash (v1 * B^(k-1) + ... + vk) mod 2^31 - 1, which rolls from place to place: one product,
one unit in, one out.  Of every w hashes in a row the least is kept, of equal ones the
rightmost, once, with its place.  Any w + k - 1 units that two texts share, from the start of
a unit on, therefore leave a hash that both fingerprints hold.

A text of fewer than k units has one hash, over all of them; one with fewer than w hashes one
window; one without units (null, empty, blank) an empty fingerprint.  The likeness of two
fingerprints is that of their sets of hashes (shared / all): 1 if both are empty.

A text is worked on as a whole in one row: arrays of some 150 bytes a unit, about 30 bytes a
character, so texts of many megabytes need the memory for it; nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered

UNIT = r"[^\x20\x09-\x0D]{1,8}"
GRAM, WINDOW = 4, 8
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Hashes that roll on from one that is computed afresh: appending costs a copy of what is there.
_BLOCK = 16
_PLACE = 1 << 32


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def rolled(values: Column, gram: int, changes: Column) -> Column:
    """Hashes of all grams of an array of values; ``changes``: what each step adds (see ``_changes``)."""

    def step(h: Column, x: Column) -> Column:
        return (h * _long(BASE) + x) % _long(PRIME)

    def block(j: Column) -> Column:
        first = F.aggregate(F.slice(values, j * _BLOCK + 1, F.lit(gram)), _long(0), step)
        return F.aggregate(F.slice(changes, j * _BLOCK + 1, F.lit(_BLOCK - 1)), F.array(first), lambda done, x: F.array_append(done, step(F.element_at(done, -1), x)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.size(changes) / _BLOCK).cast("int")), block))


def _changes(values: Column, gram: int) -> Column:
    """A unit that enters, less one that leaves times B^k."""
    leaves = pow(BASE, gram, PRIME)
    n = F.greatest(F.size(values) - gram, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(gram + 1), n), lambda out, into: (into + _long(PRIME) - out * _long(leaves) % _long(PRIME)) % _long(PRIME))


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def winnowed(rows: DataFrame, found: Column, out: str, first: Column | None = None, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: array<long> of hash * 2^32 + 2^32 - 1 - place, in the order of places.

    ``found``: units; ``first``: place of the first one.  Arrays are columns of their own, each
    used more than once below, so that Spark does not fold one's making into a function that
    runs for every element of the next.
    """
    rest = rows.columns
    df = rows.withColumns({"_v": F.transform(found, lambda u: F.crc32(u) % _long(PRIME)), "_f": F.lit(0) if first is None else first})
    df = df.select(*rest, "_f", "_v", _changes(F.col("_v"), gram).alias("_c"))
    df = df.select(*rest, "_f", F.when(F.size("_v") > 0, rolled(F.col("_v"), gram, F.col("_c"))).otherwise(F.array().cast("array<long>")).alias("_h"))
    # packed so that the least of a window is the least hash, then the rightmost place
    df = df.select(*rest, F.transform("_h", lambda h, i: h * _long(_PLACE) + (_long(_PLACE - 1) - i - F.col("_f"))).alias("_p"))
    best, wide = F.col("_p"), 1
    while wide < window:
        more = min(wide, window - wide)
        n = F.greatest(F.size(best) - more, F.lit(0))
        df = df.select(*rest, "_p", F.zip_with(F.slice(best, F.lit(1), n), F.slice(best, F.lit(1 + more), n), lambda a, b: F.least(a, b)).alias(f"_m{wide + more}"))
        wide += more
        best = F.col(f"_m{wide}")
    kept = F.when(F.size("_p") > window, F.array_distinct(best)).when(F.size("_p") > 0, F.array(F.array_min("_p"))).otherwise(F.array().cast("array<long>"))
    return df.select(*rest, kept.alias(out))


def place(kept: Column) -> Column:
    return _long(_PLACE - 1) - kept.bitwiseAND(_long(_PLACE - 1))


def rewinnowed(rows: DataFrame, kept: str, start: Column, text: Column, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the fingerprint of ``text``, which begins with ``start`` as the text of fingerprint ``kept`` does.

    Only what lies behind the shared part, and a few windows before, is hashed again.
    """
    # the last unit of the start may go on in either text
    df = rows.withColumns({"_same": F.greatest(F.size(units(start)) - 1 - gram - 3 * window, F.lit(0)), "_units": units(text)})
    df = df.withColumn("_units", F.slice("_units", F.col("_same") + 1, F.greatest(F.size("_units") - F.col("_same"), F.lit(0))))
    df = winnowed(df, F.col("_units"), "_new", F.col("_same"), gram, window).drop("_units")
    # places below this lie in windows that the texts share; those from it on were hashed again
    seam = F.when(F.col("_same") > 0, F.col("_same") + window).otherwise(F.lit(0))
    both = F.concat(F.filter(kept, lambda p: place(p) < seam), F.filter("_new", lambda p: place(p) >= seam))
    return df.withColumn(out, both).drop("_same", "_new")


def fingerprinted(rows: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    return winnowed(rows, units(F.col(text)), out, None, gram, window)


def hashes(kept: Column) -> Column:
    """array<int>: the distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(kept, lambda p: F.shiftright(p, 32).cast("int")))


def shown(kept: Column) -> Column:
    """A fingerprint as text: hash (hexadecimal) at place, in the order of places."""
    return F.array_join(F.transform(kept, lambda p: F.concat(F.hex(F.shiftright(p, 32)), F.lit("@"), place(p).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two sets (arrays without repeats) over all of them."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next (see ``digests``).

    ``edited``: the text whose last quarter (rounded down) gives way to as much of the
    beginning of the next document's text, or all of it.  Documents follow each other by
    doc_id (null first), then by a hash of the text; behind the last one comes the first.
    Repeated rows (doc_id and text) are one document and give equal rows.  Null text: empty.
    Other columns are not read.  Empty table: no rows.

    Ids alone are put in order; texts are shuffled once, by (doc_id, hash), and meet there both
    as a document and as the next one; then only beginnings and hashes go to the one before.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], text.alias("text")).withColumn("hash", F.xxhash64("text"))
    ids = numbered(rows.groupBy("doc_id", "hash").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("copies")), [], ["doc_id", "hash"], "at")
    last = ids.agg(F.max("at")).first()[0]
    after = ids.select(F.col("doc_id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("copies").alias("next_copies"), F.when(F.col("at") > 0, F.col("at") - 1).otherwise(F.lit(last)).alias("at"))
    order = ids.join(after, "at").select("doc_id", "hash", F.floor(F.col("n") / 4).cast("int").alias("cut"), "next_id", "next_hash", "next_copies")
    made = fingerprinted(rows, "text", "kept")
    key = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    texts = made.hint("shuffle_merge")  # the same columns by the same key, twice: shuffled once

    def met_by(order: DataFrame) -> DataFrame:
        tails = texts.join(order.withColumnsRenamed({"doc_id": "of_id", "hash": "of_hash", "next_id": "_id", "next_hash": "_hash"}), key)
        return tails.select(F.col("of_id").alias("_id"), F.col("of_hash").alias("_hash"), "cut", F.left("text", F.col("cut")).alias("tail"), hashes(F.col("kept")).alias("next_hashes"))

    # a next document that is repeated comes once
    tails = met_by(order.filter("next_copies = 1")).unionByName(met_by(order.filter("next_copies > 1")).dropDuplicates(["_id", "_hash"]))
    met = texts.join(tails, key).drop("_id", "_hash", "hash")
    met = met.withColumns({"n_chars": F.length("text"), "start": F.left("text", F.length("text") - F.col("cut"))})
    met = met.withColumn("edited", F.concat("start", "tail")).drop("tail", "text", "cut")
    met = rewinnowed(met, "kept", F.col("start"), F.col("edited"), "edited_kept").drop("start")
    met = met.withColumn("own", hashes(F.col("kept")))
    return met.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", F.col("kept").alias("fingerprint"), F.col("edited_kept").alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_kept"))).alias("near_edited"), likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))


def digests(pairs: DataFrame) -> DataFrame:
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fingerprint")).alias("fingerprint"), shown(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
