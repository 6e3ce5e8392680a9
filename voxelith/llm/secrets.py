"""Secret scans with Spark expressions only.

Base kinds are three patterns.  The method adds kind ``entropy``: over candidate
strings of each character class (hexadecimal, base64) a window slides, its character
counts and the sum of n*log2(n) are updated by the character that enters and the one
that leaves, and where the Shannon entropy reaches the class's threshold the candidate
is reported from its first such window to the end of its last.  Strings that match the
allow-list are not reported as ``entropy``; base kinds always stay.

Spans are code points, end exclusive.  Null text: empty, no spans.  Repeated rows give
equal rows.  Other columns are not read.  Empty table: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds.  In the last two a match is a maximal run, so the
#: least length can stand in the pattern; in the first a failing match uses up its text.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
PLACE = "[secret]"


@dataclass(frozen=True)
class CharacterClass:
    """Candidates match ``pattern``; all their characters lie in code points 43 to 122."""

    pattern: str
    window: int
    bits: float


CLASSES = (
    CharacterClass(r"(?<![A-Za-z0-9+/_=-])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_=-])", 24, 3.0),
    CharacterClass(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 20, 3.8),
)
#: Text that marks examples and other strings that are no secrets.  Slashes mark a place only
#: where they begin the string, and words only a string of at most 128 characters: in keys and
#: in long blobs they come about by chance.
ALLOW = r"(?i)^//|^(?=.{1,128}$).*?(?:example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|abcdefgh)|^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{0,6}$|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"

_LOW, _SIZE, _BLOCK = 43, 80, 64


def _spans(found: Column, between: Column, kind: str, keep) -> Column:
    """array<struct<start, order, kind, end>> of the matches that ``keep`` accepts.

    Places come from the lengths of what lies between matches, summed in blocks so that
    a text with very many matches costs no square of them.
    """
    steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    ends = F.aggregate(
        blocks,
        F.array(F.lit(0)),
        lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + x["n"])),
    )
    one = "array<struct<start:int,ord:int,kind:string,end:int,match:string>>"

    def places(b: Column, k: Column) -> Column:
        start = F.struct(F.get(ends, k).alias("at"), F.array().cast(one).alias("out"))
        return F.aggregate(b, start, lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.array_append(acc["out"], F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"),
                (acc["at"] + x["gap"] + x["n"]).alias("end"), x["m"].alias("match"))).cast(one).alias("out")), lambda acc: acc["out"])

    spans = F.filter(F.flatten(F.transform(blocks, places)), keep)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(one))


def window_entropy(chars: Column, window: int, bits: float) -> Column:
    """struct<first, last>: start of the first and end of the last window at ``bits`` or more; -1 if none."""

    def f(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    state = F.struct(
        F.array_repeat(F.lit(0), _SIZE).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )
    steps = F.transform(chars, lambda c, i: F.struct(
        (F.ascii(c) - _LOW).alias("in"), F.when(i >= window, F.ascii(F.get(chars, i - window)) - _LOW).otherwise(F.lit(-1)).alias("out"), i.cast("int").alias("i")))

    def step(acc: Column, x: Column) -> Column:
        into, out_of = F.get(acc["counts"], x["in"]), F.coalesce(F.get(acc["counts"], x["out"]), F.lit(0))
        same = x["in"] == x["out"]
        total = F.when(same, acc["sum"]).otherwise(acc["sum"] + f(into + 1) - f(into) + F.when(x["out"] >= 0, f(out_of - 1) - f(out_of)).otherwise(F.lit(0.0)))
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda n, k: n + F.when(k == x["in"], 1).otherwise(0) - F.when(k == x["out"], 1).otherwise(0))
        )
        hit = (x["i"] >= window - 1) & (math.log2(window) - total / window >= bits)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(hit & (acc["first"] < 0), x["i"] - (window - 1)).otherwise(acc["first"]).alias("first"),
            F.when(hit, x["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _scored(c: CharacterClass):
    return lambda x: F.struct(x.alias("x"), window_entropy(F.split(x["match"], ""), c.window, c.bits).alias("e"))


def scan(docs: DataFrame, classes=CLASSES, allow: str = ALLOW) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, ord, kind, end>>, by start, then kind."""

    def always(x: Column) -> Column:
        return F.lit(True)

    asked = [
        ("assign", ASSIGN, lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= ASSIGN_LEAST),
        ("access", ACCESS, always),
        ("hex", HEX, always),
        *(("entropy", c.pattern, lambda x: ~x["match"].rlike(allow)) for c in classes),
    ]
    n, text = range(len(asked)), F.col("text")
    # matches and what lies between them are columns of their own, so each pattern runs once
    # over a text, and once more over the few texts where it matches
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "spans")).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.select("row", "text", *(F.regexp_extract_all("text", F.lit(asked[k][1]), F.lit(0)).alias(f"found{k}") for k in n))
    rows = rows.select("row", *(f"found{k}" for k in n), *(F.when(F.size(f"found{k}") > 0, F.split(text, asked[k][1], -1)).alias(f"between{k}") for k in n))
    rows = rows.select("row", *(_spans(F.col(f"found{k}"), F.col(f"between{k}"), asked[k][0], asked[k][2]).alias(f"spans{k}") for k in n))

    def plain(k: int) -> Column:
        return F.transform(f"spans{k}", lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["end"].alias("end")))

    def dense(k: int, c: CharacterClass) -> Column:
        return F.transform(F.filter(F.transform(f"spans{k}", _scored(c)), lambda s: s["e"]["first"] >= 0), lambda s: F.struct(
            (s["x"]["start"] + s["e"]["first"]).alias("start"), s["x"]["ord"].alias("ord"), s["x"]["kind"].alias("kind"), (s["x"]["start"] + s["e"]["last"]).alias("end")))

    spans = [plain(k) if k < 3 else dense(k, classes[k - 3]) for k in n]
    return rows.select("row.*", F.array_sort(F.array_distinct(F.concat(*spans))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return scanned.select(
        F.col("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def redact(scanned: DataFrame) -> DataFrame:
    """``text`` with every span replaced by ``[secret]``; touching spans are one."""
    kind = "array<struct<start:int,end:int>>"

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(kind)
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))).cast(kind)
        return F.when(F.size(acc) == 0, one).when(F.try_element_at(acc, F.lit(-1))["end"] >= s["start"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), longer)).otherwise(F.concat(acc, one))

    spans = F.aggregate("spans", F.array().cast(kind), merge)
    text = F.col("text")
    out = scanned.withColumn("merged", spans)
    before = F.transform("merged", lambda s, i: F.concat(
        F.substr(text, F.coalesce(F.get(F.col("merged"), i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(F.col("merged"), i - 1)["end"], F.lit(0))), F.lit(PLACE)))
    clean = F.concat(F.array_join(before, ""), F.substr(text, F.element_at("merged", -1)["end"] + 1))
    return out.withColumn("text", F.when(F.size("merged") > 0, clean).otherwise(text)).drop("merged", "spans")
