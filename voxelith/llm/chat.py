"""Chat formatting with Spark expressions only.

Template of a conversation: adjacent turns of one role share a block

    ### role: text</turn>text</turn>

and blocks are separated by a newline.  Inside roles and texts a backslash, ``<``,
``#`` (and, in roles, ``:``) are written as backslash pairs, so a control string never
occurs in them and the escape can be undone.  The loss mask has an entry for each
``</turn>``-terminated piece of the output: how many code points to skip, then how
many to keep (only texts of the assistant are kept).

Rows are ordered by turn; ties by role, then text; a null turn comes first.  Null text
or role: empty.  Repeated rows are turns of their own.  A null conv_id is a conversation
of its own.  Other columns are not read.  Empty table: no rows.

Long conversations are collected in chunks of ``CHUNK`` consecutive turn numbers, and
their formatted chunks are then joined, so that sorting never meets a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
END = "</turn>"
#: Fixed escape pairs, in the order of writing (reading goes backwards).
PAIRS = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))


def escape(c: Column, role: bool = False) -> Column:
    for plain, pair in PAIRS if role else PAIRS[:3]:
        c = F.replace(c, F.lit(plain), F.lit(pair))
    return c


def unescape(c: Column) -> Column:
    for plain, pair in reversed(PAIRS):
        c = F.replace(c, F.lit(pair), F.lit(plain))
    return c


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<skip int, keep int>>."""
    turns = rows.select(
        rows["conv_id"],
        F.coalesce(F.floor(rows["turn"] / CHUNK), F.lit(-(1 << 62))).alias("chunk"),
        F.struct(
            rows["turn"].alias("turn"),
            F.coalesce(rows["role"], F.lit("")).alias("role"),
            F.coalesce(rows["text"], F.lit("")).alias("text"),
        ).alias("t"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # where a turn's role differs from the one before, a block starts
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    chunks = chunks.withColumn("starts", starts)
    blocks = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s, F.coalesce(F.try_element_at("starts", (k + 2).cast("int")), F.size("turns") + 1) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    chunks = chunks.select("conv_id", F.struct("chunk", blocks.alias("blocks")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))

    # a chunk's first block goes on with the block before if that has the same role
    def last_role(i: Column) -> Column:
        return F.element_at(F.element_at(F.col("c"), i)["blocks"], -1)["role"]

    def header(c: Column, i: Column, b: Column, j: Column) -> Column:
        goes_on = (j == 0) & (i > 0) & (last_role(F.greatest(i, F.lit(1))) == b["role"])
        newline = F.when((i == 0) & (j == 0), F.lit("")).otherwise(F.lit("\n"))
        return F.when(goes_on, F.lit("")).otherwise(F.concat(newline, F.lit("### "), escape(b["role"], True), F.lit(": ")))

    text = F.array_join(
        F.transform("c", lambda c, i: F.array_join(
            F.transform(c["blocks"], lambda b, j: F.concat(header(c, i, b, j), F.array_join(F.transform(b["texts"], lambda t: F.concat(t, F.lit(END))), ""))), "")), "")
    mask = F.flatten(F.transform("c", lambda c, i: F.flatten(
        F.transform(c["blocks"], lambda b, j: F.transform(b["texts"], lambda t, k: F.struct(
            F.when(k == 0, F.length(header(c, i, b, j))).otherwise(F.lit(0)).alias("skip"),
            F.when(b["role"] == "assistant", F.length(t)).otherwise(F.lit(0)).alias("keep")))))))
    return whole.select("conv_id", text.alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted, "### "), 2, 1 << 30)
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.slice(F.split(F.substr(b, F.instr(b, ": ") + 2), END), F.lit(1), F.size(F.split(b, END)) - 1),
        lambda t: F.struct(unescape(F.substring_index(b, ": ", 1)).alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """array<string>: the unescaped texts that the loss mask keeps."""
    pieces = F.zip_with(F.split(formatted, END), mask, lambda p, m: F.when(m["keep"] > 0, unescape(F.substr(p, m["skip"] + 1, m["keep"]))).otherwise(F.lit("")))
    return F.filter(F.coalesce(pieces, F.array()), lambda s: s.isNotNull())


def digests(formatted: DataFrame) -> DataFrame:
    """What the format preserves, read back from its output."""
    out = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": F.array_join(read_loss(F.col("formatted"), F.col("loss_mask")), "")})
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
