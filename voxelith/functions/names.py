"""Names of layers and exported files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """File name without folder and extension; ``.nii.gz`` counts as one extension."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.when(F.lower(name).endswith(".nii.gz"), F.regexp_replace(name, r"(?i)\.nii\.gz$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def sanitized(name: Column) -> Column:
    """Every character but letters, digits, ``_``, ``-`` and ``.`` becomes ``_``; empty: ``untitled``."""
    out = F.regexp_replace(F.trim(name), r"[^A-Za-z0-9_.-]+", "_")
    return F.when(F.length(out) == 0, F.lit("untitled")).otherwise(out)


def first_filled(*names: Column) -> Column:
    return F.coalesce(*(F.when(F.length(F.trim(n)) > 0, n) for n in names))


def numbered(name: Column, before: Column) -> Column:
    """``name``, or ``name (n)`` where ``before`` = n layers of that name exist."""
    return F.when(before > 0, F.concat(name, F.lit(" ("), before.cast("string"), F.lit(")"))).otherwise(name)
