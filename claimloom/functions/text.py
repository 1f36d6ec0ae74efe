"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(text: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, longest: int = 80) -> Column:
    """Lower case, anything but letters and digits as _, none outside."""
    return F.left(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(longest))


def source_span(text: Column, needles: list[str], width: int = 360) -> Column:
    """The text around the first needle that occurs, in the order given, whatever its case; else its beginning. Compacted."""
    low = F.lower(text)
    places = [F.nullif(F.locate(n.lower(), low), F.lit(0)) - 1 for n in needles]
    at = F.coalesce(*places, F.lit(-1))
    start = F.greatest(at - width // 3, F.lit(0))
    around = F.substring(text, start + 1, at + width - start)
    return compact(F.when(at >= 0, around).otherwise(F.left(text, F.lit(width))))
