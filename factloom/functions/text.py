"""Clipping, excerpts and readable lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(c: Column, most: int) -> Column:
    """At most `most` code points, with an ellipsis where something was cut."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def excerpt(c: Column, needle: Column | str, around: int = 60) -> Column:
    """The first hit of needle (any case) with `around` characters on both sides; null
    without a hit."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    at = F.position(F.lower(needle), F.lower(c))
    start = F.greatest(at - around, F.lit(1))
    length = at - start + F.char_length(needle) + around
    return F.when(at > 0, c.substr(start, length))


def readable_line(name: Column, properties: Column, own: tuple[str, ...] = (), most: int = 50) -> Column:
    """`name · k: v · …` of a map's entries in key order, own keys left out."""
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: ~k.isin(*own) if own else F.lit(True))))
    parts = F.transform(F.slice(entries, 1, most), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.concat_ws(" · ", name, F.array_join(parts, " · "))
