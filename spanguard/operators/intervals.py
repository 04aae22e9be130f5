"""Joins of span tables by overlap: spans meet in bins of their text, so no text is compared as a whole.

A span stands in each bin that it reaches into. Two spans that overlap share the bin in which the later one begins, and
are compared there only. A long text is many bins, which are dealt over tasks like any other keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin.
WIDTH = 256


def _binned(spans: DataFrame, key: str, side: str, width: int) -> DataFrame:
    """(key, bin, start, end, row) under names of the side; empty and reversed spans overlap nothing."""
    bins = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    rows = spans.where("end > start").select(F.col(key).alias(f"{side}key"), F.col("start").alias(f"{side}start"), F.col("end").alias(f"{side}end"), F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias(f"{side}row"), bins.alias("b"))
    return rows.select(f"{side}key", f"{side}start", f"{side}end", f"{side}row", F.explode("b").alias(f"{side}bin"))


def _meet(width: int) -> Column:
    """Whether two binned spans of a text overlap, and this is the bin in which the later one begins."""
    same = (F.col("lkey") == F.col("rkey")) & (F.col("lbin") == F.col("rbin"))
    return same & (F.col("lstart") < F.col("rend")) & (F.col("rstart") < F.col("lend")) & (F.floor(F.greatest("lstart", "rstart") / width) == F.col("lbin"))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """(left, right): the rows, as structs, of each pair of spans (key, start, end, ...) of one text that overlap.

    Half-open spans; those without characters, or with a null key, meet none. Rows that repeat are each paired.
    """
    pairs = _binned(left, key, "l", width).join(_binned(right, key, "r", width), _meet(width))
    return pairs.select(F.col("lrow").alias("left"), F.col("rrow").alias("right"))


def outside(spans: DataFrame, zones: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """The spans that overlap none of the zones (key, start, end) of their text; all columns stay, repeated rows too."""
    hit = _binned(spans.select(key, "start", "end").distinct(), key, "l", width).join(_binned(zones.select(key, "start", "end"), key, "r", width), _meet(width), "left_semi")
    gone = hit.select(F.col("lkey").alias("__k"), F.col("lstart").alias("__s"), F.col("lend").alias("__e"))
    return spans.join(gone, (F.col(key) == F.col("__k")) & (F.col("start") == F.col("__s")) & (F.col("end") == F.col("__e")), "left_anti")
