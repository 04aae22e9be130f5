"""Bloom filters built and probed with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name

#: Bits of a filter for each key it is built from, and the most bits of any filter: 2**28 bits are
#: at most 2**22 words of 64 bits, which bounds what is broadcast. A filter that is built from more
#: keys than it has room for flags more rows than need be; nothing is lost by that.
BITS_PER_KEY, LEAST_BITS, MOST_BITS, PROBES = 16, 1 << 16, 1 << 28, 2


def size_for(keys: int) -> int:
    wanted = max(LEAST_BITS, BITS_PER_KEY * max(keys, 1))
    return min(MOST_BITS, 1 << math.ceil(math.log2(wanted)))


def _cells(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def build(df: DataFrame, key: str, bits: int, least: int = 1) -> DataFrame:
    """Words (word, bits) with the cells that at least `least` rows of df set.

    Cells are counted before they are shuffled, so a hot key is one row of each task.
    """
    cell = df.select(F.explode(F.array_distinct(F.array(*_cells(F.col(key), bits)))).alias("cell"))
    if least > 1:
        cell = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bit = F.expr("shiftleft(1L, CAST(cell & 63L AS INT))")
    return cell.select(F.shiftright("cell", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def flag(df: DataFrame, key: str, words: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a boolean column `name`, which it must not have yet: false means that the key is surely not in the filter.

    df's own columns may have any names.
    """
    every = [F.col(f"`{c}`") for c in df.columns]
    row, at, found = (own_name([key], c) for c in ("row", "at", "found"))
    out = df.select(F.struct(*every).alias(row), F.array(*_cells(F.col(f"`{key}`"), bits)).alias(at), F.lit(True).alias(found))
    for i in range(PROBES):
        side = words.select(F.col("word").alias("word"), F.col("bits").alias("bits"))
        cell = F.col(at)[i]
        out = out.join(F.broadcast(side), F.shiftright(cell, 6) == F.col("word"), "left")  # bounded by MOST_BITS
        hit = F.coalesce(F.expr(f"(bits & shiftleft(1L, CAST(`{at}`[{i}] & 63L AS INT))) != 0"), F.lit(False))
        out = out.select(row, at, (F.col(found) & hit).alias(found))
    return out.select(*[F.col(row)[c].alias(c) for c in df.columns], F.col(found).alias(name))
