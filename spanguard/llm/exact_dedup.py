"""Exact deduplication: two-pass Bloom filtering, in DataFrame functions only.

Pass one counts filter cells of all text digests and keeps the cells that two rows or more set. Pass two
probes every row: rows whose cells aren't all set have a text that occurs once and go straight through;
only the others are shuffled by digest, and settled exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import cut, table

#: Rows of a task that count together if they repeat id and text: two to this power at most.
SAME_BITS = 16
_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalized(text: Column) -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.unhex(F.sha2(normalized(F.col(f"`{text_col}`")), 256)).alias("sha"), F.length(text).alias("n"), F.col(f"`{id_col}`").alias("id")]


def _order() -> Column:
    """Smallest for the row that stays: most code points, then smallest id, null ids last."""
    return F.struct((-F.col("n")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"))


def _repeats(keys: DataFrame) -> tuple[DataFrame, int]:
    bits = bloom.size_for(keys.count())
    return cut(bloom.build(keys, "sha", bits, least=2)), bits


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalized texts the one with the most code points, then the smallest id (null ids
    last), stays; of rows that repeat its id and length, one. Null and empty texts are one group; an empty
    table gives no rows. Columns of docs other than these two aren't read, whatever their names.
    """
    keys = cut(docs.select(*_keys(docs, id_col, text_col)))
    words, bits = _repeats(keys)
    seen = bloom.flag(keys, "sha", words, bits, "maybe")
    once = seen.where(~F.col("maybe")).select("id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha")
    # Rows that repeat id, length and digest are counted before the shuffle, in runs of SAME at most, so that
    # no row is repeated more often than that by one task.
    run = F.shiftright(F.monotonically_increasing_id(), SAME_BITS)
    each = seen.where("maybe").withColumn("run", run).groupBy("sha", "n", "id", "run").agg(F.count(F.lit(1)).alias("c"), F.min("run").alias("first"))
    # Cut, so that the join reads both sides from shuffles of its own, whose hot parts can be split.
    each = cut(each)
    best = cut(each.groupBy(F.col("sha").alias("of")).agg(F.min(F.struct(_order().alias("o"), F.col("run").alias("r"))).alias("best"), F.sum("c").alias("size")))
    rows = each.join(best, F.col("sha") == F.col("of"))
    first = F.col("best") == F.struct(_order().alias("o"), F.col("run").alias("r"))
    rows = rows.select("id", F.col("best.o.c").alias("keep"), "size", first.alias("first"), "sha", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("i"))
    many = rows.select("id", "keep", "size", (F.coalesce("first", F.lit(False)) & (F.col("i") == 1)).alias("kept"), "sha")
    return once.unionByName(many).select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that decisions() drops, all columns kept, whatever their names.

    Null and empty texts are one group, rows that repeat id and text leave one, an empty table gives no rows.
    Texts that surely occur once aren't shuffled.
    """
    keys = cut(docs.select(*_keys(docs, id_col, text_col)))
    words, bits = _repeats(keys)
    flagged = bloom.flag(keys, "sha", words, bits, "maybe").where("maybe")
    best = flagged.groupBy("sha").agg(F.min(_order()).alias("best"))
    best = best.select(F.col("sha").alias("of"), F.col("best.a").alias("a"), F.col("best.c").alias("k"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(docs, id_col, text_col))
    rows = bloom.flag(packed, "sha", words, bits, "maybe")
    once = rows.where(~F.col("maybe"))
    # Repeated rows fall together before the shuffle; a group of copies is dealt by digest, length and id.
    some = rows.where("maybe").dropDuplicates(["sha", "n", "id"])
    many = some.join(best, (F.col("sha") == F.col("of")) & (-F.col("n") == F.col("a")) & F.col("id").eqNullSafe(F.col("k")), "left_semi")
    return once.select("row.*").unionByName(many.select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r
"""
