"""Restoring originals in complete texts, by a cascade of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, tokens
from . import terms


def maps(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, token_id_map, display_value_map, synthetic_map), in one shuffle of the vault's rows.

    Of originals that share a key, the smallest counts.
    """
    keys = ("token_id", "display_value", "synthetic")
    pair = lambda key: F.when(F.coalesce(F.col(key), F.lit("")) != "", F.struct(F.col(key).alias("k"), F.col("original").alias("v")))
    lists = rows.groupBy(conversation).agg(*[F.array_sort(F.collect_set(pair(k))).alias(k) for k in keys])
    # A projection of its own for the sorted arrays, which the filter looks into at each place.
    first = lambda key: F.filter(key, lambda x, i: (i == 0) | (F.col(key)[F.greatest(i - 1, F.lit(0))]["k"] != x["k"]))
    return lists.select(conversation, *[F.map_from_entries(first(k)).alias(f"{k}_map") for k in keys])


def level(token: Column, by_id: Column, by_display: Column) -> Column:
    """Which lookup restores a token: 1 the whole token, 2 its id only, 3 its display value, 4 none.

    A token without an id isn't looked up at all.
    """
    tid, shown = tokens.attribute_id(token), tokens.inner(token)
    via_id, via_display = F.try_element_at(by_id, tid), F.try_element_at(by_display, shown)
    return F.when(tid == "", 4).when(via_id.isNotNull() & (via_id == via_display), 1).when(via_id.isNotNull(), 2).when(via_display.isNotNull(), 3).otherwise(4)


def _token(token: Column, by_id: Column, by_display: Column) -> Column:
    tid = tokens.attribute_id(token)
    known = F.coalesce(F.try_element_at(by_id, tid), F.try_element_at(by_display, tokens.inner(token)))
    return F.coalesce(F.when(tid != "", known), token)


def restore(text: Column, by_id: Column, by_display: Column, by_synthetic: Column) -> Column:
    """Tokens by id, then display value, else unchanged; text between tokens by surrogate, leftmost and longest."""
    pattern = "(?s)" + tokens.TOKEN
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    plain = lambda x: spans.replace_literals(x, by_synthetic)
    pieces = F.zip_with(gaps, hits, lambda g, h: F.concat(plain(g), F.coalesce(_token(h, by_id, by_display), F.lit(""))))
    return F.when(text.contains("<pii"), F.array_join(pieces, "")).otherwise(plain(text))


def restore_messages(messages: DataFrame, rows: DataFrame, text: str = "masked", conversation: str = "conv_id") -> DataFrame:
    """messages with `restored`; null texts stay null, conversations without a vault keep their text.

    One shuffle of texts and vault rows by conversation; each conversation's lookups are built once for a task.
    """
    out = terms.restored(messages, rows, messages.columns, text, conversation)
    return out.withColumn("restored", F.when(F.col(text).isNotNull(), F.col("restored")))
