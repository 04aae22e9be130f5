"""Audit views: turns, summaries, comparison, search, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from . import terms
from .running import running


def turns(messages: DataFrame, order: str = "turn", conversation: str = "conv_id") -> DataFrame:
    """messages with turn_no from 0: a user's message begins a turn, system ones and those before any are left out."""
    said = running(messages.where(F.col("role") != "system"), conversation, order, {"__n": F.col("role") == "user"})
    out = said.where(F.col("__n") > 0)
    return out.withColumn("turn_no", (F.col("__n") - 1).cast("long")).withColumn("turn_label", F.concat(F.lit("T"), F.col("__n").cast("string"))).drop("__n")


def summary(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of spans by each of the columns, and totals over the last ones (rollup)."""
    return found.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def turn_detections(turn_rows: DataFrame, rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, turn_no, n): distinct vault values that occur in the texts of each turn's requests.

    Each text is read once, past an automaton of the conversation's values.
    """
    said = terms.occurring(turn_rows.where("role = 'user'"), rows, [conversation, "turn_no"], conversation=conversation)
    hits = said.select(conversation, "turn_no", F.explode("terms").alias("__t"))
    return hits.groupBy(conversation, "turn_no").agg(F.countDistinct("__t").alias("n"))


def detection_log(found: DataFrame, keys: list[str]) -> DataFrame:
    """Detections without the text that was found: keys, entity, start, end, confidence, tier."""
    return found.select(*keys, "entity", "start", "end", "confidence", "tier")


def by_position(original: DataFrame, masked: DataFrame, order: str = "turn", conversation: str = "conv_id") -> DataFrame:
    """(conversation, position, content, content_masked): the n-th message and the n-th masked one of a conversation."""
    numbered = lambda df: running(df.select(conversation, order, "text"), conversation, order, {"__n": F.lit(1)})
    left = numbered(original).select(conversation, (F.col("__n") - 1).alias("position"), F.col("text").alias("content"))
    right = numbered(masked).select(F.col(conversation).alias("__c"), (F.col("__n") - 1).alias("__p"), F.col("text").alias("content_masked"))
    return left.join(right, (F.col(conversation) == F.col("__c")) & (F.col("position") == F.col("__p")), "left").drop("__c", "__p")


def conversation_count(messages: DataFrame, conversation: str = "conv_id") -> DataFrame:
    return messages.agg(F.countDistinct(conversation).alias("n_conversations"))


def vault_view(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the vault shows: type, original, label, surrogate, tier, confidence; of rows with the same type, label and
    surrogate the first by ordinal."""
    view = F.struct("ordinal", "original", "tier", "confidence")
    first = rows.groupBy(conversation, "entity", "synthetic").agg(F.min(view).alias("f"))
    return first.select(conversation, F.col("entity").alias("pii_type"), "f.original", label(F.col("entity")).alias("masked"), "synthetic", "f.tier", "f.confidence", percent(F.col("f.confidence")).alias("percent"))


def label(entity: Column) -> Column:
    return F.concat(F.lit("["), F.upper(entity), F.lit("]"))


def percent(confidence: Column) -> Column:
    return F.floor(F.coalesce(confidence, F.lit(0.0)) * 100 + 0.5).cast("long")


def compare(messages: DataFrame) -> DataFrame:
    """Columns of the side-by-side view: sent text, what the model saw, whether that is a guess.

    Messages that were processed but have no masked text are approximated; unprocessed ones are shown as sent.
    """
    seen = F.coalesce(F.col("content_masked"), F.when(~F.coalesce("pii_processed", F.lit(True)), F.col("content")), F.col("approximate_mask"), F.col("content"))
    guess = F.col("content_masked").isNull() & F.coalesce("pii_processed", F.lit(True))
    return messages.select("*", F.col("content").alias("sent"), seen.alias("model_saw"), guess.alias("approximate"))


def naive_mask(text: Column, terms: Column, masks: Column) -> Column:
    """Replace the terms one after the other, longest first, ties by text (masks: map from term to mask)."""
    ranked = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.aggregate(ranked, text, lambda acc, r: F.replace(acc, r["t"], F.element_at(masks, r["t"])))


def highlight(text: Column, terms: Column, cls: str = "pii") -> Column:
    """HTML in which the terms, longest first and without overlaps, are marked."""
    found = spans.find_literals(text, terms, F.lit(cls))
    mark = lambda s: F.concat(F.lit(f'<mark class="{cls}">'), html_escape(s["text"]), F.lit("</mark>"))
    return spans.replace(text, found, mark, html_escape)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("…"))).otherwise(text)


def search(conversations: DataFrame, query: str) -> DataFrame:
    return conversations.where(F.lower(F.concat_ws(" ", F.coalesce("provider", F.lit("")), F.coalesce("model", F.lit("")), F.coalesce("started_at", F.lit("")))).contains(query.lower()))


def redact_headers(raw: Column) -> Column:
    """Values of authorization and x-api-key headers hidden, line by line, names in any case."""
    return F.regexp_replace(raw, r"(?im)^[ \t]*(authorization|x-api-key)[ \t]*:[^\r\n]*", "$1: [REDACTED]")


def hex_preview(data: Column, most: int) -> Column:
    """Lower-case hex of the first bytes, space-separated, and how many there are if some are left out."""
    pairs = F.regexp_replace(F.lower(F.hex(F.substring(data, 1, most))), "(..)(?=.)", "$1 ")
    return F.when(F.octet_length(data) > most, F.concat(pairs, F.lit("... ("), F.octet_length(data).cast("string"), F.lit(" bytes)"))).otherwise(pairs)


def query_limit(path: Column) -> Column:
    """The `limit` of a query string; null if it isn't a number."""
    found = F.regexp_extract(path, r"[?&]limit=([^&#]*)", 1)
    return F.when(found.rlike(r"^\d+$"), found.try_cast("long"))


def eviction_counts(conversations: DataFrame, now: Column, ttl: str, last: str = "last_used") -> DataFrame:
    """(evicted, kept): how many conversations idle() gives, and the rest."""
    gone = F.coalesce(F.col(last) <= now - F.expr(f"INTERVAL {ttl}"), F.lit(False))
    return conversations.agg(F.count_if(gone).alias("evicted"), F.count_if(~gone).alias("kept"))


def seconds_to_midnight(ts: Column) -> Column:
    """Seconds from a time to the next midnight of the session's time zone."""
    return (F.unix_timestamp(F.date_add(ts.cast("date"), 1).cast("timestamp")) - F.unix_timestamp(ts)).cast("long")


def idle(conversations: DataFrame, now: Column, ttl: str, last: str = "last_used") -> DataFrame:
    """Conversations not used for the whole of the time to live."""
    return conversations.where(F.col(last) <= now - F.expr(f"INTERVAL {ttl}"))
