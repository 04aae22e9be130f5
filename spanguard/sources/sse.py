"""Server-sent events: complete bodies into events, events into text, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chat

#: Characters after which a response's text is no longer gathered.
MOST_TEXT = 10 * 1024 * 1024
EVENTS = "array<struct<event_type:string,data:string>>"


def blocks(body: Column) -> Column:
    """Complete event blocks of a body; what follows the last blank line is still open and left out."""
    parts = F.split(body, r"\r\n\r\n|\n\n", -1)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def events(body: Column) -> Column:
    """array of (event_type, data); data lines are trimmed and joined, blocks without data dropped."""

    def of(block: Column) -> Column:
        lines = F.split(block, r"\r?\n", -1)
        named = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.trim(F.substring(x, 7, 1 << 30)))
        data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
        return F.struct(F.when(F.size(named) > 0, F.element_at(named, -1)).alias("event_type"), F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"))

    return F.filter(F.transform(blocks(body), of), lambda e: e["data"].isNotNull()).cast(EVENTS)


def rows(streams: DataFrame, body: str = "body") -> DataFrame:
    """A row for each event: the other columns, seq, event_type, data."""
    keep = [c for c in streams.columns if c != body]
    return streams.select(*keep, F.posexplode(events(F.col(body))).alias("seq", "__e")).select(*keep, "seq", "__e.*")


def assemble(parts: DataFrame, keys: list[str], most: int = MOST_TEXT) -> DataFrame:
    """(keys, text, tokens_in, tokens_out) of each response, from rows with provider, seq, event_type, data.

    Events after the first end mark don't count. Text is gathered in order until it is over `most` characters;
    token counts are the last ones reported.
    """
    by = Window.partitionBy(*keys)
    end = F.min(F.when(chat.done(F.col("event_type"), F.col("data")), F.col("seq"))).over(by)
    e = parts.withColumn("__end", end).where(F.col("__end").isNull() | (F.col("seq") < F.col("__end")))
    e = e.withColumn("__d", chat.delta(F.col("provider"), F.col("event_type"), F.col("data"))).withColumn("__u", chat.usage(F.col("provider"), F.col("event_type"), F.col("data")))
    before = F.coalesce(F.sum(F.length("__d")).over(by.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = e.withColumn("__d", F.when(before <= most, F.col("__d")))
    ordered = F.array_sort(F.collect_list(F.when(F.col("__d").isNotNull(), F.struct("seq", F.col("__d").alias("d")))))
    return e.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["d"]), "").alias("text"),
        F.max_by(F.col("__u.tokens_in"), F.when(F.col("__u.tokens_in").isNotNull(), F.col("seq"))).alias("tokens_in"),
        F.max_by(F.col("__u.tokens_out"), F.when(F.col("__u.tokens_out").isNotNull(), F.col("seq"))).alias("tokens_out"),
    )


def serialize(event_type: Column, data: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("event: "), event_type, F.lit("\n")), F.lit("")), F.lit("data: "), data, F.lit("\n\n"))


def trailing(name: Column, text: Column) -> Column:
    """The event that carries text left over at the end; null for providers that have none, and for no text."""
    anthropic = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta")))
    openai = F.to_json(F.struct(F.lit("trailing").alias("id"), F.lit("chat.completion.chunk").alias("object"), F.array(F.struct(F.struct(text.alias("content")).alias("delta"), F.lit(0).alias("index"), F.lit(None).cast("string").alias("finish_reason"))).alias("choices")), {"ignoreNullFields": "false"})
    return F.when(F.length(text) > 0, F.when(name == "anthropic", serialize(F.lit("content_block_delta"), anthropic)).when(name == "openai", serialize(F.lit("content_block_delta"), openai)))
