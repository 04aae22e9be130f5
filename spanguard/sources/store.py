"""The conversation store: NDJSON import and export, and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running

CONVERSATION = "id string, started_at string, provider string, model string, client_hint string"
MESSAGE = "id string, conversation_id string, direction string, timestamp string, role string, content string, tokens_in bigint, tokens_out bigint, content_masked string, pii_processed boolean"
MAPPING = "original string, synthetic string, pii_type string, tier int, confidence float, token_id string, display_value string"
VAULT = f"type string, rng_seed decimal(20,0), mappings array<struct<{MAPPING.replace(' string', ': string').replace(' int', ': int').replace(' float', ': float')}>>"
DETECTION = "type string, message_id string, entity_type string, original_masked string, synthetic string, tier int, confidence float"


def read_ndjson(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """conversations, messages, vaults, detections of a folder of NDJSON files, each with file and line_no.

    A file holds one conversation or many. Each line is told apart by itself, so a large file is read in as many tasks
    as it has blocks, and nothing is shuffled but the headers: a conversation's header has no conversation_id, of
    several with one id the first counts; vaults and detections have their type, and a conversation_id, for lack of
    which that in the file's name `<time>_<id>.ndjson` counts. Blank and malformed lines are skipped. line_no, the block
    of the file and a number in it, orders a file's lines.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("line_no"),
        F.col("value").alias("line"),
    )
    vault, detection = F.col("line").contains('"type":"vault"'), F.col("line").contains('"type":"detection"')
    named = F.nullif(F.regexp_extract("file", r"_([^/_]+)\.ndjson$", 1), F.lit(""))

    def parsed(df: DataFrame, schema: str, need: list[str]) -> DataFrame:
        out = df.select("file", "line_no", F.from_json("line", schema).alias("r")).select("file", "line_no", "r.*")
        for c in need:
            out = out.where(F.col(c).isNotNull())
        return out

    def owned(df: DataFrame) -> DataFrame:
        return df.withColumn("conversation_id", F.coalesce("conversation_id", named))

    plain = lines.where(~vault & ~detection)
    heads = parsed(plain, CONVERSATION + ", conversation_id string", ["id", "started_at", "provider"]).where("conversation_id IS NULL").drop("conversation_id")
    first = heads.groupBy("id").agg(F.min_by(F.struct(*[c for c in heads.columns if c != "id"]), F.struct("file", "line_no")).alias("h"))
    return {
        "conversations": first.select(*[F.col("id") if c == "id" else F.col("h")[c].alias(c) for c in heads.columns]),
        "messages": parsed(plain, MESSAGE, ["id", "conversation_id", "direction", "timestamp", "content"]),
        "vaults": owned(parsed(lines.where(vault), VAULT + ", conversation_id string", ["rng_seed", "mappings"])),
        "detections": owned(parsed(lines.where(detection), DETECTION + ", conversation_id string", ["message_id", "entity_type"])),
    }


def recent(conversations: DataFrame, limit: int | None = None, most: int = 200, default: int = 50) -> DataFrame:
    """Newest conversations first; the limit is `default` if not given and `most` at most."""
    return conversations.orderBy(F.col("started_at").desc(), F.col("id")).limit(min(default if limit is None else limit, most))


def conversation_by_id(conversations: DataFrame, conversation: str) -> DataFrame:
    """The conversation of that id, or nothing."""
    return conversations.where(F.col("id") == conversation).limit(1)


def file_of(files: DataFrame, conversation: str, name: str = "file") -> DataFrame:
    """The file `<time>_<id>.ndjson` of a conversation; the first by name if there are several."""
    return files.where(F.col(name).endswith(f"_{conversation}.ndjson")).orderBy(name).limit(1)


def first_vaults(vaults: DataFrame) -> DataFrame:
    """The first vault line of each conversation, and a row for each of its mappings; those without one have none."""
    first = vaults.groupBy("conversation_id").agg(F.min_by(F.struct("rng_seed", "mappings"), F.struct("file", "line_no")).alias("v"))
    return first.select("conversation_id", F.col("v.rng_seed").alias("rng_seed"), F.explode("v.mappings").alias("m")).select("conversation_id", "rng_seed", "m.*")


def request_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, n_requests): messages sent in each conversation, also 0."""
    sent = messages.where("direction = 'request'").groupBy(F.col("conversation_id").alias("__c")).agg(F.count(F.lit(1)).alias("n_requests"))
    return conversations.join(sent, F.col("id") == F.col("__c"), "left").select("id", F.coalesce("n_requests", F.lit(0)).cast("long").alias("n_requests"))


def messages_of(messages: DataFrame, conversation: str | int) -> DataFrame:
    return messages.where(F.col("conversation_id") == conversation)


def detections_of(detections: DataFrame, messages: DataFrame, conversation, message: str | None = None) -> DataFrame:
    """Detections on messages of one conversation, or on one of them."""
    ids = messages.where((F.col("conversation_id") == conversation) & (F.lit(message).isNull() | (F.col("id") == F.lit(message)))).select(F.col("id").alias("__id"))
    return detections.join(ids, F.col("message_id") == F.col("__id"), "left_semi")


def by_fingerprint(conversations: DataFrame, provider: str, fingerprint: str, day: str) -> DataFrame:
    """The earliest conversation of that provider and first message on that day."""
    same = (F.col("provider") == provider) & (F.col("client_hint") == fingerprint) & (F.substring("started_at", 1, 10) == day)
    return conversations.where(same).orderBy("started_at", "id").limit(1)


def append_messages(messages: DataFrame, conversations: DataFrame, path: str) -> None:
    """Append the messages whose conversation is known."""
    known = conversations.select(F.col("id").alias("__c"))
    messages.join(known, F.col("conversation_id") == F.col("__c"), "left_semi").write.mode("append").parquet(path)


def write_conversations(conversations: DataFrame, path: str) -> None:
    conversations.withColumn("dt", F.substring("started_at", 1, 10)).write.mode("append").partitionBy("dt").parquet(path)


def append_detections(detections: DataFrame, path: str) -> None:
    detections.write.mode("append").parquet(path)


def save_vault(rows: DataFrame, path: str, version: int) -> None:
    """Append a version of vault rows; readers take the newest by operators.pseudonymize.latest."""
    rows.withColumn("version", F.lit(version)).write.mode("append").parquet(path)


def compact_vault(rows: DataFrame, path: str) -> None:
    """Write the newest version of each conversation's vault, one version in all, to a new path."""
    newest = rows.groupBy(F.col("conv_id").alias("__c")).agg(F.max("version").alias("__v"))
    rows.join(newest, (F.col("conv_id") == F.col("__c")) & (F.col("version") == F.col("__v")), "left_semi").write.parquet(path)


def write_ndjson(conversations: DataFrame, messages: DataFrame, vaults: DataFrame, detections: DataFrame, path: str) -> None:
    """Write NDJSON files of many conversations each: the conversation, its messages in order, its vault, its detections.

    vaults: conversation_id, rng_seed, mappings; detections: conversation_id and the fields of a detection. A task
    writes the conversations that it gets into one file, one after the other; lines of one, however many, are sorted
    on disk and never held together.
    """
    json = lambda columns, kind=None: F.to_json(F.struct(*([F.lit(kind).alias("type")] if kind else []), *columns))
    line = lambda df, key, rank, order, text: df.select(F.col(key).alias("conversation"), F.lit(rank).alias("rank"), order.cast("string").alias("at"), text.alias("value"))
    lines = line(conversations, "id", 0, F.lit(""), json(conversations.columns))
    lines = lines.unionByName(line(messages, "conversation_id", 1, F.col("timestamp"), json(messages.columns)))
    lines = lines.unionByName(line(vaults, "conversation_id", 2, F.lit(""), json(vaults.columns, "vault")))
    lines = lines.unionByName(line(detections, "conversation_id", 3, F.col("message_id"), json(detections.columns, "detection")))
    lines.repartition("conversation").sortWithinPartitions("conversation", "rank", "at").select("value").write.text(path)


def rotation_counts(conversations: DataFrame, today: Column, days: int = 0) -> DataFrame:
    """(kept, removed): how many conversations retain() keeps, and how many it drops."""
    keep = F.to_date(F.substring("started_at", 1, 10)) >= F.date_sub(today, days)
    return conversations.agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("removed"))


def retain(conversations: DataFrame, today: Column, days: int = 0) -> DataFrame:
    """Conversations of the last `days` days and today; 0 keeps today's only."""
    return conversations.where(F.to_date(F.substring("started_at", 1, 10)) >= F.date_sub(today, days))


def export(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, json): each conversation with its messages in order, also where it has none."""
    fields = [c for c in messages.columns if c != "conversation_id"]
    inner = messages.groupBy(F.col("conversation_id").alias("__c")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("messages"))
    joined = conversations.join(inner, F.col("id") == F.col("__c"), "left")
    none = F.array().cast(inner.schema["messages"].dataType)
    return joined.select("id", F.to_json(F.struct(F.struct(*conversations.columns).alias("conversation"), F.coalesce("messages", none).alias("messages"))).alias("json"))


def new_messages(requests: DataFrame, stored: DataFrame, order: str = "turn", conversation: str = "conv_id") -> DataFrame:
    """Messages of a resent history beyond those that are stored already, by their number."""
    have = stored.select(F.col(conversation).alias("__c"), F.col("n_stored"))
    numbered = running(requests, conversation, order, {"__n": F.lit(1)})
    out = numbered.join(have, F.col(conversation) == F.col("__c"), "left")
    return out.where(F.col("__n") > F.coalesce("n_stored", F.lit(0))).drop("__n", "__c", "n_stored")
