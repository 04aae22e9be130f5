"""Vault and rewriting: ordinals of values, surrogates, tokens, masked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans, tokens
from ..functions.synth import surrogate
from ..session import cut
from ..sources import chat, splice
from . import detect

KEY = ["conv_id"]


def vault(found: DataFrame, order: list[str], conversation: str = "conv_id") -> DataFrame:
    """One row per conversation and distinct value: ordinal by first occurrence, surrogate, token id, display value.

    found: conversation, the columns of order, entity, text, tier, confidence. First occurrences are found by an
    aggregation that combines before the shuffle; only distinct values are then ranked.
    """
    at = F.struct(*order)
    best = F.min(F.struct(at.alias("at"), F.col("entity"), F.col("tier"), F.col("confidence"))).alias("b")
    first = found.groupBy(conversation, F.col("text").alias("original")).agg(best)
    ranked = first.withColumn("ordinal", (F.row_number().over(Window.partitionBy(conversation).orderBy("b.at", "original")) - 1).cast("long"))
    rows = ranked.select(conversation, "original", "ordinal", F.col("b.entity").alias("entity"), F.col("b.tier").alias("tier"), F.col("b.confidence").alias("confidence"))
    out = rows.withColumn("synthetic", surrogate(conversation, "ordinal", "entity", "original"))
    return out.withColumn("token_id", tokens.token_id(F.col(conversation), F.col("ordinal"))).withColumn("display_value", F.col("synthetic"))


def not_synthetic(found: DataFrame, known: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Spans whose text isn't a surrogate that the conversation's vault has given out already."""
    given = known.select(F.col(conversation).alias("__c"), F.col("synthetic").alias("__s"))
    return found.join(given, (F.col(conversation) == F.col("__c")) & (F.col("text") == F.col("__s")), "left_anti")


def insert_absent(known: DataFrame, new: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """known, and the rows of new whose original the conversation doesn't have yet."""
    have = known.select(F.col(conversation).alias("__c"), F.col("original").alias("__o"))
    more = new.join(have, (F.col(conversation) == F.col("__c")) & (F.col("original") == F.col("__o")), "left_anti")
    return known.unionByName(more)


def merge_vaults(into: DataFrame, other: DataFrame, other_to: Column, conversation: str = "conv_id") -> DataFrame:
    """Vault rows of `into`, and those of `other`, moved to the conversation other_to, that it has no original of."""
    return insert_absent(into, other.withColumn(conversation, other_to), conversation)


def latest(versions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of the newest version of each key."""
    newest = versions.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(version).alias("__v"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return versions.join(newest, on & (F.col(version) == F.col("__v")), "left_semi")


def rewrite(messages: DataFrame, rows: DataFrame, message: list[str], form: str = "bare", text: str = "text", conversation: str = "conv_id") -> DataFrame:
    """messages (with spans) with `masked`: each span replaced by its vault row's surrogate or token.

    form: `bare` surrogate, `xml` token markup, or `label` ([TYPE], no vault needed). Spans that have no vault row
    (surrogates that were given out before) stay as they are. Replacements are found among narrow rows and come
    back as a small array by the message's key; that join is the one shuffle of texts. Messages that were
    detected once should be cut before, since the vault and the texts are both made from them.
    """
    if form == "label":
        return messages.withColumn("masked", spans.replace(F.col(text), F.col("spans"), lambda s: F.concat(F.lit("["), F.upper(s["entity"]), F.lit("]"))))
    return rewrite_forms(messages, rows, message, {"masked": form}, text, conversation)


def rewrite_forms(messages: DataFrame, rows: DataFrame, message: list[str], forms: dict[str, str], text: str = "text", conversation: str = "conv_id") -> DataFrame:
    """messages with a column for each of forms (`bare` or `xml`), as rewrite() gives it, in the same one shuffle of texts."""
    values = {"bare": F.col("synthetic"), "xml": tokens.markup(F.col("token_id"), F.col("display_value"))}
    found = detect.explode(messages, message).select(*message, F.col("text").alias("__original"))
    made = rows.select(F.col(conversation).alias("__c"), F.col("original").alias("__o"), F.struct(*[values[f].alias(c) for c, f in forms.items()]).alias("__v"))
    joined = found.join(made, (F.col(conversation) == F.col("__c")) & (F.col("__original") == F.col("__o")))
    pairs = joined.groupBy(*message).agg(F.collect_set(F.struct("__original", "__v")).alias("__pairs"))  # the spans of one message
    out = messages.join(pairs, message, "left").withColumn("__lookup", F.map_from_entries("__pairs"))
    for c in forms:
        known = lambda s, c=c: F.coalesce(F.try_element_at(F.col("__lookup"), s["text"])[c], s["text"])
        out = out.withColumn(c, F.when(F.col("__pairs").isNull(), F.col(text)).otherwise(spans.replace(F.col(text), F.col("spans"), known)))
    return out.drop("__pairs", "__lookup")


def rewrite_bodies(requests: DataFrame, key: list[str], form: str = "xml", body: str = "body", field: str = "messages", conversation: str = "conv_id", locale_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with `rewritten`, vault): personal data in the texts of chat bodies replaced, and written back.

    Bodies without texts, or that aren't JSON, stay as they are, and so does every character outside the changed texts.
    """
    entries = requests.select(*key, *([locale_col] if locale_col else []), F.explode(chat.entries(F.col(body), field)).alias("__e"))
    texts = entries.select("*", F.col("__e.msg_idx").alias("msg_idx"), F.coalesce("__e.part_idx", F.lit(-1)).alias("part_idx"), F.col("__e.text").alias("text")).drop("__e")
    rows = cut(detect.detect(texts, locale_col=locale_col).where(F.size("spans") > 0))
    one = [*key, "msg_idx", "part_idx"]
    order = [k for k in key if k != conversation]
    known = cut(vault(detect.explode(rows, one), [*order, "msg_idx", "part_idx", "start"], conversation))
    masked = rewrite(rows, known, one, form, conversation=conversation)
    path = F.when(F.col("part_idx") < 0, F.col("msg_idx").cast("string")).otherwise(F.concat_ws("/", F.col("msg_idx").cast("string"), F.col("part_idx").cast("string")))
    put = masked.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(path, "masked"))).alias("__put"))  # the texts of one request
    out = requests.join(put, key, "left")
    return out.withColumn("rewritten", F.when(F.col("__put").isNull(), F.col(body)).otherwise(splice.with_texts(F.col(body), F.col("__put"), field))).drop("__put"), known


def stage_one(text: Column, replacements: Column, conversation: Column, base: Column) -> Column:
    """struct(text, zones, entries): a model's replacements put in as tokens, before other tiers look at the text.

    replacements: (start, end, display_value, pii_type). Their tokens are numbered from `base` in text order; zones
    are the places of the tokens in the new text, which later tiers leave alone; entries are vault rows.
    """
    valid = F.filter(replacements, lambda r: (r["start"] <= r["end"]) & (r["start"] >= 0) & (r["end"] <= F.length(text)))
    as_spans = F.transform(valid, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"), r["pii_type"].alias("entity"), F.lit(1.0).alias("confidence"), F.lit(3).alias("tier"), r["display_value"].alias("text")))
    # The token of each goes where its text was; its original and place are found from the text.
    numbered = F.transform(spans.first_wins(F.array_sort(as_spans)), lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["entity"].alias("entity"), s["confidence"].alias("confidence"), s["tier"].alias("tier"), tokens.markup(tokens.token_id(conversation, base + i), s["text"]).alias("text")))

    def place(acc: Column, s: Column) -> Column:
        begin = s["start"] + acc["moved"]
        zone = F.struct(begin.alias("start"), (begin + F.length(s["text"])).alias("end"))
        return F.struct((acc["moved"] + F.length(s["text"]) - (s["end"] - s["start"])).alias("moved"), F.concat(acc["zones"], F.array(zone)).alias("zones"))

    none = F.struct(F.lit(0).alias("moved"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("zones"))
    zones = F.aggregate(numbered, none, place, lambda acc: acc["zones"])
    entries = F.transform(numbered, lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("original"), tokens.inner(s["text"]).alias("display_value"), tokens.attribute_id(s["text"]).alias("token_id"), s["entity"].alias("entity")))
    return F.struct(spans.replace(text, numbered, lambda s: s["text"]).alias("text"), zones.alias("zones"), entries.alias("entries"))


def records(rows: DataFrame) -> DataFrame:
    """Vault rows as they are stored and read again: a blank display value is the surrogate."""
    return rows.withColumn("display_value", F.when(F.trim(F.coalesce("display_value", F.lit(""))) == "", F.col("synthetic")).otherwise(F.col("display_value")))


def vault_stats(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, n_mappings, longest_bytes, n_prefixes): different originals, bytes of the longest surrogate, and
    different first two bytes of surrogates, those shorter than that left out."""
    raw = F.col("synthetic").cast("binary")
    return rows.groupBy(conversation).agg(
        F.countDistinct("original").alias("n_mappings"),
        F.max(F.octet_length("synthetic")).cast("long").alias("longest_bytes"),
        F.countDistinct(F.when(F.octet_length(raw) >= 2, F.substring(raw, 1, 2))).alias("n_prefixes"),
    )


def apply_replacements(text: Column, replacements: Column) -> Column:
    """Apply a model's (start, end, display_value, pii_type) to the text they were made for.

    Ranges that are empty the wrong way round or past the end are skipped, overlaps go to the first.
    """
    valid = F.filter(replacements, lambda r: (r["start"] <= r["end"]) & (r["start"] >= 0) & (r["end"] <= F.length(text)))
    as_spans = F.transform(valid, lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"), r["pii_type"].alias("entity"), F.lit(1.0).alias("confidence"), F.lit(3).alias("tier"), r["display_value"].alias("text")))
    return spans.replace(text, spans.first_wins(F.array_sort(as_spans)), lambda s: s["text"])
