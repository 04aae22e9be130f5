"""More registered queries, with their oracle SQL: the store, model tiers, bodies, streams, and format checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans, synth, tokens
from ..functions.synth import surrogate
from ..operators import audit, detect, intervals, pseudonymize, restore, terms
from ..session import cut, dealt, remove_at_exit, shared_dir, table, tasks
from ..sources import chat, config, splice, sse, store
from ..streaming import windows
from . import oracle
from . import queries as q
from .fixtures import candidates_sql

#: Rows of a task that makes or counts surrogates.
SURROGATES = 1 << 18

#: The formats of surrogates, as regular expressions that both engines know, and how long a value has to be.
FORMATS = {
    "EMAIL": r"^[a-z]+[.][a-z]+[0-9]+@example[.]com$",
    "PHONE": r"^([+][0-9]{1,3} )?555-[0-9]{4}-[0-9]{4}$",
    "SSN": r"^[1-6][0-9]{2}-(0[1-9]|[1-9][0-9])-[0-9]{4}$",
    "CREDIT_CARD": r"^[0-9]{16}$",
    "IP_V4": r"^10[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$",
    "IP_V6": r"^fd[0-9a-f]{4}:[0-9a-f]{4}::1$",
    "OPENAI_API_KEY": r"^sk-[0-9a-zA-Z]{32,}$",
    "AWS_ACCESS_KEY": r"^AKIAIOSFODNN7[0-9A-Z]{12}$",
    "AWS_SECRET_KEY": r"^[0-9a-zA-Z]{40}$",
    "GITHUB_PAT": r"^ghp_[0-9a-zA-Z]{32,}$",
    "BEARER_TOKEN": r"^[0-9a-zA-Z]{32,}$",
    "SSH_PRIVATE_KEY": r"^.REDACTED_PRIVATE_KEY_[0-9]+.$",
    "DB_CONNECTION_STRING": r"^.*://user[0-9]+:redacted@db[.]example[.]com/db$",
    "URL_WITH_CREDS": r"^.*://user[0-9]+:redacted@.*$",
    "PERSON_NAME": r"^[A-Z][a-z]+ [A-Z][a-z]+ [0-9]+$",
    "DATE_OF_BIRTH": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "AADHAAR_NUMBER": r"^[2-9][0-9]{3} [0-9]{4} [0-9]{4}$",
    "CPF_NUMBER": r"^[0-9]{3}[.][0-9]{3}[.][0-9]{3}-[0-9]{2}$",
}


# ---------------------------------------------------------------- surrogates
def synth_distinct(spark, sf_dir):
    """Surrogates of every kind for one conversation of all customers: as many different ones as values, all well formed.

    Each surrogate is counted in the task that it is dealt to, so a task holds about SURROGATES of them.
    """
    kinds = F.explode(F.array(*[F.lit(k) for k in FORMATS]))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("n"))
    n = tasks(customers, SURROGATES // len(FORMATS))
    rows = customers.repartition(n).select("n", kinds.alias("entity"))
    original = F.when(F.col("entity") == "DATE_OF_BIRTH", F.date_add(F.lit("1940-01-01").cast("date"), F.col("n").cast("int")).cast("string")).when(F.col("entity") == "PHONE", F.concat(F.when(F.col("n") % 2 == 0, "+44 ").otherwise(""), F.lit("415-555-0000"))).otherwise(F.lit("abc"))
    made = rows.withColumn("original", original).withColumn("s", surrogate("'one'", "n", "entity", "original"))
    form = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    good = F.expr("s RLIKE f")
    # Formed is a matter of kind and surrogate, so of those that are equal one test holds for all.
    each = made.select("entity", "s").repartition(n, "entity", "s").groupBy("entity", "s").agg(F.count(F.lit(1)).alias("k"))
    formed = F.sum(F.when(good, F.col("k")).otherwise(0)).alias("n_formed")
    return each.withColumn("f", form[F.col("entity")]).groupBy("entity").agg(F.sum("k").alias("n"), F.count(F.col("s")).alias("n_distinct"), formed)


def synth_not_found_again(spark, sf_dir):
    """Phone numbers, cards and IPv6 surrogates put into texts: which of them detection finds again, by kind."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("n"), F.explode(F.array(F.lit("PHONE"), F.lit("IP_V6"), F.lit("CREDIT_CARD"))).alias("entity")).withColumn("original", F.lit("4"))
    made = rows.withColumn("text", F.concat(F.lit("see "), surrogate("'one'", "n", "entity", "original"), F.lit(" there")))
    found = detect.detect(made).select("entity", F.exists("spans", lambda s: s["entity"] == F.col("entity")).alias("again"))
    return found.groupBy("entity").agg(F.count_if("again").alias("n_again"))


def stateless_synth(spark, sf_dir):
    rows = q.fixture_rows(spark, sf_dir).withColumn("kind", detect.classify(F.col("text")))
    return rows.withColumn("s", synth.stateless("kind", "text")).select("n", "kind", F.when(F.col("kind") == "person_name", F.col("s").rlike("^[A-Z][a-z]+ [A-Z][a-z]+$").cast("string")).otherwise(F.col("s")).alias("shown"))


# ---------------------------------------------------------------- store
def conv_by_id(spark, sf_dir):
    return store.conversation_by_id(q._conversations(spark, sf_dir), "7").select("id", "started_at")


def file_path(spark, sf_dir):
    c = q._conversations(spark, sf_dir)
    return store.file_of(c.select(F.concat("started_at", F.lit("_"), "id", F.lit(".ndjson")).alias("file")), "7")


def messages_by_conv(spark, sf_dir):
    return store.messages_of(table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "conversation_id"), 3).select("turn", "role")


def fingerprint_lookup(spark, sf_dir):
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.cast("string").alias("id"), F.concat(F.lit("p"), (c % 3).cast("string")).alias("provider"), F.concat(F.lit("h"), (c % 10).cast("string")).alias("client_hint"), F.concat(F.lit("2024-01-05T0"), (c % 7).cast("string")).alias("started_at"))
    return store.by_fingerprint(rows, "p1", "h4", "2024-01-05").select("id")


def request_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    heads = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").alias("id"))
    m = c.select(F.col("conv_id").alias("conversation_id"), F.when(F.col("role") == "user", "request").otherwise("response").alias("direction"))
    return store.request_counts(heads, m)


def conversation_count(spark, sf_dir):
    return audit.conversation_count(table(spark, sf_dir, "conversations"))


def rotate_counts(spark, sf_dir):
    return store.rotation_counts(q._conversations(spark, sf_dir), F.lit("1998-01-01").cast("date"), 30)


def evict_counts(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return audit.eviction_counts(last, F.lit("2024-01-31 00:00:00").cast("timestamp"), "24 hours")


def ndjson_store(spark, sf_dir):
    """Conversations written as NDJSON files with messages, vault and detections, and read back."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn", "role", "text")
    none = F.lit(None).cast("string")
    heads = c.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conversation_id").alias("id"), F.lit("2024-01-01").alias("started_at"), F.lit("openai").alias("provider"), none.alias("model"), none.alias("client_hint"))
    m = c.select(F.concat_ws("-", "conversation_id", F.col("turn").cast("string")).alias("id"), "conversation_id", F.lit("request").alias("direction"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("timestamp"), "role", F.col("text").alias("content"))
    mapping = F.struct(F.lit("o").alias("original"), F.concat(F.lit("s"), F.col("id")).alias("synthetic"), F.lit("EMAIL").alias("pii_type"), F.lit(1).alias("tier"))
    vaults = heads.select(F.col("id").alias("conversation_id"), (F.col("id").cast("decimal(20,0)") * 1000).cast("decimal(20,0)").alias("rng_seed"), F.array(mapping, mapping).alias("mappings"))
    found = m.where("role = 'user'").select("conversation_id", F.col("id").alias("message_id"), F.lit("EMAIL").alias("entity_type"))
    folder = f"{shared_dir(spark)}/ndjson-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    store.write_ndjson(heads, m, vaults, found, folder)
    back = store.read_ndjson(spark, folder)
    said = back["messages"].groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"), F.min_by("content", F.struct("file", "line_no")).alias("first_content"))
    seen = back["detections"].groupBy(F.col("conversation_id").alias("d")).agg(F.count(F.lit(1)).alias("n_detections"))
    rows = store.first_vaults(back["vaults"]).groupBy(F.col("conversation_id").alias("v")).agg(F.first("rng_seed").alias("rng_seed"), F.count(F.lit(1)).alias("n_mappings"))
    out = back["conversations"].join(said, F.col("id") == F.col("conversation_id"), "left").join(seen, F.col("id") == F.col("d"), "left").join(rows, F.col("id") == F.col("v"), "left")
    return out.select("id", "provider", "n_messages", "first_content", F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"), "n_mappings", F.col("rng_seed").cast("string").alias("seed"))


def vault_compaction(spark, sf_dir):
    """Two versions of a vault saved, compacted, and read again."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_partkey").alias("original"), F.col("l_linenumber").alias("n"))
    folder = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    store.save_vault(rows.where("n = 1"), f"{folder}/all", 1)
    store.save_vault(rows.where("conv_id % 2 = 0"), f"{folder}/all", 2)
    store.compact_vault(spark.read.parquet(f"{folder}/all"), f"{folder}/one")
    return spark.read.parquet(f"{folder}/one").groupBy("version").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("conv_id").alias("n_conversations"))


def vault_records(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("synthetic"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).when(F.col("c_custkey") % 3 == 1, F.lit("shown")).alias("display_value"))
    return pseudonymize.records(rows).select("c_custkey", "display_value")


# ---------------------------------------------------------------- audit
def detection_log(spark, sf_dir):
    return audit.detection_log(q._found(spark, sf_dir), ["conv_id", "turn"]).withColumnRenamed("end", "stop").withColumn("confidence", F.col("confidence").cast("long"))


def position_pairs(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("text"))
    return audit.by_position(m, m.where("turn % 2 = 0").select("conv_id", "turn", F.upper("text").alias("text"))).select("conv_id", F.col("position").cast("long").alias("position"), "content", "content_masked")


def vault_stats(spark, sf_dir):
    return pseudonymize.vault_stats(q._vault(spark, sf_dir))


def naive_mask(spark, sf_dir):
    terms = ("the", "of the", "th", "on")
    masks = F.create_map(*[F.lit(x) for t in terms for x in (t, f"<{len(t)}>")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(audit.naive_mask(F.col("text"), F.array(*map(F.lit, terms)), masks), 256).alias("sha"))


def midnight(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", audit.seconds_to_midnight(F.date_trunc("second", F.col("ts"))).alias("seconds"))


# ---------------------------------------------------------------- model tiers
def stage_union(spark, sf_dir):
    rows = q._groups(spark, sf_dir)
    of = lambda test: F.filter("spans", lambda s: test(s["confidence"]))
    return detect.explode(rows.select("grp", detect.union_stages(of(lambda c: c >= 0.8), of(lambda c: c < 0.8)).alias("spans")), ["grp"]).select("grp", "start", F.col("end").alias("stop"))


def ner_spans(spark, sf_dir):
    """A model's raw answers, placed in its prompt, with a number of tokens and a logit each."""
    offset = 25
    raw = lambda s, i: F.struct((s["start"] + offset - 5).alias("start"), (s["end"] + offset - 5).alias("end"), (i * 15).alias("n_tokens"), F.lit("person name").alias("entity"), (s["confidence"] * 10 - 5).alias("logit"))
    rows = q._groups(spark, sf_dir).select("grp", detect.ner_spans(F.transform("spans", raw), F.lit("x" * 50), F.lit(offset)).alias("spans"))
    return detect.explode(rows, ["grp"]).select("grp", "entity", "start", F.col("end").alias("stop"), F.length("text").cast("long").alias("n_chars"))


def size_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect.size_allowed(F.col("text"), 2000).alias("allowed"))


def cascade_models(spark, sf_dir):
    """All tiers: patterns, a model that takes the last word for a name, and verdicts that reject half of its answers."""
    rows = q.fixture_rows(spark, sf_dir)

    def last_words(df: DataFrame) -> DataFrame:
        return df.withColumn("ner_spans", spans.find_literals(F.col("text"), F.array(F.lit(" ok"), F.lit(" end")), F.lit("person name"), 0.6))

    verdicts = rows.where("n % 3 <> 0").select("n", F.when(F.col("n") % 2 == 0, F.lit("[]")).otherwise(F.lit("[0]")).alias("verdict"))
    out = detect.with_models(rows, "text", last_words, verdicts, "n")
    return detect.explode(out, ["n"]).select("n", "entity", "start", F.col("end").alias("stop"), F.col("tier").cast("long").alias("tier"))


def replacements(spark, sf_dir):
    """A model's replacements: one that moves with the key, a fixed one, and two that aren't valid."""
    n = F.col("c_custkey").cast("int")
    r = lambda a, b, shown: F.struct(a.alias("start"), b.alias("end"), F.lit(shown).alias("display_value"), F.lit("x").alias("pii_type"))
    every = F.array(r(n % 20, n % 20 + 3, "<A>"), r(F.lit(10), F.lit(12), "<B>"), r(F.lit(9), F.lit(4), "<C>"), r(F.lit(25), F.lit(27), "<D>"))
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonymize.apply_replacements(F.lit("abcdefghijklmnopqrstuvwxyz"), every).alias("text"))


def stage_one(spark, sf_dir):
    n = F.col("c_custkey").cast("int")
    r = lambda a, b, shown: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(shown).alias("display_value"), F.lit("NAME").alias("pii_type"))
    made = pseudonymize.stage_one(F.lit("dear Ann and Bob"), F.array(r(13, 16, "Y"), r(5, 8, "X")), F.col("c_custkey").cast("string"), n)
    out = table(spark, sf_dir, "customer").select("c_custkey", spans.once(made).alias("m"))
    second = spans.outside(spans.find_literals(F.col("m.text"), F.array(F.lit("X"), F.lit("and")), F.lit("L")), F.col("m.zones"))
    return out.select("c_custkey", "m.text", F.col("m.entries")[1]["original"].alias("second_original"), F.array_join(F.transform("m.zones", lambda z: F.concat_ws("-", z["start"].cast("string"), z["end"].cast("string"))), ",").alias("zones"), F.size(second).cast("long").alias("n_left"))


# ---------------------------------------------------------------- bodies
def skip_synthetic(spark, sf_dir):
    """Texts masked once, and a second time with the same vault: surrogates aren't replaced again."""
    rows = q._detected(spark, sf_dir)
    v = cut(q._vault(spark, sf_dir, rows))
    once = cut(detect.detect(pseudonymize.rewrite(rows, v, ["conv_id", "turn"]).select("conv_id", "turn", F.col("masked").alias("text"))))
    new = pseudonymize.not_synthetic(detect.explode(once, ["conv_id", "turn"]), v)
    again = pseudonymize.rewrite(once, pseudonymize.vault(new, ["turn", "start"]), ["conv_id", "turn"])
    return again.select("conv_id", "turn", (F.col("masked") == F.col("text")).alias("unchanged"))


def rewrite_bodies(spark, sf_dir):
    """Chat bodies with array contents: personal data replaced, written back, and read again."""
    m = q.messages(spark, sf_dir)
    said = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    body = F.to_json(F.struct(F.lit("claude-x").alias("model"), F.lit(7).alias("max_tokens"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(part("image", F.lit("a@b.example")), part("text", x["text"])).alias("content"))).alias("messages")))
    bodies = cut(said.select("conv_id", F.lit(0).alias("request_id"), body.alias("body")))
    out, _ = pseudonymize.rewrite_bodies(bodies, ["conv_id", "request_id"], form="bare")
    rows = out.select("conv_id", F.get_json_object("rewritten", "$.max_tokens").alias("max_tokens"), F.get_json_object("rewritten", "$.messages[0].content[0].text").alias("other"), F.explode(chat.entries(F.col("rewritten"))).alias("e"))
    return rows.select("conv_id", "max_tokens", "other", F.col("e.msg_idx").cast("long").alias("idx"), F.sha2("e.text", 256).alias("masked_sha256"))


#: Characters that need no escape in JSON.
_PLAIN = "[^ !#-Z^-~]"


def splice_bodies(spark, sf_dir):
    """Bodies with keys, spaces, numbers and escapes of their own, a message in each: only the masked text changes."""
    text = F.regexp_replace("text", _PLAIN, " ")
    body = F.concat(F.lit('{ "z": 1.50, "messages" : [ {"role":"user","content": "'), text, F.lit('"} , {"content":[{"type":"text"}]}],"a" :"\\u00e9\\/"}'))
    requests = cut(q.messages(spark, sf_dir).select("conv_id", "turn", body.alias("body")))
    out, _ = pseudonymize.rewrite_bodies(requests, ["conv_id", "turn"], form="bare")
    return out.select("conv_id", "turn", F.sha2("rewritten", 256).alias("sha"))


def remind_bodies(spark, sf_dir):
    """The reminder put into bodies with and without a system prompt, of providers that take one and of one that doesn't."""
    said, kind = F.regexp_replace("text", _PLAIN, " "), F.col("conv_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit('{"model":"m", "x":"'), said, F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('{"system": "'), said, F.lit('" ,"n":1e3}')))
        .when(kind == 2, F.concat(F.lit('{"messages":[{"role":"user"},{"role":"system","content":"'), said, F.lit('"}]}')))
        .when(kind == 3, F.concat(F.lit('{"messages":[ {"role":"user","content":"'), said, F.lit('"}]}')))
        .otherwise(F.concat(F.lit('{"contents":["'), said, F.lit('"]}')))
    )
    name = F.when(kind < 2, "anthropic").when(kind < 4, "openai").otherwise("google")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), body.alias("body"))
    return rows.select("conv_id", "turn", "name", F.sha2(splice.reminded(F.col("name"), F.col("body"), "keep tokens"), 256).alias("sha"))


def tool_blocks(spark, sf_dir):
    """Requests with tool calls and results among their blocks, parsed."""
    block = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    blocks = [block(type=F.lit("tool_use"), name=F.lit("calc"), input=F.struct(F.col("turn").alias("x"))), block(type=F.lit("tool_result"), content=F.col("text")), block(type=F.lit("tool_use"), input=F.struct(F.lit(True).alias("y"))), block(type=F.lit("tool_result"), content=F.array(F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))]
    body = F.concat(F.lit('{"model":"m","messages":[{"role":"assistant","content":['), F.concat_ws(",", *blocks), F.lit("]}]}"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.parse_anthropic(body).alias("p"))
    return rows.select("conv_id", "turn", F.sha2(F.col("p.messages")[0]["content"], 256).alias("sha"))


def content_length(spark, sf_dir):
    headers = F.lit("POST / HTTP/1.1\r\ncontent-length: 5\r\nX-Content-Length: 9\r\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.with_content_length(headers, F.col("text")).alias("headers"))


def response_bodies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    usage = F.struct(F.col("conv_id").alias("input_tokens"), F.length("text").alias("output_tokens"))
    body = F.to_json(F.struct(F.array(part("text", F.substring("text", 1, 5)), part("image", F.lit("no")), part("text", F.substring("text", 6, 1 << 30))).alias("content"), usage.alias("usage")))
    u = chat.response_usage(F.lit("anthropic"), F.col("body"))
    return c.select("conv_id", "turn", body.alias("body")).select("conv_id", "turn", chat.response_text(F.col("body")).alias("text"), u["tokens_in"].alias("tokens_in"), u["tokens_out"].alias("tokens_out"))


def trailing_events(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(F.lit("anthropic"), F.lit("openai"), F.lit("google")), (F.col("turn") % 3 + 1).cast("int"))
    made = c.select("conv_id", "turn", name.alias("provider"), sse.trailing(name, F.col("text")).alias("event"))
    data = F.regexp_extract("event", r"(?s)data: (.*)\n\n$", 1)
    return made.select("conv_id", "turn", F.sha2(F.coalesce(F.get_json_object(data, "$.delta.text"), F.get_json_object(data, "$.choices[0].delta.content")), 256).alias("sha"))


def other_streams(spark, sf_dir):
    """Streams of two more providers: two deltas each, token counts where the provider reports them, an end mark."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    line = lambda d: F.concat(F.lit("data: "), d, F.lit("\r\n\r\n"))
    openai = lambda t: F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("content")).alias("delta"))).alias("choices")))
    count = F.struct(F.col("conv_id").alias("promptTokenCount"), F.length("text").alias("candidatesTokenCount"))
    google = lambda t: F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(t.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), count.alias("usageMetadata")))
    head, rest = F.substring("text", 1, 10), F.substring("text", 11, 1 << 30)
    rows = None
    for name, of in (("openai", openai), ("google", google)):
        body = F.concat(line(of(head)), line(of(rest)), line(F.lit("[DONE]")), line(of(F.lit("late"))))
        one = c.select("conv_id", "turn", F.lit(name).alias("provider"), body.alias("body"))
        rows = one if rows is None else rows.unionByName(one)
    return sse.assemble(sse.rows(rows), ["conv_id", "turn", "provider"])


# ---------------------------------------------------------------- streaming
def _byte_chunks(spark, sf_dir, size: int):
    """The event bodies of sse_blocks as UTF-8, cut into chunks of so many bytes, the last one marked."""
    bodies = q._streams(spark, sf_dir).select((F.col("conv_id").cast("long") * 1_000_000 + F.col("turn")).alias("stream_id"), F.encode("body", "utf-8").alias("body"))
    n = F.ceil(F.octet_length("body") / size).cast("int")
    chunks = bodies.select("stream_id", "body", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return chunks.select("stream_id", F.col("i").cast("long").alias("chunk"), F.substring(F.col("body"), F.col("i") * size + 1, F.lit(size)).alias("data"), (F.col("i") == F.col("n") - 1).alias("end"))


def sse_chunks(spark, sf_dir):
    """Bodies cut into chunks of nine bytes, put together by the stateful stream."""
    from ..streaming.events import events_stream

    return q.run_stream(spark, _byte_chunks(spark, sf_dir, 9), events_stream).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("n_chars"))


def state_rows(spark, checkpoint: str, variable: str) -> int:
    """How many entries of a state variable a stopped stream has left."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).count()


def sse_state(spark, sf_dir):
    """What the stream of sse_chunks has left in its state when all bodies have ended: nothing."""
    from ..streaming.events import events_stream

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    rows = _byte_chunks(spark, sf_dir, 64)
    rows.write.parquet(f"{folder}/in")
    out = events_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    with q.state_provider(spark):
        out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    left = sum(state_rows(spark, f"{folder}/state", v) for v in ("open", "piece", "early"))
    return spark.read.schema(out.schema).parquet(f"{folder}/out").agg(F.countDistinct("stream_id").alias("n_streams")).withColumn("n_left", F.lit(left).cast("long"))


def stream_idle(spark, sf_dir):
    """Replies that never end, the last token of each left open: what the stream holds comes out when its conversation
    has been idle, and the state goes. The stream goes on until there is none."""
    from ..streaming.restore import restore_stream

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    rows = q.deltas(spark, sf_dir, size=40, tail='<pii id="open', ends=False)
    rows.write.parquet(f"{folder}/in")
    out = restore_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), idle_ms=1000)
    with q.state_provider(spark):
        running = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(processingTime="500 milliseconds").format("parquet").option("path", f"{folder}/out").start()
        q.wait_until(running, lambda seen: sum(p["numInputRows"] for p in seen) > 0 and seen[-1]["stateOperators"][0]["numRowsTotal"] == 0)
    left = state_rows(spark, f"{folder}/state", "open") + state_rows(spark, f"{folder}/state", "piece")
    parts = q.together(spark.read.schema(out.schema).parquet(f"{folder}/out"))
    said = q.messages(spark, sf_dir).select("conv_id", F.col("turn").alias("response_id"), F.concat("text", F.lit('<pii id="open')).alias("text"))
    return said.join(parts, ["conv_id", "response_id"], "left").select("conv_id", "response_id", (F.col("restored") == F.col("text")).alias("equal"), F.lit(left).cast("long").alias("n_left"))


def stream_windows(spark, sf_dir):
    """Events in three batches, the last tenth of them late, counted by the hour: windows that the watermark has closed.

    A batch leaves out what is later than the watermark that the batch before it began with."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    events = table(spark, sf_dir, "events")
    for low, high in ((1, 8), (9, 9), (0, 0)):  # a file each, in this order
        events.where((F.col("event_id") % 10).between(low, high)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs times with a zone
    out = windows.tumbling(timed, ["event_type"], "1 hour", watermark="2 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# ---------------------------------------------------------------- model tiers
def ner_batches(spark, sf_dir):
    """A model that marks the first word and fails for some texts, one text at a time: its spans, and its faults."""

    def model(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        if any(len(t) % 10 == 0 for t in texts):
            raise ValueError
        return [[(0, t.find(" "), "person name", 0.9)] if " " in t[1:] and t[0] != " " else [] for t in texts]

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = detect.with_ner(rows, model, batch=1, timeout=60)
    return found.select("conv_id", "turn", F.get("ner_spans.text", F.lit(0)).alias("word"), F.col("ner_spans_failure").alias("failure"))


def slm_prompts(spark, sf_dir):
    """The question to a model about the spans of each message, and its answer taken out of a Markdown fence."""
    rows = detect.detect(q.messages(spark, sf_dir)).where(F.size("spans") > 0)
    answer = detect.without_fence(F.concat(F.lit("  ```json\n["), F.col("turn").cast("string"), F.lit("]\n```\n")))
    return rows.select("conv_id", "turn", F.sha2(detect.prompt(F.col("text"), F.col("spans")), 256).alias("sha"), answer.alias("answer"))


def store_appends(spark, sf_dir):
    """Messages and detections appended twice: those of unknown conversations are left out, repeated ones stay."""
    m = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("conversation_id"), "role")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    for _ in range(2):
        store.append_messages(m, known, f"{folder}/messages")
        store.append_detections(m.select(F.col("id").alias("message_id"), F.col("role").alias("entity_type")), f"{folder}/detections")
    said = spark.read.parquet(f"{folder}/messages").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))
    found = spark.read.parquet(f"{folder}/detections").groupBy(F.substring_index("message_id", "-", 1).alias("c")).agg(F.count(F.lit(1)).alias("n_detections"))
    return found.join(said, F.col("c") == F.col("conversation_id"), "left").select(F.col("c").alias("conv_id"), F.coalesce("n_messages", F.lit(0)).cast("long").alias("n_messages"), "n_detections")


# ---------------------------------------------------------------- span tables
def _span_tables(spark, sf_dir):
    """Made-up spans of long texts, as a table of candidates and one of zones."""
    rows = q.candidate_rows(spark, sf_dir).select("grp", "i", (F.col("start") * 37).alias("start"), (F.col("stop") * 37).alias("end"), "confidence")
    return rows.where("confidence < 0.6"), rows.where("confidence >= 0.6")


def overlap_pairs(spark, sf_dir):
    """Pairs of overlapping spans of two tables, counted for each text."""
    pairs = intervals.overlapping(*_span_tables(spark, sf_dir), "grp")
    return pairs.groupBy(F.col("left.grp").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("left.end", "right.end") - F.greatest("left.start", "right.start")).cast("long").alias("shared"))


def exclusion_join(spark, sf_dir):
    """Spans of a table that overlap no zone of another."""
    return intervals.outside(*_span_tables(spark, sf_dir), "grp").select("grp", "i", "start", F.col("end").alias("stop"))


# ---------------------------------------------------------------- vault terms in texts
def replace_originals(spark, sf_dir):
    """All originals of each conversation's vault replaced in all of its messages, by one automaton."""
    rows = q._detected(spark, sf_dir)
    out = terms.replace_originals(rows, q._vault(spark, sf_dir, rows), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.sha2("replaced", 256).alias("sha"), F.col("any").alias("changed"))


def replace_synthetics(spark, sf_dir):
    """Masked messages with their surrogates replaced by originals, and whether there was one."""
    rows = q._detected(spark, sf_dir)
    v = q._vault(spark, sf_dir, rows)
    out = terms.replace_synthetics(pseudonymize.rewrite(rows, v, ["conv_id", "turn"]), v, ["conv_id", "turn"], "masked")
    return out.select("conv_id", "turn", F.sha2("replaced", 256).alias("sha"), F.col("any").alias("changed"))


def vault_places(spark, sf_dir):
    """Places of the vault's originals in the messages, longest first: how many, and the sum of their starts."""
    rows = q._detected(spark, sf_dir)
    out = terms.resolved(rows, q._vault(spark, sf_dir, rows), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.size("hits").cast("long").alias("n"), F.aggregate("starts", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_start")).where("n > 0")


def live_counts(spark, sf_dir):
    from ..streaming.events import live_counts as counts

    return q.run_stream(spark, table(spark, sf_dir, "events").select("event_type", "user_id"), lambda s: counts(s, ["event_type"]), "complete")


# ---------------------------------------------------------------- settings
def config_levels(spark, sf_dir):
    """The protection level of settings that differ from customer to customer, and what the level's own settings are."""
    n = F.col("c_custkey")
    mode = F.element_at(F.array(F.lit("off"), F.lit("detect-only"), F.lit("replace"), F.lit("other")), (n % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", mode.alias("mode"), (n % 3 > 0).alias("regex"), (n % 5 > 1).alias("ner"), (n % 7 > 2).alias("slm"))
    level = config.level(F.col("mode"), F.col("regex"), F.col("ner"), F.col("slm"))
    return rows.select("c_custkey", level.alias("level")).withColumn("patch_mode", config.level_mode(F.col("level")))


QUERIES = {
    f.__name__: f
    for f in (
        synth_distinct, synth_not_found_again, stateless_synth, conv_by_id, file_path, messages_by_conv, fingerprint_lookup, request_counts, conversation_count, rotate_counts,
        evict_counts, ndjson_store, vault_compaction, vault_records, detection_log, position_pairs, vault_stats, naive_mask, midnight, stage_union, ner_spans, size_guard,
        cascade_models, replacements, stage_one, skip_synthetic, rewrite_bodies, splice_bodies, remind_bodies, tool_blocks, content_length, response_bodies, trailing_events, other_streams, sse_chunks, sse_state, stream_idle, stream_windows, ner_batches, slm_prompts, store_appends, overlap_pairs, exclusion_join, replace_originals, replace_synthetics, vault_places, live_counts, config_levels,
    )
}

_ONE = "c_custkey::VARCHAR"
_KINDS = oracle.SQL["classify_pii"]
_FOUR = "lpad((('0x' || substr(sha256(text), 1, 4))::BIGINT % 10000)::VARCHAR, 4, '0')"
_PLACED = "c_custkey::INT % 20"
SQL = {
    "synth_distinct": f"SELECT entity, count(*) AS n, count(*) AS n_distinct, count(*) AS n_formed FROM customer, (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in FORMATS)}) v(entity) GROUP BY entity",
    "synth_not_found_again": "SELECT entity, CASE WHEN entity = 'CREDIT_CARD' THEN count(*) ELSE 0 END AS n_again FROM customer, (VALUES ('PHONE'), ('IP_V6'), ('CREDIT_CARD')) v(entity) GROUP BY entity",
    "stateless_synth": f"WITH kinds AS ({_KINDS}), {oracle._FIX} SELECT n, kind, CASE kind WHEN 'person_name' THEN 'true' WHEN 'email' THEN 'redacted' || substr(sha256(text), 1, 4) || '@example.com' WHEN 'phone' THEN '555-000-' || {_FOUR} WHEN 'ssn' THEN '000-00-' || {_FOUR} WHEN 'credit_card' THEN '4000-0000-0000-' || {_FOUR} WHEN 'api_key' THEN '[REDACTED-KEY-' || substr(sha256(text), 1, 6) || ']' ELSE '[REDACTED]' END AS shown FROM kinds JOIN fix USING (n)",
    "conv_by_id": "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS started_at FROM orders WHERE o_orderkey = 7",
    "file_path": "SELECT strftime(o_orderdate, '%Y-%m-%d') || '_7.ndjson' AS file FROM orders WHERE o_orderkey = 7",
    "messages_by_conv": "SELECT turn, role FROM conversations WHERE conv_id = 3",
    "fingerprint_lookup": f"SELECT {_ONE} AS id FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 10 = 4 ORDER BY c_custkey % 7, {_ONE} LIMIT 1",
    "request_counts": "SELECT conv_id AS id, count(*) FILTER (role = 'user') AS n_requests FROM conversations GROUP BY 1",
    "conversation_count": "SELECT count(DISTINCT conv_id) AS n_conversations FROM conversations",
    "rotate_counts": "SELECT count(*) FILTER (o_orderdate::DATE >= DATE '1997-12-02') AS kept, count(*) FILTER (o_orderdate::DATE < DATE '1997-12-02') AS removed FROM orders",
    "evict_counts": "WITH u AS (SELECT max(ts) AS t FROM events GROUP BY user_id) SELECT count(*) FILTER (t <= TIMESTAMP '2024-01-30 00:00:00') AS evicted, count(*) FILTER (t > TIMESTAMP '2024-01-30 00:00:00') AS kept FROM u",
    "ndjson_store": "SELECT conv_id::VARCHAR AS id, 'openai' AS provider, count(*) AS n_messages, min_by(text, turn) AS first_content, count(*) FILTER (role = 'user') AS n_detections, 2::BIGINT AS n_mappings, (conv_id * 1000)::VARCHAR AS seed FROM conversations GROUP BY conv_id",
    "vault_compaction": "WITH v AS (SELECT l_orderkey, 1 AS version FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 1 UNION ALL SELECT l_orderkey, 2 FROM lineitem WHERE l_orderkey % 2 = 0) SELECT version, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_conversations FROM v GROUP BY version",
    "vault_records": f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'shown' ELSE 's' || {_ONE} END AS display_value FROM customer",
    "detection_log": f"WITH {oracle._HITS} SELECT conv_id, turn, entity, start, stop, 1::BIGINT AS confidence, 1 AS tier FROM hits",
    "position_pairs": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE turn % 2 = 0) SELECT a.conv_id, a.position, a.role AS content, upper(b.role) AS content_masked FROM a LEFT JOIN b ON b.conv_id = a.conv_id AND b.position = a.position",
    "vault_stats": f"WITH {oracle._VAULT} SELECT conv_id, count(DISTINCT original) AS n_mappings, max(strlen(synthetic))::BIGINT AS longest_bytes, count(DISTINCT substr(synthetic, 1, 2)) AS n_prefixes FROM vault GROUP BY conv_id",
    "naive_mask": "SELECT conv_id, turn, sha256(replace(replace(replace(replace(text, 'of the', '<6>'), 'the', '<3>'), 'on', '<2>'), 'th', '<2>')) AS sha FROM conversations",
    "midnight": "SELECT event_id, (86400 - (epoch(date_trunc('second', ts))::BIGINT % 86400))::BIGINT AS seconds FROM events",
    "stage_union": f"WITH {oracle._CAND} SELECT grp, start, stop FROM c a WHERE confidence >= 0.8 OR NOT EXISTS (SELECT 1 FROM c b WHERE b.grp = a.grp AND b.confidence >= 0.8 AND {oracle._OVER})",
    "ner_spans": (
        f"WITH RECURSIVE {oracle._CAND}, g AS (SELECT grp, i, start - 5 AS a, stop - 5 AS b, confidence AS p FROM c WHERE start >= 5 AND stop - 5 <= 50 AND i * 15 <= 50 AND confidence * 10 - 5 >= 0), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, i) AS k FROM g), "
        "f AS (SELECT grp, k, [{'a': a, 'b': b}] AS acc FROM r WHERE k = 1 UNION ALL SELECT f.grp, r.k, CASE WHEN len(list_filter(f.acc, lambda x: x.a < r.b AND r.a < x.b)) > 0 THEN f.acc ELSE list_append(f.acc, {'a': r.a, 'b': r.b}) END FROM f JOIN r ON r.grp = f.grp AND r.k = f.k + 1), "
        "l AS (SELECT grp, unnest(acc) AS s FROM f QUALIFY k = max(k) OVER (PARTITION BY grp)) SELECT grp, 'PERSON_NAME' AS entity, s.a AS start, s.b AS stop, (s.b - s.a)::BIGINT AS n_chars FROM l"
    ),
    "size_guard": "SELECT doc_id, length(coalesce(text, '')) <= 2000 AS allowed FROM documents",
    "cascade_models": (
        f"WITH {oracle._FIX}, {oracle.detected('fix', 'n')}, w AS (SELECT n, CASE WHEN ends_with(text, ' ok') THEN ' ok' WHEN ends_with(text, ' end') THEN ' end' END AS t, length(text) AS size FROM fix) "
        "SELECT n, entity, start, stop, 1::BIGINT AS tier FROM hits UNION ALL SELECT n, 'PERSON_NAME', (size - length(t))::INT, size::INT, 2 FROM w WHERE t IS NOT NULL AND (n % 3 = 0 OR n % 2 <> 0)"
    ),
    "replacements": f"SELECT c_custkey, CASE WHEN {_PLACED} + 3 <= 10 THEN substr('abcdefghijklmnopqrstuvwxyz', 1, {_PLACED}) || '<A>' || substr('abcdefghijklmnopqrstuvwxyz', {_PLACED} + 4, 10 - {_PLACED} - 3) || '<B>mnopqrstuvwxyz' WHEN {_PLACED} >= 12 THEN 'abcdefghij<B>' || substr('abcdefghijklmnopqrstuvwxyz', 13, {_PLACED} - 12) || '<A>' || substr('abcdefghijklmnopqrstuvwxyz', {_PLACED} + 4) WHEN {_PLACED} < 10 OR {_PLACED} = 10 AND FALSE THEN substr('abcdefghijklmnopqrstuvwxyz', 1, {_PLACED}) || '<A>' || substr('abcdefghijklmnopqrstuvwxyz', {_PLACED} + 4) ELSE 'abcdefghij<B>mnopqrstuvwxyz' END AS text FROM customer",
    "stage_one": (
        f"WITH t AS (SELECT c_custkey, {oracle._token(_ONE, 'c_custkey')} AS a, {oracle._token(_ONE, '(c_custkey + 1)')} AS b FROM customer) "
        "SELECT c_custkey, 'dear <pii id=\"' || a || '\">X</pii> and <pii id=\"' || b || '\">Y</pii>' AS text, 'Bob' AS second_original, '5-31,36-62' AS zones, 1::BIGINT AS n_left FROM t"
    ),
    "skip_synthetic": "SELECT conv_id, turn, TRUE AS unchanged FROM conversations",
    "rewrite_bodies": f"WITH {oracle._VAULT}, " + oracle._masked("msg", "conv_id, turn", "", "v.synthetic", "JOIN vault v ON v.conv_id = h.conv_id AND v.original = h.hit") + " SELECT conv_id, '7' AS max_tokens, 'a@b.example' AS other, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, sha256(masked) AS masked_sha256 FROM masked",
    "content_length": "SELECT conv_id, turn, 'POST / HTTP/1.1' || chr(13) || chr(10) || 'content-length: ' || strlen(text) || chr(13) || chr(10) || 'X-Content-Length: 9' || chr(13) || chr(10) AS headers FROM conversations",
    "response_bodies": "SELECT conv_id, turn, text, conv_id::BIGINT AS tokens_in, length(text)::BIGINT AS tokens_out FROM conversations WHERE role = 'assistant'",
    "trailing_events": "SELECT conv_id, turn, CASE WHEN turn % 3 < 2 AND text <> '' THEN sha256(text) END AS sha FROM conversations",
    "other_streams": "SELECT conv_id, turn, p AS provider, text, CASE WHEN p = 'google' THEN conv_id END::BIGINT AS tokens_in, CASE WHEN p = 'google' THEN length(text) END::BIGINT AS tokens_out FROM conversations, (VALUES ('openai'), ('google')) v(p) WHERE role = 'assistant'",
    "sse_chunks": oracle.SQL["sse_blocks"],
    "splice_bodies": f"WITH {oracle._VAULT}, " + oracle._masked("msg", "conv_id, turn", "", "v.synthetic", "JOIN vault v ON v.conv_id = h.conv_id AND v.original = h.hit") + f""" SELECT conv_id, turn, sha256('{{ "z": 1.50, "messages" : [ {{"role":"user","content": "' || regexp_replace(masked, '{_PLAIN}', ' ', 'g') || '"}} , {{"content":[{{"type":"text"}}]}}],"a" :"\\u00e9\\/"}}') AS sha FROM masked""",
    "remind_bodies": f"""WITH r AS (SELECT '<system-reminder>\\nkeep tokens\\n</system-reminder>' AS b), c AS (SELECT conv_id, turn, conv_id % 5 AS k, regexp_replace(text, '{_PLAIN}', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN k < 2 THEN 'anthropic' WHEN k < 4 THEN 'openai' ELSE 'google' END AS name, sha256(CASE k
 WHEN 0 THEN '{{"system":"' || b || '","model":"m", "x":"' || t || '"}}'
 WHEN 1 THEN '{{"system": "' || t || '\\n\\n' || b || '" ,"n":1e3}}'
 WHEN 2 THEN '{{"messages":[{{"role":"user"}},{{"role":"system","content":"' || t || '\\n\\n' || b || '"}}]}}'
 WHEN 3 THEN '{{"messages":[{{"role":"system","content":"' || b || '"}}, {{"role":"user","content":"' || t || '"}}]}}'
 ELSE '{{"contents":["' || t || '"]}}' END) AS sha FROM c, r""",
    "tool_blocks": """SELECT conv_id, turn, sha256('[calc] {"x":' || turn || '}[result] ' || text || '[unknown] {"y":true}[result] ' || role) AS sha FROM conversations""",
    "ner_batches": "SELECT conv_id, turn, CASE WHEN length(text) % 10 > 0 AND instr(text, ' ') > 1 THEN substr(text, 1, instr(text, ' ') - 1) END AS word, CASE WHEN length(coalesce(text, '')) % 10 = 0 THEN 'ValueError' END AS failure FROM conversations",
    "slm_prompts": f"WITH {oracle._HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start) - 1 AS i FROM hits), l AS (SELECT conv_id, turn, string_agg(i || ': ' || entity || ' (1.00) ' || hit, chr(10) ORDER BY i) AS lines FROM n GROUP BY ALL) SELECT l.conv_id, l.turn, sha256('Which of the numbered strings in this text are personal data or secrets?' || chr(10) || chr(10) || m.text || chr(10) || chr(10) || lines || chr(10) || chr(10) || 'Answer with their numbers only, as a JSON array such as [1, 3].') AS sha, '[' || l.turn || ']' AS answer FROM l JOIN msg m ON m.conv_id = l.conv_id AND m.turn = l.turn",
    "store_appends": "SELECT conv_id::VARCHAR AS conv_id, (2 * count(*) FILTER (EXISTS (SELECT 1 FROM customer WHERE c_custkey = conv_id)))::BIGINT AS n_messages, (2 * count(*))::BIGINT AS n_detections FROM conversations GROUP BY conv_id",
    "stream_windows": (
        "WITH e AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS stop, event_id % 10 = 0 AS late FROM events), "
        "w AS (SELECT max(ts) FILTER (event_id % 10 BETWEEN 1 AND 8) - INTERVAL 2 HOUR AS one, max(ts) - INTERVAL 2 HOUR AS two FROM e) "
        "SELECT stop - INTERVAL 1 HOUR AS window_start, event_type, count(*) AS n FROM e, w WHERE stop <= two AND (NOT late OR stop > one) GROUP BY ALL"
    ),
    "overlap_pairs": f"WITH r AS (SELECT grp, i, start * 37 AS start, stop * 37 AS stop, confidence FROM ({candidates_sql(True)})), a AS (SELECT * FROM r WHERE confidence < 0.6), z AS (SELECT * FROM r WHERE confidence >= 0.6) SELECT a.grp, count(*) AS n, CAST(sum(least(a.stop, z.stop) - greatest(a.start, z.start)) AS BIGINT) AS shared FROM a JOIN z ON a.grp = z.grp AND a.start < z.stop AND z.start < a.stop GROUP BY a.grp",
    "exclusion_join": f"WITH r AS (SELECT grp, i, start * 37 AS start, stop * 37 AS stop, confidence FROM ({candidates_sql(True)})), a AS (SELECT * FROM r WHERE confidence < 0.6), z AS (SELECT * FROM r WHERE confidence >= 0.6) SELECT grp, i, start, stop FROM a WHERE NOT EXISTS (SELECT 1 FROM z WHERE a.grp = z.grp AND a.start < z.stop AND z.start < a.stop)",
    "sse_state": "SELECT count(*) AS n_streams, 0::BIGINT AS n_left FROM conversations WHERE role = 'assistant'",
    "stream_idle": "SELECT conv_id, turn AS response_id, TRUE AS equal, 0::BIGINT AS n_left FROM conversations",
    "replace_originals": f"WITH {oracle._VAULT}, t AS (SELECT conv_id, list([original, synthetic] ORDER BY original) AS v FROM vault GROUP BY ALL) SELECT m.conv_id, m.turn, sha256(CASE WHEN t.v IS NULL THEN m.text ELSE list_reduce(t.v, lambda acc, x: [replace(acc[1], x[1], x[2])], [m.text])[1] END) AS sha, coalesce(len(list_filter(t.v, lambda x: contains(m.text, x[1]))) > 0, FALSE) AS changed FROM msg m LEFT JOIN t ON t.conv_id = m.conv_id",
    "replace_synthetics": f"WITH {oracle._VAULT}, n AS (SELECT DISTINCT conv_id, turn FROM hits) SELECT m.conv_id, m.turn, sha256(m.text) AS sha, n.turn IS NOT NULL AS changed FROM msg m LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn",
    "vault_places": f"WITH {oracle._VAULT}, p AS (SELECT m.conv_id, m.turn, unnest(list_filter(range(1, length(m.text) + 1), lambda i: starts_with(substr(m.text, i), v.original))) - 1 AS start FROM msg m JOIN vault v ON v.conv_id = m.conv_id AND contains(m.text, v.original)) SELECT conv_id, turn, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM p GROUP BY ALL",
    "live_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "config_levels": "WITH r AS (SELECT c_custkey, c_custkey % 4 AS m, c_custkey % 3 > 0 AS a, c_custkey % 5 > 1 AS b, c_custkey % 7 > 2 AS c FROM customer), l AS (SELECT c_custkey, CASE WHEN m = 1 THEN 'detect-only' WHEN m = 2 AND a AND b AND c THEN '3' WHEN m = 2 AND a AND b THEN '2' WHEN m = 2 AND a AND NOT c THEN '1' WHEN m = 2 AND NOT a AND NOT b AND c THEN 'intelligent' ELSE 'off' END AS level FROM r) SELECT *, CASE level WHEN 'off' THEN 'off' WHEN 'detect-only' THEN 'detect-only' ELSE 'replace' END AS patch_mode FROM l",
}
