"""The registered queries: each applies operators to whole tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import spans, tokens, validators
from ..functions.synth import surrogate
from ..operators import audit, detect, evaluate, pseudonymize, restore
from ..session import cut, remove_at_exit, shared_dir, table
from ..sources import chat, sse, store
from ..streaming import windows
from . import fixtures


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """SQL over one table, given as a DataFrame and not as a view of the session."""
    return spark.sql(sql.replace(f"FROM {name}", "FROM {" + name + "}"), **{name: table(spark, sf_dir, name)})


def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, fixtures.fixtures_sql(False), "customer")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, fixtures.messages_sql(False), "conversations")


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, fixtures.candidates_sql(False), "orders")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages with spans, cut, since both the vault and the texts are made from them."""
    return cut(detect.detect(messages(spark, sf_dir)))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.explode(detect.detect(messages(spark, sf_dir)), ["conv_id", "turn"])


def _vault(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    found = _found(spark, sf_dir) if rows is None else detect.explode(rows, ["conv_id", "turn"])
    return pseudonymize.vault(found, ["turn", "start"])


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their keyed state as they need; the session's own setting is put back."""
    from ..streaming.restore import STATE_PROVIDER

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def wait_until(running: StreamingQuery, done, seconds: float = 300) -> None:
    """Let a stream that goes on run until done(progress of its batches) or for so long, then stop it.

    A stream with processing-time timers always has another batch to run, so there is no end of its input to wait for.
    """
    seen, until = {}, time.monotonic() + seconds
    try:
        while running.isActive and time.monotonic() < until:
            seen |= {p["batchId"]: p for p in running.recentProgress}
            if seen and done([seen[k] for k in sorted(seen)]):
                return
            time.sleep(0.3)
        if running.exception() is not None:
            raise running.exception()
        raise TimeoutError(f"the stream hasn't come to its end in {seconds} s")
    finally:
        running.stop()


def run_stream(spark: SparkSession, rows: DataFrame, of, mode: str = "append") -> DataFrame:
    """What a stream over rows gives: written, read as a stream until it ends, and read again."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    rows.write.parquet(f"{folder}/in")
    out = of(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    writer = out.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    with state_provider(spark):
        if mode == "append":
            writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        else:
            writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


# ---------------------------------------------------------------- detection
def pii_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = detect.explode(detect.detect(docs), ["doc_id", "source"])
    return found.groupBy("source", "entity").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


def t1_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect.explode(detect.detect(docs), ["doc_id"]).select("doc_id", "entity", "start", F.col("end").alias("stop"), F.col("text").alias("hit"))


def t1_spans_by_locale(spark, sf_dir):
    found = detect.explode(detect.detect(fixture_rows(spark, sf_dir), locale_col="locale"), ["n", "expected"])
    return found.select("n", "expected", "entity", "start", F.col("end").alias("stop"), F.col("text").alias("hit"))


def overlap_priority(spark, sf_dir):
    rows = fixture_rows(spark, sf_dir)
    every = detect.explode(detect.candidates(rows), ["n"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n_candidates"))
    kept = detect.explode(detect.detect(rows), ["n"]).groupBy(F.col("entity").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(kept, F.col("entity") == F.col("e"), "left").select("entity", "n_candidates", F.coalesce("n", F.lit(0)).alias("n_accepted"))


def luhn_validate(spark, sf_dir):
    n = F.col("o_orderkey")
    number = F.concat(F.lit("4"), F.lpad(n.cast("string"), 14, "0"), ((n * 7) % 10).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", number.alias("number")).select("o_orderkey", validators.luhn(F.col("number")).alias("valid"))


def ipv6_validate(spark, sf_dir):
    s = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("fe80::"), s)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a:"), s)).otherwise(F.concat(F.lit("crate::vault"), s))
    return table(spark, sf_dir, "customer").select("c_custkey", validators.ipv6(text).alias("valid"))


def cpf_validate(spark, sf_dir):
    n = F.col("c_custkey")
    text = F.when(n % 5 == 0, F.lit("529.982.247-25")).when(n % 5 == 1, F.lit("111.111.111-11")).otherwise(F.concat(F.lit("529.982."), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((n * 7 % 100).cast("string"), 2, "0")))
    return table(spark, sf_dir, "customer").select("c_custkey", validators.cpf(text).alias("valid"))


def _span(start, stop, entity, confidence, tier, text):
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("end"), entity.alias("entity"), confidence.cast("double").alias("confidence"), F.lit(tier).alias("tier"), text.alias("text"))


def _groups(spark, sf_dir):
    one = _span(F.col("start"), F.col("stop"), F.lit("X"), F.col("confidence"), 1, F.col("i").cast("string"))
    rows = candidate_rows(spark, sf_dir).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("i", one.alias("s")))).alias("a"))
    return rows.select("grp", F.transform("a", lambda x: x["s"]).alias("spans"))


def merge_confidence(spark, sf_dir):
    merged = _groups(spark, sf_dir).select("grp", detect.merge(F.filter("spans", lambda s: s["text"] < "3"), F.filter("spans", lambda s: s["text"] >= "3")).alias("spans"))
    return detect.explode(merged, ["grp"]).select("grp", "start", F.col("end").alias("stop"), "confidence")


def exclusion_filter(spark, sf_dir):
    zones = lambda: F.filter("spans", lambda s: s["confidence"] >= 0.8)
    rows = _groups(spark, sf_dir).select("grp", spans.outside(F.filter("spans", lambda s: s["confidence"] < 0.8), zones()).alias("spans"))
    return detect.explode(rows, ["grp"]).select("grp", "start", F.col("end").alias("stop"))


def threshold_split(spark, sf_dir):
    rows = detect.split_by_confidence(_groups(spark, sf_dir))
    return rows.select("grp", F.size("sure").cast("long").alias("n_sure"), F.size("unsure").cast("long").alias("n_unsure"))


def slm_verdict_join(spark, sf_dir):
    rows = _groups(spark, sf_dir)
    verdicts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.lit("[0, 2, 99]")).when(F.col("c_custkey") % 3 == 1, F.lit("not json")).alias("verdict"))
    joined = rows.join(verdicts, F.col("grp") == F.col("k"), "left")
    return detect.explode(joined.select("grp", detect.confirmed(F.col("spans"), F.col("verdict")).alias("spans")), ["grp"]).select("grp", "start", F.col("end").alias("stop"))


def resolve_literals(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("the the"), F.lit("of the"), F.lit("on"))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", spans.find_literals(F.col("text"), terms, F.lit("LIT")).alias("spans"))
    return detect.explode(found, ["conv_id", "turn"]).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("sum_start")).withColumnRenamed("text", "term")


def classify_pii(spark, sf_dir):
    return fixture_rows(spark, sf_dir).select("n", "expected", detect.classify(F.col("text")).alias("kind"))


# ---------------------------------------------------------------- pseudonyms and vault
def token_ids(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tokens.token_id(F.col("conv_id"), F.col("turn")).alias("token_id"))


def xml_tokens(spark, sf_dir):
    v = _vault(spark, sf_dir)
    return v.select("conv_id", "ordinal", tokens.markup(F.col("token_id"), F.col("display_value")).alias("token"))


def vault_seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tokens.vault_seed(F.col("c_custkey")).cast("string").alias("seed"))


def vault_first_seen(spark, sf_dir):
    return _vault(spark, sf_dir).select("conv_id", "ordinal", "original", "entity")


def synth_format(spark, sf_dir):
    rows = fixture_rows(spark, sf_dir).withColumn("ordinal", F.col("n") % 7)
    return rows.select("n", "expected", surrogate("n", "ordinal", "expected", "text").alias("synthetic"))


def mask_documents(spark, sf_dir):
    docs = detect.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    masked = pseudonymize.rewrite(docs, docs, ["doc_id"], form="label")
    return masked.where(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.sha2("masked", 256).alias("masked_sha256"))


def mask_messages(spark, sf_dir):
    rows = _detected(spark, sf_dir)
    return pseudonymize.rewrite(rows, _vault(spark, sf_dir, rows), ["conv_id", "turn"], form="bare").select("conv_id", "turn", F.sha2("masked", 256).alias("masked_sha256"))


def restore_roundtrip(spark, sf_dir):
    """Messages masked in both forms and restored, in one pass each."""
    rows = _detected(spark, sf_dir)
    v = _vault(spark, sf_dir, rows)
    masked = pseudonymize.rewrite_forms(rows, v, ["conv_id", "turn"], {"bare": "bare", "xml": "xml"})
    form = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("masked")) for f in ("bare", "xml")]))
    both = masked.select("conv_id", "turn", F.sha2("text", 256).alias("sha"), form.alias("f")).select("conv_id", "turn", "sha", "f.*")
    both = both.withColumn("changed", F.sha2("masked", 256) != F.col("sha"))
    back = restore.terms.restored(both, v, ["conv_id", "turn", "form", "sha", "changed"])
    return back.select("conv_id", "turn", "form", (F.sha2("restored", 256) == F.col("sha")).alias("equal"), "changed")


def cascade_levels(spark, sf_dir):
    """How tokens of five kinds are restored: whole, with another text, another id, both, and without an id."""
    v = cut(_vault(spark, sf_dir))
    by = restore.maps(v).withColumnRenamed("conv_id", "c")
    kind = F.col("conv_id") % 5
    tid = F.when(kind == 3, F.lit("????")).when(kind == 2, F.lit("zzzz")).otherwise(F.col("token_id"))
    shown = F.when(kind.isin(1, 3), F.lit("something else")).otherwise(F.col("display_value"))
    token = F.when(kind == 4, F.concat(F.lit("<pii>"), F.col("display_value"), F.lit("</pii>"))).otherwise(tokens.markup(tid, shown))
    rows = v.select("conv_id", "original", token.alias("token")).join(by, F.col("conv_id") == F.col("c"))
    level = restore.level(F.col("token"), F.col("token_id_map"), F.col("display_value_map")).cast("long")
    back = restore.restore(F.col("token"), F.col("token_id_map"), F.col("display_value_map"), F.create_map().cast("map<string,string>"))
    return rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(back == F.col("original")).alias("n_original"), F.count_if(back == F.col("token")).alias("n_unchanged"))


def leftmost_longest(spark, sf_dir):
    mapping = F.create_map(*[F.lit(x) for x in ("the", "<1>", "the th", "<2>", "th", "<3>", "of", "<4>")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(spans.replace_literals(F.col("text"), mapping), 256).alias("sha"))


def vault_merge(spark, sf_dir):
    v = _vault(spark, sf_dir).select("conv_id", "original", "ordinal")
    into, other = v.where("conv_id % 2 = 0"), v.where("conv_id % 2 = 1")
    return pseudonymize.merge_vaults(into, other, F.col("conv_id") - 1)


def vault_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conv_id"), F.col("l_partkey").alias("original"), F.col("l_linenumber").alias("version"))
    return pseudonymize.latest(rows, ["conv_id"], "version")


def vault_dedup(spark, sf_dir):
    return audit.vault_view(_vault(spark, sf_dir)).select("conv_id", "pii_type", "masked", "synthetic", "percent")


def not_synthetic(spark, sf_dir):
    v = _vault(spark, sf_dir)
    seen = v.select("conv_id", F.col("original").alias("text")).unionByName(v.where("ordinal % 2 = 0").select("conv_id", F.col("synthetic").alias("text")))
    return pseudonymize.not_synthetic(seen, v).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- text projections
def _raw_headers(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("POST /v1 HTTP/1.1\r\nHost: api.example.com\r\nAuthorization: Bearer t"), k, F.lit("\r\nX-Api-Key:  k"), k, F.lit("\r\nAccept: */*")).alias("raw"))


def header_redact(spark, sf_dir):
    return _raw_headers(spark, sf_dir).select("c_custkey", audit.redact_headers(F.col("raw")).alias("safe"))


def hex_preview(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", audit.hex_preview(F.encode("c_name", "utf-8"), 8).alias("hex"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(audit.html_escape(F.col("html")), 256).alias("sha"))


def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", audit.preview(F.col("text")).alias("shown"))


def highlight(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("there"), F.lit("of"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(audit.highlight(F.col("text"), terms), 256).alias("sha"))


def provider_from_host(spark, sf_dir):
    host = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("api.anthropic.com", "api.openai.com", "eu.googleapis.com", "example.org")]), (F.col("page_id") % 4 + 1).cast("int")), F.lit(""))
    own = F.parse_url("url", F.lit("HOST"))
    rows = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), own.alias("page_host"))
    return rows.select("page_id", "page_host", chat.provider(F.col("host")).alias("provider"), chat.intercepted(F.col("host")).alias("intercepted"))


def query_limit(spark, sf_dir):
    path = F.concat(F.lit("/api/conversations?limit="), F.when(F.col("c_custkey") % 3 == 0, F.lit("x")).otherwise(F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.least(F.coalesce(audit.query_limit(path), F.lit(50)), F.lit(200)).cast("long").alias("limit_used"))


# ---------------------------------------------------------------- chat
def _bodies(spark, sf_dir):
    """A request per conversation and provider shape, built from its turns."""
    c = table(spark, sf_dir, "conversations")
    said = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    openai = F.to_json(F.struct(F.lit("gpt-x").alias("model"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    blocks = F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"), F.lit(None).cast("string").alias("thinking")), F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("hm").alias("thinking")), F.struct(F.lit("image").alias("type"), F.lit("no").alias("text"), F.lit(None).cast("string").alias("thinking"))).alias("content")))
    anthropic = F.to_json(F.struct(F.lit("claude-x").alias("model"), F.when(F.col("conv_id") % 2 == 0, F.lit("be brief")).alias("system"), blocks.alias("messages")))
    google = F.to_json(F.struct(F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(x["text"].alias("text")), F.struct(F.lit("!").alias("text"))).alias("parts"))).alias("contents")))
    return said.select("conv_id", openai.alias("openai"), anthropic.alias("anthropic"), google.alias("google"))


def _parsed(spark, sf_dir, name):
    rows = _bodies(spark, sf_dir).select("conv_id", chat.parse(F.lit(name), F.col(name)).alias("p"))
    return rows.select("conv_id", F.col("p.model").alias("model"), F.posexplode("p.messages").alias("idx", "x")).select("conv_id", "model", F.col("idx").cast("long").alias("idx"), F.col("x.role").alias("role"), F.col("x.content").alias("content"))


def parse_openai(spark, sf_dir):
    return _parsed(spark, sf_dir, "openai")


def parse_anthropic(spark, sf_dir):
    return _parsed(spark, sf_dir, "anthropic")


def parse_google(spark, sf_dir):
    return _parsed(spark, sf_dir, "google")


def message_entries(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("conv_id", F.explode(chat.entries(F.col("anthropic"))).alias("e"))
    return rows.select("conv_id", F.col("e.msg_idx").cast("long").alias("msg_idx"), F.col("e.part_idx").cast("long").alias("part_idx"), F.col("e.text").alias("text"))


def inject_reminder(spark, sf_dir):
    rows = _bodies(spark, sf_dir).select("conv_id", chat.remind(F.lit("anthropic"), chat.parse_anthropic(F.col("anthropic")), chat.system_kind(F.col("anthropic")), "keep tokens").alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("first_content"))


def fingerprint(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by(F.struct("role", "text"), "turn").alias("f"))
    return first.select("conv_id", tokens.fingerprint(F.col("f.role"), F.col("f.text")).alias("fingerprint"))


def _streams(spark, sf_dir):
    """A server-sent event body for each assistant message: usage, two deltas, the end, and an open tail."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    data = lambda t: F.to_json(F.struct(F.struct(F.lit("text_delta").alias("type"), t.alias("text")).alias("delta")))
    begin = F.to_json(F.struct(F.struct(F.struct(F.col("conv_id").alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("usage")).alias("message")))
    usage = F.to_json(F.struct(F.struct(F.length("text").alias("output_tokens")).alias("usage")))
    line = lambda e, d: F.concat(F.lit(f"event: {e}\ndata: "), d, F.lit("\n\n"))
    body = F.concat(
        F.lit(": comment\n\n"), line("message_start", begin), line("content_block_delta", data(F.substring("text", 1, 10))), line("content_block_delta", data(F.substring("text", 11, 1 << 30))),
        F.lit("id: 5\nretry: 1\n\n"), line("message_delta", usage), line("message_stop", F.lit("{}")), line("content_block_delta", data(F.lit("late"))), F.lit("event: open\ndata: x"),
    )
    return c.select("conv_id", "turn", F.lit("anthropic").alias("provider"), body.alias("body"))


def sse_blocks(spark, sf_dir):
    rows = sse.rows(_streams(spark, sf_dir))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("data")).alias("n_chars"))


def sse_assemble(spark, sf_dir):
    return sse.assemble(sse.rows(_streams(spark, sf_dir)), ["conv_id", "turn"]).select("conv_id", "turn", "text")


def token_usage(spark, sf_dir):
    return sse.assemble(sse.rows(_streams(spark, sf_dir)), ["conv_id", "turn"]).select("conv_id", "turn", "tokens_in", "tokens_out")


def sse_rewrite(spark, sf_dir):
    rows = sse.rows(_streams(spark, sf_dir)).where("event_type = 'content_block_delta'")
    new = chat.rewrite_delta(F.col("provider"), F.col("data"), F.lit('a "quoted" word'))
    return rows.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.get_json_object(new, "$.delta.text").alias("text"), sse.serialize(F.lit("x"), F.lit("y")).alias("event"))


# ---------------------------------------------------------------- audit
def new_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    stored = c.groupBy("conv_id").agg(F.min("turn").alias("x")).select("conv_id", (F.col("conv_id") % 3).alias("n_stored"))
    return store.new_messages(c.select("conv_id", "turn", "role"), stored)


def turns(spark, sf_dir):
    return audit.turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "turn_no", "turn_label")


def turn_detections(spark, sf_dir):
    return audit.turn_detections(audit.turns(messages(spark, sf_dir)), _vault(spark, sf_dir))


def conv_summary_rollup(spark, sf_dir):
    return audit.summary(_found(spark, sf_dir), ["conv_id", "entity"])


def compare_view(spark, sf_dir):
    rows = detect.detect(messages(spark, sf_dir))
    masked = spans.replace(F.col("text"), F.col("spans"), lambda s: audit.label(s["entity"]))
    m = rows.select("conv_id", "turn", F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, masked).alias("content_masked"), F.when(F.col("turn") % 3 == 0, F.lit(False)).when(F.col("turn") % 3 == 1, F.lit(True)).alias("pii_processed"), masked.alias("approximate_mask"))
    return audit.compare(m).select("conv_id", "turn", F.sha2("sent", 256).alias("sent"), F.sha2("model_saw", 256).alias("model_saw"), "approximate")


def _conversations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("started_at"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("model"), F.lit(None).cast("string").alias("client_hint"))


def list_recent(spark, sf_dir):
    return store.recent(_conversations(spark, sf_dir), 500).select("id", "started_at")


def conv_search(spark, sf_dir):
    return audit.search(_conversations(spark, sf_dir), "URGENT").select("id", "provider")


def rotate_retention(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    kept = store.retain(c, F.lit("1998-01-01").cast("date"), 30)
    return kept.groupBy(F.substring("started_at", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"))


def export_nested(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    heads = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("conv_id").cast("string").alias("id"), F.lit("2024-01-01").alias("started_at"))
    m = c.where("conv_id % 5 <> 0").select(F.col("turn"), F.col("conv_id").cast("string").alias("conversation_id"), "role", F.col("text").alias("content"))
    out = store.export(heads, m)
    return out.select("id", F.get_json_object("json", "$.conversation.id").alias("conversation"), F.get_json_object("json", "$.messages[0].role").alias("first_role"), F.get_json_object("json", "$.messages[1].content").alias("second_content"))


def detection_lookup(spark, sf_dir):
    found = _found(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("entity").alias("entity_type"))
    m = messages(spark, sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("conversation_id"))
    return store.detections_of(found, m, 3).select("message_id", "entity_type")


def ttl_evict(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_used"))
    return audit.idle(last, F.lit("2024-01-31 00:00:00").cast("timestamp"), "24 hours").select("user_id")


def benchmark_prf(spark, sf_dir):
    """Scores over all rows, against labels of which some were given wrong on purpose."""
    rows = fixture_rows(spark, sf_dir)
    wrong = F.when(F.col("n") % 9 == 0, F.lit("EMAIL")).when(F.col("n") % 9 == 1, F.lit("NEVER_FOUND")).otherwise(F.col("expected"))
    found = detect.explode(detect.detect(rows, locale_col="locale"), ["n"]).select("n", "entity")
    return evaluate.scores(rows.select("n", wrong.alias("entity")), found, ["n"])


def doc_label_audit(spark, sf_dir):
    """Detections among labelled documents: how many toxic and low-quality ones hold personal data."""
    docs = detect.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", (F.size("spans") > 0).alias("has"))
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("has").alias("n_with"))


# ---------------------------------------------------------------- streaming
def events_tumbling(spark, sf_dir):
    out = windows.tumbling(table(spark, sf_dir, "events"), ["event_type"], "1 hour")
    return out.select("window_start", "event_type", "n", F.round("sum_value", 2).alias("sum_value"))


def events_sliding(spark, sf_dir):
    return windows.sliding(table(spark, sf_dir, "events"), ["event_type"], "2 hours", "1 hour").select("window_start", "event_type", "n")


def events_session(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "30 minutes").select("user_id", "window_start", "window_end", "n")


def deltas(spark, sf_dir, size: int = 7, tail: str = "", ends: bool = True):
    """Rows for restore_stream: vaults, and masked replies, with a tail, cut into deltas of so many characters."""
    rows = _detected(spark, sf_dir)
    v = cut(_vault(spark, sf_dir, rows))
    masked = pseudonymize.rewrite(rows, v, ["conv_id", "turn"], form="xml").withColumn("masked", F.concat("masked", F.lit(tail)))
    known = F.to_json(F.struct(F.col("token_id_map").alias("by_id"), F.col("display_value_map").alias("by_display"), F.col("synthetic_map").alias("by_synthetic")))
    none = lambda kind: F.lit(None).cast(kind)
    vaults = restore.maps(v).select("conv_id", none("long").alias("response_id"), none("long").alias("seq"), none("string").alias("delta"), none("boolean").alias("end"), known.alias("vault"))
    n = F.ceil(F.greatest(F.length("masked"), F.lit(1)) / size).cast("int")
    pieces = masked.select("conv_id", F.col("turn").cast("long").alias("response_id"), "masked", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    end = (F.col("i") == F.col("n") - 1) if ends else F.lit(False)
    cuts = pieces.select("conv_id", "response_id", F.col("i").cast("long").alias("seq"), F.substring(F.col("masked"), F.col("i") * size + 1, F.lit(size)).alias("delta"), end.alias("end"), none("string").alias("vault"))
    return vaults.unionByName(cuts)


def together(parts: DataFrame) -> DataFrame:
    """(conv_id, response_id, restored): the texts of a response in order."""
    return parts.groupBy("conv_id", "response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("restored"))


def stream_restore(spark, sf_dir):
    """Masked replies cut into deltas of seven characters, restored by the stateful stream, put together again."""
    from ..streaming.restore import restore_stream

    parts = together(run_stream(spark, deltas(spark, sf_dir), restore_stream))
    said = messages(spark, sf_dir).select("conv_id", F.col("turn").alias("response_id"), "text")
    return said.join(parts, ["conv_id", "response_id"], "left").select("conv_id", "response_id", (F.col("restored") == F.col("text")).alias("equal"))


QUERIES = {
    f.__name__: f
    for f in (
        pii_audit, t1_spans, t1_spans_by_locale, overlap_priority, luhn_validate, ipv6_validate, cpf_validate, merge_confidence, exclusion_filter, threshold_split,
        slm_verdict_join, resolve_literals, classify_pii, token_ids, xml_tokens, vault_seeds, vault_first_seen, synth_format, mask_documents, mask_messages,
        restore_roundtrip, cascade_levels, leftmost_longest, vault_merge, vault_latest, vault_dedup, not_synthetic, header_redact, hex_preview, html_escape,
        preview, highlight, provider_from_host, query_limit, parse_openai, parse_anthropic, parse_google, message_entries, inject_reminder, fingerprint,
        sse_blocks, sse_assemble, token_usage, sse_rewrite, new_messages, turns, turn_detections, conv_summary_rollup, compare_view, list_recent,
        conv_search, rotate_retention, export_nested, detection_lookup, ttl_evict, benchmark_prf, doc_label_audit, events_tumbling, events_sliding, events_session,
        stream_restore,
    )
}
