import json

import pytest
from pyspark.sql import functions as F

from spanguard.operators import audit, evaluate
from spanguard.sources import chat, config, sse, store


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_parsers_and_their_failures(spark):
    blocks = [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "f", "input": {"a": 1}}, {"type": "tool_result", "content": [{"type": "text", "text": "ok"}]}, {"type": "tool_result", "content": ""}, {"type": "image"}]
    body = json.dumps({"model": "m", "system": "s", "messages": [{"role": "user", "content": blocks}, {"content": "x"}]})
    got = one(spark, chat.parse_anthropic(F.lit(body)))
    assert [(m.role, m.content) for m in got.messages] == [("system", "s"), ("user", 'hi[thinking] hm[f] {"a":1}[result] ok'), ("user", "x")]
    assert one(spark, chat.parse_openai(F.lit("{not json"))) is None
    assert one(spark, chat.parse_openai(F.lit('{"messages": []}'))) is None
    assert one(spark, chat.parse_openai(F.lit('{"model": "m"}'))) is None
    got = one(spark, chat.parse_google(F.lit('{"contents": [{"role": "user", "parts": [{"text": "a"}, {"x": 1}, {"text": "b"}]}]}')))
    assert got.model == "gemini" and got.messages[0].content == "ab"
    got = one(spark, chat.parse(F.lit("unknown"), F.lit('{"model": "m", "messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "image"}]}]}')))
    assert got.messages[0].content == "p"


def test_reminder(spark):
    body = F.lit('{"model": "m", "messages": [{"role": "user", "content": "x"}]}')
    put = lambda name, b, kind=None: one(spark, chat.remind(F.lit(name), chat.parse(F.lit(name), b), kind if kind is not None else chat.system_kind(b), "R"))
    assert [m.role for m in put("openai", body)] == ["system", "user"]
    assert [m.role for m in put("google", F.lit('{"contents": [{"parts": [{"text": "x"}]}]}'))] == ["user"]
    odd = F.lit('{"model": "m", "system": [1], "messages": [{"role": "user", "content": "x"}]}')
    assert [m.role for m in put("anthropic", odd)] == ["user"]


def test_sse(spark):
    body = "event: a\r\ndata: 1\r\ndata: 2\r\n\r\n: note\n\nid: 3\n\ndata: [DONE]\n\nevent: open\ndata: x"
    got = one(spark, sse.events(F.lit(body)))
    assert [(e.event_type, e.data) for e in got] == [("a", "1\n2"), (None, "[DONE]")]
    assert one(spark, chat.done(F.lit(None).cast("string"), F.lit(" [DONE] "))) is True
    assert one(spark, sse.trailing(F.lit("google"), F.lit("x"))) is None
    text = one(spark, sse.trailing(F.lit("anthropic"), F.lit('q"')))
    assert json.loads(text.split("data: ")[1])["delta"]["text"] == 'q"'


def test_assembly_stops_at_the_end_and_at_the_most(spark):
    d = lambda t: json.dumps({"choices": [{"delta": {"content": t}}]})
    rows = [(1, "openai", i, None, x) for i, x in enumerate([d("ab"), d("cd"), d("ef"), "[DONE]", d("no")])]
    parts = spark.createDataFrame(rows, "r int, provider string, seq int, event_type string, data string")
    assert sse.assemble(parts, ["r"]).first().text == "abcdef"
    assert sse.assemble(parts, ["r"], most=3).first().text == "abcd"


def test_ndjson_store(spark, tmp_path):
    lines = [
        json.dumps({"id": "c1", "started_at": "2024-01-02T00:00:00Z", "provider": "openai"}),
        json.dumps({"id": "m1", "conversation_id": "c1", "direction": "request", "timestamp": "t", "content": "hello", "role": "user"}),
        "not valid json at all{{{{",
        "",
        json.dumps({"type": "vault", "rng_seed": 18446744073709551615, "mappings": [{"original": "a", "synthetic": "b", "pii_type": "EMAIL"}]}, separators=(",", ":")),
        json.dumps({"type": "detection", "message_id": "m1", "entity_type": "EMAIL", "original_masked": "[EMAIL]", "synthetic": "b", "tier": 1, "confidence": 1.0}, separators=(",", ":")),
        json.dumps({"id": "m2", "conversation_id": "c1", "direction": "response", "timestamp": "t", "content": "yo"}),
    ]
    (tmp_path / "20240102_c1.ndjson").write_text("\n".join(lines))
    got = store.read_ndjson(spark, str(tmp_path))
    assert [r.id for r in got["messages"].orderBy("line_no").collect()] == ["m1", "m2"]
    v = got["vaults"].first()
    assert int(v.rng_seed) == 2**64 - 1 and v.mappings[0].token_id is None
    assert got["detections"].count() == 1 and got["conversations"].first().provider == "openai"
    heads = got["conversations"].drop("file", "line_no")
    doc = json.loads(store.export(heads, got["messages"].drop("file")).first().json)
    assert doc["conversation"]["id"] == "c1" and len(doc["messages"]) == 2
    store.write_conversations(heads, str(tmp_path / "conv"))
    store.append_messages(got["messages"], heads.where("id = 'zz'"), str(tmp_path / "msg"))
    assert spark.read.parquet(str(tmp_path / "conv")).count() == 1
    assert spark.read.schema(got["messages"].schema).parquet(str(tmp_path / "msg")).count() == 0
    assert store.retain(heads, F.lit("2024-01-03").cast("date"), 1).count() == 1
    assert store.retain(heads, F.lit("2024-01-03").cast("date"), 0).count() == 0
    assert v.conversation_id == "c1" == got["detections"].first().conversation_id


def test_a_large_store_file_is_read_in_several_tasks(spark, tmp_path):
    """One file of two conversations: its lines stay in order over the blocks, and each is read once."""
    said = lambda c, i: json.dumps({"id": f"{c}-{i}", "conversation_id": c, "direction": "request", "timestamp": "t", "content": f"{i} " + "x" * 300})
    head = lambda c: json.dumps({"id": c, "started_at": "2024-01-02T00:00:00Z", "provider": "openai"})
    lines = [head("a"), *(said("a", i) for i in range(2000)), head("b"), *(said("b", i) for i in range(2000)), head("a").replace("openai", "late")]
    (tmp_path / "all.ndjson").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = store.read_ndjson(spark, str(tmp_path))
        assert got["messages"].rdd.getNumPartitions() > 5
        rows = got["messages"].orderBy("file", "line_no").select("id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in rows] == [f"{c}-{i}" for c in "ab" for i in range(2000)]
    assert sorted((r.id, r.provider) for r in got["conversations"].collect()) == [("a", "openai"), ("b", "openai")]


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[pii]\nmode = "off"\n[pii.tiers]\nner = true\n')
    assert config.load(str(path))["pii"]["mode"] == "off" and config.load(str(tmp_path / "none"))["pii"]["mode"] == "replace"
    base = {"a": {"b": 1, "c": 2}}
    assert config.merge(base, {"a": {"b": 1, "c": 3}, "d": 4}) == ["a.c", "d"]
    assert config.dotted("a.b", "true") == {"a": {"b": True}} and config.dotted("a", "x") == {"a": "x"} and config.dotted("a", "7") == {"a": 7}
    for level in config.LEVELS:
        made = config.load(str(tmp_path / "none"))
        config.merge(made, config.level_patch(level))
        assert config.level_of(made) == level
    assert config.level_of({"pii": {"mode": "replace", "tiers": {"regex": True, "ner": False, "slm": True}}}) == "off"
    with pytest.raises(ValueError):
        config.validate({"pii": {"tiers": {"ner": True, "regex": False}}})


def test_audit_helpers(spark):
    assert one(spark, audit.redact_headers(F.lit("A: b\r\nauthorization:  secret\r\nC: d"))) == "A: b\r\nauthorization: [REDACTED]\r\nC: d"
    assert one(spark, audit.hex_preview(F.encode(F.lit("abc"), "utf-8"), 2)) == "61 62... (3 bytes)"
    assert one(spark, audit.query_limit(F.lit("/x?limit=7"))) == 7 and one(spark, audit.query_limit(F.lit("/x?limit=a"))) is None
    masks = F.create_map(F.lit("ab"), F.lit("1"), F.lit("abc"), F.lit("2"))
    assert one(spark, audit.naive_mask(F.lit("abc ab"), F.array(F.lit("ab"), F.lit("abc")), masks)) == "2 1"
    assert one(spark, audit.percent(F.lit(0.125))) == 13
    assert one(spark, audit.highlight(F.lit("a<b the"), F.array(F.lit("the")))) == 'a&lt;b <mark class="pii">the</mark>'


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "n int, entity string")
    some = spark.createDataFrame([(1, "A")], "n int, entity string")
    assert evaluate.scores(some, none, ["n"]).first().f1 == 0.0
    assert evaluate.detection_rate(some, some, ["n"]).first().rate == 100.0


def test_places_and_splices():
    import json
    import random

    from spanguard.sources import splice

    rnd = random.Random(5)

    def made(depth):
        kind = rnd.randrange(8 if depth else 5)
        if kind < 5:
            return rnd.choice([None, True, -1.5e3, 7, "a\n\"é\\", "", "x]}", "😀"])
        if kind < 7:
            return [made(depth - 1) for _ in range(rnd.randrange(4))]
        return {rnd.choice(["role", "content", "text", 'q"', "é"]): made(depth - 1) for _ in range(rnd.randrange(4))}

    def reach(value, path):
        for k in path:
            value = value[k]
        return value

    for _ in range(400):
        value = made(4)
        body = json.dumps(value, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1, "\t"]))
        for path, (s, e) in splice.places(body).items():
            assert json.loads(body[s:e]) == reach(value, path)
    for bad in ("", "{", "[1", '{"a" 1}', '{"a":}', "[1 2]", '"open', '{1:2}', "[" * 100_000):
        assert splice.put_texts(bad, {"0": "x"}, "messages") == bad and splice.put_reminder("openai", bad, "R") == bad
    body = '{ "n":1.0,"messages":[{"content":"a"},{"content":[{"type":"text","text":"b\\u00e9"},{"text":3}]}] ,"z":[]}'
    new = splice.put_texts(body, {"0": 'A"', "1/0": "B", "1/1": "no", "2": "no", "1": "no"}, "messages")
    assert new == body.replace('"a"', '"A\\""').replace('"b\\u00e9"', '"B"')
    assert splice.put_texts(body, {"0": "a", "1/0": "bé"}, "messages") == body
    for name, b, want in [
        ("anthropic", "{}", '{"system":"<system-reminder>\\nR\\n</system-reminder>"}'),
        ("anthropic", '{"system":null}', '{"system":"<system-reminder>\\nR\\n</system-reminder>"}'),
        ("anthropic", '{"system":[]}', '{"system":[]}'),
        ("openai", '{"messages":[]}', '{"messages":[{"role":"system","content":"<system-reminder>\\nR\\n</system-reminder>"}]}'),
        ("openai", '{"messages":[{"role":"system","content":[]}]}', '{"messages":[{"role":"system","content":[]}]}'),
        ("openai", '{"model":1}', '{"model":1}'),
        ("google", '{"contents":[]}', '{"contents":[]}'),
    ]:
        assert splice.put_reminder(name, b, "R") == want


def test_one_parse_for_each_body(spark):
    from pyspark.sql import functions as F

    body = F.concat(F.lit('{"model":"m","messages":[{"role":"a","content":[{"type":"text","text":"x"}]}],"i":'), F.col("id").cast("string"), F.lit("}"))
    rows = spark.range(3).select(body.alias("b")).repartition(2)
    for of in (chat.parse_openai, chat.parse_anthropic, chat.parse_google, chat.entries, lambda b: chat.parse(F.lit("openai"), b)):
        plan = rows.select(of(F.col("b")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1, plan
