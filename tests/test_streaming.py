"""Stateful streams: restoring with the vault in state, chunks of event bodies, live counts."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanguard.plans.queries import run_stream
from spanguard.sources import sse
from spanguard.functions.restoring import Known, Restorer, restore_text
from spanguard.plans.more import state_rows
from spanguard.streaming.events import Splitter, events_stream, parse_block, parse_bytes
from spanguard.streaming.restore import STATE_PROVIDER, restore_stream

ROWS = "conv_id long, response_id long, seq long, delta string, end boolean, vault string"
VAULT = json.dumps({"by_id": {"t1": "Ann"}, "by_display": {"Xena": "Ann"}, "by_synthetic": {"Xena": "Ann"}})


def together(out):
    rows = out.groupBy("conv_id", "response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("t")).collect()
    return {(r.conv_id, r.response_id): r.t for r in rows}


def test_vault_in_state_and_order_of_deltas(spark):
    text = 'Dear <pii id="t1">Xena</pii>, <pii>Xena</pii> and Xena'
    parts = [text[i : i + 4] for i in range(0, len(text), 4)]
    rows = [(1, None, None, None, None, VAULT)] + [(1, 5, i, d, i == len(parts) - 1, None) for i, d in enumerate(parts)]
    rows += [(2, 5, 1, "na", True, None), (2, 5, 0, "Xe", False, None)]
    random.Random(1).shuffle(rows)
    got = together(run_stream(spark, spark.createDataFrame(rows, ROWS), restore_stream))
    assert got == {(1, 5): "Dear Ann, <pii>Xena</pii> and Ann", (2, 5): "Xena"}


def test_later_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    batches = [[(1, None, None, None, None, VAULT), (1, 7, 2, "!", True, None)], [(1, 7, 0, "Xe", False, None)], [(1, 7, 1, "na", False, None)]]
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = restore_stream(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert together(spark.read.parquet(f"{tmp_path}/out")) == {(1, 7): "Ann!"}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_chunks_equal_whole_bodies(spark, size):
    body = ": c\n\nevent: a\ndata: 1é\ndata: 2😀\r\n\r\nid: 3\n\ndata: x\n\n\n\nevent: b\r\ndata: y\r\n\r\ndata: open"
    raw = body.encode()
    chunks = [(1, i, raw[s : s + size], s + size >= len(raw)) for i, s in enumerate(range(0, len(raw), size))]
    random.Random(size).shuffle(chunks)
    got = run_stream(spark, spark.createDataFrame(chunks, CHUNKS), events_stream).orderBy("seq").collect()
    want = spark.createDataFrame([(body,)], "body string").select(F.explode(sse.events(F.col("body"))).alias("e")).select("e.*").collect()
    assert [(r.event_type, r.data) for r in got] == [tuple(r) for r in want] and len(got) == 3


CHUNKS = "stream_id long, chunk long, data binary, end boolean"


def test_blocks():
    assert Splitter().feed(b"a\n\nb\r\n\r\nc") == [b"a", b"b"] and parse_block("event: x") is None
    assert parse_bytes(b"data: \xff") is None and parse_bytes("data: é".encode()) == (None, "é")
    rnd = random.Random(4)
    for _ in range(300):
        raw = b"".join(rnd.choice([b"\n", b"\r\n", b"a", b"data: x", b"\n\n", b"\r", b"\r\n\r\n"]) for _ in range(12))
        want = re.split(rb"\r\n\r\n|\n\n", raw)
        for size in (1, 2, 3, 50):
            s = Splitter()
            out = [x for i in range(0, len(raw), size) for x in s.feed(raw[i : i + size])]
            assert (out, b"".join(s.pieces)) == (want[:-1], want[-1])


def run_batches(spark, folder, batches, schema, of):
    """Each batch through the same checkpoint; all rows that came out."""
    from spanguard.plans.queries import state_provider

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = of(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        with state_provider(spark):
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_open_blocks_and_ended_streams_in_later_batches(spark, tmp_path):
    batches = [[(1, 0, b"data: a", False), (2, 0, b"data: z\n\n", True)], [(1, 1, b"bc\n", False)], [(1, 3, b"data: q\n\n", True)], [(1, 2, b"\nx", False)]]
    got = run_batches(spark, tmp_path, batches, CHUNKS, events_stream).collect()
    assert sorted((r.stream_id, r.seq, r.data) for r in got) == [(1, 0, "abc"), (2, 0, "z")]  # a line "xdata: q" is no data
    assert sum(state_rows(spark, f"{tmp_path}/state", v) for v in ("open", "piece", "early")) == 0


def test_abandoned_streams_go_with_the_watermark(spark, tmp_path):
    at = lambda m: time.strftime("%Y-%m-%d %H:%M:00", time.gmtime(1_700_000_000 + 60 * m))
    batches = [[(1, 0, b"data: a", False, at(0)), (2, 0, b"data: z\n\n", True, at(0))], [(2, 1, b"data: late\n\n", False, at(1)), (3, 0, b"data: b\n\n", False, at(90))], [(3, 1, b"data: c", False, at(91))]]
    of = lambda s: events_stream(s.withColumn("ts", F.to_timestamp("ts")).withWatermark("ts", "1 minute"), idle_ms=600_000)
    got = run_batches(spark, tmp_path, batches, CHUNKS + ", ts string", of).collect()
    assert sorted((r.stream_id, r.data) for r in got) == [(2, "z"), (3, "b")]
    assert state_rows(spark, f"{tmp_path}/state", "open") == 1 and state_rows(spark, f"{tmp_path}/state", "piece") == 1


def test_an_ended_response_is_not_begun_anew(spark, tmp_path):
    batches = [[(1, None, None, None, None, VAULT), (1, 7, 0, "Xena", True, None)], [(1, 7, 0, "Xena", True, None), (1, 7, 2, "x", False, None)]]
    out = run_batches(spark, tmp_path, batches, ROWS, restore_stream)
    assert [(r.response_id, r.text) for r in out.collect()] == [(7, "Ann")]
    assert state_rows(spark, f"{tmp_path}/state", "early") == 0 == state_rows(spark, f"{tmp_path}/state", "open")


def test_open_tokens_over_batches(spark, tmp_path):
    parts = ['a <pii id="t1">Xe', "na, a long", " inner <", "/p", "ii> Xen", "a."]
    batches = [[(1, None, None, None, None, VAULT)], *[[(1, 7, i, d, i == len(parts) - 1, None)] for i, d in enumerate(parts)]]
    assert together(run_batches(spark, tmp_path, batches, ROWS, restore_stream)) == {(1, 7): "a Ann Ann."}
    assert state_rows(spark, f"{tmp_path}/state", "piece") == 0


KNOWN = Known({"t1": "Ann"}, {"Xena": "Ann"}, {"Xena": "Ann", "Xe": "E", "aXa": "Q"})


def test_restoring_is_the_same_however_text_is_cut():
    token = re.compile(r"(?s)(<pii[^>]*>.*?</pii>)")

    def plain(text):  # tokens by a pattern, the rest place by place
        out = ""
        for k, part in enumerate(token.split(text)):
            if k % 2:
                out += KNOWN.token(part)
                continue
            while part:
                hit = next((t for t in ("Xena", "aXa", "Xe") if part.startswith(t)), None)
                out, part = out + (KNOWN.by_synthetic[hit] if hit else part[0]), part[len(hit or "x") :]
        return out

    rnd = random.Random(1)
    for _ in range(1500):
        text = "".join(rnd.choice(["<pii", ' id="t1"', ">", "Xena", "</pii>", "Xe", "na", "aX", "<", "p", "ii", "</", "x", '<pii id="zz">Xena</pii>']) for _ in range(rnd.randint(0, 12)))
        assert restore_text(text, KNOWN) == plain(text)
        for size in (1, 2, 3, 5):
            r = Restorer(KNOWN)
            assert "".join(r.feed(text[i : i + size]) for i in range(0, len(text), size)) + r.finish() == plain(text)


@pytest.mark.parametrize("text", ["<pii id='x'>" + "word Xena " * 100_000, "some Xena text " * 70_000, "<pii " * 200_000])
def test_a_megabyte_in_small_deltas_takes_linear_time(text):
    r, began = Restorer(KNOWN), time.process_time()
    out = [r.feed(text[i : i + 200]) for i in range(0, len(text), 200)]
    assert "".join(out) + r.finish() == text.replace("Xena", "Ann") and time.process_time() - began < 2


def test_an_open_event_of_many_chunks_takes_linear_time():
    s, began = Splitter(), time.process_time()
    raw = b"data: " + b"x" * 4_000_000 + b"\n\n"
    assert [x for i in range(0, len(raw), 500) for x in s.feed(raw[i : i + 500])] == [raw[:-2]] and time.process_time() - began < 2


def test_state_is_forgotten_after_its_time_to_live(spark, tmp_path):
    """A stream that goes on: the vault, set more than ttl_ms before the second delta, no longer counts for it."""
    from spanguard.plans.queries import state_provider, wait_until

    put = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([(1, None, None, None, None, VAULT), (1, 7, 0, "Xena", True, None), (2, None, None, None, None, VAULT)])
    out = restore_stream(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), ttl_ms=2000)
    with state_provider(spark):
        running = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
        rows = lambda seen: sum(p["numInputRows"] for p in seen)
        added = []

        def done(seen):
            if rows(seen) >= 3 and not added:
                time.sleep(4)
                put([(1, 8, 0, "Xena", True, None), (2, 5, 0, "Xena", True, None)])
                added.append(1)
            return rows(seen) >= 5

        wait_until(running, done, 90)
    assert together(spark.read.parquet(f"{tmp_path}/out")) == {(1, 7): "Ann", (1, 8): "Xena", (2, 5): "Xena"}
