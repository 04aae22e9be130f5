"""Running sums over keys that are dealt over several tasks."""

import random

from pyspark.sql import functions as F

from spanguard.operators import audit, running
from spanguard.sources import store


def test_equal_to_plain_sums(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), i, rnd.choice([0, 1, 5, None]), "x") for i in range(600)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, at int, v int, n string")
    want, total = set(), {}
    for k, at, v, _ in sorted(rows, key=lambda r: r[1]):
        s, c = total.get(k, (0, 0))
        total[k] = s + (v or 0), c + 1
        want.add((k, at, *total[k]))
    for size in (running.SMALL_BYTES, -1):
        monkeypatch.setattr(running, "SMALL_BYTES", size)
        got = running.running(df, "k", "at", {"sum": F.col("v"), "count": F.lit(1)})
        assert got.columns == ["k", "at", "v", "n", "sum", "count"]
        assert {(r.k, r.at, r["sum"], r["count"]) for r in got.collect()} == want and got.count() == 600
        assert running.running(df.where("1 = 0"), "k", "at", {"sum": F.col("v")}).count() == 0


def test_a_long_conversation_is_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(running, "SMALL_BYTES", -1)
    tasks = []
    monkeypatch.setattr(running, "cut", lambda df: _kept(df, tasks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 200_000
        said = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 4 = 0 THEN 'user' ELSE 'assistant' END AS role", "'t' AS text")
        out = audit.turns(said).agg(F.count(F.lit(1)).alias("n"), F.max("turn_no").alias("last"), F.count_if(F.col("turn_no") != F.floor(F.col("turn") / 4)).alias("wrong")).first()
        assert tuple(out) == (n, n // 4 - 1, 0)
        kept = store.new_messages(said, spark.createDataFrame([(1, n - 3)], "conv_id long, n_stored long"))
        assert sorted(r.turn for r in kept.collect()) == [n - 3, n - 2, n - 1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(t) > 1 and max(t) < 0.7 * n for t in tasks) and len(tasks) == 2


def _kept(df, tasks):
    from spanguard.session import cut

    out = cut(df)
    tasks.append([r["count"] for r in out.groupBy("__part").count().collect()])
    return out
