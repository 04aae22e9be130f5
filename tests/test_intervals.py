"""Joins of span tables by overlap, against all pairs."""

import random

import pytest

from spanguard.operators import intervals

SPANS = "k long, start int, end int, tag string"


def rows(rnd, n, keys):
    out = []
    for i in range(n):
        s = rnd.randrange(0, 3000)
        out.append((rnd.choice(keys), s, s + rnd.choice([0, 1, 5, 40, 900, -3]), f"t{i % 7}"))
    return out


@pytest.mark.parametrize("width", [1, 16, 256, 100_000])
def test_equal_to_all_pairs(spark, width):
    rnd = random.Random(width)
    left, right = rows(rnd, 60, [1, 1, 1, 2, None]), rows(rnd, 50, [1, 2, 2, 3, None])
    left += left[:3]
    a, b = spark.createDataFrame(left, SPANS), spark.createDataFrame(right, SPANS)
    meet = lambda x, y: x[0] is not None and x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])
    got = sorted((tuple(r.left), tuple(r.right)) for r in intervals.overlapping(a, b, "k", width).collect())
    assert got == sorted((x, y) for x in left for y in right if meet(x, y)) and len(got) > 5
    kept = sorted(map(tuple, intervals.outside(a, b, "k", width).collect()), key=str)
    assert kept == sorted((x for x in left if not any(meet(x, y) for y in right)), key=str)
    assert intervals.overlapping(a, b.where("1 = 0"), "k", width).count() == 0 and intervals.outside(a, b.where("1 = 0"), "k", width).count() == len(left)


def test_no_cartesian_product(spark):
    df = spark.createDataFrame(rows(random.Random(1), 9, [1, 2]), SPANS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (intervals.overlapping(df, df, "k"), intervals.outside(df, df, "k")):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
