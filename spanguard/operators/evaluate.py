"""Quality of detection against expected labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(expected: DataFrame, detected: DataFrame, keys: list[str], entity: str = "entity") -> DataFrame:
    """(entity, tp, fp, fn, precision, recall, f1) over distinct (keys, entity)."""
    on = [*keys, entity]
    want = expected.select(*on).distinct().withColumn("__w", F.lit(1))
    have = detected.select(*on).distinct().withColumn("__h", F.lit(1))
    both = want.join(have, on, "full_outer")
    count = lambda c: F.count_if(c)
    w, h = F.col("__w").isNotNull(), F.col("__h").isNotNull()
    out = both.groupBy(entity).agg(count(w & h).alias("tp"), count(~w & h).alias("fp"), count(w & ~h).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = out.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def detection_rate(expected: DataFrame, detected: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the expected (keys, entity) that was detected, in percent."""
    on = [*keys, "entity"]
    have = detected.select(*on).distinct().withColumn("__h", F.lit(1))
    return expected.select(*on).distinct().join(have, on, "left").agg(F.count(F.lit(1)).alias("total"), F.count("__h").alias("detected"), (100 * F.count("__h") / F.count(F.lit(1))).alias("rate"))
