"""Running sums over the rows of a key, also of one that has more rows than a task can take.

Rows are dealt by ranges of key and order, so a long key is several tasks. Each sums its own rows; what the tasks before
it have of the same key, one row for each, is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Tables of so many bytes at most, by the optimizer's estimate, are summed by one window for each key.
SMALL_BYTES = 32 << 20


def running(df: DataFrame, by: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """df with a column for each of sums: the sum over the key's rows up to this one. order tells a key's rows apart.

    A null key is a key, null values count as nothing; the new columns' names must not be df's. An empty table gives none.
    """
    values = {c: F.coalesce(v.cast("long"), F.lit(0)) for c, v in sums.items()}
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES:
        return df.select("*", *[F.sum(v).over(up_to(by)).alias(c) for c, v in values.items()])
    dealt = cut(df.select("*", *[v.alias(f"__v_{c}") for c, v in values.items()]).repartitionByRange(by, order).withColumn("__part", F.spark_partition_id()))
    total = dealt.groupBy(F.col(by).alias("__k"), F.col("__part").alias("__p")).agg(*[F.sum(f"__v_{c}").alias(f"__t_{c}") for c in values])
    before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the key
    offset = total.select("__k", "__p", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in values])
    local = dealt.select("*", *[F.sum(f"__v_{c}").over(up_to("__part", by)).alias(f"__l_{c}") for c in values])
    out = local.join(offset, F.col(by).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(c) for c in values])
