"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from spanguard.plans import more, oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or pd.api.types.is_scalar(v) and pd.isna(v):
            return "null"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return [list(df.columns), *sorted(tuple(one(v) for v in row) for row in df.itertuples(index=False))]


QUERIES, SQL = queries.QUERIES | more.QUERIES, oracle.SQL | more.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(SQL[name]).fetchdf())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL) and not set(queries.QUERIES) & set(more.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_surrogates_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(more, "SURROGATES", 10 * len(more.FORMATS))
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    out = more.synth_distinct(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-customers // 10)}), REPARTITION_BY_NUM" in plan and customers > 40
    assert {(r.n, r.n_distinct, r.n_formed) for r in out.collect()} == {(customers, customers, customers)}


def test_customers_are_dealt_over_all_cores(spark, monkeypatch):
    from spanguard import session

    assert spark.read.parquet(f"{SF}/customer.parquet").rdd.getNumPartitions() == 1
    assert session.table(spark, SF, "customer").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS", 10)
    assert session.table(spark, SF, "customer").rdd.getNumPartitions() == -(-session.table(spark, SF, "customer").count() // 10)


def test_surrogates_are_searched_in_tasks_of_bounded_size(spark, monkeypatch):
    from spanguard import session

    monkeypatch.setattr(session, "ROWS", 10, raising=False)
    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    out = more.synth_not_found_again(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert f"({-(-customers // 10)}), REPARTITION_BY_NUM" in plan and customers > 40
    assert {r.entity: r.n_again for r in out.collect()} == {"PHONE": 0, "IP_V6": 0, "CREDIT_CARD": customers}
