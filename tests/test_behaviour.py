"""Values at the edges, the same meaning at every size, and plans that do not grow."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from prepflow.functions.datetimes import convert_datetime
from prepflow.operators.charts import heatmap, histogram, waterfall
from prepflow.operators.joins import join_tables
from prepflow.operators.ordering import running_total, sample_rows
from prepflow.operators.reshape import pivot_wide
from prepflow.plans.graph import switched_off
from prepflow.session import MADE_FOLDERS, shared_folder
from prepflow.sources.jdbc import check_query
from prepflow.schema import GuardError


def test_chained_left_joins_read_each_input_once(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    joined, keys = read("lineitem"), [("orders", "l_orderkey", "o_orderkey"), ("part", "l_partkey", "p_partkey"),
                                      ("supplier", "l_suppkey", "s_suppkey"), ("customer", "o_custkey", "c_custkey")]
    for table, left, right in keys:
        joined = join_tables(joined, read(table), left, right, "left")
    plan = joined._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 5 and "Union" not in plan.toString()


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_join_with_a_hot_key(spark, how):
    left = spark.range(400).select(F.when(F.col("id") < 150, 1).when(F.col("id") < 200, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 3, 1).when(F.col("id") < 9, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    out = join_tables(left, right, "k", "k", how, coalesce_keys=True)
    want = {"left": 150 * 3 + 250, "right": 150 * 3 + 297, "full": 150 * 3 + 250 + 297 - 100}[how]
    assert out.count() == want


@pytest.mark.parametrize("odd", [math.nan, math.inf])
def test_running_totals_stay_clean_before_an_odd_value(spark, odd):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, odd), (4, 5.0)], "i int, v double")
    for start in (df, df.orderBy(F.desc("i")), df.filter("i > 2").union(df.filter("i < 3"))):
        got = [r[2] for r in rows(running_total(start, "v", ["i"], "t"), "i")]
        assert got[:2] == [1.0, 3.0] and all(not math.isfinite(x) for x in got[2:])
    steps = rows(waterfall(df, "i", "v"), "i")
    assert [s[2] for s in steps][:3] == [0.0, 1.0, 3.0]
    first = spark.createDataFrame([(1, odd), (2, 1.0)], "i int, v double")
    assert [r[2] for r in rows(waterfall(first, "i", "v"), "i")][0] == 0.0


@pytest.mark.parametrize("n", [5, 40])
def test_a_seed_draws_the_same_rows(spark, monkeypatch, n):
    """For any partitioning, and on both sides of the limit between the two ways."""
    df = spark.range(300).withColumn("x", F.col("id") % 7)
    draws = []
    for limit in (10_000, 3):
        monkeypatch.setattr("prepflow.operators.ordering.TOP_N_LIMIT", limit)
        for parts in (3, 8):
            draws.append(rows(sample_rows(df.repartition(parts), "random", n, seed=9), "id"))
    assert len(draws[0]) == n and all(d == draws[0] for d in draws)


def test_pivot_tells_null_from_its_name(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "null", 7)], "k int, h string, v int")
    with pytest.raises(ValueError, match="both null"):
        pivot_wide(df, "k", "h", "v")
    assert rows(pivot_wide(df.filter("h is null"), "k", "h", "v")) == [(1, 5)]


def test_short_dates(spark):
    df = spark.createDataFrame([("5/3/2024",), ("15/03/2024",), ("5/13/2024",)], "t string")
    out = convert_datetime(df, "t", custom_format="%d/%m/%Y", format="Custom", output_column="d")
    assert [str(r[1])[:10] for r in rows(out, "t")] == ["2024-03-15", "None", "2024-03-05"]


def test_charts_over_dates_and_texts(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-11", 2), ("b", None, 3)], "t string, d string, v int")
    df = df.withColumn("d", F.to_date("d"))
    bins = rows(histogram(df, "d", 2), "bin")
    assert [(str(b[1]), str(b[2]), b[3]) for b in bins] == [
        ("2024-01-01 00:00:00", "2024-01-06 00:00:00", 1), ("2024-01-06 00:00:00", "2024-01-11 00:00:00", 1)]
    assert rows(histogram(df, "t"), "bin") == [("a", "a", "a", 2), ("b", "b", "b", 1)]
    assert rows(heatmap(df, "t", "v", y_bins=2), "x_bin", "y_bin") == [("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]


def test_containers_inside_containers():
    nodes = [{"id": "a", "type": "container", "data": {"enabled": False}}, {"id": "b", "type": "container", "parentId": "a"},
             {"id": "c", "parentId": "b"}, {"id": "d"}]
    assert switched_off(nodes) == {"a", "b", "c"}


def test_query_words_in_quotes_and_comments():
    assert check_query("select 'it''s; drop' as x -- delete\n from t /* update; */")
    for bad in ("select 1; select 2", "drop table t", "select 1 /* x */ delete"):
        with pytest.raises(GuardError):
            check_query(bad)


def test_scratch_folder_without_a_setting(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf, sparkContext = Conf, spark.sparkContext

    made = shared_folder(Session)
    assert made == shared_folder(Session) == MADE_FOLDERS.pop(spark.sparkContext.applicationId)
