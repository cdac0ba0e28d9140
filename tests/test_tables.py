"""Joins, unions, duplicates, summaries, pivots, charts."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from prepflow.operators import charts
from prepflow.operators.aggregates import summarize
from prepflow.operators.joins import join_tables
from prepflow.operators.profile import column_profile, preview
from prepflow.operators.quantiles import selected_quantiles
from prepflow.operators.reshape import pivot_wide, unpivot_long
from prepflow.operators.stack import union_tables, unique_rows
from prepflow.schema import SchemaError, semantic_types, tag


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 30), (2, "bb", 40)], "k bigint, v string, w int")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([(2, "B", True), (3, "C", False), (None, "N", True), (2, "BB", True)], "k bigint, v string, f boolean")


def test_inner_and_left(left, right):
    inner = join_tables(left, right, "k", "k", "inner")
    assert inner.columns == ["k", "v", "w", "v_right", "f"]
    assert rows(inner, "w", "v_right") == [
        (2, "b", 20, "B", True), (2, "b", 20, "BB", True), (2, "bb", 40, "B", True), (2, "bb", 40, "BB", True)
    ]
    outer = join_tables(left, right, ["k"], ["k"], "left")
    assert outer.count() == 6
    assert rows(outer.where("w in (10, 30)"), "w") == [(1, "a", 10, None, None), (None, "n", 30, None, None)]


def test_right_keeps_right_keys(left, right):
    out = join_tables(left, right, "k", "k", "right")
    assert out.columns == ["v", "w", "k", "v_right", "f"]
    assert rows(out.where("w is null"), "v_right") == [(None, None, 3, "C", False), (None, None, None, "N", True)]


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_outer_joins_match_native_ones(left, right, how):
    """Same rows as Spark's own join, with each input in the plan once."""
    l, r = left.alias("l"), right.alias("r")
    native = l.join(r, F.col("l.k") == F.col("r.k"), how).select("l.v", "l.w", F.col("r.v").alias("rv"), "r.f")
    out = join_tables(left, right, "k", "k", how).select("v", "w", "v_right", "f")
    assert sorted(map(str, rows(out))) == sorted(map(str, rows(native)))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_full_equals_native_full(left, right):
    out = join_tables(left, right, "k", "k", "outer")
    assert out.columns == ["k", "v", "w", "k_right", "v_right", "f"]
    l, r = left.alias("l"), right.alias("r")
    native = l.join(r, F.col("l.k") == F.col("r.k"), "full").select("l.*", "r.*")
    assert sorted(map(str, rows(out))) == sorted(map(str, rows(native)))
    one = join_tables(left, right, "k", "k", "full", coalesce_keys=True)
    assert one.columns == ["k", "v", "w", "v_right", "f"]
    assert sorted(str(r[0]) for r in rows(one)) == sorted(["1", "2", "2", "2", "2", "3", "None", "None"])


def test_semi_anti_self_and_names(left, right):
    assert rows(join_tables(left, right, "k", "k", "semi"), "w") == [(2, "b", 20), (2, "bb", 40)]
    assert rows(join_tables(left, right, "k", "k", "anti"), "w") == [(1, "a", 10), (None, "n", 30)]
    self_join = join_tables(left, left, "k", "k", "inner", suffix="_2", hint="broadcast")
    assert self_join.columns == ["k", "v", "w", "v_2", "w_2"] and self_join.count() == 5
    renamed = right.withColumnsRenamed({"k": "key"})
    assert join_tables(left, renamed, "k", "key", "inner").columns == ["k", "v", "w", "v_right", "f"]


def test_join_checks(left, right):
    assert join_tables(left, right) is left
    with pytest.raises(ValueError, match="1 left keys but 2"):
        join_tables(left, right, "k", "k, v")
    with pytest.raises(SchemaError):
        join_tables(left, right, "k", "gone")
    with pytest.raises(ValueError, match="unknown kind"):
        join_tables(left, right, "k", "k", "cross")


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2.0)], "a string, z double")
    both = union_tables([a, b, a])
    assert both.columns == ["id", "a", "z"]
    assert sorted(map(str, rows(both))) == ["(1, 'x', None)", "(1, 'x', None)", "(None, 'y', 2.0)"]
    assert union_tables(a) is a
    assert union_tables([a, a], "vertical").count() == 2
    for tables, how in (([a, b], "vertical"), ([a, spark.createDataFrame([("1", "x")], "id string, a string")], "diagonal")):
        with pytest.raises(SchemaError):
            union_tables(tables, how)


@pytest.fixture(scope="module")
def dups(spark):
    return spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, None), ("b", 5, "q"), ("a", 6, "x")], "k string, seq bigint, v string"
    ).repartition(3)


def test_unique(dups):
    assert rows(unique_rows(dups, ["k"], "first", ["seq"]), "seq") == [("a", 1, "x"), (None, 3, "z"), ("b", 5, "q")]
    assert rows(unique_rows(dups, ["k"], "last", ["seq"]), "seq") == [(None, 4, None), ("b", 5, "q"), ("a", 6, "x")]
    assert rows(unique_rows(dups, ["k"], "first", [("seq", "desc")]), "seq")[-1] == ("a", 6, "x")
    assert rows(unique_rows(dups, "k", "none")) == [("b", 5, "q")]
    assert unique_rows(dups, "k", "any").count() == 3
    assert unique_rows(dups.select("k", "v"), [], "first").count() == 5
    assert unique_rows(dups.select("k", "v"), [], "none").count() == 4
    with pytest.raises(ValueError, match="order_by"):
        unique_rows(dups, ["k"])


RULES = [
    {"column": "g", "action": "group_by", "output": "ignored"},
    {"column": "x", "action": "sum"},
    {"column": "x", "action": "count", "output": "n"},
    {"column": "s", "action": "count_unique", "output": "u"},
    {"column": "d", "action": "mean", "output": "mean"},
    {"column": "x", "action": "median", "output": "mid"},
    {"column": "x", "action": "std", "output": "std"},
    {"column": "s", "action": "first", "output": "f"},
    {"column": "s", "action": "last", "output": "l"},
    {"column": "s", "action": "concat", "output": "all"},
]


@pytest.mark.parametrize("group_limit", [1000, 0])
def test_summarize(nulls, group_limit):
    out = summarize(nulls.repartition(4), RULES, order_by=["id"], group_limit=group_limit)
    assert out.columns == ["g", "sum_x", "n", "u", "mean", "mid", "std", "f", "l", "all"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    std = statistics.stdev([5, 7, 5])
    assert got["a"] == (17, 3, 3, (1.5 + 2.5 + 1.5) / 3, 5.0, pytest.approx(std), "x", "x", "x, y, x")
    assert got["b"] == (0, 0, 1, None, None, None, None, None, "")
    assert got["c"] == (1, 1, 1, 8.0, 1.0, None, "x", "x", "x")
    assert got[None] == (9, 1, 1, 4.0, 9.0, None, "z", "z", "z")


@pytest.mark.parametrize("group_limit", [1000, 0])
def test_descending_order_puts_nulls_first(spark, group_limit):
    df = spark.createDataFrame(
        [("k", 1, 9, "a"), ("k", 2, 9, "b"), ("k", None, 9, "c"), ("k", 3, 8, "d")], "k string, o int, p int, v string"
    ).repartition(3)
    rules = [{"column": "k", "action": "group_by"}] + [
        {"column": "v", "action": a, "output": a} for a in ("first", "last", "concat")
    ]
    down = summarize(df, rules, order_by=[("o", "desc")], group_limit=group_limit)
    assert rows(down) == [("k", "c", "a", "c, d, b, a")]
    up = summarize(df, rules, order_by=["o"], group_limit=group_limit)
    assert rows(up) == [("k", "c", "d", "c, a, b, d")]
    with pytest.raises(ValueError, match="same direction"):
        summarize(df, rules, order_by=["o", ("p", "desc")])
    assert rows(unique_rows(df, ["k"], "first", [("o", "desc")]).select("v")) == [("c",)]
    assert rows(unique_rows(df, ["k"], "last", [("o", "desc")]).select("v")) == [("a",)]
    assert rows(unique_rows(df, ["k"], "first", [("p", "desc"), "o"]).select("v")) == [("c",)]
    assert rows(unique_rows(df, ["k"], "last", [("p", "desc"), "o"]).select("v")) == [("d",)]


def test_ordered_aggregates_read_only_their_columns(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    actions = [{"column": "l_returnflag", "action": "group_by"}, {"column": "l_tax", "action": "first"}]
    made = (
        summarize(lines, actions, order_by=["l_orderkey"]),
        pivot_wide(lines, ["l_returnflag"], "l_linestatus", "l_tax", "last", order_by=["l_orderkey"]),
    )
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "l_extendedprice" not in plan and "l_shipdate" not in plan


def test_summarize_forms(nulls):
    assert rows(summarize(nulls, group_by="g", agg_column="x"), "g")[1] == ("a", 17)
    assert summarize(nulls, group_by="g", agg_column="x").columns == ["g", "Aggregated"]
    assert summarize(nulls, [{"column": "g", "action": "group_by"}]).count() == 4
    assert summarize(nulls) is nulls
    everything = [{"column": "x", "action": "median", "output": "m"}, {"column": "s", "action": "concat", "output": "c"}]
    for limit in (1000, 0):
        assert rows(summarize(nulls, everything, order_by=["id"], group_limit=limit)) == [(5.0, "x, y, z, x, x")]
    assert rows(summarize(nulls.where("false"), [{"column": "x", "action": "sum"}])) == [(0,)]
    with pytest.raises(SchemaError):
        summarize(nulls, [{"column": "gone", "action": "sum"}])
    with pytest.raises(ValueError, match="unknown action"):
        summarize(nulls, [{"column": "x", "action": "mode"}])
    with pytest.raises(ValueError, match="order_by"):
        summarize(nulls, [{"column": "x", "action": "first"}])
    approx = summarize(nulls, RULES[:1] + RULES[3:4] + RULES[5:6], approx=True)
    assert {r[0]: r[1] for r in approx.collect()}["a"] == 3


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=60), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_selected_quantiles_match_percentile(spark, values, p):
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int").repartition(4)
    wanted = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in selected_quantiles(df, ["g"], "v", {"q": p}).collect()}
    assert got == pytest.approx(wanted)


def test_pivot(spark, nulls):
    wide = pivot_wide(nulls, ["g"], "s", "x", "sum")
    assert wide.columns == ["g", "null", "x", "y", "z"]
    assert rows(wide, "g") == [
        (None, None, None, None, 9), ("a", 0, 10, 7, None), ("b", 0, None, None, None), ("c", None, 1, None, None)
    ]
    assert rows(pivot_wide(nulls, "g", "s", "x", "count"), "g")[1] == ("a", 1, 2, 1, None)
    last = pivot_wide(nulls, ["g"], "s", "id", "last", order_by=["id"])
    assert rows(last, "g")[1] == ("a", 2, 8, 3, None)
    assert pivot_wide(nulls, ["g"], "s", "x", header_order_by="id").columns == ["g", "x", "null", "y", "z"]
    assert pivot_wide(nulls, ["g"], "s", "x", header_values=["y"]).columns == ["g", "y"]
    assert pivot_wide(nulls, [], "s", "x") is nulls
    with pytest.raises(ValueError):
        pivot_wide(nulls, ["g"], "s", "x", "mode")


def test_unpivot_and_back(spark, nulls):
    long = unpivot_long(nulls, ["id"], ["x", "d"])
    assert long.dtypes == [("id", "bigint"), ("name", "string"), ("value", "double")]
    assert long.count() == 16
    assert dict(unpivot_long(nulls, "id", ["x", "s"], "n", "v").dtypes)["v"] == "string"
    numbers = nulls.select("id", "x", "d")
    back = pivot_wide(unpivot_long(numbers, "id"), ["id"], "name", "value", "max")
    assert rows(back.select("id", F.col("x").cast("bigint"), "d"), "id") == rows(numbers, "id")


def test_charts(spark, nulls):
    assert rows(charts.bar_totals(nulls, "g", "x"), "g") == [(None, 9), ("a", 17), ("b", 0), ("c", 1)]
    shares = {r["g"]: r["share"] for r in charts.pie_shares(nulls, "g", "x").collect()}
    assert shares["a"] == 17 / 27 and sum(shares.values()) == pytest.approx(1)
    bins = rows(charts.histogram(nulls, "x", 4), "bin")
    assert bins == [(0, 1.0, 3.0, 1), (2, 5.0, 7.0, 2), (3, 7.0, 9.0, 2)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert rows(charts.histogram(same, "v", 5)) == [(0, 3.0, 3.0, 2)]
    assert rows(charts.heatmap(nulls, "x", "d", 2, 2), "x_bin", "y_bin") == [(0, 1, 1), (1, 0, 3)]
    steps = rows(charts.waterfall(nulls.where("x is not null"), "id", "x"), "id")
    assert [s[3] for s in steps] == [5, 12, 21, 22, 27] and [s[2] for s in steps] == [0, 5, 12, 21, 22]
    links = rows(charts.sankey_links(nulls, "g", "s"), "source", "target")
    assert links == [("a", "x", 2, 0, 2), ("a", "y", 1, 0, 3), ("c", "x", 1, 1, 2)]
    assert charts.points(nulls, "x", "d", "g").columns == ["x", "d", "g"]
    assert charts.points(nulls, "x", "d", n_records=3).count() == 3


@pytest.mark.parametrize("group_limit", [1000, 0])
def test_box_stats(spark, group_limit):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]] + [("b", 5.0), (None, None)], "g string, v double")
    got = {r["g"]: r for r in charts.box_stats(df, "g", "v", group_limit=group_limit).collect()}
    a = got["a"]
    assert (a["q1"], a["median"], a["q3"]) == (2.0, 3.0, 4.0)
    assert (a["lowest"], a["lower_whisker"], a["upper_whisker"], a["highest"], a["n"]) == (1.0, 1.0, 4.0, 100.0, 5)
    assert got["b"]["median"] == 5.0 and None not in got


def test_axis_formats(nulls):
    tagged = tag(nulls, {"x": "currency_usd", "d": "percentage", "gone": "percentage"})
    assert charts.axis_formats(tagged, "x", "d", "s") == {"x": "$,.2f", "d": ".0%"}
    chart = charts.with_axis_formats(charts.bar_totals(tagged, "g", "x"), tagged, {"total": "x"})
    assert chart.schema["total"].metadata["format"] == "$,.2f"


def test_profile_and_preview(nulls):
    tagged = tag(nulls, {"x": "currency_usd"})
    want = {
        "id": ("bigint", None, 8, 0, 8, "1", "8"),
        "g": ("string", None, 7, 1, 3, "a", "c"),
        "x": ("bigint", "currency_usd", 5, 3, 4, "1", "9"),
        "d": ("double", None, 5, 3, 4, "1.5", "8.0"),
        "s": ("string", None, 5, 3, 3, "x", "z"),
    }
    for approx in (False, True):
        assert {r[0]: tuple(r)[1:] for r in column_profile(tagged, approx).collect()} == want
    seen = preview(tagged, 3, "x", descending=True)
    assert (seen.row_count, seen.column_count, seen.rows.count()) == (8, 5, 3)
    assert seen.columns[2] == {"name": "x", "type": "bigint", "semantic_type": "currency_usd"}
    assert rows(seen.rows.select("x")) == [(None,)] * 3
    assert semantic_types(seen.rows) == {"x": "currency_usd"}
