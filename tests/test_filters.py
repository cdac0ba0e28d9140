from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import rows
from prepflow.functions.expressions import predicate
from prepflow.operators.filters import filter_column, filter_split, filter_text
from prepflow.schema import GuardError, SchemaError
from pyspark.sql import functions as F


def ids(df):
    return [r[0] for r in rows(df.select("id"), "id")]


@pytest.mark.parametrize(
    "operator, value, expected",
    [
        ("==", "5", [1, 8]),
        ("!=", "5", [3, 6, 7]),
        (">", "5", [3, 6]),
        (">=", "5", [1, 3, 6, 8]),
        ("<", "5", [7]),
        ("<=", "5", [1, 7, 8]),
        ("is_null", "", [2, 4, 5]),
        ("is_not_null", "", [1, 3, 6, 7, 8]),
    ],
)
def test_number_comparisons_and_both_ports(nulls, operator, value, expected):
    ports = filter_column(nulls, "x", operator, value)
    assert ids(ports["true"]) == expected
    assert ids(ports["false"]) == [i for i in range(1, 9) if i not in expected]


def test_null_outcome_goes_to_the_false_port_for_contains_and_not_contains(nulls):
    assert ids(filter_column(nulls, "s", "contains", "x|y")["true"]) == [1, 3, 7, 8]
    assert ids(filter_column(nulls, "s", "not_contains", "x|y")["true"]) == [6]
    assert ids(filter_column(nulls, "s", "not_contains", "x|y")["false"]) == [1, 2, 3, 4, 5, 7, 8]


def test_contains_is_a_pattern_unless_literal(spark):
    df = spark.createDataFrame([(1, "a.b"), (2, "axb")], "id int, s string")
    assert ids(filter_column(df, "s", "contains", "a.b")["true"]) == [1, 2]
    assert ids(filter_column(df, "s", "contains", "a.b", literal=True)["true"]) == [1]


def test_values_take_the_type_of_the_column(spark):
    df = spark.createDataFrame(
        [(1, date(2024, 1, 2), datetime(2024, 1, 2, 3, 4), Decimal("1.50"), True),
         (2, date(2024, 5, 6), datetime(2024, 5, 6), Decimal("2.25"), False)],
        "id int, day date, at timestamp_ntz, price decimal(8,2), flag boolean",
    )
    assert ids(filter_column(df, "day", ">", "2024-02-01")["true"]) == [2]
    assert ids(filter_column(df, "at", "<=", "2024-01-02T03:04:00")["true"]) == [1]
    assert ids(filter_column(df, "price", "==", "1.5")["true"]) == [1]
    for word in ("true", "1", "Yes", "T"):
        assert ids(filter_column(df, "flag", "==", word)["true"]) == [1]
    assert ids(filter_column(df, "flag", "==", "anything")["true"]) == [2]


def test_bad_values_and_names_are_errors(nulls):
    with pytest.raises(ValueError, match="not a valid value"):
        filter_column(nulls, "x", ">", "30x")
    with pytest.raises(SchemaError):
        filter_column(nulls, "nope", ">", "1")
    with pytest.raises(ValueError, match="unsupported operator"):
        filter_column(nulls, "x", "~", "1")


@pytest.mark.parametrize("column, value", [("", "5"), ("x", ""), ("x", "   ")])
def test_nothing_to_test_keeps_everything(nulls, column, value):
    ports = filter_column(nulls, column, "==", value)
    assert ports["true"].count() == 8
    assert ports["false"].count() == 0
    assert ports["false"].schema == nulls.schema


def test_text_predicates(nulls):
    cases = {
        '[x] > 5 AND [g] = "a"': [3],
        "[x] >= 1 and not ([g] == 'a')": [7],
        "[g] IS NULL OR [d] IS NOT NULL": [1, 2, 6, 7, 8],
        '[s] CONTAINS "x|z"': [1, 6, 7, 8],
        'CONTAINS([s], "x") or STARTSWITH([g], "c")': [1, 7, 8],
        '[s] ENDSWITH "y"': [3],
        '[x] <> "5"': [3, 6, 7],
        "[x] * 2 + 1 > [d] * 2 + 10": [6],
        "[x] > -1 AND TRUE": [1, 3, 6, 7, 8],
    }
    for text, expected in cases.items():
        assert ids(filter_text(nulls, text)["true"]) == expected, text
    assert filter_text(nulls, "  ")["false"].count() == 0


def test_text_predicate_on_dates_and_bad_numbers(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 2), 30)], "id int, day date, age int")
    assert ids(filter_text(df, '[day] > "2024-01-01"')["true"]) == [1]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        filter_text(df, "[age] > '30x'")["true"].collect()


def test_brackets_and_words_inside_literals_stay(spark):
    df = spark.createDataFrame([(1, "[a] AND b"), (2, "it's")], "id int, s string")
    assert ids(filter_text(df, '[s] = "[a] AND b"')["true"]) == [1]
    assert ids(filter_text(df, '[s] = "it\'s"')["true"]) == [2]


@pytest.mark.parametrize(
    "text", ["reflect('java.lang.Math', 'random') > 0", "[x] > (SELECT 1)", "`java_method`('a', 'b') = 1"]
)
def test_guard(nulls, text):
    with pytest.raises(GuardError):
        filter_text(nulls, text)
    assert "SELECT" in predicate("[s] = 'SELECT'", nulls.schema)


def test_predicate_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for made in (
        filter_column(orders, "o_totalprice", ">", "1000"),
        filter_text(orders, "[o_totalprice] > 1000"),
        filter_column(orders, "o_orderdate", ">", "1996-01-01"),
    ):
        plan = made["true"]._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(o_" in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(-2, 12), st.sampled_from(["==", "!=", ">", ">=", "<", "<="]))
def test_ports_partition_the_input(nulls, value, operator):
    ports = filter_column(nulls, "x", operator, value)
    assert sorted(ids(ports["true"]) + ids(ports["false"])) == list(range(1, 9))


def test_split_by_column(nulls):
    ports = filter_split(nulls, F.col("x") > 5, persist=True)
    assert ids(ports["true"]) == [3, 6]
    nulls.unpersist()
