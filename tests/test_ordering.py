import random

import pytest
from pyspark.sql import functions as F

import prepflow.operators.ordering as ordering
from conftest import rows
from prepflow.operators.ordering import (
    chunk_rows,
    number_rows,
    record_id,
    running_total,
    sample_rows,
    sort_rows,
    top_k,
)


def test_sort_puts_nulls_first_both_ways(nulls):
    up = sort_rows(nulls, [{"column": "g", "order": "asc"}, {"column": "id", "order": "desc"}])
    assert [r[0] for r in rows(up)] == [6, 8, 3, 2, 1, 5, 4, 7]
    down = sort_rows(nulls, [{"column": "g", "order": "desc"}, {"column": "gone"}, {"column": "id"}])
    assert [r[0] for r in rows(down)] == [6, 7, 4, 5, 1, 2, 3, 8]
    assert [r[0] for r in rows(sort_rows(nulls, column="id", descending=True))] == list(range(8, 0, -1))
    assert sort_rows(nulls, [{"column": "gone"}]) is nulls and sort_rows(nulls) is nulls


@pytest.mark.parametrize("partitions", [1, 7])
@pytest.mark.parametrize("unique_order", [True, False])
def test_record_id_is_dense_and_ordered(spark, partitions, unique_order):
    df = spark.range(1000).select(F.expr("(id * 37) % 1000").alias("k"), F.lit("v").alias("v"))
    out = record_id(df.repartition(partitions), "No", 5, [("k", "desc")], unique_order)
    assert out.columns == ["No", "k", "v"]
    assert rows(out, "No") == [(5 + i, 999 - i, "v") for i in range(1000)]


def test_record_id_parameters(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b")], "RecordID bigint, v string")
    assert rows(record_id(df, "", "x", ["RecordID"]), "v") == [(2, "a"), (1, "b")]
    with pytest.raises(ValueError, match="order_by"):
        record_id(df)


def test_copies_are_kept_and_spread(spark, monkeypatch):
    """One row is most of the table; with short runs its copies land in several slices."""
    monkeypatch.setattr(ordering, "COPY_RUN", 100)
    df = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 10).alias("a"))
    slices = ordering.sorted_slices(df, ["a"])
    sizes = dict(rows(slices.groupBy(ordering.SLICE).count()))
    assert sum(sizes.values()) == 6000 and max(sizes.values()) < 3000
    numbered = rows(number_rows(df, ["a"], "n"), "n")
    assert [n for _, n in numbered] == list(range(6000))
    assert [a for a, _ in numbered] == sorted(a for a, _ in numbered)


def test_a_frequent_order_value_is_split(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    sizes = [r[1] for r in rows(ordering.sorted_slices(df, ["k"]).groupBy(ordering.SLICE).count())]
    assert sum(sizes) == 8000 and max(sizes) < 3500


def test_slices_follow_the_input_size(spark, monkeypatch, tmp_path):
    spark.range(20000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(ordering, "SLICE_BYTES", 8 << 10)
    slices = ordering.sorted_slices(df, [("id", "desc")], unique_order=True)
    assert slices.select(ordering.SLICE).distinct().count() > 4
    numbered = number_rows(df, [("id", "desc")], "n", unique_order=True)
    assert numbered.filter("n + id <> 19999").count() == 0 and numbered.count() == 20000


def test_running_total(spark):
    random.seed(3)
    values = [(i, random.choice([None, 1, 2, 3])) for i in range(500)]
    out = running_total(spark.createDataFrame(values, "i int, v bigint").repartition(5), "v", ["i"], "t", True)
    total, expected = 0, []
    for i, v in values:
        total += v or 0
        expected.append((i, v, total))
    assert rows(out, "i") == expected


@pytest.mark.parametrize("limit", [ordering.TOP_N_LIMIT, 0])
def test_samples(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "TOP_N_LIMIT", limit)
    df = spark.range(50).select(F.expr("(id * 7) % 50").alias("k")).repartition(4)
    assert rows(sample_rows(df, "first", 3, ["k"]), "k") == [(0,), (1,), (2,)]
    assert rows(sample_rows(df, "last", 3, ["k"]), "k") == [(47,), (48,), (49,)]
    assert rows(sample_rows(df, "first", 3, [("k", "desc")]), "k") == [(47,), (48,), (49,)]
    assert sample_rows(df, "last", 80, ["k"]).count() == 50
    drawn = rows(sample_rows(df, "random", 20, seed=1))
    assert len(drawn) == len(set(drawn)) == 20
    assert sample_rows(df, "random", 80).count() == 50


def test_large_random_sample_of_copies(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TOP_N_LIMIT", 0)
    df = spark.range(300).select((F.col("id") % 2).alias("k"))
    counts = dict(rows(sample_rows(df, "random", 100, seed=5).groupBy("k").count()))
    assert sum(counts.values()) == 100 and min(counts.values()) > 20


def test_sample_edges(spark):
    df = spark.range(5)
    assert sample_rows(df, "first", 0).count() == 0
    assert sample_rows(df, "first", -1).schema == df.schema
    assert sample_rows(df, "other", 3) is df
    with pytest.raises(ValueError, match="order_by"):
        sample_rows(df, "first", 3)


def test_top_k_is_one_step(spark):
    out = top_k(spark.range(100), [{"column": "id", "order": "desc"}], 2)
    assert rows(out) == [(99,), (98,)]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()


def test_chunks(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5), (2, None, 2.5), (3, "c", None), (4, None, 4.5), (5, None, None)], "i int, t string, d double"
    ).repartition(3)
    out = chunk_rows(df, 3, ["t", "d", "gone"], ", ", ["i"])
    assert rows(out, "Chunk_ID") == [(0, "a, c", "1.5, 2.5", 3), (1, "", "4.5", 2)]
    assert rows(chunk_rows(df, 5, "t", "\\n", ["i"]))[0][1] == "a\nc"
    assert chunk_rows(df, 3, [], order_by=["i"]) is df
    assert chunk_rows(df, 3, ["gone"], order_by=["i"]) is df
    with pytest.raises(ValueError):
        chunk_rows(df, 0, ["t"], order_by=["i"])
    with pytest.raises(ValueError, match="order_by"):
        chunk_rows(df, 2, ["t"])


def test_streams_are_refused(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    for call in (
        lambda: record_id(stream, order_by=["ts"]),
        lambda: sort_rows(stream, column="ts"),
        lambda: sample_rows(stream, "random", 3),
        lambda: chunk_rows(stream, 3, ["props"], order_by=["ts"]),
    ):
        with pytest.raises(ValueError, match="stream"):
            call()
