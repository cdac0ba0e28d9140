"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import written


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a partition by one link from each node to its root; batches are joined as they come."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    for at in range(0, len(pairs), 50_000):
        some = pairs[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in some], pa.int64()), pa.array([p[1] for p in some], pa.int64())], ["a", "b"]
        )


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b: bigint); equal comp iff connected. Loops do no harm.

    Every round each node joins the neighbour with the most links (ties by hash), and the links between joined
    nodes remain. Stars vanish in one round, paths shrink by a constant factor.
    """
    edges = written(links.select("a", "b").filter("a <> b").mapInArrow(local_forest, "a bigint, b bigint"), "links")
    labels = written(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node")), "labels"
    )
    round_ = 0
    while not edges.isEmpty():
        round_ += 1
        both = edges.select("a", "b").union(edges.select("b", "a"))
        degree = written(both.groupBy("a").agg(F.count("*").alias("degree")), "degrees")
        known = both.join(degree.select("a", F.col("degree").alias("da")), "a").join(
            degree.select(F.col("a").alias("b"), F.col("degree").alias("db")), "b"
        )
        ranked = [
            F.struct(-F.col(d), F.xxhash64(F.col(side), F.lit(round_)), F.col(side).alias("id"))
            for side, d in (("a", "da"), ("b", "db"))
        ]
        best = known.select("a", F.least(*ranked).alias("best")).groupBy("a").agg(F.min("best").alias("best"))
        chosen = written(best.select(F.col("a").alias("old"), F.col("best.id").alias("new")), "chosen")
        labels = written(
            labels.join(chosen, F.col("comp") == F.col("old"), "left").select(
                "node", F.coalesce("new", "comp").alias("comp")
            ),
            "labels",
        )
        moved = edges.join(chosen.select(F.col("old").alias("a"), F.col("new").alias("x")), "a").join(
            chosen.select(F.col("old").alias("b"), F.col("new").alias("y")), "b"
        )
        edges = written(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return labels
