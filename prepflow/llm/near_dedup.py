"""Near-duplicates by min-hash signatures in an LSH forest.

Every document has ``TREES`` signatures of ``LEVELS`` min-hash values. Sorting the documents by each signature gives
one order per tree; documents that share a prefix of ``LEAST`` values form a region, and within a region the
neighbours in the order share the longest prefixes. For neighbours, regions that are too large for a task are sorted
deeper, by more values, until they are not; everything else looks at the regions themselves, dealt into blocks.

1. Documents with the same set of shingles become one node.
2. Nodes in no region with another node have no link. For the others the full sets are made, and the shingles that
   no other of them has are counted: they bound how similar a node can be to any other one.
3. Neighbours in all orders are compared on their full sets; links join nodes to components.
4. In regions that still hold several components, all pairs between components which neither the bound nor the
   signatures rule out are compared on full sets, inside the region's task. Only links leave the task.

A pair at the least similarity shares a region in some tree with probability 1 - (1 - s^4)^20: 0.9999996 at 0.85,
0.99997 at 0.8, in regions of any size. Signatures rule a pair out when its agreement is 5.5 standard errors below the least similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import map_texts, maybe_in, written
from prepflow.llm.components import components
from prepflow.llm.shingles import factors, shingle_set, signature

TREES = 20
LEVELS = 8
LEAST = 4
FUNCTIONS = TREES * LEVELS

#: Rows of a region that one task compares; larger regions are dealt into blocks.
REGION_ROWS = 20_000

#: What tells regions, and blocks of very large ones, apart.
REGION = ["tree", "region", "block"]


def describe(size: int) -> Callable:
    """Of a text: number of shingles, 128-bit digest of the set, signature bytes ordered by tree and level."""

    def make():
        a, b = factors(FUNCTIONS)

        def one(text: str | None) -> tuple:
            found = shingle_set(text, size)
            if not len(found):
                return 0, None, None
            return len(found), hashlib.md5(found.tobytes()).digest(), signature(found, a, b).astype(">u2").tobytes()

        return one

    return make


def full_set(size: int) -> Callable:
    def one(text: str | None) -> tuple:
        found = shingle_set(text, size)
        return hashlib.md5(found.tobytes()).digest(), found.view(np.int64)

    return lambda: one


def prefix(depth: int) -> Column:
    """The first values of tree ``tree`` of a signature."""
    return F.substring(F.col("sig"), F.col("tree") * (2 * LEVELS) + 1, F.lit(2 * depth))


def by_tree(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))


def with_regions(nodes: DataFrame, region_rows: int) -> DataFrame:
    """Rows (tree, region, blocks, node columns) of all regions of two or more nodes.

    ``blocks`` tells how many tasks' rows a region has.
    """
    return with_counts(by_tree(nodes).withColumn("region", prefix(LEAST)), region_rows)


def with_counts(rows: DataFrame, region_rows: int) -> DataFrame:
    counts = written(rows.groupBy("tree", "region").count().filter("count > 1"), "regions")
    blocks = F.ceil(F.col("count") / region_rows).cast("int")
    return rows.drop("blocks").join(counts, ["tree", "region"]).withColumn("blocks", blocks).drop("count")


def for_neighbours(regions: DataFrame, region_rows: int) -> DataFrame:
    """The rows with a ``block``, large regions sorted deeper until a task can hold them; rows alone there are left out.

    A region at full depth that is still too large is dealt into blocks. Nothing is decided here but who is whose
    neighbour: what is not compared now is compared in the region itself.
    """
    done = regions.filter("blocks = 1")
    rows, depth = regions.filter("blocks > 1"), LEAST
    while depth < LEVELS and not rows.isEmpty():
        depth += 1
        rows = written(with_counts(rows.withColumn("region", prefix(depth)), region_rows), "deeper")
        done = done.unionByName(rows.filter("blocks = 1"))
        rows = rows.filter("blocks > 1")
    return done.unionByName(rows).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def in_blocks(split: DataFrame, region_rows: int) -> DataFrame:
    """Rows of large regions, in blocks in which all pairs but those inside the region's largest component meet.

    Every node has one home block. The nodes outside of the largest component are dealt into parts, and each part is
    asked in every block; the new ``block`` is a block with a part, of about twice ``region_rows`` rows at most.
    """
    sizes = written(split.groupBy("tree", "region", "comp").count(), "region-components")
    largest = sizes.groupBy("tree", "region").agg(
        F.max(F.struct("count", "comp")).alias("most"), F.sum("count").alias("rows")
    )
    parts = F.ceil((F.col("rows") - F.col("most.count")) / region_rows)
    largest = written(largest.select("tree", "region", F.col("most.comp").alias("main"), parts.alias("parts")), "largest")
    rows = split.join(largest, ["tree", "region"]).withColumn("outside", F.col("comp") != F.col("main"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))

    def up_to(count: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))

    at_home = rows.withColumn("with", up_to(F.col("parts"))).withColumn("home", F.lit(True))
    at_home = at_home.withColumn("query", F.col("outside") & (F.col("with") == F.col("part")))
    abroad = rows.filter("outside").withColumn("with", F.col("part")).withColumn("home", F.lit(False))
    abroad = abroad.withColumn("away", up_to(F.col("blocks"))).filter(F.col("away") != F.col("block"))
    abroad = abroad.withColumn("block", F.col("away")).drop("away").withColumn("query", F.lit(True))
    return (
        at_home.unionByName(abroad)
        .withColumn("block", F.col("block") * F.col("parts") + F.col("with"))
        .drop("main", "parts", "outside", "part", "with")
    )


def may_link(shared: np.ndarray, own: int, sizes: np.ndarray, mine: int, percent: int) -> np.ndarray:
    """Whether counts allow a link: an intersection has at most the smaller number of shared shingles."""
    most = np.minimum(shared, own)
    return 100 * most >= percent * (sizes + mine - most)


def agreements(sigs: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sigs == one).sum(1)


def least_agreement(percent: int) -> int:
    s = percent / 100
    return int(np.floor(FUNCTIONS * s - 5.5 * (FUNCTIONS * s * (1 - s)) ** 0.5))


def signatures(column: pd.Series) -> np.ndarray:
    """Rows of FUNCTIONS values."""
    return np.frombuffer(b"".join(column), ">u2").reshape(len(column), FUNCTIONS)


def in_shards(regions: DataFrame, fn: Callable, schema: str, region_rows: int) -> DataFrame:
    """Apply a function of many whole regions at a time: a shard holds about ``region_rows`` rows."""
    shards = max(
        int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-regions.count() // region_rows)
    )
    dealt = regions.withColumn("shard", F.pmod(F.xxhash64(*REGION), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(fn, schema)


def neighbour_pairs(percent: int) -> Callable:
    """Pairs of neighbours in the order of a region's tree that may be linked."""
    least = least_agreement(percent)

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        region = shard.groupby(REGION, sort=False).ngroup().to_numpy()
        sigs = signatures(shard["sig"])
        own = sigs.reshape(len(shard), TREES, LEVELS)[np.arange(len(shard)), shard["tree"].to_numpy()]
        node = shard["node"].to_numpy()
        order = np.lexsort([node, *own.T[::-1], region])
        region, sigs, node = region[order], sigs[order], node[order]
        n, m = shard["n"].to_numpy()[order], shard["m"].to_numpy()[order]
        most = np.minimum(m[1:], m[:-1])
        fine = (region[1:] == region[:-1]) & (100 * most >= percent * (n[1:] + n[:-1] - most))
        fine[fine] = (sigs[1:][fine] == sigs[:-1][fine]).sum(1) >= least
        a, b = node[1:][fine], node[:-1][fine]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return one


def first_shared_tree(sigs: np.ndarray, one: np.ndarray, tree: int) -> np.ndarray:
    """Whether no tree before ``tree`` has the pair in one region."""
    if not tree:
        return np.ones(len(sigs), bool)
    same = (sigs == one).reshape(len(sigs), TREES, LEVELS)[:, :tree, :LEAST].all(2)
    return ~same.any(1)


def open_nodes(percent: int) -> Callable:
    """Rows of nodes that have a pair between components of their region that may be linked."""
    least = least_agreement(percent)

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        sigs = signatures(shard["sig"])
        n, m, comp, tree = (shard[c].to_numpy() for c in ("n", "m", "comp", "tree"))
        query, home, blocks = (shard[c].to_numpy() for c in ("query", "home", "blocks"))
        used = np.zeros(len(shard), bool)
        for rows in shard.groupby(REGION, sort=False).indices.values():
            # Pairs of two nodes of the largest component need no look, so the others are compared with all.
            # In a block, it is the region's largest one that counts, which is not asked there.
            asked, home_rows = rows[query[rows]], rows[home[rows]]
            if blocks[rows[0]] == 1:
                kinds, counts = np.unique(comp[rows], return_counts=True)
                asked = asked[comp[asked] != kinds[counts.argmax()]]
            for i in asked:
                other = home_rows[comp[home_rows] != comp[i]]
                other = other[may_link(m[other], m[i], n[other], n[i], percent)]
                other = other[agreements(sigs[other], sigs[i]) >= least]
                other = other[first_shared_tree(sigs[other], sigs[i], int(tree[i]))]
                if len(other):
                    used[i] = True
                    used[other] = True
        return shard.loc[used, [*REGION, "node"]]

    return one


def region_links(percent: int) -> Callable:
    """Links between components of each region, on full sets; one link for each two components that meet."""
    least = least_agreement(percent)

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        sigs = signatures(shard["sig"])
        node, n, m, own = (shard[c].to_numpy() for c in ("node", "n", "m", "comp"))
        sets = [np.asarray(s) for s in shard["shingles"]]
        links = []
        for rows in shard.groupby(REGION, sort=False).indices.values():
            comp = own[rows]
            for k, i in enumerate(rows):
                some = np.flatnonzero(comp != comp[k])
                some = some[may_link(m[rows[some]], m[i], n[rows[some]], n[i], percent)]
                some = some[agreements(sigs[rows[some]], sigs[i]) >= least]
                for other in some:
                    j = rows[other]
                    if comp[other] == comp[k]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        links.append((node[i], node[j]))
                        comp = np.where(comp == comp[other], comp[k], comp)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return one


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", both)
        .filter(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent)
        .select("a", "b")
    )


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    region_rows: int = REGION_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when their sets of ``size``-word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least ``percent`` / 100. component_id is the smallest id that links reach, kept tells whether it is the row's
    own. Null, empty and wordless texts have 0 shingles and are linked with nothing; so are rows with a null id,
    whose component is null and which are kept. Repeated rows give repeated rows, an empty table an empty result;
    other columns are not looked at.
    """
    kinds = [("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())]
    base = written(
        map_texts(docs, describe(size), kinds, "n_shingles bigint, digest binary, sig binary", id_col, text_col), "signatures"
    )
    known = base.filter("doc_id is not null and digest is not null")
    nodes = written(
        known.groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    links = near_links(docs, nodes, id_col, text_col, size, percent, region_rows)
    found = components(links)
    in_comp = found.join(nodes.select("node", "id"), "node")
    least = written(in_comp.groupBy("comp").agg(F.min("id").alias("component_id")), "components")
    named = written(
        nodes.join(found, "node", "left").join(least, "comp", "left").select(
            F.col("digest").alias("of"), F.coalesce("component_id", "id").alias("component_id")
        ),
        "named",
    )
    return base.join(
        named, (F.col("digest") == F.col("of")) & F.col("doc_id").isNotNull(), "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def near_links(
    docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int, percent: int, region_rows: int
) -> DataFrame:
    """Links (a, b) between nodes that connect all linked nodes."""
    trees = by_tree(nodes.select("node", "sig")).select("node", "tree", prefix(LEAST).alias("region"))
    shared = written(trees.groupBy("tree", "region").count().filter("count > 1").drop("count"), "shared-regions")
    near = written(trees.join(shared, ["tree", "region"]).select("node").distinct(), "near-nodes")
    wanted = written(nodes.join(near, "node").select("node", "digest", F.col("id").alias("wanted_id")), "wanted")
    texts = docs.select(F.col(id_col).alias("wanted_id"), F.col(text_col).alias("text"))
    # Only texts that may be wanted are sent to the join.
    texts = maybe_in(texts, wanted.select("wanted_id"), "wanted_id", "__maybe").filter("__maybe").drop("__maybe")
    texts = texts.join(wanted, "wanted_id")
    made = map_texts(
        texts.withColumn("key", F.struct("node", "digest")),
        full_set(size),
        [("made", pa.binary()), ("shingles", pa.list_(pa.int64()))],
        "made binary, shingles array<bigint>",
        "key",
    )
    # An id may come with several texts; only the one whose set the node stands for counts.
    sets = written(
        made.filter(F.col("doc_id.digest") == F.col("made"))
        .select(F.col("doc_id.node").alias("node"), "shingles")
        .dropDuplicates(["node"]),
        "sets",
    )
    alone = (
        sets.select("node", F.explode("shingles").alias("shingle"))
        .groupBy("shingle")
        .agg(F.count("*").alias("times"), F.min("node").alias("node"))
        .filter("times = 1")
        .groupBy("node")
        .agg(F.count("*").alias("alone"))
    )
    live = written(
        nodes.join(near, "node")
        .join(alone, "node", "left")
        .withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0)))
        .filter(F.col("m") * 100 >= F.col("n") * percent)
        .select("node", "n", "m", "sig"),
        "live-nodes",
    )
    regions = written(with_regions(live, region_rows), "members")
    ordered = for_neighbours(regions, region_rows)
    pairs = written(
        in_shards(ordered, neighbour_pairs(percent), "a bigint, b bigint", region_rows).distinct(), "pairs"
    )
    first = written(verified(pairs, sets, percent), "first-links")
    found = components(first)
    placed = written(
        regions.join(found, "node", "left")
        .withColumn("comp", F.coalesce(F.col("comp"), F.col("node")))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))),
        "placed",
    )
    mixed = placed.groupBy("tree", "region").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("rows")
    ).filter("low <> high and rows > 2")
    mixed = written(mixed.select("tree", "region"), "mixed-regions")
    asked = placed.join(mixed, ["tree", "region"])
    own = asked.filter("blocks = 1").withColumn("query", F.lit(True)).withColumn("home", F.lit(True))
    split = asked.filter("blocks > 1")
    if not split.isEmpty():
        own = own.unionByName(in_blocks(split, region_rows))
    own = written(own, "asked")
    still = written(
        in_shards(own, open_nodes(percent), "tree int, region binary, block bigint, node bigint", region_rows), "open"
    )
    asked = written(own.join(still, [*REGION, "node"], "left_semi"), "open-rows")
    some = maybe_in(sets, asked.select("node").distinct(), "node", "__maybe").filter("__maybe").drop("__maybe")
    asked = asked.join(some, "node")
    rest = in_shards(asked, region_links(percent), "a bigint, b bigint", region_rows)
    return first.unionByName(written(rest, "more-links"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The kept rows of ``docs`` with all their columns. Ids are taken to be unique; rows with a null id stay."""
    groups = near_groups(docs, id_col, text_col, **options)
    gone = groups.groupBy(F.col("doc_id").alias("__gone")).agg(F.max("kept").alias("kept")).filter("not kept")
    gone = written(gone.select("__gone"), "gone")
    # Rows that surely stay are not moved; the others meet the ids that go.
    marked = maybe_in(docs, gone, id_col, "__maybe")
    stay = marked.filter("not __maybe").drop("__maybe")
    asked = marked.filter("__maybe").drop("__maybe")
    return stay.unionByName(asked.join(gone, F.col(id_col) == F.col("__gone"), "left_anti"))
