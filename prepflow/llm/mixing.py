"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. The copies a document is expected to get are target / source size;
their whole part is allocated for certain. The rest is a fixed-size sample: each document draws a uniform number
from its id and text, its rank is the draw's odds divided by the odds of its inclusion, and the lowest ranks are
taken until the words that are left to the source are used up. A document that does not fit what is left is passed
over, and those behind it are still taken as long as they fit.

The cut is found without bringing a source together: words are summed by source and rank interval, and only
the interval in which the budget ends is ordered row by row. That is repeated with what is left of the budget over
the documents that still fit it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.llm.common import word_count, written

#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)

MAX_COPIES = 3

#: Rank intervals per source; the interval of the cut holds about 1 / INTERVALS of a source's rows.
INTERVALS = 1 << 16

#: How near to its target, as a share of it, a source is left alone.
CLOSE = 0.001


def draw(seed: int, *parts: Column) -> Column:
    """Uniform number in (0, 1), the same on every run: 52 bits of a digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Add ``target`` to rows (source, source_size): weight shares of all words, at most max_copies times the size.

    What exceeds a source's limit is shared again by weight among the others, until no target is above its limit.
    Only the two totals of a round pass the driver. A source is one row here, so ordering them takes one task.
    """
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    weighed = written(weighed.withColumn("limit", (F.col("source_size") * max_copies).cast("double")), "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, None
    while True:
        over = F.lit(False) if above is None else F.col("limit") < F.col("weight") * above
        row = weighed.agg(
            F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))
        ).first()
        if not row[1]:
            break
        level = (total - (row[0] or 0.0)) / row[1]
        pinned = weighed.filter(F.col("limit") < F.col("weight") * level).count()
        above = level
        if pinned == row[2]:
            break
    return weighed.select(
        "source", "source_size", F.least(F.col("weight") * level, F.col("limit")).alias("target")
    )


def candidates(drawn: DataFrame, left: DataFrame, fits: Column) -> DataFrame:
    """The rows not yet drawn that ``fits`` what is left to their source."""
    return drawn.filter("extra = 0 and rank is not null").join(left, F.col("s").eqNullSafe(F.col("b"))).filter(fits)


def cuts(drawn: DataFrame, left: DataFrame, fits: Column) -> DataFrame | None:
    """(b, left, cut_slot, before) of each source with candidates; cut_slot is null if all fit. None without any."""
    slots = written(candidates(drawn, left, fits).groupBy("s", "slot").agg(F.sum("size").alias("words")), "slots")
    if slots.isEmpty():
        return None
    before = Window.partitionBy("s").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = (F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))
    return written(
        slots.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(left, F.col("s").eqNullSafe(F.col("b")))
        .groupBy("b", "left")
        .agg(F.min(F.when(ends, F.col("slot"))).alias("cut_slot"), F.min(F.when(ends, F.col("before"))).alias("before")),
        "cuts",
    )


def taken_up_to(drawn: DataFrame, cut: DataFrame, fits: Column) -> DataFrame:
    """``drawn`` with ``extra`` set for the candidates that come before the first one which does not fit."""
    placed = drawn.join(cut, F.col("s").eqNullSafe(F.col("b")), "left")
    open_ = F.col("b").eqNullSafe(F.col("s")) & F.col("left").isNotNull() & (F.col("extra") == 0) & F.col("rank").isNotNull() & fits
    placed = placed.withColumn("open", F.coalesce(open_, F.lit(False)))
    at_edge = F.col("open") & F.coalesce(F.col("slot") == F.col("cut_slot"), F.lit(False))
    inner = Window.partitionBy("s").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.filter(at_edge).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("ahead") + F.col("size") <= F.col("left")).cast("long"))
    # Without a cut the budget is never reached: every candidate is taken.
    ahead = F.col("open") & (F.col("cut_slot").isNull() | (F.col("slot") < F.col("cut_slot")))
    rest = placed.filter(~at_edge).withColumn("extra", F.col("extra") + ahead.cast("long"))
    return edge.select(*drawn.columns).unionByName(rest.select(*drawn.columns))


def what_is_left(drawn: DataFrame) -> DataFrame:
    """(b, left, goal) of each source."""
    return drawn.groupBy(F.col("s").alias("b")).agg(
        (F.max("budget") - F.sum(F.col("size") * F.col("extra"))).alias("left"), F.max("target").alias("goal")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    preference: Column | None = None,
    seed: int = 7,
    intervals: int = INTERVALS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``taken`` is size * copies. ``preference`` (positive, default 1) makes the inclusion odds of a source's
    documents unequal; its expected copies are shared in that proportion, at most ``max_copies`` each.
    Null texts have size 0; a null source is a source of its own, ordered last; null ids draw by their text.
    Rows with equal id and text draw the same number and are taken one by one. A source without words has
    target 0. An empty table gives an empty result.
    """
    liking = F.lit(1.0) if preference is None else preference.cast("double")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            liking.alias("liking"),
            draw(seed, F.col(id_col)).alias("u"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("liking")).alias("liked")
    )
    sizes = written(sizes, "source-sizes")
    goal = targets(sizes.select("source", "source_size"), weights, max_copies)
    known = written(
        goal.join(
            sizes.select(F.col("source").alias("s"), "liked"), F.col("source").eqNullSafe(F.col("s"))
        ).select("s", "source_size", "target", "liked"),
        "targets",
    )
    expected = F.least(
        F.lit(float(max_copies)),
        F.when(F.col("liked") > 0, F.col("target") * F.col("liking") / F.col("liked")).otherwise(0.0),
    )
    # Rounding in the target must not turn a whole number of copies into slightly fewer.
    whole = F.floor(expected + 1e-9)
    part = F.greatest(F.lit(0.0), expected - whole)
    odds = F.col("u") / (1 - F.col("u"))
    rank = F.when(F.col("part") > 0, odds * (1 - F.col("part")) / F.col("part"))
    ranked = written(
        rows.join(known, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", whole.cast("long"))
        .withColumn("part", part)
        .withColumn("rank", rank)
        .withColumn(
            "slot",
            F.when(F.col("rank").isNotNull(), F.floor(F.col("rank") / (1 + F.col("rank")) * intervals)).cast("long"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "slot", "s")
        .withColumn("row", F.monotonically_increasing_id()),
        "ranked",
    )
    certain = ranked.groupBy("s").agg(
        F.max("target").alias("target"), F.sum(F.col("size") * F.col("whole")).alias("certain")
    )
    budget = certain.select(F.col("s").alias("b"), (F.col("target") - F.col("certain")).alias("budget"))
    left = written(budget.withColumnRenamed("budget", "left"), "budgets")
    drawn = ranked.join(budget, F.col("s").eqNullSafe(F.col("b")), "left").drop("b").withColumn("extra", F.lit(0).cast("long"))
    # Documents without words fit anywhere; they are drawn once, up to the first cut.
    fits = (F.col("target") > 0) & ((F.col("size") == 0) | (F.col("size") <= F.col("left")))
    while True:
        cut = cuts(drawn, left, fits)
        if cut is None:
            break
        drawn = written(taken_up_to(drawn, cut, fits), "drawn")
        left = written(what_is_left(drawn).filter(F.col("left") > F.col("goal") * CLOSE).select("b", "left"), "left")
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    # What is left of a budget goes to the one document whose size fits best, if that is nearer.
    left = what_is_left(drawn).filter(F.abs("left") > F.col("goal") * CLOSE).select("b", "left")
    fit = F.struct(F.abs(F.col("size") - F.col("left")).alias("miss"), "rank", "row")
    filler = written(
        drawn.filter("extra = 0 and rank is not null")
        .join(left, F.col("s").eqNullSafe(F.col("b")))
        .groupBy("s")
        .agg(F.min(fit).alias("fit"), F.max("left").alias("left"))
        .filter(F.col("fit.miss") < F.abs("left"))
        .select(F.col("fit.row").alias("filler")),
        "fillers",
    )
    more = F.col("extra") + F.col("filler").isNotNull().cast("long")
    drawn = drawn.join(filler, F.col("row") == F.col("filler"), "left").withColumn("extra", more)
    return drawn.withColumn("copies", F.col("whole") + F.col("extra")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
