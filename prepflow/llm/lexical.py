"""Ranked lexical search over whole texts, with per-term geometric blocks that are skipped by exact bounds.

Scoring (all integer but the term weight): N documents with a term, L all their terms, n a document's terms, df and
tf as usual. w = floor(1000 ln((2N+2)/(2df+1))); m = 50 + (50 n N) div L; a document scores, for each distinct term of
a query, w * ((10^9 tf) div (1000 tf + 20 m)).

Index. The index covers the terms of a stated vocabulary (the terms of the query set). A document's vector has one
coordinate per vocabulary term, its contribution w * g(tf, m) >= 0; it is folded into ``BUCKETS`` coordinates by a
hash of the term (sums within a bucket). Each term's posting list is clustered by document similarity: documents are
placed by a signature of signs of ``BITS`` fixed random projections of their centred folded vector (SimHash), and the list is
cut into cells of the signature prefix, deeper for longer lists (about ``BLOCK`` documents a cell). Each block keeps
the coordinatewise maximum of its documents' folded vectors.

Search. For a query Q and a block, the sum over the buckets Q touches of the block's maxima bounds the score of every
document in the block from above (contributions are never negative). Each query first scores exactly the documents of
its best-bounded blocks, about ``FIRST`` for each one wanted; the k-th best score found is a lower bound of the final k-th score. A query's terms whose
largest contributions together stay below it cannot lift a document that has none of the others, so their lists are
not opened. In the lists of the other terms every block whose bound reaches it is scored exactly. A block is skipped
only when no document in it that is not found elsewhere could enter the top k. Results equal brute force.

Texts are cut into terms in Arrow batches, twice: for the lengths of all documents, then for the counts of the
vocabulary's terms. Exact scores are made in groups of documents that hold their own contributions, by binary search.
The rest is joins, aggregations and windows; the per-query windows are taken in two steps (by query and a salt of
the block or row first, then by query over at most k rows a salt), so one query with a hot term does not sort all its
rows in one task.

Edge cases: a null text has no terms; so has an empty one or one of separators only (those count neither in N nor L).
Repeated doc_ids are separate documents (each row is one); equal scores go by ascending doc_id, null ids last, then by
row. Items with equal item_id are one query over the union of their terms; a null item_id is one query. Items without
terms, or whose terms occur nowhere, give no rows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepflow.llm.common import fold, map_texts, written

#: Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50

#: Index parameters: folded coordinates, signature bits, documents a block aims at, salts of the two-step windows.
BUCKETS = 16
BITS = 16
BLOCK = 64
SALTS = 64
SEED = 13

#: Documents scored first for each one wanted: more give a higher least score, and fewer blocks to open after.
FIRST = 20

#: Pairs of query and document, and contributions, that a scoring group aims at.
GROUP_PAIRS = 1_000_000

#: What the bytes of a text become: terms with A-Z lower-cased, blanks between them. Bytes from 0x80 on are of terms.
TERM_BYTES = bytes(b + 32 if chr(b).isupper() and b < 128 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TERM), 0)


def split_terms(text: str | None) -> list[bytes]:
    """The terms of one text in UTF-8."""
    return (text or "").encode().translate(TERM_BYTES).split()


def length() -> Callable:
    return lambda text: (len(split_terms(text)),)


def term_counts() -> Callable:
    """Of a text: number of terms, distinct terms, their occurrences."""

    def one(text: str | None) -> tuple:
        found = Counter(split_terms(text))
        return found.total(), list(found), list(found.values())

    return one


def projections() -> list[list[int]]:
    """``BITS`` fixed random sign vectors over the buckets."""
    rng = random.Random(SEED)
    return [[rng.choice((-1, 1)) for _ in range(BUCKETS)] for _ in range(BITS)]


def signature(vector: Column, means: list[float]) -> Column:
    """Signs of the projections of ``vector`` less ``means``: vectors without negative parts lie on one side else."""
    bits = [
        F.when(
            sum((vector[i] * sign for i, sign in enumerate(signs)), F.lit(0)) > sum(m * sign for m, sign in zip(means, signs)),
            F.lit(1 << (BITS - 1 - b)),
        ).otherwise(F.lit(0))
        for b, signs in enumerate(projections())
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term, F.lit(SEED)), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Postings of the vocabulary's terms in blocks, block maxima, and contributions.

    ``vocabulary`` has a column ``term``. Gives tables ``terms`` (text, term: its number, bucket, most: largest
    contribution), ``rows`` (row, doc_id), ``weights`` (row, term, s: contribution), ``postings`` (term, block, row)
    and ``blocks`` (term, block, top: array of bucket maxima, size). Terms that no document holds are left out.
    """
    # Row numbers of a scan are the same on every evaluation of it, so the tokenised texts are not written.
    base = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).alias("text"))
    sized = map_texts(base, length, [("n", pa.int64())], "n bigint", "key")
    rows = written(sized.select(F.col("doc_id.row").alias("row"), F.col("doc_id.id").alias("doc_id"), "n"), "lex-rows")
    stats = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.sum("n").alias("total")).first()
    n_docs, total = stats.n_docs or 0, stats.total or 0
    wanted = written(
        vocabulary.select("term").distinct().select(F.col("term").alias("text"), F.monotonically_increasing_id().alias("term")),
        "lex-terms",
    )
    counted = map_texts(
        base,
        term_counts,
        [("n", pa.int64()), ("text", pa.list_(pa.binary())), ("tf", pa.list_(pa.int64()))],
        "n bigint, text array<binary>, tf array<bigint>",
        "key",
    )
    # Only terms of the vocabulary are counted; n still counts all terms of the document.
    tf = written(
        counted.select(F.col("doc_id.row").alias("row"), "n", F.inline(F.arrays_zip("text", "tf")))
        .withColumn("text", F.col("text").cast("string"))
        .join(wanted, "text")
        .select("row", "n", "term", "tf"),
        "lex-counts",
    )
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n_docs + 2)) / (F.col("df") * 2 + 1).cast("double"))).cast("long")
    m = f"(50L + (50L * n * {n_docs}L) div {max(1, total)}L)"
    contribution = F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 20L * {m}))")
    known = written(df.join(wanted, "term").select("term", "text", "df", weight.alias("w"), bucket(F.col("text")).alias("bucket")), "lex-known")
    post = written(
        tf.join(known.select("term", "df", "w", "bucket"), "term").select("row", "term", contribution.alias("s"), "df", "bucket"),
        "lex-postings",
    )
    folded = post.groupBy("row").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("bucket") == i, F.col("s"))), F.lit(0).cast("long")) for i in range(BUCKETS)]).alias("vec")
    )
    vectors = written(folded, "lex-vectors")
    means = [m or 0.0 for m in vectors.agg(*[F.avg(F.col("vec")[i]) for i in range(BUCKETS)]).first()]
    vectors = vectors.withColumn("sig", signature(F.col("vec"), means))
    depth = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("df") / F.lit(float(BLOCK)))).cast("int")))
    spread = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("df") / F.lit(float(BLOCK * (1 << BITS)))).cast("long"))
    block = F.expr(f"shiftright(sig, {BITS} - depth)").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("row"), spread)
    placed = written(
        post.join(vectors, "row").withColumn("depth", depth).select("term", block.alias("block"), "row", "vec"), "lex-blocks"
    )
    blocks = placed.groupBy("term", "block").agg(
        F.array(*[F.max(F.col("vec")[i]) for i in range(BUCKETS)]).alias("top"), F.count(F.lit(1)).alias("size")
    )
    most = post.groupBy("term").agg(F.max("s").alias("most"))
    return {
        "terms": written(known.join(most, "term").select("text", "term", "bucket", "most"), "lex-vocabulary"),
        "rows": rows.select("row", "doc_id"),
        "weights": post.select("row", "term", "s"),
        "postings": placed.select("term", "block", "row"),
        "blocks": written(blocks, "lex-maxima"),
    }


def best(df: DataFrame, key: str, order: list[Column], salt: Column, k: int) -> DataFrame:
    """Rows ranked 1..k per ``key`` (k at most), in two windows: by key and salt, then by key."""
    salted = df.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))).filter(
        F.col("_r") <= k
    )
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(
        F.col("rank") <= k
    ).drop("_salt", "_r")


def group_scores(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Scores of the rows that queries ask for, from the contributions of these rows; those below ``least`` are left out."""
    keys, rows, scores = [], [], []
    if asked.num_rows and held.num_rows:
        known, at = np.unique(held["row"].to_numpy(), return_inverse=True)
        names, which = np.unique(held["term"].to_numpy(), return_inverse=True)
        order = np.lexsort([at, which])
        at, s = at[order], held["s"].to_numpy()[order]
        ends = np.searchsorted(which[order], np.arange(len(names) + 1))
        for q, wanted, some, least in zip(asked["qkey"].to_pylist(), asked["terms"], asked["rows"], asked["least"].to_pylist()):
            some = np.sort(some.values.to_numpy())
            place = np.searchsorted(known, some)
            full, total = np.zeros(len(known), np.int64), np.zeros(len(some), np.int64)
            for t in np.intersect1d(names, wanted.values.to_numpy(), return_indices=True)[1]:
                here, its = at[ends[t] : ends[t + 1]], s[ends[t] : ends[t + 1]]
                if len(here) < 8 * len(some):
                    full[here] += its
                else:
                    k = np.minimum(np.searchsorted(here, place), len(here) - 1)
                    total += np.where(here[k] == place, its[k], 0)
            total += full[place]
            fine = total >= least
            keys.append(np.full(fine.sum(), q, np.int64))
            rows.append(some[fine])
            scores.append(total[fine])
    joined = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, rows, scores)]
    return pa.table(dict(zip(("qkey", "row", "score"), joined)))


def search(index: dict, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Top ``k`` documents with positive score per query: item_id, rank, doc_id, score."""
    q_terms = queries.select(F.col(id_col).alias("item_id"), F.explode(terms(F.col(text_col))).alias("text")).distinct()
    # Null item ids are one query: queries are matched by a key that is never null.
    q = written(
        q_terms.join(index["terms"], "text")
        .groupBy("item_id")
        .agg(F.collect_set("term").alias("terms"), F.collect_set("bucket").alias("buckets"))
        .withColumn("qkey", F.monotonically_increasing_id()),
        "lex-queries",
    )
    bounds = written(
        q.select("qkey", F.explode("terms").alias("term"), "buckets").join(index["blocks"], "term").select(
            "qkey",
            "term",
            "block",
            "size",
            F.aggregate(F.transform("buckets", lambda b: F.col("top")[b]), F.lit(0).cast("long"), lambda a, x: a + x).alias("bound"),
        ),
        "lex-bounds",
    )

    def exact(chosen: DataFrame, least: DataFrame) -> DataFrame:
        """(qkey, row, doc_id, score) of the documents of chosen blocks with at least the score of their query in ``least``."""
        spark = chosen.sparkSession
        pairs = written(
            chosen.select("qkey", "term", "block").join(index["postings"], ["term", "block"]).select("qkey", "row").distinct(),
            "lex-pairs",
        )
        size = max(pairs.count(), index["weights"].count())
        groups = F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_PAIRS)))
        group = F.pmod(F.xxhash64("row"), groups).alias("group")
        asked = pairs.select(group, "qkey", "row").groupBy("group", "qkey").agg(F.collect_list("row").alias("rows"))
        asked = asked.join(q.select("qkey", "terms"), "qkey").join(least, "qkey").select("group", "qkey", "terms", "rows", "least")
        held = index["weights"].select(group, "row", "term", "s")
        scored = asked.groupBy("group").cogroup(held.groupBy("group")).applyInArrow(
            group_scores, "qkey bigint, row bigint, score bigint"
        )
        return written(scored, "lex-scores").join(index["rows"], "row")

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    first_blocks = best(bounds, "qkey", [F.col("bound").desc(), "term", "block"], F.xxhash64("term", "block"), k)
    before = F.sum("size").over(Window.partitionBy("qkey").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    first_blocks = first_blocks.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < FIRST * k)
    first = exact(first_blocks, q.select("qkey", F.lit(1).cast("long").alias("least")))
    kth = best(first, "qkey", order, F.xxhash64("row"), k).groupBy("qkey").agg(
        F.count(F.lit(1)).alias("found"), F.min("score").alias("kth")
    )
    least = written(
        q.select("qkey").join(kth, "qkey", "left").select(
            "qkey", F.when(F.col("found") >= k, F.col("kth")).otherwise(F.lit(1)).cast("long").alias("least")
        ),
        "lex-least",
    )
    running = Window.partitionBy("qkey").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = (
        q.select("qkey", F.explode("terms").alias("term"))
        .join(index["terms"].select("term", "most"), "term")
        .withColumn("reach", F.sum("most").over(running))
        .join(least, "qkey")
        .filter(F.col("reach") >= F.col("least"))
        .select("qkey", "term", "least")
    )
    open_blocks = bounds.join(needed, ["qkey", "term"]).filter(F.col("bound") >= F.col("least"))
    top = best(exact(open_blocks, least), "qkey", order, F.xxhash64("row"), k)
    return top.join(q.select("qkey", "item_id"), "qkey").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.col("score").cast("long").alias("score")
    )


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """Every benchmark item against all documents."""
    vocabulary = benchmark.select(F.explode(terms(F.col("text"))).alias("term"))
    return search(build_index(docs, vocabulary), benchmark, k)
