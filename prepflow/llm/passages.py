"""Passages of more than a number of words that several documents hold, whatever their length in bytes.

Two equal runs of ``least`` words choose the same gram of words in them, the first with the smallest hash: its mark.
Grams that one document holds alone are done with. The words of all runs that choose a mark are its piece; where a
gram always has the same piece, all of it is shared. For the others, the runs of each different piece are hashed once
and compared in shards, by gram, and those that come from several documents are the shared ones. The runs of a gram
with more than ``PIECES`` pieces are counted one by one instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import maybe_in, mixed, text_key, written
from prepflow.llm.suffix_dedup import VALUES, Powers, pair_hash, prefix_sums, range_hash

LEAST = 51
GRAM = 13

#: Different pieces of a gram that are compared in one shard, and those of all grams that a shard holds on average.
PIECES = 2000
SHARD_PIECES = 20_000

#: Bytes of texts handled at a time; a longer text is handled alone.
CHUNK = 1 << 18

#: Bytes between words, and the bytes' values after lower-casing A-Z.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
FOLDED = VALUES[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds of the texts in them) of some texts at a time."""
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Hashes of the words of some texts, and of runs of them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: Powers) -> None:
        if len(data) >= len(powers.up):
            powers = Powers(len(data) + 1)
        inside = ~BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        hashes = range_hash(prefix_sums(data, FOLDED, powers), starts, ends, powers)
        self.first = np.searchsorted(starts, bounds)
        self.count = len(starts)
        self.powers = powers
        self.sums, self.more = np.zeros((2, self.count + 1), np.uint64)
        np.cumsum(hashes * powers.up[: self.count], out=self.sums[1:])
        np.cumsum(mixed(hashes) * powers.up[: self.count], out=self.more[1:])

    def grams(self, gram: int) -> np.ndarray:
        at = np.arange(self.count - gram + 1)
        return range_hash(self.sums, at, at + gram, self.powers)

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return pair_hash(self.sums, self.more, start, end, self.powers)


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of every ``width`` neighbours."""
    least, place = values, np.arange(len(values))
    span = 1
    while span < width:
        step = min(span, width - span)
        later = least[step:] < least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.minimum(least[:-step], least[step:])
        span += step
    return place


def marks(words: Words, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, words before and from there on in the piece, gram hash, piece hash) of the marks of all runs."""
    if words.count < least:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    grams = words.grams(gram)
    # Runs that cross from text to text choose nothing.
    valid = text[: words.count - least + 1] == text[least - 1 :]
    place = np.where(valid, first_least(grams, least - gram + 1), -1)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    end = np.append(begin[1:], len(place)) + least - 1
    used = place[begin] >= 0
    begin, end = begin[used], end[used]
    place = place[begin]
    piece = words.runs(begin, end) ^ (place - begin).astype(np.uint64)
    return text[place], place - words.first[text[place]], place - begin, end - place, grams[place], piece


MARK = "key bigint, lead boolean, place int, back int, ahead int, gram bigint, piece bigint"


def mark_rows(least: int, gram: int):
    """(key, text) -> one row per mark; ``lead`` is true for the first of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(CHUNK + 1)
        for batch in batches:
            for at, data, bounds in chunks(batch.column(1)):
                text, place, back, ahead, key, piece = marks(Words(data, bounds, powers), least, gram)
                columns = [
                    batch.column(0).take(pa.array(text + at)), pa.array(np.diff(text, prepend=-1) > 0),
                    *(pa.array(c.astype(np.int32)) for c in (place, back, ahead)),
                    pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "lead", "place", "back", "ahead", "gram", "piece"])

    return run


PIECE = "gram bigint, piece bigint, low bigint, high bigint, back int, runs binary"


def cut_runs(least: int):
    """(text, wanted marks) -> one row per wanted piece with the hashes of its runs, 8 bytes each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "piece", "low", "high", "back"]
        powers = Powers(CHUNK + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts, wanted = batch.column(0).slice(at, 200), batch.column(1).slice(at, 200)
                rows = wanted.flatten()
                held = []
                for text, some in zip(texts, wanted):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    words = Words(data, np.array([0, len(data)]), powers)
                    start = np.arange(words.count - least + 1)
                    runs = words.runs(start, start + least).tobytes()
                    place, back, ahead = (some.values.field(n).to_numpy() for n in ("place", "back", "ahead"))
                    bounds = zip((8 * (place - back)).tolist(), (8 * (place + ahead - least + 1)).tolist())
                    held.extend(runs[a:b] for a, b in bounds)
                yield pa.RecordBatch.from_arrays([*(rows.field(n) for n in names), pa.array(held, pa.binary())], [*names, "runs"])

    return run


def unpacked(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, number within the row) of all runs."""
    held = runs.to_pylist()
    sizes = np.array([len(x) // 8 for x in held], np.int64)
    of = np.repeat(np.arange(len(held)), sizes)
    return np.frombuffer(b"".join(held), np.int64), of, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]


def shard_spans(least: int):
    """Pieces of some grams -> (gram, piece, since, until) of those with shared runs."""

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        gram, low, high, back = (table.column(n).to_numpy() for n in ("gram", "low", "high", "back"))
        run, of, at = unpacked(table.column("runs"))
        order = np.lexsort((run, gram[of]))
        run, name = run[order], gram[of[order]]
        first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (name[1:] != name[:-1]))))
        several = np.minimum.reduceat(low[of[order]], first) != np.maximum.reduceat(high[of[order]], first)
        shared = np.zeros(len(run), bool)
        shared[order] = np.repeat(several, np.diff(np.append(first, len(run))))
        of, at = of[shared], at[shared]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        end = np.append(begin[1:], len(of))[: len(begin)] - 1
        rows = of[begin]
        columns = [(at[begin] - back[rows]).astype(np.int32), (at[end] - back[rows] + least).astype(np.int32)]
        picked = table.select(["gram", "piece"]).take(pa.array(rows))
        return pa.table([*picked.columns, *map(pa.array, columns)], names=["gram", "piece", "since", "until"])

    return one


def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> one row per run; ``at`` is seen from the mark."""
    names = ["gram", "piece", "low", "high"]
    for batch in batches:
        run, of, at = unpacked(batch.column("runs"))
        at = (at - batch.column("back").to_numpy()[of]).astype(np.int32)
        columns = [*(batch.column(n).take(pa.array(of)) for n in names), pa.array(at), pa.array(run)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "at", "run"])


def counted_spans(pieces: DataFrame, least: int) -> DataFrame:
    """(gram, piece, since, until) of the pieces of frequent grams, run by run."""
    runs = written(
        pieces.mapInArrow(run_rows, "gram bigint, piece bigint, low bigint, high bigint, at int, run bigint"), "word-runs"
    )
    shared = runs.groupBy("gram", "run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return (
        runs.drop("low", "high")
        .join(shared.filter("low <> high").select("gram", "run"), ["gram", "run"])
        .groupBy("gram", "piece")
        .agg(F.min("at").alias("since"), (F.max("at") + least).alias("until"))
    )


def piece_spans(rows: DataFrame, again: DataFrame, least: int, pieces: int) -> DataFrame:
    """(gram, piece, since, until) of the marks whose gram has several pieces: what is shared, seen from the mark."""
    named = again.groupBy("gram", "piece").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.min(F.struct("key", "place", "back", "ahead")).alias("of")
    )
    wanted = written(
        named.groupBy(F.col("of.key").alias("want")).agg(
            F.collect_list(F.struct("gram", "piece", "low", "high", "of.place", "of.back", "of.ahead")).alias("wanted")
        ),
        "wanted-pieces",
    )
    # Of rows that repeat an id and text, each gives the same pieces.
    texts = maybe_in(rows, wanted.select("want"), "key", "__maybe").filter("__maybe")
    cut = written(
        texts.join(wanted, F.col("key") == F.col("want")).select("text", "wanted").mapInArrow(cut_runs(least), PIECE),
        "word-pieces",
    )
    often = written(cut.groupBy("gram").count().filter(F.col("count") > pieces).select("gram"), "frequent-grams")
    frequent = not often.isEmpty()
    dealt = cut.join(often, "gram", "left_anti") if frequent else cut
    shards = 1 + cut.count() // SHARD_PIECES
    found = (
        dealt.groupBy(F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"))
        .applyInArrow(shard_spans(least), "gram bigint, piece bigint, since int, until int")
    )
    if frequent:
        found = found.unionByName(counted_spans(cut.join(often, "gram", "left_semi"), least))
    return found.groupBy("gram", "piece").agg(F.min("since").alias("since"), F.max("until").alias("until"))


def shared_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, pieces: int = PIECES
) -> DataFrame:
    """(key, n_shared_words) of the rows with such words, by ``text_key``: how many stand in a shared passage.

    That is a run of ``least`` or more words that another row holds too, with A-Z lower-cased and whatever blanks
    between them. Null counts as empty; rows that repeat an id and text share all words, if those are enough, and have
    one row here.
    """
    rows = docs.select(text_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = written(rows.mapInArrow(mark_rows(least, gram), MARK), "word-marks")
    grams = written(
        found.groupBy("gram")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("key", "piece") for n, f in (("low", F.min), ("high", F.max))))
        .filter("low_key <> high_key")
        .select("gram", (F.col("low_piece") == F.col("high_piece")).alias("whole")),
        "shared-grams",
    )
    maybe = maybe_in(found, grams.select("gram"), "gram", "__maybe").filter("__maybe").drop("__maybe")
    again = written(maybe.join(grams, "gram"), "shared-marks")
    everything = ((F.col("place") - F.col("back")).alias("since"), (F.col("place") + F.col("ahead")).alias("until"))
    some = again.filter("not whole")
    spans = again.filter("whole").select("key", *everything)
    spans = spans.unionByName(
        some.join(piece_spans(rows, some, least, pieces), ["gram", "piece"]).select(
            "key", (F.col("place") + F.col("since")).alias("since"), (F.col("place") + F.col("until")).alias("until")
        )
    )
    copied = written(found.filter("lead").groupBy("key").count().filter("count > 1").select("key"), "copied-keys")
    if not copied.isEmpty():
        spans = spans.unionByName(found.join(copied, "key").select("key", *everything))
    held = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("since", "until"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reach"), F.lit(0).cast("bigint").alias("n")),
        lambda seen, s: F.struct(
            F.greatest(seen["reach"], s["until"]).alias("reach"),
            (seen["n"] + F.greatest(F.lit(0), s["until"] - F.greatest(seen["reach"], s["since"]))).alias("n"),
        ),
        lambda seen: seen["n"],
    )
    return held.select("key", covered.alias("n_shared_words"))
