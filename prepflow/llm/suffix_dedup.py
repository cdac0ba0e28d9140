"""Removal of long byte strings that repeat, found with suffix arrays built in shards.

Two equal strings of ``length`` bytes must meet in one shard. Every such window chooses the place in it where a short
gram has the smallest hash: its anchor. Equal windows have equal anchors, so the grams of all anchors are counted,
and those that occur once are done with. The text around an anchor that holds all its windows is its piece.
Anchors whose gram always has the same piece repeat as a whole. For the others, each different piece is cut out once
and parted: windows that start within ``STEP`` bytes of each other share a core, and only parts whose core occurs in
other parts too are dealt to shards, by their core. A shard's suffix array is built by induced sorting, and windows
that share ``length`` bytes with another place are those whose permuted common prefixes say so.

A core with more than ``PIECES`` different parts would overload a shard: its windows are counted one by one by
128 bits of hash, which partial aggregation combines before anything meets.

All windows of a piece hold its anchor's gram, so those to remove cover one run of bytes without a gap: a part and a
piece need no list of windows, only where the first begins and the last ends.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import mixed, text_key, written
from prepflow.llm.suffixes import common_prefixes, suffix_array

LENGTH = 400
GRAM = 256
STEP = 73
NARROW = 16
PIECES = 2000

#: Bytes of different pieces that a shard holds on average.
SHARD_BYTES = 1 << 21

#: Bytes of a text handled at a time; slices overlap by two windows.
SLICE = 1 << 20

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
OTHER = mixed(np.arange(257, 513, dtype=np.uint64) * np.uint64(BASE))


class Powers:
    """Powers of the base and of its inverse, for ranges of one slice."""

    def __init__(self, size: int = SLICE + 4 * LENGTH) -> None:
        self.up = self.of(BASE, size)
        self.down = self.of(INVERSE, size)

    @staticmethod
    def of(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def prefix_sums(data: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers.up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the bytes from start to end, wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram hash, piece hash) of the anchors of all windows of a text, slice by slice."""
    found = []
    n = len(data)
    for at in range(0, max(n - length + 1, 0), SLICE):
        # Windows that start in this slice, and what their anchors' pieces reach.
        low, high = max(0, at - length), min(n, at + SLICE + 2 * length)
        part = data[low:high]
        sums, more = prefix_sums(part, VALUES, powers), prefix_sums(part, OTHER, powers)
        starts = np.arange(at - low, min(n, at + SLICE + length - 1) - low - gram + 1)
        grams = range_hash(sums, starts, starts + gram, powers)
        width = length - gram + 1
        least = sliding(grams, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate((edge, least, edge)), width, np.maximum)
        place = starts[most == grams]
        begin, end = np.maximum(place - (length - gram), 0), np.minimum(place + length, len(part))
        piece = range_hash(sums, begin, end, powers) ^ (
            range_hash(more, begin, end, powers) * np.uint64(3) + (place - begin).astype(np.uint64)
        )
        found.append((place + low, grams[place - starts[0]], piece))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    place, key, piece = (np.concatenate(x) for x in zip(*found))
    # Slices overlap, so an anchor may come twice.
    place, first = np.unique(place, return_index=True)
    return place, key[first], piece[first]


def anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            held, count = [], 0
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                place, key, piece = anchors(np.frombuffer(data, np.uint8), length, gram, powers)
                if len(place):
                    held.append((i, zlib.crc32(data), place, key, piece))
                    count += len(place)
                if held and (count > 100_000 or i == batch.num_rows - 1):
                    yield rows(batch.column(0), held)
                    held, count = [], 0
            if held:
                yield rows(batch.column(0), held)

    def rows(ids: pa.Array, held: list) -> pa.RecordBatch:
        sizes = [len(p) for _, _, p, _, _ in held]
        index = np.repeat([i for i, *_ in held], sizes)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(index)),
                pa.array(np.repeat([c for _, c, *_ in held], sizes).astype(np.int64)),
                pa.array(np.concatenate([p for _, _, p, _, _ in held])),
                pa.array(np.concatenate([k for *_, k, _ in held]).view(np.int64)),
                pa.array(np.concatenate([q for *_, q in held]).view(np.int64)),
            ],
            ["doc_id", "crc", "place", "gram", "piece"],
        )

    return run


def cut_pieces(length: int, gram: int):
    """Texts with the anchors wanted from them -> one row per anchor with its piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "piece", "times", "origin", "start", "offset", "bytes"]
        for batch in batches:
            rows: list[tuple] = []
            for text, origin, wanted in zip(batch.column(0), batch.column(1), batch.column(2)):
                data = text.as_py().encode()
                for want in wanted.as_py():
                    start = max(0, want["place"] - (length - gram))
                    rows.append(
                        (want["gram"], want["piece"], want["times"], origin.as_py(), start, want["place"] - start,
                         data[start : want["place"] + length])
                    )
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    return run


def repeated(s: np.ndarray, valid: np.ndarray, place: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Which valid places of a string begin ``length`` symbols that also begin at another place.

    Symbol 1 ends a piece, 0 the string. Equal ``place`` is the same place, and ``times`` above 1 is several.
    """
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, s == 1, 8 * length)
    order = sa[valid[sa]]
    flags = np.zeros(len(s), bool)
    if len(order):
        # Between two windows that share all their symbols only such windows stand, so the others never part a group.
        first = np.flatnonzero(np.concatenate(([True], shared[order[1:]] < length)))
        low, high = np.minimum.reduceat(place[order], first), np.maximum.reduceat(place[order], first)
        often = np.maximum.reduceat(times[order], first) > 1
        flags[order] = np.repeat((low != high) | often, np.diff(np.append(first, len(order))))
    return flags


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column one after another, and where each value begins and the last one ends."""
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in column.to_pylist()]))).astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), bounds


def pair_hash(sums: np.ndarray, more: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return range_hash(sums, start, end, powers) ^ (range_hash(more, start, end, powers) * np.uint64(3))


def place_of(origin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for a byte of a document."""
    return mixed(origin.astype(np.int64).view(np.uint64) + at.astype(np.uint64) * np.uint64(BASE)).view(np.int64)


def part_pieces(length: int, gram: int, step: int):
    """Pieces -> one row per part: windows whose starts, seen from the anchor, lie in the same ``step`` bytes.

    ``key`` names the core that all windows of the part share, ``part`` its whole content, ``where`` its place.
    ``low`` is the first window's start in the piece and ``more`` how many follow; ``skip`` windows of the block,
    which has ``span`` more than one, are missing before it.
    """
    names = ["gram", "piece", "times", "origin", "start", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        first = np.arange(gram - length, 1, step)
        last = np.minimum(first + step - 1, 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                data, bounds = flat(rows.column("bytes"))
                sums, more = prefix_sums(data, VALUES, powers), prefix_sums(data, OTHER, powers)
                base, size = bounds[:-1, None], np.diff(bounds)[:, None]
                offset = rows.column("offset").to_numpy()[:, None]
                low, high = np.maximum(first + offset, 0), np.minimum(last + offset, size - length)
                used = low <= high
                begin, end = (base + last + offset)[used], (base + first + offset + length)[used]
                key = mixed(pair_hash(sums, more, begin, end, powers) + np.broadcast_to(first, used.shape)[used].astype(np.uint64))
                skip = low - first - offset
                part = pair_hash(sums, more, (base + low)[used], (base + high + length)[used], powers)
                part = mixed(part + skip[used].astype(np.uint64))
                which = np.nonzero(used)[0]
                held = {n: rows.column(n).to_numpy()[which] for n in names}
                columns = [
                    *held.values(), key.view(np.int64), part.view(np.int64), place_of(held["origin"], held["start"] + low[used]),
                    low[used], (high - low)[used], skip[used], np.broadcast_to(last - first, used.shape)[used],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], [*names, "key", "part", "where", "low", "more", "skip", "span"]
                )

    return run


PART = (
    "gram bigint, piece bigint, times bigint, origin bigint, start bigint, offset bigint, key bigint, part bigint,"
    " where bigint, low bigint, more bigint, skip bigint, span bigint"
)


def shard_spans(length: int, step: int):
    """Parts of a shard -> (key, part, since, until), bounds seen from the part's first byte."""

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        times, origin, start, skip, more, span = (
            table.column(n).to_numpy() for n in ("times", "origin", "start", "skip", "more", "span")
        )
        data, bounds = flat(table.column("bytes"))
        flags = shard_windows(data, bounds[:-1], times, origin, start, skip, more, span, length, step)
        used = np.flatnonzero(flags.any(axis=1))
        first = flags[used].argmax(axis=1) - skip[used]
        last = flags.shape[1] - 1 - flags[used, ::-1].argmax(axis=1) - skip[used]
        picked = table.take(pa.array(used))
        return pa.table(
            [picked.column("key"), picked.column("part"), pa.array(first), pa.array(last + length)],
            names=["key", "part", "since", "until"],
        )

    return one


def shard_windows(
    data: np.ndarray, base: np.ndarray, times: np.ndarray, origin: np.ndarray, start: np.ndarray,
    skip: np.ndarray, more: np.ndarray, span: np.ndarray, length: int, step: int,
) -> np.ndarray:
    """For each part and window of its block, whether the window also starts at another place.

    Parts are cut once more into runs of NARROW windows. What all windows of a run share becomes one name, so that a
    run is its few bytes before the name, the name and the few bytes after it; only runs whose shared bytes come
    with different surroundings need to be told apart, and those strings go into the suffix array.
    """
    powers = Powers(len(data) + 1)
    sums, also = prefix_sums(data, VALUES, powers), prefix_sums(data, OTHER, powers)
    first = np.arange(0, step, NARROW)[None, :]
    last = np.minimum(first + NARROW - 1, span[:, None])
    low, high = np.maximum(first, skip[:, None]), np.minimum(last, (skip + more)[:, None])
    used = low <= high
    row, block = np.nonzero(used)
    first, last, low, high = first[0][block], last[used], low[used], high[used]
    at = base[row] - skip[row]
    core = mixed(pair_hash(sums, also, at + last, at + first + length, powers) + (last - first).astype(np.uint64))
    whole = pair_hash(sums, also, at + low, at + high + length, powers)
    whole = mixed(mixed(whole + (low - first).astype(np.uint64)) + core)
    _, one, of = np.unique(whole, return_index=True, return_inverse=True)
    place = place_of(origin[row], start[row] + low - skip[row])
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(one)))
    often = np.maximum.reduceat(times[row][order], cuts) > 1
    often |= np.minimum.reduceat(place[order], cuts) != np.maximum.reduceat(place[order], cuts)
    _, name, different = np.unique(core[one], return_inverse=True, return_counts=True)
    column = np.arange(NARROW)[None, :]
    inside = (column >= (low - first)[one][:, None]) & (column <= (high - first)[one][:, None])
    flags = inside & often[:, None]
    width = (last - first)[one]
    for w in np.unique(width):
        some = np.flatnonzero((different[name] > 1) & (width == w))
        if len(some):
            pick = one[some]
            found = named_windows(
                data, (at + first)[pick], (low - first)[pick], (high - first)[pick], name[some], int(w), length,
                np.where(often[some], 2, 1), origin[row][pick], (start[row] - skip[row] + first)[pick],
            )
            flags[some, : w + 1] |= found
    out = np.zeros((len(base), step + NARROW), bool)
    out[row[:, None], first[:, None] + column] = flags[of]
    return out[:, :step]


def named_windows(
    data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, name: np.ndarray, w: int, length: int,
    times: np.ndarray, origin: np.ndarray, start: np.ndarray,
) -> np.ndarray:
    """Windows 0 to ``w`` of runs: flags of those that occur at another place too.

    A window is its bytes before the name, the name's three digits and its bytes after it: w + 3 symbols.
    """
    column = np.arange(w)[None, :]
    left = np.where(column >= low[:, None], data[np.minimum(at[:, None] + column, len(data) - 1)].astype(np.int64) + 2, 1)
    right = np.where(
        column < high[:, None], data[np.minimum(at[:, None] + length + column, len(data) - 1)].astype(np.int64) + 2, 1
    )
    digits = np.stack([name & 255, (name >> 8) & 255, (name >> 16) & 255], 1) + 258
    s = np.concatenate([left, digits, right, np.ones((len(at), 1), np.int64)], 1)
    size = s.shape[1]
    s = np.append(s.ravel(), 0)
    window = np.arange(w + 1)[None, :]
    valid = np.zeros((len(at), size), bool)
    valid[:, : w + 1] = (window >= low[:, None]) & (window <= high[:, None])
    place = np.zeros((len(at), size), np.int64)
    place[:, : w + 1] = place_of(np.repeat(origin, w + 1), (start[:, None] + window).ravel()).reshape(len(at), w + 1)
    flags = repeated(s, np.append(valid.ravel(), False), np.append(place.ravel(), 0), np.append(np.repeat(times, size), 1), w + 3)
    return flags[:-1].reshape(len(at), size)[:, : w + 1]


def window_rows(length: int):
    """Parts -> one row per window with 128 bits of hash and the place it was cut from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(4 * length)
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                n = len(data) - length + 1
                at = np.arange(n)
                h1, h2 = (
                    range_hash(prefix_sums(data, v, powers), at, at + length, powers).view(np.int64) for v in (VALUES, OTHER)
                )
                same = lambda x: pa.array(np.full(n, x))
                place = np.uint64(row["origin"] & (2**64 - 1)) + (row["start"] + at).astype(np.uint64) * np.uint64(BASE)
                yield pa.RecordBatch.from_arrays(
                    [same(row["key"]), same(row["part"]), same(row["times"]), pa.array(at), pa.array(h1), pa.array(h2),
                     pa.array(mixed(place).view(np.int64))],
                    ["key", "part", "times", "at", "h1", "h2", "where"],
                )

    return run


def window_spans(parts: DataFrame, length: int) -> DataFrame:
    """(key, part, since, until) of the parts of frequent cores, by counting windows."""
    rows = written(
        parts.mapInArrow(
            window_rows(length), "key bigint, part bigint, times bigint, at bigint, h1 bigint, h2 bigint, where bigint"
        ),
        "windows",
    )
    often = written(
        rows.groupBy("h1", "h2")
        .agg(F.min("where").alias("low"), F.max("where").alias("high"), F.max("times").alias("times"))
        .filter("low <> high or times > 1")
        .select("h1", "h2"),
        "repeated-windows",
    )
    return (
        rows.join(often, ["h1", "h2"])
        .groupBy("key", "part")
        .agg(F.min("at").alias("since"), (F.max("at") + length).alias("until"))
    )


def piece_spans(cut: DataFrame, length: int, gram: int, step: int, pieces: int, shard_bytes: int) -> DataFrame:
    """(gram, piece, since, until) of cut pieces, bounds seen from the anchor."""
    rows = written(cut.mapInArrow(part_pieces(length, gram, step), PART), "part-rows")
    parts = written(
        rows.groupBy("key", "part").agg(
            F.when((F.max("times") > 1) | (F.min("where") != F.max("where")), 2).otherwise(1).cast("bigint").alias("times"),
            F.min(F.struct("gram", "piece", "origin", "start", "low", "more", "skip", "span")).alias("of"),
        ),
        "parts",
    )
    per_key = written(parts.groupBy("key").agg(F.count("*").alias("different")), "cores")
    counted = parts.join(per_key, "key")
    own = counted.filter("different = 1 and times > 1").select(
        "key", "part", F.lit(0).cast("bigint").alias("since"), (F.col("of.more") + length).alias("until")
    )
    shared = written(
        counted.filter("different > 1")
        .select("key", "part", "times", "different", "of.*")
        .join(cut.select("gram", "piece", "bytes"), ["gram", "piece"])
        .select(
            "key", "part", "times", "different", "origin", (F.col("start") + F.col("low")).alias("start"), "more", "skip", "span",
            F.substring("bytes", (F.col("low") + 1).cast("int"), (F.col("more") + length).cast("int")).alias("bytes"),
        ),
        "shared-parts",
    )
    shards = 1 + shared.count() * (length + step) // shard_bytes
    dealt = shared.filter(F.col("different") <= pieces).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(shard_spans(length, step), "key bigint, part bigint, since bigint, until bigint")
    frequent = shared.filter(F.col("different") > pieces)
    if not frequent.isEmpty():
        found = found.unionByName(window_spans(frequent, length))
    found = written(own.unionByName(found), "part-spans")
    seen = F.col("low") - F.col("offset")
    return (
        rows.join(found, ["key", "part"])
        .groupBy("gram", "piece")
        .agg(F.min(F.col("since") + seen).alias("since"), F.max(F.col("until") + seen).alias("until"))
    )


def removed_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    step: int = STEP, pieces: int = PIECES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, crc, spans): bounds of the runs to remove, in order, by id and checksum of the text.

    The last run may reach beyond the text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = written(
        rows.mapInArrow(
            anchor_rows(length, gram), f"doc_id {id_type}, crc bigint, place bigint, gram bigint, piece bigint"
        ),
        "anchors",
    )
    grams = written(
        found.groupBy("gram")
        .agg(F.count("*").alias("times"), F.min("piece").alias("low"), F.max("piece").alias("high"))
        .filter("times > 1")
        .select("gram", (F.col("low") == F.col("high")).alias("whole")),
        "repeated-grams",
    )
    again = written(found.join(grams, "gram"), "repeated-anchors")
    mixed_ = written(
        again.filter("not whole")
        .groupBy("gram", "piece")
        .agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "crc", "place")).alias("at")),
        "pieces",
    )
    wanted = mixed_.groupBy(F.col("at.doc_id").alias("want_id"), F.col("at.crc").alias("want_crc")).agg(
        F.collect_list(F.struct("gram", "piece", "times", F.col("at.place").alias("place"))).alias("wanted")
    )
    texts = rows.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.crc32(F.col("text").cast("binary")) == F.col("want_crc"))
    )
    cut = (
        texts.select("text", F.xxhash64("doc_id", "want_crc").alias("origin"), "wanted")
        .mapInArrow(
            cut_pieces(length, gram),
            "gram bigint, piece bigint, times bigint, origin bigint, start bigint, offset bigint, bytes binary",
        )
    )
    # Of rows that repeat an id and text, one gives the piece; its count tells of the others.
    cut = written(cut, "cut-pieces").dropDuplicates(["gram", "piece"])
    spans = written(piece_spans(cut, length, gram, step, pieces, shard_bytes), "piece-spans")
    part = again.filter("not whole").join(spans, ["gram", "piece"]).select("doc_id", "crc", "place", "since", "until")
    whole = again.filter("whole").select(
        "doc_id", "crc", "place", F.lit(gram - length).cast("bigint").alias("since"), F.lit(length).cast("bigint").alias("until")
    )
    return (
        part.unionByName(whole)
        .groupBy("doc_id", "crc")
        .agg(
            F.collect_list(
                F.struct(
                    F.greatest(F.lit(0), F.col("place") + F.col("since")).alias("since"),
                    (F.col("place") + F.col("until")).alias("until"),
                )
            ).alias("spans")
        )
        .mapInArrow(merge_spans, f"doc_id {id_type}, crc bigint, spans array<bigint>")
    )


def merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans -> lists of the bounds of their sorted, disjoint runs; no list is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("spans")
        since, until = (lists.flatten().field(n).to_numpy() for n in ("since", "until"))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        # Each row's places follow those of the row before, with a gap.
        apart = int(until.max(initial=0)) + 1
        order = np.argsort(row * apart + since, kind="stable")
        row, since = row[order], since[order]
        reach = np.maximum.accumulate(row * apart + until[order])
        first = np.flatnonzero(np.concatenate(([True], (row * apart + since)[1:] > reach[:-1])))
        ends = reach[np.append(first[1:], len(row)) - 1] - row[first] * apart
        bounds = np.concatenate(([0], 2 * np.cumsum(np.bincount(row[first], minlength=len(lists))))).astype(np.int32)
        runs = pa.ListArray.from_arrays(bounds, pa.array(np.stack([since[first], ends], 1).ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("crc"), runs], ["doc_id", "crc", "spans"])


def merged(spans: list[int] | None, n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint runs within a text of n bytes."""
    if not spans:
        return []
    pairs = np.asarray(spans, np.int64).reshape(-1, 2)
    pairs = np.minimum(pairs[np.argsort(pairs[:, 0], kind="stable")], n)
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    ends = np.append(reach[first[1:] - 1], reach[-1])
    return [(a, b) for a, b in zip(pairs[first, 0].tolist(), ends.tolist()) if a < b]


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, texts, spans, copied = batch.columns
        out: list[tuple] = []
        for text, span, all_ in zip(texts, spans, copied):
            data = text.as_py().encode()
            runs = merged([0, len(data)] if all_.as_py() else span.as_py(), len(data))
            at, kept = 0, []
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((len(data), len(data) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for at in range(0, len(out), 1000):
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, 1000), keys.slice(at, 1000),
                    *[pa.array(list(c), k) for c, k in zip(zip(*out[at : at + 1000]), kinds)],
                ],
                ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    step: int = STEP, pieces: int = PIECES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in this or another row, is removed;
    all is judged on the input. Strings lie within one text. Null counts as empty; texts shorter than ``length`` are
    left as they are. Rows that repeat an id and text repeat each other; an empty table gives an empty result; other
    columns are not looked at. ``kept`` may end within a character, so it is binary. ``key`` is the row's ``text_key``.
    """
    spans = written(removed_spans(docs, id_col, text_col, length, gram, step, pieces, shard_bytes), "spans").select(
        F.col("doc_id").alias("of"), F.col("crc").alias("of_crc"), "spans"
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "crc", F.crc32(F.col("text").cast("binary"))
    )
    copied = written(
        rows.filter(F.octet_length("text") >= length).groupBy("doc_id", "crc").count().filter("count > 1"), "copied-rows"
    ).select(F.col("doc_id").alias("of"), F.col("crc").alias("of_crc"), F.lit(True).alias("copied"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("crc") == F.col("of_crc"))
    known = copied.join(
        spans, copied["of"].eqNullSafe(spans["of"]) & (copied["of_crc"] == spans["of_crc"]), "full"
    ).select(
        F.coalesce(copied["of"], spans["of"]).alias("of"), F.coalesce(copied["of_crc"], spans["of_crc"]).alias("of_crc"),
        "spans", F.coalesce("copied", F.lit(False)).alias("copied"),
    )
    joined = rows.join(known, same, "left").select(
        "doc_id", text_key("doc_id", "text").alias("key"), "text", "spans",
        (F.coalesce("copied", F.lit(False)) & (F.octet_length("text") >= length)).alias("copied"),
    )
    id_type = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        remove,
        f"doc_id {id_type}, key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string",
    )
