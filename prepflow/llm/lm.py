"""Language-model scoring with a bigram model kept in Elias-Fano tries.

Tokens: lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+`` of the whole text, then one end token (the empty string,
which no word can be). Counts come from every training document; nothing is sampled, so the model grows with the
input.

Model. Unigrams are the add-0.1 model over the V training tokens plus one class for unknown words:
p1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). Bigrams (the first token's context is a start symbol) are interpolated by
absolute discounting: p2(w | u) = (c(u, w) - D) / c(u) + D T(u) / c(u) p1(w), T(u) the distinct successors of u. Kept in
backoff form: a seen pair costs log10 p2, an unseen one log10 of D T(u) / c(u) plus log10 p1(w). Both levels are proper
distributions. All these log10 values are quantised to 16 bits over [``LOW``, 0], so a token's log10 probability is off
by at most ``STEP`` (``2 * STEP`` through a backoff) from the unquantised model.

Trie. Word ids are dense ranks by count (frequent words small). The model is sharded by context; a shard holds, per
level, monotone sequences in Elias-Fano form (high bits in unary with a rank directory, low bits packed): the sorted
context ids (level 1), the pointers where each context's block of successors starts (monotone; their differences are
T(u)), and the successors relative to their context (block k holds k (V + 1) + w, so the level is one monotone
sequence), with the counts c(u, w). A shard is one flat buffer of 64-bit words read through views. Looking up finds a
context by successor search in level 1, then the word by successor search inside the context's block. Counts of single
words follow from their ids: ids rank by count, and the first id of each different count is known to every task.

At scale. Documents are taken in chunks of about ``CHUNK_BYTES`` of text. A chunk is its tokens' codes in a dictionary of
its own, so only its different words meet the global ids, and only its different pairs, as packed arrays, are dealt to
the shards that count and look them up (``SHARD_ENTRIES`` tokens a shard on average). A context that occurs more than
``GROUP_ROWS`` times is dealt to several shards by its successors, and its T(u) is the sum over them. The answers go
back to the chunk, which adds up its documents. Chunks are made again for each pass over them rather than written.

Edge cases: null texts count as empty; an empty text has the end token only. Unknown words take the unknown class. No
training rows: V = N = 0, every token has probability 1 (log 0). Repeated doc_ids are separate rows. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from prepflow.llm.common import mixed, written
from prepflow.operators.ordering import number_rows

#: Fixed values of the contract: the add-constant of the base model and the end token (no word is empty).
ADD = 0.1
END = ""

#: Discount of the bigram level; quantisation range and step of stored log10 values.
DISCOUNT = 0.75
LOW = -40.0
STEP = -LOW / 65535

#: Tokens a shard aims at; times from which on a context is dealt to several shards.
SHARD_ENTRIES = 2_000_000
GROUP_ROWS = 2_000_000

#: Bytes of text of a chunk, unless a text is longer.
CHUNK_BYTES = 1 << 24

#: Word ids that are packed at a time.
PACKED_ROWS = 2_000_000

#: A sequence with less than so many values for each query is decoded as a whole.
FEW = 16

ONE = np.uint64(1)


def quantised(x: np.ndarray) -> np.ndarray:
    return np.round((np.maximum(x, LOW) - LOW) / STEP).astype(np.uint16)


def value(q: np.ndarray) -> np.ndarray:
    return LOW + q.astype(np.float64) * STEP


class EliasFano:
    """A monotone sequence of n integers below ``universe`` in about n (2 + log2(universe / n)) bits."""

    def __init__(self, low_bits: int, n: int, high: np.ndarray, ranks: np.ndarray, low: np.ndarray):
        self.l, self.n, self.high, self.ranks, self.low = low_bits, n, high, ranks, low
        self.decoded: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        l = max(0, int(math.floor(math.log2(universe / n)))) if n and universe > n else 0
        hi = (values >> np.uint64(l)) + np.arange(n, dtype=np.uint64)
        nbits = n + (int(universe) >> l) + 2
        high = np.zeros(nbits // 64 + 2, dtype=np.uint64)
        np.bitwise_or.at(high, (hi >> np.uint64(6)).astype(np.int64), ONE << (hi & np.uint64(63)))
        ranks = np.concatenate([[0], np.cumsum(popcount(high))[:-1]]).astype(np.uint64)
        low = np.zeros((n * l) // 64 + 2, dtype=np.uint64)
        if l:
            lv = values & ((ONE << np.uint64(l)) - ONE)
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, lv << shift)
            spill = shift + np.uint64(l) > np.uint64(64)
            np.bitwise_or.at(low, word[spill] + 1, lv[spill] >> (np.uint64(64) - shift[spill]))
        return cls(l, n, high, ranks, low)

    def lows(self, i: np.ndarray) -> np.ndarray:
        at = i * np.uint64(self.l)
        w, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        lo = self.low[w] >> shift
        spill = shift + np.uint64(self.l) > np.uint64(64)
        lo[spill] |= self.low[w[spill] + 1] << (np.uint64(64) - shift[spill])
        return lo & ((ONE << np.uint64(self.l)) - ONE)

    def values(self) -> np.ndarray:
        """All values; kept, since lookups that need them come in batches."""
        if self.decoded is None:
            i = np.arange(self.n, dtype=np.uint64)
            bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
            high = np.flatnonzero(bits).astype(np.uint64) - i
            self.decoded = (high << np.uint64(self.l)) | self.lows(i) if self.l else high
        return self.decoded

    def access(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.uint64)
        if len(i) * FEW >= self.n:
            return self.values()[i.astype(np.int64)]
        word = np.searchsorted(self.ranks, i, side="right") - 1
        bits = (self.high[word][:, None] >> np.arange(64, dtype=np.uint64)) & ONE
        r = (i - self.ranks[word]).astype(np.int64)
        pos = np.argmax(np.cumsum(bits, axis=1) > r[:, None], axis=1).astype(np.uint64)
        high = word.astype(np.uint64) * np.uint64(64) + pos - i
        return (high << np.uint64(self.l)) | self.lows(i) if self.l else high

    def successor(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Per query, the first index in [lo, hi) whose value is >= target (hi if none), by binary search."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        target = np.asarray(target, dtype=np.uint64)
        if len(target) * FEW >= self.n:
            return np.clip(np.searchsorted(self.values(), target), lo, hi)
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            idx = np.flatnonzero(open_)
            below = self.access(mid[idx]) < target[idx]
            lo[idx] = np.where(below, mid[idx] + 1, lo[idx])
            hi[idx] = np.where(below, hi[idx], mid[idx])

    def words(self) -> list[np.ndarray]:
        return [np.array([self.l, self.n, len(self.high), len(self.low)], dtype=np.uint64), self.high, self.ranks, self.low]

    @classmethod
    def read(cls, buf: np.ndarray, at: int) -> tuple["EliasFano", int]:
        l, n, nh, nl = (int(x) for x in buf[at : at + 4])
        at += 4
        high, ranks, low = buf[at : at + nh], buf[at + nh : at + 2 * nh], buf[at + 2 * nh : at + 2 * nh + nl]
        return cls(l, n, high, ranks, low), at + 2 * nh + nl


def popcount(x: np.ndarray) -> np.ndarray:
    bytes_ = x.view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bytes_, axis=1).sum(axis=1).astype(np.uint64)


def build_shard(u: np.ndarray, w: np.ndarray, counts: np.ndarray, vocab: int) -> bytes:
    """One shard of pairs sorted by (u, w): level 1 (contexts), pointers, level 2 (words in contexts, counts)."""
    contexts, starts = np.unique(u, return_index=True)
    k = np.repeat(np.arange(len(contexts)), np.diff(np.append(starts, len(u))))
    rel = k.astype(np.uint64) * np.uint64(vocab + 1) + w.astype(np.uint64)
    parts = [np.array([len(contexts), len(rel)], dtype=np.uint64)]
    parts += EliasFano.encode(contexts, vocab + 1).words()
    parts += EliasFano.encode(np.append(starts, len(rel)), len(rel) + 1).words()
    parts += EliasFano.encode(rel, max(1, len(contexts)) * (vocab + 1)).words()
    parts += [counts.astype(np.uint64)]
    return np.concatenate(parts).tobytes()


class Shard:
    def __init__(self, blob: bytes):
        buf = np.frombuffer(blob, dtype=np.uint64)
        self.n1, n2 = int(buf[0]), int(buf[1])
        self.contexts, at = EliasFano.read(buf, 2)
        self.starts, at = EliasFano.read(buf, at)
        self.successors, at = EliasFano.read(buf, at)
        self.counts = buf[at : at + n2]

    def blocks(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each context and the bounds of its block, which is empty for what is no context."""
        k = self.contexts.successor(np.zeros(len(u)), np.full(len(u), self.n1), u)
        there = k < self.n1
        there[there] = self.contexts.access(k[there]) == u[there].astype(np.uint64)
        lo, hi = np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=np.int64)
        lo[there] = self.starts.access(k[there]).astype(np.int64)
        hi[there] = self.starts.access(k[there] + 1).astype(np.int64)
        return k, lo, hi

    def look_up(self, u: np.ndarray, runs: np.ndarray, w: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
        """T of each context u, and the counts of its pairs with the next ``runs`` words of w (below 0: unknown)."""
        k, lo, hi = self.blocks(u)
        successors = hi - lo
        k, lo, hi = np.repeat(k, runs), np.repeat(lo, runs), np.repeat(hi, runs)
        target = k.astype(np.uint64) * np.uint64(vocab + 1) + np.maximum(w, 0).astype(np.uint64)
        j = self.successors.successor(lo, hi, target)
        hit = (j < hi) & (w >= 0)
        hit[hit] = self.successors.access(j[hit]) == target[hit]
        counts = np.zeros(len(w), dtype=np.int64)
        counts[hit] = self.counts[j[hit]]
        return successors, counts


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers from 0, each in its fewest bytes and byte by byte, compressed."""
    planes, head = [], []
    for x in arrays:
        x = np.ascontiguousarray(x, dtype=np.uint64)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes += [(x >> np.uint64(8 * b)).astype(np.uint8) for b in range(width)]
        head += [len(x), width]
    raw = np.array([len(arrays), *head], dtype=np.int64).tobytes() + b"".join(p.tobytes() for p in planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 * (2 * n + 1), []
    for size, width in head.reshape(-1, 2).tolist():
        x = np.zeros(size, dtype=np.int64)
        for b in range(width):
            x |= np.frombuffer(raw, np.uint8, size, at).astype(np.int64) << (8 * b)
            at += size
        out.append(x)
    return out


class Chunk(NamedTuple):
    """Documents as codes of their tokens, each with an end; ``words`` has the word of each code, the end last."""

    ids: pa.Array
    train: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    words: pa.Array


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """Numbered chunks of (id, train, text, partition); a scan gives the same ones on every evaluation."""
    number = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        number = number or batch.column(3)[0].as_py() << 32
        texts = pc.fill_null(batch.column(2), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        share = ends[-1] / -(-ends[-1] // CHUNK_BYTES) if len(ends) and ends[-1] else 1
        cuts = np.flatnonzero(np.diff((ends - 1) // share)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ends)]):
            if hi > lo:
                yield number, chunk(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), texts.slice(lo, hi - lo))
                number += 1


def chunk(ids: pa.Array, train: pa.Array, texts: pa.Array) -> Chunk:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    values = lists.flatten()
    word = pc.not_equal(values, END).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(word)])
    lengths = np.diff(upto[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])
    coded = values.filter(pa.array(word)).dictionary_encode()
    codes = np.full(len(coded) + len(lengths), len(coded.dictionary), dtype=np.int64)
    codes[np.arange(len(coded)) + np.repeat(np.arange(len(lengths)), lengths)] = coded.indices.to_numpy()
    words = pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)])
    return Chunk(ids, train.to_numpy(zero_copy_only=False).astype(bool), lengths + 1, codes, words)


class Vocabulary(NamedTuple):
    """What every task knows: sizes, the first id of each different count, and the contexts dealt to several shards."""

    v: int
    n: int
    first: np.ndarray
    count: np.ndarray
    shards: int
    often: np.ndarray
    parts: np.ndarray

    def counts(self, w: np.ndarray) -> np.ndarray:
        """Counts of word ids, the start symbol's (V) too; 0 below 0."""
        return np.where(w < 0, 0, self.count[np.searchsorted(self.first, np.maximum(w, 0), side="right") - 1])

    def p1(self, w: np.ndarray) -> np.ndarray:
        return (self.counts(w) + ADD) / (self.n + ADD * (self.v + 1))

    def split(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where u is dealt to several shards, and its place among those."""
        at = np.searchsorted(self.often, u)
        return np.isin(u, self.often), np.minimum(at, max(0, len(self.often) - 1))

    def shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = (mixed(u.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int64)
        split, at = self.split(u)
        at = at[split]
        part = (mixed((w[split] + 1).astype(np.uint64)) % self.parts[at].astype(np.uint64)).astype(np.int64)
        out[split] = self.shards + np.cumsum(self.parts)[at] - self.parts[at] + part
        return out


class Asked:
    """The different pairs of a chunk with a known context, in the order in which they are asked for: shard, u, w.

    Unknown words stand as -1. A context dealt to several shards is asked for in each of them.
    """

    def __init__(self, vocab: Vocabulary, train: np.ndarray, lengths: np.ndarray, codes: np.ndarray, ids: np.ndarray):
        n = len(ids)
        before = np.concatenate([[n], codes[:-1]])
        before[np.cumsum(lengths)[:-1]] = n
        pairs, self.pair = np.unique(before * n + codes, return_inverse=True)
        u, w = np.append(ids, vocab.v)[pairs // n], ids[pairs % n]
        self.known, self.w_all = u >= 0, w
        trained = np.bincount(self.pair, weights=np.repeat(train, lengths)).astype(np.int64)[self.known]
        u, w = u[self.known], w[self.known]
        often = np.intersect1d(vocab.often, u)
        at = np.searchsorted(vocab.often, often)
        parts = vocab.parts[at]
        base = vocab.shards + np.cumsum(vocab.parts)[at] - parts
        extra = np.repeat(base, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        shard = np.concatenate([vocab.shard(u, w), extra])
        u, w = np.concatenate([u, np.repeat(often, parts)]), np.concatenate([w, np.full(len(extra), -1)])
        order = np.argsort(u * (vocab.v + 2) + w + 1)
        kind = np.uint16 if vocab.shards + vocab.parts.sum() < 1 << 16 else np.int64
        self.order = order[np.argsort(shard[order].astype(kind), kind="stable")]
        self.shard, self.u, self.w = shard[self.order], u[self.order], w[self.order]
        self.trained = np.concatenate([trained, np.zeros(len(extra), dtype=np.int64)])[self.order]
        new = np.ones(len(self.u), dtype=bool)
        new[1:] = (self.u[1:] != self.u[:-1]) | (self.shard[1:] != self.shard[:-1])
        self.runs = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.runs, len(self.u)))

    def by_shard(self) -> Iterator[tuple[int, slice, slice]]:
        """(shard, its pairs, its runs of one context)."""
        shards, lo = np.unique(self.shard, return_index=True)
        lo = np.append(lo, len(self.shard))
        runs = np.searchsorted(self.runs, lo)
        for i, shard in enumerate(shards.tolist()):
            yield shard, slice(lo[i], lo[i + 1]), slice(runs[i], runs[i + 1])

    def log_probs(self, vocab: Vocabulary, answers: dict[int, bytes]) -> np.ndarray:
        """log10 probability of each token of the chunk."""
        successors, counts = np.empty(len(self.runs), dtype=np.int64), np.empty(len(self.u), dtype=np.int64)
        for shard, pairs, runs in self.by_shard():
            successors[runs], counts[pairs] = unpack(answers[shard])
        split, at = vocab.split(self.u[self.runs])
        successors[split] = np.bincount(at[split], weights=successors[split], minlength=1)[at[split]]
        left = np.repeat(DISCOUNT * successors / vocab.counts(self.u[self.runs]), self.lengths)
        p1 = vocab.p1(self.w)
        lp = stored(np.log10(left)) + stored(np.log10(p1))
        seen = counts > 0
        lp[seen] = stored(
            np.log10((counts[seen] - DISCOUNT) / vocab.counts(self.u[seen]) + left[seen] * p1[seen])
        )
        out = stored(np.log10(vocab.p1(self.w_all)))
        of_pair = np.empty(len(lp))
        of_pair[self.order] = lp
        out[self.known] = of_pair[: int(self.known.sum())]
        return out[self.pair]


def stored(x: np.ndarray) -> np.ndarray:
    """What is left of log10 values in 16 bits."""
    return value(quantised(x))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probability under the model).

    ``train`` is a condition on the documents' columns that marks the training rows.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"),
        F.spark_partition_id().alias("part"),
    )
    id_type = rows.schema["doc_id"].dataType

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x in chunks(batches):
            c = np.bincount(x.codes, weights=np.repeat(x.train, x.lengths), minlength=len(x.words)).astype(np.int64)
            n = np.bincount(x.codes, minlength=len(x.words))
            columns = [np.full(len(n), number), np.arange(len(n)), x.words, c, n]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in columns], ["chunk", "code", "token", "c", "n"])

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, x in chunks(batches):
            ids = pa.ListArray.from_arrays(pa.array([0, len(x.ids)], pa.int32()), x.ids)
            data = pa.array([pack(np.array([len(x.words)]), x.train, x.lengths, x.codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, data], ["chunk", "ids", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, held = [], 0
        for batch in batches:
            rows_.append(np.array([x.to_numpy() for x in batch.columns]))
            held += batch.num_rows
            if held > PACKED_ROWS:
                yield by_chunk(rows_)
                rows_, held = [], 0
        if held:
            yield by_chunk(rows_)

    found = rows.mapInArrow(words_of, "chunk long, code long, token string, c long, n long")
    counted = found.groupBy("token").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).filter("c > 0")
    words = written(number_rows(counted, [("c", "desc"), "token"], "id", unique_order=True), "lm-vocab")
    vocab = vocabulary(words)
    schema = StructType(
        [StructField("chunk", LongType()), StructField("ids", ArrayType(id_type)), StructField("data", BinaryType())]
    )
    # One row a word would make the groups of a chunk slow to hand over.
    known = (
        found.select("chunk", "code", "token")
        .join(words.select("token", "id"), "token")
        .select("chunk", "code", "id")
        .mapInArrow(packed, "chunk long, data binary")
        .select("chunk", F.lit(None).cast(ArrayType(id_type)).alias("ids"), "data")
    )
    coded = rows.mapInArrow(codes_of, schema).unionByName(known)
    out = StructType([StructField("doc_id", id_type), *StructType.fromDDL(
        "n_tokens long, n_known long, base_score double, score double"
    ).fields])

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_, trained, lengths, codes, ids = read_chunk(left)
        if vocab.v:
            answers = dict(zip(right["shard"].to_pylist(), right["data"].to_pylist()))
            lp = Asked(vocab, trained, lengths, codes, ids).log_probs(vocab, answers)
        else:
            lp = np.zeros(len(codes))
        at = np.cumsum(lengths) - lengths
        base = np.log10(vocab.p1(ids))[codes]
        columns = [lengths, np.add.reduceat((ids >= 0)[codes].astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(lp, at)]
        return pa.Table.from_arrays([docs_, *[pa.array(x) for x in columns]], out.names)

    answers = answered(coded, vocab)
    scored = coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sums, out)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score"
    )


def vocabulary(words: DataFrame) -> Vocabulary:
    """Sizes and bounds from numbered words; what it gathers has at most a row for each different count (about the
    square root of 2 N) and one for each ``GROUP_ROWS`` tokens."""
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.sum("n").alias("all")).first()
    v, n, tokens = int(totals.v or 0), int(totals.n or 0), int(totals["all"] or 0)
    steps = sorted((r["first"], r.c) for r in words.groupBy("c").agg(F.min("id").alias("first")).collect())
    end = words.filter(F.col("token") == END).select("c", "n").first()
    often = words.filter((F.col("n") > GROUP_ROWS) & (F.col("token") != END)).select("id", "n").collect()
    often = sorted((r.id, r.n) for r in often)
    if end:  # the start symbol has an id after the words', and stands as often as the end
        steps.append((v, end.c))
        often += [(v, end.n)] * (end.n > GROUP_ROWS)
    steps = np.array(steps or [(0, 0)], dtype=np.int64)
    often = np.array(often, dtype=np.int64).reshape(-1, 2)
    parts = -(-often[:, 1] // GROUP_ROWS)
    return Vocabulary(v, n, steps[:, 0], steps[:, 1], max(1, math.ceil(tokens / SHARD_ENTRIES)), often[:, 0], parts)


def by_chunk(rows: list[np.ndarray]) -> pa.RecordBatch:
    """(chunk, code, id) as packed codes and ids, a row a chunk."""
    chunk_, code, id_ = np.concatenate(rows, axis=1)
    order = np.argsort(chunk_, kind="stable")
    numbers, at = np.unique(chunk_[order], return_index=True)
    blobs = [pack(code[x], id_[x]) for x in np.split(order, at[1:])]
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(blobs, pa.binary())], ["chunk", "data"])


def read_chunk(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, training marks, lengths, codes, and the word id of each code (-1: unknown)."""
    whole = rows.filter(pc.is_valid(rows["ids"]))
    (n,), train, lengths, codes = unpack(whole["data"][0].as_py())
    ids = np.full(n, -1, dtype=np.int64)
    for known in rows.filter(pc.is_null(rows["ids"]))["data"]:
        code, id_ = unpack(known.as_py())
        ids[code] = id_
    return whole["ids"].combine_chunks().flatten(), train, lengths, codes, ids


def answered(coded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(chunk, shard, data) with T and c(u, w) of what chunks ask for, looked up in the shards' tries."""

    def ask(rows: pa.Table) -> pa.Table:
        _, train, lengths, codes, ids = read_chunk(rows)
        asked = Asked(vocab, train, lengths, codes, ids)
        shards, blobs = [], []
        for shard, pairs, runs in asked.by_shard() if vocab.v else ():
            u = asked.u[asked.runs[runs]]
            shards.append(shard)
            blobs.append(pack(np.diff(u, prepend=0), asked.lengths[runs], asked.w[pairs] + 1, asked.trained[pairs]))
        number = pa.array([rows["chunk"][0].as_py()] * len(shards), pa.int64())
        return pa.Table.from_arrays([number, pa.array(shards, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "shard", "data"])

    def answer(rows: pa.Table) -> pa.Table:
        asked = [unpack(x) for x in rows["data"].to_pylist()]
        asked = [(np.cumsum(u), runs, w - 1, c) for u, runs, w, c in asked]
        u = np.concatenate([np.repeat(u, runs) for u, runs, _, _ in asked])
        w, c = np.concatenate([x[2] for x in asked]), np.concatenate([x[3] for x in asked])
        trained = c > 0
        pairs, at = np.unique(u[trained] * (vocab.v + 1) + w[trained], return_inverse=True)
        counts = np.bincount(at, weights=c[trained], minlength=len(pairs))
        trie = Shard(build_shard(pairs // (vocab.v + 1), pairs % (vocab.v + 1), counts, vocab.v))
        # All at once, so that a level is decoded once and not searched bit by bit for each chunk.
        contexts, runs = np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])
        successors, found = trie.look_up(contexts, runs, w, vocab.v)
        successors = np.split(successors, np.cumsum([len(x[0]) for x in asked])[:-1])
        found = np.split(found, np.cumsum([len(x[2]) for x in asked])[:-1])
        blobs = [pack(*x) for x in zip(successors, found)]
        return pa.Table.from_arrays([rows["chunk"], rows["shard"], pa.array(blobs, pa.binary())], ["chunk", "shard", "data"])

    schema = "chunk long, shard long, data binary"
    return coded.groupBy("chunk").applyInArrow(ask, schema).groupBy("shard").applyInArrow(answer, schema)
