"""Quality classifier on supervised subword embeddings.

Words and the character n-grams inside them are hashed to buckets, each bucket has a learned vector, a document is
the mean of the vectors of all its n-grams, and a softmax layer gives the probability of a label. Vectors and
layer are trained together by stochastic gradient descent in numpy on a bounded, labelled sample.

Mean and layer are linear, so that scoring only needs each bucket's vector times the layer: one number a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import code_points, map_texts, mixed, sample_ids, sampled_texts

BUCKET_BITS = 16
GRAMS = (2, 3, 4)
PER_LABEL = 1500

#: Characters handled at a time; slices overlap, so that no n-gram is lost.
SLICE = 1 << 18

BASE = np.uint64(0x9E3779B97F4A7C15)


def is_blank(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


def buckets(text: str | None, bits: int = BUCKET_BITS, grams: tuple[int, ...] = GRAMS) -> list[np.ndarray]:
    """Bucket numbers of all n-grams and words of a text, slice by slice. Blanks end a word and count as its edges."""
    whole = code_points(text)
    if not len(whole):
        return []
    padded = np.concatenate(([32], whole, [32])).astype(np.uint64)
    parts = []
    for at in range(0, len(padded), SLICE):
        parts += slice_buckets(padded[at : at + SLICE + max(grams) - 1], bits, grams)
    return parts


def slice_buckets(chars: np.ndarray, bits: int, grams: tuple[int, ...]) -> list[np.ndarray]:
    shift = np.uint64(64 - bits)
    blank = is_blank(chars)
    found, rolled = [], chars + np.uint64(1)
    for n in range(2, max(grams) + 1):
        rolled = rolled[:-1] * BASE + chars[n - 1 :] + np.uint64(1)
        if len(rolled) < 1:
            break
        if n in grams:
            found.append((mixed(rolled + np.uint64(n)) >> shift).astype(np.int64))
    # A word is the sum of its mixed characters by place, summed over its run.
    edges = np.flatnonzero(np.diff(blank.astype(np.int8)))
    starts, ends = edges[~blank[edges + 1]] + 1, edges[blank[edges + 1]] + 1
    ends = ends[ends > starts[0]] if len(starts) else ends[:0]
    starts = starts[: len(ends)]
    if len(starts):
        place = np.arange(len(chars)) - np.repeat(
            np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(chars)])))
        )
        value = mixed(chars * BASE + place.astype(np.uint64))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(value, dtype=np.uint64)))
        named = mixed(sums[ends] - sums[starts])
        found.append((named >> shift).astype(np.int64))
        # Word pairs are named by the difference, so that any word that follows itself falls into one bucket.
        found.append((mixed(named[1:] - named[:-1]) >> shift).astype(np.int64))
    return found


def bucket_counts(text: str | None, bits: int = BUCKET_BITS) -> tuple[bytes, bytes]:
    """Buckets that occur and how often, as bytes of int32 and float32."""
    counts = np.zeros(1 << bits, np.float32)
    for part in buckets(text, bits):
        counts += np.bincount(part, minlength=1 << bits)
    used = np.flatnonzero(counts)
    return used.astype(np.int32).tobytes(), counts[used].tobytes()


@dataclass
class Model:
    """``value`` by bucket and ``bias``: the log-odds of label 1 are mean(value) + bias."""

    value: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for part in buckets(text, int(len(self.value)).bit_length() - 1):
            total += float(self.value[part].sum(dtype=np.float64))
            n += len(part)
        odds = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BUCKET_BITS, dim: int = 8, epochs: int = 8,
    rate: float = 6.0, seed: int = 1,
) -> Model:
    """Fit on (label, buckets, counts); labels weigh alike. Without both labels the score is their share."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    share = sum(y for y, _, _ in rows) / len(rows) if rows else 0.5
    if share in (0, 1):
        return Model(np.zeros(1 << bits, np.float32), 4.0 if share else -4.0)
    weight = (0.5 / (1 - share), 0.5 / share)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(rows)):
            label, used, counts = rows[k]
            if not len(used):
                continue
            part = (counts / counts.sum())[:, None]
            own = vectors[used]
            mean = (own * part).sum(0)
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            error *= step * min(weight[label], 10.0)
            vectors[used] = own - part * (layer @ error)
            layer -= np.outer(mean, error)
            bias -= 0.1 * error
    return Model(vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "quality", per_label: int = PER_LABEL) -> Model:
    """Train on at most ``per_label`` rows of each label (0 or 1) of ``labelled`` (doc_id, label_col).

    Whole texts are counted in the tasks; only bucket counts of the sample reach the driver.
    """
    ids = sample_ids(labelled, label_col, per_label)
    kind = [("used", pa.binary()), ("counts", pa.binary())]
    texts = sampled_texts(docs, ids)
    counted = map_texts(texts, lambda: bucket_counts, kind, "used binary, counts binary")
    rows = counted.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "label").collect()
    return train(
        [(int(r["label"]), np.frombuffer(r["used"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in rows]
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: label 1 likelier).

    Whole texts are read; null and empty texts get the score of no evidence. Repeated rows give repeated rows, an
    empty table an empty result; other columns are not looked at.
    """

    def make():
        return lambda text: (model.score(text),)

    return map_texts(docs, make, [("score", pa.float64())], "score double", id_col, text_col)
