"""Language identification by a convolutional network over bytes.

A text is cut into windows of a fixed number of bytes. Each byte has a learned vector; filters of several widths
run over a window, the largest answer of each filter is kept, and a softmax layer gives the languages. The network
is trained in numpy on windows of a bounded labelled sample, and applied to all windows of a text in batches; a
text's probabilities are those of its windows, weighted by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import map_texts, sample_ids, sampled_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
PER_LABEL = 400
WINDOWS_PER_TEXT = 4
BATCH = 64
UNKNOWN = "und"


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(windows, bytes in each) of a whole text; the last window is filled with zeros."""
    data = np.frombuffer(text.encode().lower().replace(b"\0", b" "), np.uint8)
    n = -(-len(data) // WINDOW)
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(data)] = data
    sizes = np.full(n, WINDOW)
    if n:
        sizes[-1] = len(data) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), sizes


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Network:
    labels: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    layer: np.ndarray
    offset: np.ndarray

    def patches(self, x: np.ndarray, width: int) -> np.ndarray:
        """The ``width`` vectors from each place on, side by side."""
        own = self.vectors[x]
        n, length, dim = own.shape
        shape, (a, b, c) = (n, length - width + 1, width * dim), own.strides
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(own, shape, (a, b, c)))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest answers of all filters, and where they are."""
        most, where = [], []
        for width, kernel in zip(WIDTHS, self.filters):
            answers = self.patches(x, width) @ kernel
            where.append(answers.argmax(1))
            most.append(np.take_along_axis(answers, where[-1][:, None, :], 1)[:, 0])
        return np.concatenate(most, 1), where

    def largest(self, x: np.ndarray) -> np.ndarray:
        """Largest answers only: the faster half of ``pooled``."""
        return np.concatenate([(self.patches(x, w) @ k).max(1) for w, k in zip(WIDTHS, self.filters)], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = [self.largest(x[at : at + BATCH]) for at in range(0, len(x), BATCH)]
        if not parts:
            return np.zeros((0, len(self.labels)), np.float32)
        return softmax(np.maximum(np.concatenate(parts) + self.bias, 0) @ self.layer + self.offset)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; UNKNOWN with 0 for null and letterless texts."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        count = 0
        for i, text in enumerate(texts):
            if self.labels and has_letter(text):
                held.append((i, *windows(text)))
                count += len(held[-1][1])
            if count >= 4096 or i == len(texts) - 1:
                self.settle(held, out)
                held, count = [], 0
        return out

    def settle(self, held: list, out: list) -> None:
        if not held:
            return
        p = self.probabilities(np.concatenate([x for _, x, _ in held]))
        at = 0
        for i, x, sizes in held:
            mean = (p[at : at + len(x)] * sizes[:, None]).sum(0) / sizes.sum()
            at += len(x)
            best = int(mean.argmax())
            out[i] = (self.labels[best], float(min(1.0, mean[best])))


def softmax(logits: np.ndarray) -> np.ndarray:
    odds = np.exp(logits - logits.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network:
    """Adam on cross-entropy; labels weigh alike."""
    rng = np.random.default_rng(seed)
    c, total = len(labels), FILTERS * len(WIDTHS)
    net = Network(
        labels,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, total**-0.5, (total, c)).astype(np.float32),
        np.zeros(c, np.float32),
    )
    net.vectors[0] = 0
    if not len(x):
        return net
    weight = len(y) / (c * np.maximum(np.bincount(y, minlength=c), 1))
    state = [net.vectors, *net.filters, net.bias, net.layer, net.offset]
    first, second = [np.zeros_like(a) for a in state], [np.zeros_like(a) for a in state]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            for a, g, m, v in zip(state, gradients(net, x[rows], y[rows], weight), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-7)
            step += 1
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    pooled, where = net.pooled(x)
    hidden = np.maximum(pooled + net.bias, 0)
    error = softmax(hidden @ net.layer + net.offset)
    error[np.arange(len(y)), y] -= 1
    error *= (weight[y] / len(y)).astype(np.float32)[:, None]
    back = (error @ net.layer.T) * (hidden > 0)
    d_vectors = np.zeros_like(net.vectors)
    d_filters = []
    for k, (width, kernel) in enumerate(zip(WIDTHS, net.filters)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        used = x[np.arange(len(x))[:, None, None], where[k][:, :, None] + np.arange(width)]
        patch = net.vectors[used].reshape(len(x), FILTERS, width * DIM)
        d_filters.append(np.einsum("nf,nfk->kf", g, patch))
        flow = (g[:, :, None] * kernel.T[None]).reshape(-1, DIM)
        np.add.at(d_vectors, used.reshape(-1), flow)
    d_vectors[0] = 0
    return [d_vectors, *d_filters, back.sum(0), hidden.T @ error, error.sum(0)]


def fit(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL) -> Network:
    """Train on at most ``per_label`` texts of each language and WINDOWS_PER_TEXT windows of each, evenly spaced.

    Rows without a language, an id or a letter in the text are left out. Without any the network knows no language.
    """
    ids = sample_ids(docs, label_col, per_label, id_col)

    def some(text: str | None) -> tuple:
        if not has_letter(text):
            return (b"",)
        cut, _ = windows(text)
        return (cut[np.unique(np.linspace(0, len(cut) - 1, WINDOWS_PER_TEXT).round().astype(int))].tobytes(),)

    cut = map_texts(sampled_texts(docs, ids, id_col, text_col), lambda: some, [("data", pa.binary())], "data binary")
    rows = cut.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "label").collect()
    rows = [(str(r["label"]), np.frombuffer(r["data"], np.uint8).reshape(-1, WINDOW)) for r in rows if r["data"]]
    labels = sorted({label for label, _ in rows})
    x = np.concatenate([w for _, w in rows]) if rows else np.zeros((0, WINDOW), np.uint8)
    y = np.array([labels.index(label) for label, w in rows for _ in w], np.int64)
    return train(x, y, labels)


def identify(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the language's probability, 0 to 1).

    Whole texts are read; null, empty and letterless texts are ``und`` with score 0. Repeated rows give repeated
    rows, an empty table an empty result; other columns are not looked at.
    """
    kinds = [("lang_pred", pa.string()), ("score", pa.float64())]
    return map_texts(docs, lambda: network.identify, kinds, "lang_pred string, score double", id_col, text_col, many=True)


def keep_identified(docs: DataFrame, network: Network, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language has at least ``least_score``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = identify(rows, network, "row", "text")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("doc_id.*")
