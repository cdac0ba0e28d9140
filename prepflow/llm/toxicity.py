"""Toxicity score: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features are densities of a small fixed lexicon and of a lexicon learned from the labelled sample, how near
lexicon words stand to the second person, and rates of capitals, punctuation and obfuscated spelling. The trees
are grown in numpy on a bounded sample by histograms of quantile bins with logistic loss; a held-back share of
the sample, which the trees have not seen, calibrates the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import code_points, map_texts, sample_ids, sampled_texts, words, written

PER_LABEL = 1500
LEXICON_SIZE = 400
STEMS = (4, 5, 6)
HEAD = min(STEMS)

# Insults and second-person words of the four languages.
INSULTS = (
    "asshole bastard bitch clown creep crap cunt disgusting dumb dumbass fool freak fuck fucking garbage idiot idiots"
    " imbecile jerk loser losers lunatic moron morons pathetic pig retard scum shit shut slut stupid trash ugly vermin"
    " whore worthless abschaum arschloch dumm idiotin schlampe trottel versager connard connasse débile salaud salope"
    " crétin imbécile cabrón estúpido gilipollas mierda pendejo puta tonto basura asqueroso"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr tu te toi ton ta vous votre ti tú usted vosotros".split()

#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W_]+(?:[*@$!0-9'’-]+[^\W_]+)*")
MIXED = re.compile(r"[^\W\d_][*@$!0-9]+[^\W\d_]")
SHOUTED = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")

FEATURES = (
    "insults", "insult_words", "learned", "learned_most", "learned_words", "learned_sum", "near_you", "you", "capitals", "shouted",
    "marks", "exclaims", "repeats", "disguised", "mixed", "stretched", "symbols", "word_length", "log_words",
)

#: Words around a lexicon word in which the second person counts as near.
NEAR = 4

#: Characters handled at a time; a slice ends at a blank if there is one near.
SLICE = 1 << 18


def slices(text: str):
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):
            blank = max(text.rfind(" ", at + SLICE // 2, end), text.rfind("\n", at + SLICE // 2, end))
            end = blank if blank > 0 else end
        yield text[at:end]
        at = end


def char_classes() -> np.ndarray:
    """Class of each code point below 256: 1 capital, 2 mark, 3 exclaiming mark, 4 other sign, 0 the rest."""
    kinds = np.zeros(256, np.int64)
    kinds[65:91] = kinds[0xC0:0xDF] = 1
    kinds[[ord(c) for c in ".,;:\"'()"]] = 2
    kinds[[ord(c) for c in "!?"]] = 3
    kinds[[ord(c) for c in "*#%&$|@^~<>{}[]\\/=+_"]] = 4
    return kinds


CLASSES = char_classes()
BAD_WORDS, YOU_WORDS = frozenset(INSULTS), frozenset(SECOND_PERSON)


def learned_gain(word: str, learned: dict[str, float]) -> float:
    """The largest log-odds of a word and its beginnings."""
    gain = learned.get(word + " ", 0.0)
    for size in STEMS:
        if len(word) >= size:
            gain = max(gain, learned.get(word[:size], 0.0))
    return gain


def heads(learned: dict[str, float]) -> frozenset[str]:
    """First characters of all learned terms: most words can be set aside by them."""
    return frozenset(term.rstrip()[:HEAD] for term in learned)


def features(text: str | None, learned: dict[str, float], known: frozenset[str] | None = None) -> np.ndarray:
    """One row of FEATURES over a whole text; zeros for null, empty and wordless ones.

    Lexicon words count once a slice for what is summed by distinct word, so that one repeated word weighs little.
    """
    n = chars = insults = distinct = weight = most = found = near = you = shouted = disguised = mixed = length = 0
    stretched = repeats = 0
    classes = np.zeros(5)
    known = heads(learned) if known is None else known
    for part in slices(text or ""):
        tokens = WORD.findall(part.lower())
        bad, own = set(), set()
        length += sum(map(len, tokens))
        for word, times in Counter(tokens).items():
            plain = word
            if not word.isalpha():
                plain = word.translate(DISGUISE).replace("*", "")
                mixed += times * bool(MIXED.search(word))
            if plain in BAD_WORDS:
                insults += times
                distinct += 1
                disguised += times * (plain != word)
                bad.add(word)
            if word[:HEAD] in known and (gain := learned_gain(word, learned)):
                weight += gain
                most = max(most, gain)
                found += 1
                bad.add(word)
            if word in YOU_WORDS:
                you += times
                own.add(word)
        if bad and own:
            last_bad = last_you = -NEAR - 1
            for i, word in enumerate(tokens):
                if word in own:
                    last_you = i
                    near += i - last_bad <= NEAR
                if word in bad:
                    last_bad = i
                    near += i - last_you <= NEAR
        codes = code_points(part)
        kinds = np.where(codes < 256, CLASSES[np.minimum(codes, 255)], 0)
        classes += np.bincount(kinds, minlength=5)
        repeats += int(((kinds[1:] == 3) & (kinds[:-1] == 3)).sum())
        stretched += int(((codes[2:] == codes[1:-1]) & (codes[1:-1] == codes[:-2]) & (codes[2:] >= 65)).sum())
        shouted += len(SHOUTED.findall(part))
        n += len(tokens)
        chars += len(part)
    if not n:
        return np.zeros(len(FEATURES))
    return np.array(
        [
            insults / n, min(distinct, 8), weight / n, most, min(found, 40), min(weight, 60.0), near / n, you / n,
            classes[1] / chars, shouted / n, classes[2] / chars, classes[3] / chars, repeats / n, disguised / n,
            mixed / n, stretched / chars, classes[4] / chars, length / n, np.log1p(n),
        ],
        np.float64,
    )


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and bin edge by node, value by leaf."""

    edges: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    limit: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += leaf[node - len(feature)]
        return total


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int, depth: int, rate: float, bins: int = 64) -> Trees:
    """Boosting by second-order gains on binned features."""
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(FEATURES), bins - 1))
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], 1)
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
    trees = Trees(edges, start=float(np.log(share / (1 - share))))
    margin, columns = np.full(len(x), trees.start), np.arange(x.shape[1])
    inner, ridge = (1 << depth) - 1, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-6
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * x.shape[1] + columns) * bins + binned
            shape = (count, x.shape[1], bins)
            gs, hs = (
                np.bincount(cell.ravel(), np.repeat(v, x.shape[1]), int(np.prod(shape))).reshape(shape).cumsum(2)
                for v in (g, h)
            )
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain = np.where((hs > 1.0) & (ha - hs > 1.0), gain, 0)[:, :, :-1].reshape(count, -1)
            best = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(count), best] > 1e-3):
                feature[first + k], bin_ = divmod(int(best[k]), bins - 1)
                limit[first + k] = edges[feature[first + k], bin_]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > limit[node])
        at = node - inner
        size = 1 << depth
        leaf = -rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + ridge)
        margin += leaf[at]
        trees.feature.append(feature)
        trees.limit.append(limit)
        trees.leaf.append(leaf)
    return trees


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (x, value) by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b, w in zip(x[order], y[order], weight[order]):
        blocks.append([a, a, b * w, w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    # Each block keeps its two ends, shrunk a little, so that no score is exactly 0 or 1.
    ends = [(e, (b[2] + 0.05) / (b[3] + 0.1)) for b in blocks for e in dict.fromkeys(b[:2])]
    return np.array([e for e, _ in ends]), np.maximum.accumulate(np.array([v for _, v in ends]))


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees
    steps: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated scores; the trees see all texts at once."""
        known = heads(self.learned)
        margin = self.trees.margin(np.stack([features(t, self.learned, known) for t in texts]))
        return np.interp(margin, *self.steps) if len(self.steps[0]) else 1 / (1 + np.exp(-margin))


def terms(text: Column) -> Column:
    """Distinct words (marked by a blank) and word beginnings of a text."""
    bare = F.filter(
        F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")),
        lambda w: w != "",
    )
    stems = [F.transform(F.filter(bare, lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.substring(w, 1, k)) for k in STEMS]
    return F.array_distinct(F.concat(F.transform(bare, lambda w: F.concat(w, F.lit(" "))), *stems))


def learn_lexicon(texts: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """The terms whose presence speaks most for label 1, with their log-odds; counted in the tasks."""
    totals = {int(r[0]): r[1] for r in texts.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = (
        texts.select("label", F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
        .filter(F.col("pos") >= 4)
    )
    gain = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    top = (
        counts.withColumn("gain", gain)
        .withColumn("expected", (F.col("pos") + F.col("neg") + 1) * F.lit(n1 / (n1 + n0)))
        .filter((F.col("gain") > 1.5) & ((F.col("pos") - F.col("expected")) > 2.5 * F.sqrt(F.col("expected") + 1)))
        .orderBy((F.col("gain") * F.sqrt("pos")).desc(), "term")
        .limit(size)
        .collect()
    )
    return {r["term"]: float(r["gain"]) for r in top}


def train(rows: list[tuple[int, np.ndarray]], learned: dict[str, float], rounds: int = 80, depth: int = 3, rate: float = 0.15) -> Model:
    """Fit trees on four fifths of the rows and calibrate on the rest; without both labels the score is constant."""
    y = np.array([float(label) for label, _ in rows])
    if not len(y) or y.min() == y.max():
        value = 0.0 if not len(y) else float(y[0])
        return Model({}, Trees(np.zeros((0, 0))), (np.array([0.0]), np.array([0.01 + 0.98 * value])))
    x = np.stack([f for _, f in rows])
    weight = np.ones(len(y))
    aside = np.arange(len(y)) % 5 == 4
    if y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside[:] = False
    trees = grow(x[~aside], y[~aside], weight[~aside], rounds, depth, rate)
    check = aside if aside.any() else ~aside
    return Model(learned, trees, isotonic(trees.margin(x[check]), y[check], weight[check]))


def fit(docs: DataFrame, labelled: DataFrame, label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """Fit on at most ``per_label`` rows of each label (0 or 1) of ``labelled`` (doc_id, label_col).

    The lexicon is counted and the features are made in the tasks; the driver gets one short row a document.
    No document is described by a lexicon it has helped to learn: each half of the sample gets the lexicon of the
    other half. The finished model uses the lexicon of both.
    """
    ids = sample_ids(labelled, label_col, per_label)
    texts = sampled_texts(docs, ids).withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)))
    texts = written(texts, "sample")
    of_half = [learn_lexicon(texts.filter(F.col("half") == k)) for k in (0, 1)]
    rows = []
    for k in (0, 1):
        other = of_half[1 - k]
        made = map_texts(
            texts.filter(F.col("half") == k),
            lambda other=other: lambda t: (features(t, other).tolist(),),
            [("x", pa.list_(pa.float64()))],
            "x array<double>",
        )
        rows += made.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "label").collect()
    return train([(int(r["label"]), np.array(r["x"])) for r in rows], learn_lexicon(texts))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher: label 1 likelier).

    Whole texts are read; null and empty texts get the score of a text without features. Repeated rows give
    repeated rows, an empty table an empty result; other columns are not looked at.
    """
    kind = [("score", pa.float64())]
    return map_texts(
        docs, lambda: lambda texts: [(s,) for s in model.scores(texts)], kind, "score double", id_col, text_col, many=True
    )
