"""Language-model scores, vector codes and ranked search against brute force, with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import math
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepflow.llm import codebooks, lexical, lm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def random_text(rng, n, vocabulary=("a", "b", "Cat", "dog", "é", "x-y", "the", "THE", "q")):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# ---- language model -------------------------------------------------------------------------------------------


def lm_brute(rows, train):
    toks = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(FOLD)) if w] + [""]
    c = collections.Counter(x for r in rows if train(r) for x in toks(r[1]))
    n, v = sum(c.values()), len(c)
    den = n + 0.1 * (v + 1)
    cuw = collections.Counter()
    for r in rows:
        if train(r):
            t = toks(r[1])
            cuw.update(zip(["<s>"] + t[:-1], t))
    cu, distinct = collections.Counter(), collections.Counter()
    for (u, _), k in cuw.items():
        cu[u] += k
        distinct[u] += 1

    def lp(u, w):
        p1 = (c.get(w, 0) + 0.1) / den
        if u not in cu:
            return math.log10(p1)
        return math.log10(max(cuw.get((u, w), 0) - 0.75, 0) / cu[u] + 0.75 * distinct[u] / cu[u] * p1)

    out = []
    for r in rows:
        t = toks(r[1])
        base = sum(math.log10((c.get(x, 0) + 0.1) / den) for x in t)
        out.append((r[0], len(t), sum(c.get(x, 0) > 0 for x in t), n, base, sum(lp(u, w) for u, w in zip(["<s>"] + t[:-1], t))))
    return out


@pytest.mark.parametrize("shard_entries", [7, 2_000_000])
def test_lm_against_brute_force(spark, monkeypatch, shard_entries):
    monkeypatch.setattr(lm, "SHARD_ENTRIES", shard_entries)
    monkeypatch.setattr(lm, "GROUP_ROWS", max(5, shard_entries))
    rng = random.Random(1)
    rows = [(i, random_text(rng, rng.randint(0, 30)), "s") for i in range(60)]
    rows += [(60, None, "s"), (61, "", "s"), (62, " \t\n ", "s"), (3, rows[3][1], "s"), (None, "a b", "s"), (63, "zz unseen", "s")]
    rows += [(64, random_text(rng, 3000), "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string")
    train = lambda r: r[0] is not None and r[0] % 3 != 0 and r[0] != 63
    got = lm.score(docs, (F.col("doc_id") % 3 != 0) & (F.col("doc_id") != 63)).collect()
    expected = lm_brute(rows, train)
    assert len(got) == len(expected)
    by_id = collections.defaultdict(list)
    for g in got:
        by_id[g.doc_id].append(g)
    for doc_id, n_tokens, n_known, n, base, model in expected:
        match = [g for g in by_id[doc_id] if g.n_tokens == n_tokens and g.n_known == n_known]
        assert match, doc_id
        g = match[0]
        assert g.train_tokens == n
        assert g.base_score == pytest.approx(base, abs=1e-9)
        assert abs(g.score - model) <= 2 * lm.STEP * n_tokens + 1e-9


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    found = {}
    for top in env.blockManager().diskBlockManager().localDirs():
        for path in pathlib.Path(top.getPath()).rglob("shuffle_*.data"):
            found[path] = path.stat().st_size
    return found


def test_lm_shuffles_less_than_a_row_a_token(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000, raising=False)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, random_text(rng, 400, vocabulary)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = shuffle_files(spark)
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 10 != 0).collect()}
    moved = sum(size for path, size in shuffle_files(spark).items() if path not in before)
    assert moved < 8 * 300 * 401
    for doc_id, n_tokens, n_known, n, base, model in lm_brute(rows, lambda r: r[0] % 10 != 0):
        g = got[doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (n_tokens, n_known, n)
        assert g.base_score == pytest.approx(base, abs=1e-8)
        assert abs(g.score - model) <= 2 * lm.STEP * n_tokens + 1e-9


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = sorted(lm.score(docs, F.lit(False)).collect())
    assert [(g.doc_id, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got] == [
        (1, 3, 0, 0, 0.0, 0.0),
        (2, 1, 0, 0, 0.0, 0.0),
    ]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.score(empty, F.lit(True)).count() == 0


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, universe in [(1, 1), (5, 1000), (1000, 1 << 40), (300, 301), (64, 1 << 62)]:
        values = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        ef = lm.EliasFano.encode(values, universe)
        assert (ef.access(np.arange(n)) == values).all()
        targets = rng.integers(0, universe, 50, dtype=np.uint64)
        got = ef.successor(np.zeros(50), np.full(50, n), targets)
        assert (got == np.searchsorted(values, targets, side="left")).all()


# ---- vector codes ---------------------------------------------------------------------------------------------


def pq_brute(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, [math.floor(x * 1024) for x in r[1]]))
    if not kept:
        return {}, hashlib.sha256(b"").hexdigest()
    v = np.array([[math.floor(np.float64(x) * 1024) for x in r[1]] for r in kept], dtype=np.int64)
    w = v.shape[1] // parts
    books = [v[:entries, p * w : (p + 1) * w].copy() for p in range(parts)]

    def assign(x, b):
        d = ((x[:, None, :] - b[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        for p in range(parts):
            x = v[:, p * w : (p + 1) * w]
            e, _ = assign(x, books[p])
            for k in range(len(books[p])):
                if (e == k).any():
                    books[p][k] = x[e == k].sum(0) // (e == k).sum()
    codes, err = [], np.zeros(len(v), dtype=np.int64)
    for p in range(parts):
        e, d = assign(v[:, p * w : (p + 1) * w], books[p])
        codes.append(e)
        err += d
    label_err = collections.Counter()
    for r, e in zip(kept, err):
        label_err[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for en in b for x in en).encode()).hexdigest()
    out = collections.Counter(
        (r[0], "".join(f"{c[i]:02x}" for c in codes), int(err[i]), label_err[r[2]]) for i, r in enumerate(kept)
    )
    return out, digest


def test_vector_codes_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3]) + rng.random() / 50 for _ in range(8)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [
        (400, None, 1),
        (401, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1),
        (402, [float("nan")] + [0.0] * 7, 0),
        (403, [float("inf")] + [0.0] * 7, 0),
        (5, rows[5][1], rows[5][2]),
        (None, [0.0] * 8, None),
        (404, [-1e-9] * 8, 1),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("v", F.lit("clash"))
    got = codebooks.coded(df).collect()
    expected, digest = pq_brute(rows)
    assert collections.Counter((g.vec_id, g.code, g.error, g.label_error) for g in got) == expected
    assert {g.codebooks_sha256 for g in got} == {digest}


def test_vector_codes_small_and_empty(spark):
    few = spark.createDataFrame([(2, [0.5, 0.5, 0.5, 0.5], 1), (1, [0.0, 0.0, 0.0, 0.0], None)], "vec_id bigint, embedding array<float>, label int")
    got = sorted(codebooks.coded(few).collect())
    assert [(g.vec_id, g.code, g.error) for g in got] == [(1, "00000000", 0), (2, "01010101", 0)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert codebooks.coded(empty).count() == 0
    uneven = spark.createDataFrame([(1, [0.0] * 4, 1), (2, [0.0] * 8, 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(ValueError):
        codebooks.coded(uneven)


def test_active_entries_equal_full_scan():
    rng = np.random.default_rng(1)
    parts = rng.integers(-5, 5, (500, 3))
    book = rng.integers(-5, 5, (20, 3))
    entry, dist = codebooks.nearest(parts, book)
    moved = np.zeros(20, dtype=bool)
    moved[[1, 4, 7]] = True
    new = book.copy()
    new[moved] = rng.integers(-5, 5, (3, 3))
    assert [x.tolist() for x in codebooks.reassign(parts, entry, dist, new, moved)] == [x.tolist() for x in codebooks.nearest(parts, new)]


# ---- ranked search --------------------------------------------------------------------------------------------


def search_brute(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    terms = [split(t) for _, t in docs]
    n_docs = sum(1 for t in terms if t)
    total = sum(len(t) for t in terms)
    df = collections.Counter(x for t in terms for x in set(t))
    out = []
    queries = collections.defaultdict(set)
    for item_id, text in items:
        queries[item_id] |= set(split(text))
    for item_id, q in queries.items():
        scored = []
        for (doc_id, _), t in zip(docs, terms):
            tf = collections.Counter(t)
            m = 50 + (50 * len(t) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in q if tf[x])
            if s > 0:
                scored.append((s, doc_id))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        out += [(item_id, rank + 1, doc_id, s) for rank, (s, doc_id) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_search_against_brute_force(spark):
    rng = random.Random(4)
    words = ["apple", "Bear", "cat", "dog", "élan", "fig", "x9", "the", "of", "ünï"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    docs += [(None, "apple cat"), (7, docs[7][1]), (301, None), (302, ""), (303, "!!! ..."), (304, "cat " * 2000)]
    items = [(1, "apple cat"), (2, "THE of the"), (3, "élan, ünï; x9"), (4, "nothing here zzz"), (5, ""), (2, "fig"), (None, "dog")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, row string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for k in (3, 50):
        got = sorted((tuple(r) for r in lexical.ranked(d, b, k).collect()), key=str)
        assert got == search_brute(docs, items, k)


def test_search_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.ranked(d, b).count() == 0
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lexical.ranked(d, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_terms_in_bytes_equal_the_pattern():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(128, 0x300), 0x1F600, 0x85, 0x3000])) for _ in range(40))
        assert [t.decode() for t in lexical.split_terms(text)] == re.findall(lexical.TERM, text.translate(FOLD))
    assert lexical.split_terms(None) == []


def test_search_blocks_stay_small(spark):
    """Folded vectors have no negative parts; a list of all documents must not end up in a few cells all the same."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, "the " + " ".join(rng.sample(words, 20))) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    index = lexical.build_index(d, spark.createDataFrame([(w,) for w in ["the", *words]], "term string"))
    sizes = [r["count"] for r in index["postings"].groupBy("term", "block").count().collect()]
    assert sum(sizes) == 2000 * 21
    assert max(sizes) <= 250
