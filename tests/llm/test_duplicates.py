"""Exact and near duplicates, repeated strings and benchmark passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepflow.llm import decontaminate, exact_dedup, near_dedup, passages, queries, suffix_dedup, suffixes
from prepflow.llm.common import maybe_in, text_key
from prepflow.llm.components import components

SCHEMA = "doc_id bigint, text string, name string, kept string, sha string"


def docs_of(spark, texts):
    """Rows (id, text); the other columns clash with names the operators use."""
    return spark.createDataFrame([(i, t, "n", "k", "s") for i, t in texts], SCHEMA)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("sql", sorted(queries.SQL))
def test_sql_twin(spark, sf_dir, sql):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    found = queries.QUERIES[sql](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[sql]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


TEXTS = [
    (1, "Abc"), (2, "aBC"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 30), (8, "X" * 30), (9, "x" * 29),
    (10, "x" * 31), (8, "X" * 30), (None, "abc"), (None, "alone"), (11, "xy" * 9), (12, "yx" * 9),
]


@pytest.mark.parametrize("hash_", [F.xxhash64, lambda b: F.length(b).cast("long"), lambda b: F.lit(1).cast("long")])
def test_exact_groups(spark, hash_):
    """Names tell texts apart even if the hash does not."""
    out = exact_dedup.exact_groups(docs_of(spark, TEXTS), block_bytes=4, block_hash=hash_).collect()
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(low(t), []).append(i)
    want = [
        (i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]),
         hashlib.sha256(low(t).encode()).hexdigest())
        for i, t in TEXTS
    ]
    order = lambda r: tuple(str(x) for x in r)
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out]
    assert sorted(got, key=order) == sorted(want, key=order)
    kept = [r.text_sha256 for r in out if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)
    assert len({r.name for r in out}) == len(groups)


def test_drop_copies(spark):
    docs = docs_of(spark, TEXTS)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(low(r.text) for r in out.collect()) == sorted({low(t) for _, t in TEXTS})
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(40)] + [(7, 7)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    frame = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    got = {r.node: r.comp for r in components(frame).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    nodes = [n for n in parent if n in got]
    assert {n for n in parent if any(n in (a, b) and a != b for a, b in links)} == set(got)
    assert all((root(a) == root(b)) == (got[a] == got[b]) for a in nodes for b in nodes)
    assert components(frame.limit(0)).count() == 0


def shingles(text, size):
    words = low(text).encode().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def near_brute(texts, size, percent):
    sets = [(i, shingles(t, size)) for i, t in texts]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def near_texts():
    """A large group of copies of one text with more or fewer changes, small groups, and what has no words."""
    rng = random.Random(5)
    texts, base = [], sentence(rng, 120).split()
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        texts.append((1000 - i, " ".join(words)))
    for i in range(30):
        own = sentence(rng, 90)
        texts += [(2000 + 3 * i, own), (2001 + 3 * i, own.upper()), (2002 + 3 * i, own + " more")]
    return texts + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "ab " * 5000)]


@pytest.mark.parametrize("rows", [near_dedup.REGION_ROWS, 7])
def test_near_groups(spark, rows):
    """Also with regions far larger than a task may hold, which are dealt into blocks."""
    texts = near_texts()
    out = near_dedup.near_groups(docs_of(spark, texts), size=3, percent=85, region_rows=rows).collect()
    assert sorted(map(tuple, out)) == near_brute(texts, 3, 85)


def signed(same, rng):
    """Signature bytes of random values but for the given (tree, level) -> value."""
    sig = rng.integers(0, 1 << 16, (near_dedup.TREES, near_dedup.LEVELS))
    for (tree, level), value in same.items():
        sig[tree, level] = value
    return bytearray(sig.astype(">u2").tobytes())


def test_near_regions_keep_pairs_parted_deeper(spark):
    """A region larger than a task may hold keeps all rows, as later trees count on it."""
    rng = np.random.default_rng(2)
    same = {(t, k): 7 for t in (3, 5) for k in range(near_dedup.LEAST)}
    nodes = spark.createDataFrame([(i, signed(same, rng)) for i in range(9)], "node bigint, sig binary")
    found = near_dedup.with_regions(nodes, 4).groupBy("tree", "region").count().collect()
    assert sorted((r.tree, r["count"]) for r in found) == [(3, 9), (5, 9)]


def test_near_blocks_of_two_large_components(spark):
    """In a block, the largest component is the region's, not the block's; all pairs between the two are looked at."""
    same = bytearray(np.full(near_dedup.FUNCTIONS, 7, ">u2").tobytes())
    shard = pd.DataFrame({
        "tree": 0, "region": b"r", "block": 0, "node": range(9), "n": 50, "m": 50, "sig": [bytes(same)] * 9,
        "comp": [1] * 6 + [2] * 3, "query": [True] * 6 + [False] * 3, "home": True, "blocks": 3,
    })
    assert sorted(near_dedup.open_nodes(85)(shard)["node"]) == list(range(9))
    rows = [(0, bytearray(b"r"), i, 50, 50, same, 1 if i < 30 else 2, 7) for i in range(50)]
    split = spark.createDataFrame(
        rows, "tree int, region binary, node bigint, n bigint, m bigint, sig binary, comp bigint, blocks int"
    ).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = near_dedup.in_blocks(split, 8).collect()
    groups = {}
    for r in met:
        groups.setdefault(r.block, []).append(r)
    pairs = {(i.node, j.node) for g in groups.values() for i in g if i.query for j in g if j.home}
    assert {(i, j) for i in range(30, 50) for j in range(30)} <= pairs
    assert all(len({r.node for r in g}) == len(g) for g in groups.values())
    open_ = near_dedup.in_shards(
        near_dedup.in_blocks(split, 8), near_dedup.open_nodes(85), "tree int, region binary, block bigint, node bigint", 8
    )
    assert {r.node for r in open_.collect()} == set(range(50))


def test_near_edges(spark):
    texts = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E"), (3, None)]
    out = sorted(near_dedup.near_groups(docs_of(spark, texts)).collect(), key=lambda r: (r.doc_id or 0, r.kept))
    assert [(r.doc_id, r.component_id, r.kept) for r in out] == [
        (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)
    ]
    assert near_dedup.drop_near(docs_of(spark, texts)).columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert near_dedup.near_groups(docs_of(spark, texts).limit(0)).count() == 0


def repeats_brute(texts, length):
    rows = [(t or "").encode() for t in texts]
    count = {}
    for data in rows:
        for k in range(len(data) - length + 1):
            count[data[k : k + length]] = count.get(data[k : k + length], 0) + 1
    out = []
    for data in rows:
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            if count[data[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2] if len(data) else []))).sum()) if len(data) else 0
        out.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(9)
    shared = [sentence(rng, n) for n in (9, 12, 30)]
    texts = [sentence(rng, 20) + rng.choice([" ", "é"]) + rng.choice(shared) + " " + sentence(rng, 20) for _ in range(40)]
    texts += [sentence(rng, 200)] * 3 + ["a" * 300, "ab" * 200, "é" * 90, None, "", "short"]
    texts.append(sentence(rng, 40) + shared[2] * 2)
    return texts


@pytest.mark.parametrize("pieces, slice_, step", [(2000, 1 << 20, 16), (1, 150, 64)])
def test_remove_repeats(spark, monkeypatch, pieces, slice_, step):
    """Also with every core treated as frequent and texts cut into short slices."""
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    texts = repeat_texts()
    docs = docs_of(spark, enumerate(texts))
    out = suffix_dedup.remove_repeats(docs, length=60, gram=12, step=step, pieces=pieces).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == repeats_brute(texts, 60)


@pytest.mark.parametrize("pieces", [2000, 1])
def test_removed_spans_of_near_copies(spark, pieces):
    """Copies that differ in a word each: one pair of bounds per run, not one per window or anchor."""
    rng = random.Random(4)
    words = sentence(rng, 120).split()
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(5, 115, 3)] + [sentence(rng, 120), None, ""]
    texts += [sentence(rng, 30) + " " + " ".join(words[20:50]) + " " + sentence(rng, 30) for _ in range(5)]
    docs = docs_of(spark, enumerate(texts))
    out = suffix_dedup.remove_repeats(docs, length=60, gram=12, pieces=pieces).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == repeats_brute(texts, 60)
    runs = {r.doc_id: r.spans for r in suffix_dedup.removed_spans(docs, length=60, gram=12, pieces=pieces).collect()}
    assert {i: len(s) // 2 for i, s in runs.items()} == {r.doc_id: r.n_spans for r in out if r.n_spans}
    assert all(a < b for s in runs.values() for a, b in zip(s, s[1:]))


def test_remove_repeats_of_repeated_rows(spark):
    """Rows with the same id and text are two places; ids may be null."""
    long, other = sentence(random.Random(1), 50), sentence(random.Random(2), 50)
    texts = [(1, long), (1, long), (1, other), (None, other[:-9]), (None, None)]
    out = suffix_dedup.remove_repeats(docs_of(spark, texts), length=60, gram=12).collect()
    want = repeats_brute([t for _, t in texts], 60)
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)
    assert suffix_dedup.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def shared_words_brute(rows, least):
    """Words of each row (id, text) in runs of ``least`` words that another row holds too."""
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] for _, t in rows]
    held = {}
    for i, words in enumerate(split):
        for k in range(len(words) - least + 1):
            held.setdefault(tuple(words[k : k + least]), set()).add(i)
    out = []
    for words in split:
        shared = set()
        for k in range(len(words) - least + 1):
            if len(held[tuple(words[k : k + least])]) > 1:
                shared.update(range(k, k + least))
        out.append(len(shared))
    return out


def found_words(spark, rows, **options):
    """n_shared_words of each row (id, text), as the query joins it."""
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n bigint, doc_id bigint, text string")
    found = passages.shared_words(docs, **options)
    out = docs.withColumn("key", text_key("doc_id", "text")).join(found, "key", "left").orderBy("n").collect()
    return [r.n_shared_words or 0 for r in out]


def passage_rows():
    rng = random.Random(12)
    shared = [sentence(rng, n) for n in (7, 11, 12, 13, 20, 40)]
    texts = [" ".join([sentence(rng, 25), rng.choice(shared), sentence(rng, 15)]) for _ in range(60)]
    texts += [shared[4].upper().replace(" ", "\n\t"), shared[3], shared[1], sentence(rng, 90), None, "", " \n", "é " * 30, "É " * 30]
    # Twice in one row only, near copies, and words that all are equal.
    texts += [shared[5] + " x " + shared[5], " ".join([sentence(rng, 14)] * 2), "a " * 50, "b a " * 30, "a " * 12]
    words = sentence(rng, 60).split()
    texts += [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in range(5, 55, 3)]
    rows = list(enumerate(texts))
    # The same id on other texts, the same row again, and null ids.
    return rows + [(3, sentence(rng, 30)), (3, sentence(rng, 30)), rows[63], (500, rows[2][1])] + [(None, sentence(rng, 30))] * 2


@pytest.mark.parametrize("gram, chunk, pieces", [(4, 1 << 18, 2000), (12, 1, 2), (1, 300, 1)])
def test_shared_words(spark, monkeypatch, gram, chunk, pieces):
    """Also with texts handled alone, few grams to a shard, and every gram treated as frequent."""
    monkeypatch.setattr(passages, "CHUNK", chunk)
    monkeypatch.setattr(passages, "SHARD_PIECES", 20)
    rows = passage_rows()
    want = shared_words_brute(rows, 12)
    assert len(set(want)) > 10
    assert found_words(spark, rows, least=12, gram=gram, pieces=pieces) == want
    assert found_words(spark, [], least=12, gram=gram, pieces=pieces) == []


def test_short_passages_are_told(spark, tmp_path):
    """Passages of over 50 words below 400 bytes: nothing to remove, but counted; of 50 words: not counted."""
    rng = random.Random(3)
    told, untold, long = sentence(rng, 51, 900), sentence(rng, 50, 900), sentence(rng, 120, 900)
    assert len(told) < 400 < len(long)
    texts = [f"{sentence(rng, 40)} {p} {sentence(rng, 40)}" for p in (told, told, untold, untold, long, long)]
    texts += [sentence(rng, 200), None]
    docs_of(spark, enumerate(texts)).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["op10_suffix_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.n_shared_words for r in out] == [51, 51, 0, 0, 120, 120, 0, 0]
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out] == repeats_brute(texts, 400)


@pytest.mark.parametrize("alphabet", [1, 1024])
def test_suffix_array(monkeypatch, alphabet):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", alphabet)
    rng = np.random.default_rng(0)
    for trial in range(60):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 50))
        s = np.append(np.tile(s, 3) if trial % 3 == 0 else s, 0)
        text = s.tolist()
        want = sorted(range(len(text)), key=lambda i: text[i:])
        sa = suffixes.suffix_array(s)
        assert sa.tolist() == want
        shared = suffixes.common_prefixes(s, sa, np.zeros(len(s), bool), 1000)
        for a, b in zip(want, want[1:]):
            m = next(m for m in range(len(text)) if text[a + m] != text[b + m])
            assert shared[b] == m


def test_common_prefixes_of_large_symbols():
    """Neighbouring symbols that differ in the last bit only, up to the largest digit of a name."""
    rng = np.random.default_rng(1)
    for pair in ((512, 258, 512, 259), (513, 513, 512, 512), (511, 2, 513, 1)):
        same = rng.integers(1, 514, 12)
        s = np.concatenate((same, pair[:2], same, [5], same, pair[2:], same, [6], [0]))
        sa = suffixes.suffix_array(s)
        text = s.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffixes.common_prefixes(s, sa, np.zeros(len(s), bool), 1000)
        for a, b in zip(sa, sa[1:]):
            assert shared[b] == next(m for m in range(len(text)) if text[a + m] != text[b + m])


def test_masks_leave_no_pattern():
    """Every allowed pattern of substitutions leaves a stretch in which some mask's words are all the same."""
    import itertools

    for n in range(decontaminate.LEAST_WORDS, decontaminate.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - (4 * n + 4) // 5):
            assert any(
                all(s + k not in gone for k in mask) for mask in decontaminate.MASKS for s in range(n - mask[-1])
            )


def leaks_brute(text, items):
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    doc, found = words(text), []
    for item, t in items:
        own = words(t)
        if item is None or len(own) < 8:
            continue
        width = min(13, len(own))
        need = (4 * width + 4) // 5
        for shift in range(-len(own), len(doc)):
            same = [i for i in range(len(own)) if 0 <= i + shift < len(doc) and doc[i + shift] == own[i]]
            if any(same[k + need - 1] - same[k] < width for k in range(len(same) - need + 1)):
                found.append(item)
                break
    return sorted(found)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_SEEDS, 0])
def test_contamination(spark, broadcast):
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.randrange(6, 40), 300)) for k in range(25)]
    items += [(90, items[10][1].upper() + "!"), (None, items[11][1]), (91, None), (92, "too short")]
    texts = [(1000 + k, sentence(rng, 60, 300)) for k in range(10)]
    for k, t in items[:25]:
        for gone in (0, 2, 5):
            own = t.split()
            for _ in range(gone):
                own[rng.randrange(len(own))] = "other"
            texts.append((len(texts), f"{sentence(rng, 20, 300)}. {' '.join(own)}, {sentence(rng, 9, 300)}"))
    texts += [(500, None), (501, ""), (502, items[3][1]), (502, items[3][1]), (None, items[4][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    docs = docs_of(spark, texts)
    out = decontaminate.contamination(docs, bench, broadcast_seeds=broadcast).collect()
    got = sorted((r.doc_id or -1, tuple(r["items"]), r.contaminated) for r in out)
    want = sorted((i or -1, tuple(x := leaks_brute(t, items)), bool(x)) for i, t in texts)
    assert got == want
    clean = decontaminate.drop_leaks(docs, bench)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == [i for i, _, bad in want if not bad]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_maybe_in_never_misses(spark, kind):
    docs = spark.range(3000).select(F.col("id").cast(kind).alias("doc_id"), F.lit("t").alias("text"))
    docs = docs.unionByName(docs.filter("doc_id = 5")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast(kind)))
    ids = spark.range(0, 3000, 30).select(F.col("id").cast(kind).alias("x"))
    found = maybe_in(docs, ids.unionByName(ids).unionByName(ids.limit(1).select(F.lit(None).cast(kind).alias("x"))), "doc_id", "m")
    assert found.columns == ["doc_id", "text", "m"]
    rows = [(r.doc_id, r.m) for r in found.collect()]
    assert len(rows) == 3002 and (None, False) in rows
    assert all(m for i, m in rows if i is not None and int(i) % 30 == 0)
    assert sum(m for _, m in rows) < 600
    assert not any(r.m for r in maybe_in(docs, ids.limit(0), "doc_id", "m").collect())


def test_near_copies_leave_without_moving_other_texts(spark, monkeypatch):
    """The rows of drop_near are those whose id has a kept row; texts that surely stay meet no join by id."""
    rng = random.Random(12)
    texts = [(i, sentence(rng, 40)) for i in range(60)]
    texts += [(100 + i, t + " end") for i, t in texts[:20]] + [(None, texts[0][1]), (None, None), (70, ""), (71, None), (3, texts[3][1])]
    docs = docs_of(spark, texts)
    kept = {r.doc_id for r in near_dedup.near_groups(docs).collect() if r.kept}
    asked = []
    real = near_dedup.maybe_in

    def noted(rows, ids, id_col, mark):
        out = real(rows, ids, id_col, mark)
        asked.append(out.filter(mark).count())
        return out

    monkeypatch.setattr(near_dedup, "maybe_in", noted)
    got = near_dedup.drop_near(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in texts if i in kept)
    assert 20 <= asked[-1] <= 40
    # Of 85 texts, only those that share a region are sent to be made into sets.
    assert 40 <= asked[0] <= 60
