"""The pipeline's stages against brute force on a small fixture."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry

from test_duplicates import leaks_brute, low, near_brute, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    folder = str(tmp_path)
    items = [(k, sentence(rng, 25)) for k in range(5)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = [sentence(rng, 80) for _ in range(60)]
    texts += [t.upper() for t in texts[:5]] + [t + " tail" for t in texts[5:12]] + ["123 456", "", None]
    texts += [sentence(rng, 30) + " " + t + " " + sentence(rng, 30) for _, t in items]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")

    want = [(i, t) for i, t, *_ in rows if any(map(str.isalpha, t or ""))]
    last = {low(t): i for i, t in want}
    want = [(i, t) for i, t in want if last[low(t)] == i]
    near = {i for i, _, _, kept in near_brute(want, 5, 80) if kept}
    want = [(i, t) for i, t in want if i in near]
    want = {i: t for i, t in want if not leaks_brute(t, items)}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == set(want)
    assert all(r.size == len(want[r.doc_id].split()) for r in out)
    for stage in corpus_pipeline.STAGES[:-1]:
        made = stage[1](spark, docs, folder)
        assert made.columns == docs.columns and 0 < made.count() <= len(rows)
        assert stage[1](spark, docs.limit(0), folder).count() == 0
    assert {"pipeline", "op10_suffix_dedup"} <= set(entry.queries())
