"""The registered queries of the text operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepflow.llm import codebooks, decontaminate, lexical, lm, exact_dedup, language, mixing, near_dedup, passages, pii, quality, secrets, suffix_dedup, toxicity
from prepflow.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY folded) AS keep_id,
       count(*) OVER (PARTITION BY folded) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY folded) AS kept,
       sha256(folded) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
      FROM documents)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return held_out_scores(toxicity.score(docs, toxicity.fit(docs, labels)), 5, 0)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def listed(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def span_digests(found: DataFrame, base: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    return found.select(
        "doc_id",
        *[counted(F.col("found"), kind) for kind in base],
        F.sha2(listed(F.col("found"), base), 256).alias("base_sha256"),
        listed(F.col("found"), kinds).alias("spans"),
    )


def held_out_scores(scored: DataFrame, modulus: int, fold: int) -> DataFrame:
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), modulus) == fold).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    return held_out_scores(quality.score(docs, quality.fit(docs, labels)), 3, 1)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(secrets.scan_secrets(documents(spark, sf_dir)), secrets.BASE_KINDS, secrets.KINDS)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "contaminated",
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
    )


#: Every pair of equal words of a document and an item is laid on its line, then dense stretches are sought.
OP4_SQL = r"""
WITH item AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
    FROM benchmark WHERE item_id IS NOT NULL),
item_word AS (
    SELECT item_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM item WHERE len(words) >= 8),
doc AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words
    FROM documents),
doc_word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM doc),
line AS (
    SELECT doc_id, item_id, d.p - i.p AS shift, i.p AS p, least(n, 13) AS width, (least(n, 13) * 4 + 4) // 5 AS need
    FROM doc_word d JOIN item_word i USING (word)),
many AS (
    SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS n FROM line
    WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY p)),
hit AS (
    SELECT DISTINCT a.doc_id, a.item_id
    FROM (SELECT * FROM many WHERE n >= need) a JOIN (SELECT * FROM many WHERE n >= need) b
      ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.shift = b.shift AND b.k = a.k + a.need - 1
    WHERE b.p - a.p < a.width),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN found USING (doc_id)
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(documents(spark, sf_dir), size=3, percent=85)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = language.fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    return language.identify(docs, network).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(pii.find_personal_data(documents(spark, sf_dir)), pii.BASE_KINDS, pii.KINDS)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    removed = suffix_dedup.remove_repeats(docs).drop("kept")
    shared = F.coalesce("n_shared_words", F.lit(0).cast("bigint")).alias("n_shared_words")
    return removed.join(passages.shared_words(docs), "key", "left").drop("key").withColumn("n_shared_words", shared)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 10) != 0)
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.coded(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Brute force: every term of every item against every posting, then the 50 best per item.
OP13_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
st AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
dl AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sc AS (
    SELECT q.item_id, tf.r,
           sum(CAST(floor(1000 * ln((2 * st.n_docs + 2) / (2 * df.df + 1))) AS BIGINT)
               * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * dl.n * st.n_docs) // st.total)))) AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (r) CROSS JOIN st
    GROUP BY q.item_id, tf.r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
      FROM sc JOIN dl USING (r) WHERE score > 0)
WHERE rank <= 50
"""


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dedup": op5_near_dedup,
    "op6_language": op6_language,
    "op7_personal_data": op7_personal_data,
    "op8_toxicity": op8_toxicity,
    "op9_mix_sources": op9_mix_sources,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lm_score": op11_lm_score,
    "op12_vector_codes": op12_vector_codes,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL.strip(),
    "op4_decontaminate": OP4_SQL.strip(),
    "op13_lexical_search": OP13_SQL.strip(),
}
