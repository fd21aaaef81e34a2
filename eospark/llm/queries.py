"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eospark.llm import (
    exact_dedup,
    fingerprints,
    manifest,
    mixing,
    packing,
    periodic_runs,
    pii,
    sharding,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


SQL["op8_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@query
def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs, repetition_limit=2.0)
    return mixed.select("doc_id", "source", mixing.words(F.col("text")).alias("tokens"), "_epoch", "_block", "_mix_key").withColumnsRenamed(
        {"_epoch": "epoch", "_block": "block", "_mix_key": "mix_key"}
    )


@query
def op3_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), 40)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_table(spark, sf_dir, "documents"), size=4, radius=4)


@query
def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = warc.archived(_table(spark, sf_dir, "pages"))
    return heads.select(
        F.expr("try_cast(id as bigint)").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


@query
def op6_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


@query
def op7_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(_table(spark, sf_dir, "documents"))


@query
def op4_suffix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "passage_words")


@query
def op11_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.verify(_table(spark, sf_dir, "documents"), tampered, {"n_chars": F.col("n_chars") + 1})


SQL["op11_merkle_witnesses"] = """
WITH RECURSIVE
docs AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))
              AS crc
    FROM documents
),
leaves AS (
    SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf, sha256(head || CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n1 ELSE n0 END || tail) AS used
    FROM (
        SELECT doc_id, lang, crc,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head,
               coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS n0,
               coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') AS n1,
               coalesce(strlen(text) || ':' || text, '-') AS tail
        FROM docs
    )
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low AS (
    SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM placed
    UNION ALL
    SELECT lang, lvl + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, lvl, pos // 2
),
groups AS (
    SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
),
high AS (
    SELECT 0 AS lvl, pos, n, subroot AS h FROM groups
    UNION ALL
    SELECT lvl + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2
),
proofs AS (
    SELECT p.doc_id, p.leaf, list({'h': s.h, 'l': s.pos < p.pos >> s.lvl, 'k': s.lvl}) AS low
    FROM placed p JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.pos = xor(p.pos >> s.lvl, 1) AND s.n > 1
    GROUP BY ALL
),
tops AS (
    SELECT g.lang, list({'h': s.h, 'l': s.pos < g.pos >> s.lvl, 'k': s.lvl}) AS high
    FROM groups g JOIN high s ON s.pos = xor(g.pos >> s.lvl, 1) AND s.n > 1
    GROUP BY ALL
),
paths AS (
    SELECT p.doc_id, p.leaf, p.used, g.subroot, (SELECT h FROM high WHERE n = 1) AS root,
           list_concat(
               list_transform(range(CASE WHEN p.n > 1 THEN length(bin(p.n - 1)) ELSE 0 END),
                   lambda k: list_filter(coalesce(q.low, []), lambda s: s.k = k)),
               list_transform(range(CASE WHEN g.n > 1 THEN length(bin(g.n - 1)) ELSE 0 END),
                   lambda k: list_filter(coalesce(t.high, []), lambda s: s.k = k))) AS path
    FROM placed p JOIN groups g ON g.lang IS NOT DISTINCT FROM p.lang
    LEFT JOIN proofs q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf
    LEFT JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
),
folds AS (
    SELECT *, list_reduce(list_prepend([{'h': used, 'l': false, 'k': -1}], path),
        lambda a, b: [{'h': sha256(CASE WHEN len(b) = 0 THEN a[1].h WHEN b[1].l THEN b[1].h || a[1].h ELSE a[1].h || b[1].h END), 'l': false, 'k': -1}])[1].h AS fold
    FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(flatten(path), lambda s: s.h), '')) AS proof_sha256,
       fold AS folded_root, fold = root AS verified
FROM folds
"""


@query
def op12_dyadic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = periodic_runs.with_periodic_tails(_table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.periodic_runs(edited))


@query
def op13_token_transducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), packing.vocabulary_path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)
