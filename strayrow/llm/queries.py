"""Queries over the whole test tables, one for each operator, and their SQL.

The queries without SQL are checked in ``tests/llm`` against brute force, exact round
trips or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm import boilerplate, contamination, filter_audit, hard_negatives, jaccard, langid, lbl, mih, minmax, packing, preference, sharding, toxicity
from strayrow.llm.ranks import remainder
from strayrow.session import ship_package


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Executors get the package; Arrow batches get fewer rows and bytes, since rows hold whole texts."""
    ship_package(spark)
    if int(spark.conf.get(BATCH_ROWS)) > 1000:
        spark.conf.set(BATCH_ROWS, "1000")
    spark.conf.set(BATCH_BYTES, str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shard_lpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 50 == 0, 5)


def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_preferences(preference.stale_answers(table(spark, sf_dir, "conversations")))
    return out.drop("chosen", "rejected")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizer(), 4096)


def word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_langid(docs.where(remainder("doc_id", 5) != 0))
    out = langid.identify(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract_pages(table(spark, sf_dir, "pages"))


def grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lbl.score_texts(docs, docs.where(remainder("doc_id", 10) != 0))
    return out.withColumn("held_out", remainder("doc_id", 10) == 0)


def positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def conv_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    score = F.col("toxicity")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def filter_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), lambda c: c % 50 == 0)


def minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), 5, 85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_lpt": shard_lpt,
    "op2_multi_index_hashing": multi_index_hashing,
    "op3_preference_format": preference_format,
    "op4_best_fit_packing": best_fit_packing,
    "op5_word_backoff_langid": word_backoff_langid,
    "op6_host_suffix_array": host_suffix_array,
    "op7_grouped_prefix_join": grouped_prefix_join,
    "op8_log_bilinear": log_bilinear,
    "op9_positional_index": positional_index,
    "op10_conv_toxicity": conv_toxicity,
    "op11_filter_diagrams": filter_diagrams,
    "op12_lemp_negatives": lemp_negatives,
    "op13_minmax_hashing": minmax_hashing,
}

# One turn as text, and the span of an answer with its end mark.
PREFERENCE_SQL = """
    WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS chosen
               FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    a AS (SELECT conv_id, chosen, list_filter(range(1, len(chosen) + 1), lambda i: chosen[i].role = 'assistant') AS answers FROM c),
    r AS (SELECT conv_id, chosen, CASE WHEN len(answers) = 0 THEN chosen ELSE list_concat(chosen[1:answers[-1] - 1],
                 [{'role': 'assistant', 'text': chosen[answers[1]].text}]) END AS rejected FROM a),
    s AS (SELECT conv_id, chosen, rejected, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
                 lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) AS n FROM r),
    t AS (SELECT conv_id, n AS n_shared,
                 list_transform(chosen[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS p,
                 list_transform(chosen[n + 1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS x,
                 list_transform(rejected[n + 1:], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) AS y,
                 list_transform(chosen[n + 1:], lambda x: x.role) AS xr, list_transform(rejected[n + 1:], lambda x: x.role) AS yr FROM s),
    u AS (SELECT *, array_to_string(p, '') AS prompt, array_to_string(x, '') AS cx, array_to_string(y, '') AS cy FROM t)
    SELECT conv_id, CAST(n_shared AS BIGINT) AS n_shared, prompt, cx AS chosen_completion, cy AS rejected_completion,
           array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: xr[i] = 'assistant'),
               lambda i: (length(prompt) + length(array_to_string(x[1:i - 1], '')) + 14) || ':' ||
                    (length(prompt) + length(array_to_string(x[1:i], '')) - 1)), ',') AS chosen_spans,
           array_to_string(list_transform(list_filter(range(1, len(y) + 1), lambda i: yr[i] = 'assistant'),
               lambda i: (length(prompt) + length(array_to_string(y[1:i - 1], '')) + 14) || ':' ||
                    (length(prompt) + length(array_to_string(y[1:i], '')) - 1)), ',') AS rejected_spans
    FROM u"""

ORACLE_SQL: dict[str, str] = {
    "op3_preference_format": PREFERENCE_SQL,
    "op11_filter_diagrams": filter_audit.AUDIT_SQL,
    "op12_lemp_negatives": hard_negatives.MINING_SQL,
}
