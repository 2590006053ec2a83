"""A corpus pipeline: documents in, packed sequences out, in five stages.

Every stage reads all rows that the one before it kept, and is written before the next
one reads it. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrow.llm import contamination, jaccard, langid, packing, toxicity
from strayrow.llm.queries import BATCH_BYTES, prepare, public_tokenizer, table
from strayrow.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE_SCORE = 0.5
JACCARD_BATCH = 1 << 20  # bytes of an Arrow batch there


def only_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without a letter go, and rows whose language stays in doubt."""
    prepare(spark)
    found = langid.identify(docs, langid.fit_langid(docs), keep=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows at or above the calibrated threshold go."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=tuple(COLUMNS)).where("toxicity < 0.5").select(*COLUMNS)


def with_rows(docs: DataFrame, label: str) -> DataFrame:
    """The documents with a key of each row, written so that the keys stay; ids may be missing or repeat."""
    return materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), f"{label}-rows")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of connected near-duplicates (five words, 0.8) the smallest id stays.

    Of those without an id one stays as well. Texts that share an id are told apart.
    """
    prepare(spark)
    # this stage sorts and joins in a heap that the stages before it have filled: less beside it
    spark.conf.set(BATCH_BYTES, str(JACCARD_BATCH))
    rows = with_rows(docs, "jaccard")
    found = jaccard.jaccard_components(rows, 5, 80, id_col="_row")
    found = found.join(rows.select("_row", F.col("doc_id").alias("id")), "_row")
    least = found.groupBy("component_id", F.col("id").isNull().alias("nameless")).agg(F.min(F.struct("id", "_row")).alias("l"), F.max("n_shingles").alias("n"))
    least = materialize(least.select("l._row", "nameless", "n"), "jaccard-kept")
    # texts without words are no copies of each other, but the same row may occur twice; one stays.
    # Equal texts with words are linked, so only those without are compared here, and no other text is shuffled
    bare = rows.where(F.col("text").isNull() | F.col("text").rlike(r"\A[\x09-\x0D\x20]*\z")).join(least.where("n = 0 AND NOT nameless"), "_row", "left_semi")
    once = bare.groupBy("doc_id", "text").agg(F.min("_row").alias("_row"))
    chosen = least.where("n > 0 OR nameless").select("_row").union(once.select("_row"))
    return rows.join(chosen, "_row", "left_semi").select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: rows that hold ten consecutive words of a benchmark item go."""
    rows = with_rows(docs, "contamination")
    found = contamination.contamination(rows, table(spark, sf_dir, "benchmark"), 10, id_col="_row")
    return rows.join(found.where("contaminated").select("_row"), "_row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizer(), 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", only_identified),
    ("toxicity", not_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", uncontaminated),
    ("best_fit_packing", packed),
]

# classifiers, a tokenizer and components of links are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
