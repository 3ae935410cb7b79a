"""The corpus pipeline: five stages over ``documents``, each on all rows that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result as Parquet in the shared
checkpoint folder and reads it back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.llm import bpe, grading, mixing, near_dup, repeats
from votepanel.session import cut_lineage

#: Near duplicates of the corpus: the general rule, five words and similarity 0.8 or more (``op3_near_dup`` has 0.85).
NEAR_PERCENT = 80
#: Passages of the corpus: words in a row that two texts share (``op10_repeats`` has 400 bytes).
PASSAGE_WORDS = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier does not reject."""
    return grading.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group at similarity 0.80: the smallest doc_id, a row without doc_id only where none has one.

    Rows are told apart by a number of their own, so rows that repeat a doc_id, or have none, are members like others. Texts without
    words have no group and stay."""
    rows = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_dup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_PERCENT)
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select("_row", F.col("doc_id").cast("long").alias("_id"))
    # false before true: null ids come last; the rows of one id by number
    kept = groups.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row")))["_row"].alias("_row")).select("_row")
    wordless = found.where("n_shingles = 0").select(F.col("doc_id").alias("_row"))
    return rows.join(kept.unionByName(wordless), "_row", "left_semi").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words and more that other texts hold too; documents of which nothing is left go."""
    columns = docs.columns
    left = repeats.remove_passages(docs, PASSAGE_WORDS)
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; sources weigh 5, 2, 1, repeating."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of ids and decoded text."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]
#: The classifier is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
