"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.

* quality: documents outside their language's perplexity band, or failing the base rules, go.
* near_dedup: five-word shingles, similarity 0.8; of each group the document with the smallest doc_id stays.
* repeats: bytes of 100-byte strings that occur earlier in the corpus are cut out of the texts.
* mixture: sources are brought to their target weights; a document taken twice is two rows.
* tokens: doc_id, lang, source, n_tokens and the token ids of every row.

Null texts fail the quality rules; a null doc_id is kept as it is; an empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, neardup, quality, substrings
from quarry.llm.scratch import save


#: Rows of an Arrow batch: texts are long, and both the executor and its Python workers hold whole batches.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return quality.filter_quality(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return neardup.drop_near_duplicates(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return substrings.remove_repeats(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    _small_batches(spark)
    ids = bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("repeats", repeats_stage),
          ("mixture", mixture_stage), ("tokens", tokens_stage)]

#: The language model, the sketches and the hashes have no SQL form; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
