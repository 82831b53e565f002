"""Token counts from an exact length histogram (operator 6).

Every text is encoded; documents are aggregated by encoded length, and running
sums from both ends of that histogram answer, for every length as a context limit:
documents and tokens within it, quantiles, and the total if longer documents are cut to it.

Defined results: null and empty texts have length 0; repeated rows count each; extra columns are
ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import read_ranks
from quarry.llm.scratch import running_total, save

_encodings: dict[int, tiktoken.Encoding] = {}


def token_counter(docs: DataFrame, rank_file: str, pattern: str):
    """A function of a text column: its number of tokens."""
    with open(rank_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(texts: pa.Array) -> pa.Array:
        key = hash(shared.value)
        if key not in _encodings:
            _encodings[key] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=read_ranks(shared.value), special_tokens={})
        encode = _encodings[key].encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(count, "long")


def histogram(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs), a row for each length that occurs."""
    count = token_counter(docs, rank_file, pattern)
    return docs.select(count("text").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: docs_within, tokens_within (documents no longer), docs_longer,
    truncated_total (all documents, the longer ones cut), lost_tokens, and quantile (share of documents within)."""
    hist = save(hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")))
    docs, tokens = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # what is ahead of a length, from the short end; what is longer is the rest of the total
    h = running_total(hist, [F.col("n_tokens")], "n_docs", "d0")
    h = running_total(h, [F.col("n_tokens")], "tokens", "t0")
    within, inside = F.col("d0") + F.col("n_docs"), F.col("t0") + F.col("tokens")
    longer = F.lit(docs) - within
    total = inside + longer * F.col("n_tokens")
    return h.select("n_tokens", "n_docs", within.alias("docs_within"), inside.alias("tokens_within"), longer.alias("docs_longer"),
                    total.alias("truncated_total"), (F.lit(tokens) - total).alias("lost_tokens"), (within / F.lit(max(docs, 1))).alias("quantile"))


def at_limits(hist: DataFrame, wanted: list[int]) -> DataFrame:
    """The columns of ``limits`` for any context limits, whether a document has that length or not (column ``limit``)."""
    docs, tokens = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0))).first()
    each = hist.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in wanted])).alias("limit"))
    inside = F.col("n_tokens") <= F.col("limit")
    sums = each.groupBy("limit").agg(F.sum(F.when(inside, F.col("n_docs")).otherwise(0)).alias("docs_within"),
                                     F.sum(F.when(inside, F.col("n_tokens") * F.col("n_docs")).otherwise(0)).alias("tokens_within"))
    longer = F.lit(docs) - F.col("docs_within")
    total = F.col("tokens_within") + longer * F.col("limit")
    return sums.select("limit", "docs_within", "tokens_within", longer.alias("docs_longer"), total.alias("truncated_total"),
                       (F.lit(tokens) - total).alias("lost_tokens"), (F.col("docs_within") / F.lit(max(docs, 1))).alias("quantile"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length within which that share of the documents lies."""
    found = limits(hist).select("n_tokens", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return found.where(F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
