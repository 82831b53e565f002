"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 2).

Every source gets a budget of words: weights share a fixed part of all words, a
source's budget stops at CAP times its own size, and the excess is shared again
by weight until no budget is above its stop.  Whole passes over a source (epochs)
come first.  For what is left of a budget, each document draws an exponential
key whose rate is its quality weight (-ln(u) / weight, which is the order of
Efraimidis and Spirakis' u ** (1 / weight)); the source's documents are sorted
by key and their sizes summed up until the budget is met, the last document being
cut to fit.  u comes from a hash of the document, so reruns agree.

The sort is one range partitioning over (source, key): a source may hold any
part of the rows, and the running sums need only one offset for each partition.

Defined results: null texts have size 0 and are never taken; a null source is a
source of its own, last in order; a row without a quality weight counts as the
least weight; repeated rows tie and are taken in an arbitrary but fixed order;
extra columns are ignored by ``mixture`` and kept by ``mix``; an empty table, or one without
words, gives targets of 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import running_total, save

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating; part of all words to give out; stop, in source sizes.
WEIGHTS, PART, CAP = (3, 1, 2), 1.5, 2.0
SEED = 20210
LEAST_WEIGHT = 0.05
#: Copies of a row that one task makes at a time.
COPIES = 1 << 16


def quality_weight(text: str = "text") -> Column:
    """In (0, 1]: falls with the share of symbol characters."""
    symbols = F.length(text) - F.length(F.translate(F.col(text), "#*$%&|<>", ""))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 - 10 * symbols / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, part: float = PART, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source."""
    ranked = running_total(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "rank")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = save(ranked.select("source", "source_size", w.alias("w")))
    total, level_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget = part * (total or 0)
    level, capped = (budget / level_w if level_w else 0.0), 0
    stop = cap * F.col("source_size")
    while True:  # ends when no further source reaches its stop
        full = stop <= level * F.col("w")
        n, used, open_w = ranked.agg(F.count_if(full), F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("w")))).first()
        if n == capped or not open_w:
            break
        level, capped = (budget - (used or 0.0)) / open_w, n
    return ranked.select("source", "source_size", F.least(stop, level * F.col("w")).cast("double").alias("target"))


def mixture(docs: DataFrame, *, weight: Column | None = None, weights: tuple = WEIGHTS, part: float = PART, cap: float = CAP,
            extra: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) for each row; ``extra`` names
    a column that is passed through."""
    weight = F.coalesce(F.greatest(weight if weight is not None else quality_weight(), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    mark = F.xxhash64("text")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", mark), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    base = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       (-F.log(u) / weight).alias("key"), mark.alias("mark"), *([extra] if extra else []))
    placed = save(running_total(save(base), [F.col("source").asc_nulls_last(), "key", "doc_id", "mark"], "size", "ahead"))
    by_source = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("ahead").alias("from"))
    targets = source_targets(by_source.select("source", "source_size"), weights, part, cap)
    per = by_source.select(F.col("source").alias("s1"), "from").join(
        targets.withColumnRenamed("source", "s2"), F.col("s1").eqNullSafe(F.col("s2"))).drop("s2")
    out = placed.join(per, F.col("source").eqNullSafe(F.col("s1")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long") - (F.col("ahead") - F.col("from"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *([extra] if extra else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with all columns of ``docs``: a row for each whole copy taken, and the cut
    documents with their first words only (and ``n_chars``, where there is one, counted anew).  The sampling moves
    names of rows only; the texts are joined to its result once."""
    names = [F.xxhash64(*docs.columns).alias("__1"), F.xxhash64(F.lit(7), *docs.columns).alias("__2")]
    rows = mixture(docs.select("doc_id", "source", "text", F.struct(*names).alias("__key")), extra="__key", **options)
    # rows that repeat each other follow each other in the order, so that one of them at most is cut
    per = save(rows.groupBy("__key.__1", "__key.__2").agg(
        F.count("*").alias("__rows"), F.sum(F.expr("coalesce(taken div nullif(size, 0), 0)")).alias("__whole"), F.max(F.expr("coalesce(taken % nullif(size, 0), 0)")).alias("__part"))
        .where("__whole > 0 OR __part > 0"))
    marked = docs.select("*", *names)
    found = marked.join(per.where("__rows = 1"), ["__1", "__2"])
    repeated = per.where("__rows > 1")
    if not repeated.isEmpty():
        found = found.unionByName(marked.join(repeated, ["__1", "__2"]).dropDuplicates(["__1", "__2"]))

    few = F.sequence(F.lit(0).cast("long"), F.expr(f"(__whole - 1) div {COPIES}"))
    blocks = found.where("__whole > 0").select("*", F.explode(few).alias("__b"))
    if not repeated.where(F.col("__whole") > COPIES).isEmpty():  # a row taken very many times is copied in many tasks
        blocks = blocks.repartition("__1", "__2", "__b")
    last = F.least(F.col("__whole"), (F.col("__b") + 1) * COPIES) - 1
    whole = blocks.select(*docs.columns, F.explode(F.sequence(F.col("__b") * COPIES, last)).alias("__i")).select(docs.columns)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts.to_pylist(), n.to_pylist(), strict=True):
            b = t.encode()
            tail = b.split(None, k)  # the words, and what follows them
            out.append((b[:len(b) - len(tail[k])] if len(tail) > k else b).rstrip().decode())
        return pa.array(out, pa.string())

    part = found.where("__part > 0").withColumn("__text", cut("text", "__part"))
    changed = {"text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    part = part.select(*(changed[c].alias(c) if c in changed else F.col(f"`{c}`").alias(c) for c in docs.columns))
    return whole.unionByName(part)
