"""What executors hold beside their tasks: Python workers, what those keep, and files of small tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quarry.llm import bpe, mixing, neardup, quality, substrings
from quarry.llm import textkit as K
from quarry.llm.scratch import components, numbered, running_total, save

PYTHON = re.compile(r"MapInArrow|ArrowEvalPython|BatchEvalPython|Flat(Map|MapCo)GroupsInArrow")


def docs(spark):
    text = lambda k: " ".join(f"w{(i * (k % 7 + 1) + i // 7) % 97}" for i in range(120)) + f" é{k}"
    rows = [(k, text(k), "en" if k % 3 else None, "ab"[k % 2], 5, None) for k in range(40)]
    rows += [(40, text(1), "en", "a", 5, None), (1, text(1), "en", "b", 5, None), (None, None, "en", "a", 0, None)]
    return save(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, url string"))


def most_python_nodes(df):
    """Python operators that run in one task, each of which takes a worker of its own."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    most, path = 0, []  # (indentation, Python operators since the last exchange)
    for line in plan.splitlines():
        m = re.match(r"[\s:|+*\-]*", line)
        at, name = m.end(), line[m.end():]
        while path and path[-1][0] >= at:
            path.pop()
        n = 0 if "Exchange" in name.split("(")[0] else path[-1][1] if path else 0
        n += bool(PYTHON.match(re.sub(r"^\(\d+\) ", "", name)))
        path.append((at, n))
        most = max(most, n)
    assert PYTHON.search(plan)
    return most


def test_repeats_take_one_worker_a_task(spark):
    table = docs(spark)
    assert most_python_nodes(substrings.remove_repeats(table)) == 1
    got = {r.doc_id: r.text for r in substrings.remove_repeats(table.where("doc_id <> 1")).collect()}
    kept = {r.doc_id: r.kept_bytes.decode("utf-8", "ignore") for r in substrings.repeated_spans(table.where("doc_id <> 1")).collect()}
    assert got == kept and any(len(got[d]) < 100 for d in got)


@pytest.mark.parametrize("rows", [[(3, "a", 2), (1, "b", 5), (2, "a", 7)], []])
def test_offsets_need_no_python_workers(spark, rows):
    df = spark.createDataFrame(rows, "x long, k string, n long")
    total, place = running_total(save(df), ["x"], "n", "ahead"), numbered(save(df), "k", ["x"], "at")
    for out in (total, place):
        assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.x, r.ahead) for r in total.collect()) == [(1, 0), (2, 5), (3, 12)][:len(rows)]
    assert sorted((r.x, r.at) for r in place.collect()) == [(1, 0), (2, 0), (3, 1)][:len(rows)]


def test_tables_of_known_size_are_few_files(spark):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(1000).repartition(5 * cores + 20)
    assert len(save(many, 1000).inputFiles()) <= cores < len(save(many).inputFiles())
    assert save(many, 1000).agg(F.sum("id")).first()[0] == 499500
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 100 > 0, 1).otherwise(0)).alias("b"))
    out = components(links.repartition(5 * cores + 20))
    assert len(out.inputFiles()) <= cores
    assert {(r.node, r.root) for r in out.collect()} == {(i, i // 100 * 100) for i in range(400)}


def test_workers_let_go_of_another_operators_encoder():
    made = []
    make = lambda: made.append(1) or object()
    first = K.held(("bpe", 1), make)
    K.release(("bpe", 1))
    assert K.held(("bpe", 1), make) is first
    K.release()
    assert K.held(("bpe", 1), make) is not first and len(made) == 2
    assert K.held(("bpe", 2), make) and list(K._held) == [("bpe", 2)]
    K.release()
    raw = b"YQ== 0\nYg== 1\nYWI= 2\n"
    assert bpe._encoder(raw) is bpe._encoder(raw) and len(K._held) == 1
    K.release()


def test_stages_take_one_worker_a_task(spark):
    table = docs(spark)
    for stage in (quality.filter_quality, neardup.drop_near_duplicates, mixing.mix):
        out = stage(table)
        if PYTHON.search(out._jdf.queryExecution().executedPlan().toString()):
            assert most_python_nodes(out) == 1
    assert [name for name, _ in C.STAGES] == ["quality", "near_dedup", "repeats", "mixture", "tokens"]
