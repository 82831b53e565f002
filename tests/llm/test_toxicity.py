import zlib

from quarry.llm import toxicity as T


def test_grammar_clauses():
    s = T.Scorer({"idiot": 4.0, "scum": 3.0, "zork*": 5.0})
    plain = s.clause("what an idiot")
    assert plain == 4.0
    assert s.clause("you idiot") > plain and s.clause("idiot you") > plain
    assert s.clause("this is not an idiot") < plain
    assert s.clause("he said what an idiot") < s.clause("he thought what an idiot")
    assert s.clause("i will kill you") > 0 == s.clause("they kill time")
    assert s.clause("zorkling stuff") == 5.0
    assert s.features(None) == s.features("") == (0.0, 0.0, 0.0)
    best, total, _ = s.features("Idiot! A clean clause. scum, and scum.")
    assert best == 6.0 and total > 0
    assert s.features("idiotic scummy") == (0.0, 0.0, 0.0)


def test_composition_is_the_product():
    import random
    rng = random.Random(1)
    a = T.Transducer(2, lambda s, x: (x % 2, 0.5 if s else 2.0))
    b = T.Transducer(3, lambda s, x: ((s + x) % 3, 1.0 + s))
    c = a.compose(b)
    s1 = s2 = s = 0
    for _ in range(200):
        x = rng.randrange(8)
        (s1, f1), (s2, f2), (s, f) = a.table[s1][x], b.table[s2][x], c.table[s][x]
        assert f == f1 * f2 and s == s1 * 3 + s2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (3, "you idiot " * 30000, 0.2), (3, "you idiot " * 30000, 0.2), (None, "fine", 0.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 0, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = T.toxicity(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        for r in out:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert T.toxicity(docs.limit(0), none).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = T.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.02 * len(clean)
