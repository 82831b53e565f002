import re
from itertools import combinations

from quarry.llm import neardup
from quarry.llm.neardup import drop_near_duplicates, near_duplicates


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[top(j)] = top(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = low.get(top(i)) if sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return sorted(out, key=repr)


def check(spark, rows, width=2):
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, kept string, node double")
    got = sorted(map(tuple, near_duplicates(df, width=width).collect()), key=repr)
    assert got == brute(rows, width, 80)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w50 ", "x50 ").replace("w120 ", "y120 ")
    check(spark, [(5, base), (3, near), (9, base.upper()), (9, base.upper()), (11, None), (12, ""), (13, " \t\n"), (1, "One"),
                  (2, "one"), (4, "two"), (None, base), (None, "zzz"), (None, None), (20, "a b"), (21, "A  b"), (22, "é Ä b"), (23, "é ä b")])
    check(spark, [])


def test_documents_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    check(spark, rows, width=5)


def test_large_near_group(spark):
    import random
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 16)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    check(spark, rows)


def variants():
    x, y = (" ".join(f"{c}{i}" for i in range(100)) for c in "xy")
    return x, x.replace("x50 ", "q50 "), y, y.replace("y50 ", "q50 ")


def test_two_texts_under_one_doc_id_are_two_nodes(spark):
    x, x2, y, y2 = variants()
    check(spark, [(9, x), (9, y), (3, y2), (1, x2)])
    check(spark, [(None, x), (None, y), (3, y2), (None, x2)])


def test_one_row_of_each_group_stays(spark):
    x, x2, y, y2 = variants()
    rows = [(None, y2), (5, y), (None, x), (None, x2), (7, "alone"), (9, x + " tail"), (9, x + " tail"), (None, "own words here"), (8, None), (8, None), (8, "")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, t1 int")
    out = drop_near_duplicates(df, width=2)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(5, y), (7, "alone"), (9, x + " tail"), (None, "own words here"), (8, None), (8, "")], key=repr)
    assert drop_near_duplicates(df.limit(0)).collect() == []


def test_a_text_with_many_partners_meets_them_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 16)
    test_large_near_group(spark)
