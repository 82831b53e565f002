"""Operator 12: the packing of runs equals one group at a time, and the assignment keeps what it promises."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm.packing import assign, best_fit, write


def one_by_one(sizes, capacity):
    rooms, where = [], []
    for s in sizes:
        fit = [(room, i) for i, room in enumerate(rooms) if room >= s]
        if fit:
            room, i = min(fit)
        else:
            i, room = len(rooms), capacity
            rooms.append(capacity)
        rooms[i] = room - s
        where.append(i)
    return rooms, where


def test_runs_equal_one_group_at_a_time():
    rnd = random.Random(5)
    for _ in range(40):
        sizes = sorted((rnd.choice([1, 2, 3, 5, 8, 13, 40, rnd.randint(1, 60)]) for _ in range(rnd.randint(0, 300))), reverse=True)
        items = sorted(Counter(sizes).items(), reverse=True)
        packed = best_fit(items, 64)
        rooms, where = one_by_one(sizes, 64)
        flat = [shard for runs in packed for n, shard in runs for _ in range(n)]
        filled = Counter()
        for s, i in zip(sizes, flat, strict=True):
            filled[i] += s
        assert sorted(64 - v for v in filled.values()) == sorted(rooms)  # the same shards, up to their names
        assert best_fit(items, 64, len(rooms)) is not None
        assert not rooms or best_fit(items, 64, len(rooms) - 1) is None


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_assignment(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (1, ""), (7, None), (7, None), (3, "x" * 90000), (4, "é")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    rows = collected(assign(docs, extra="text"))
    assert len(rows) == docs.count()
    groups = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        groups.setdefault(raw, set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    big = max(r["size"] for r in rows)  # above an equal share: alone, and the others share the rest
    rest = [x for x in total.values() if x != big]
    assert set(total) == set(range(8)) and big == 90001 and len(rest) == 7 and max(rest) <= 1.02 * sum(rest) / 7
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_a_group_of_a_third_of_all_rows_is_cut_to_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = collected(assign(docs))
    total = Counter()
    for r in rows:
        total[r["shard"]] += r["size"]
    assert len(rows) == 3000 and len(total) == 8 and max(total.values()) - min(total.values()) <= 202
    one = collected(assign(docs, capacity=5000, shards=None))
    load = Counter()
    for r in one:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 5000 and len(load) <= -(-sum(load.values()) // 5000) + 2
    assert collected(assign(docs.limit(0))) == []


def test_write_keeps_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 4}", i * 2) for i in range(40)], "doc_id long, text string, size long")
    write(docs, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("doc_id", "text", "size").collect()) == sorted(tuple(r) for r in docs.collect())
    assert back.select("text", "shard").distinct().count() == 4
