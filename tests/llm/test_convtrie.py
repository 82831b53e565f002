"""Operator 11 against a brute-force trie of dictionaries."""

import hashlib
import math
import random
import re
import zlib

from quarry.llm.convtrie import rebuild, trie, turns

KIND = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t, r or "", x or ""))

    def order(z):
        role = z[1].encode()
        return z[0] is not None, z[0] or 0, hashlib.sha256(len(role).to_bytes(8, "big") + role + z[2].encode()).digest()[:16]

    for c in own:
        own[c].sort(key=order)
    nodes = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = [x[1:] for x in own.get(c - int(math.fmod(c, 20)), [])[:h]] + [x[1:] for x in ts[h:]]
        for d in range(len(path) + 1):
            n = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": [], "children": set()})
            n["members"].append(c)
            if d == len(path):
                n["ends"].append(c)
            if d:
                nodes[tuple(path[:d - 1])]["children"].add(tuple(path[:d]))
    leaves, saved, out = {}, {}, []
    for k in sorted(nodes, key=len, reverse=True):
        n = nodes[k]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in n["children"]) or 1
        saved[k] = sum(saved[x] for x in n["children"]) + (len(n["members"]) - 1) * words
        out.append((min(n["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(n["members"]), len(n["children"]), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, KIND).withColumnRenamed("text", "t").selectExpr("conv_id", "turn", "role", "t as text", "1 as pos", "'x' as key", "2 as words")
    return sorted((tuple(r) for r in trie(rebuild(turns(df)), **options).collect()), key=str)


def sample():
    rnd, rows = random.Random(3), []
    for c in range(-45, 100):
        for t in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 13])):
            rows.append((c, rnd.choice([None, t, t, t]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a b", "c", None, "", " x\ty ", "a b"])))
    rows += [(None, 1, "user", "q"), *rows[:7], (7, 99, "user", "long " * 40000)]
    return rows + [(c, t, "u", "same words") for c in range(1000, 1300) for t in range(3)]


def test_trie_equals_brute_force_with_ties_nulls_and_a_hot_path(spark):
    rows = sample()
    assert found(spark, rows) == brute(rows)


def test_long_conversations_go_on_in_further_levels(spark):
    rows = sample()
    assert found(spark, rows, segment=5) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    rows = [(21, 0, "user", "x")]  # its base is absent; h decides whether its own turn is left
    assert found(spark, rows) == brute(rows)
