"""Registered queries of the llm operators: name -> (spark, sf_dir) -> DataFrame.

``ORACLES`` holds DuckDB SQL for those that SQL can express; the others are
tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8."""
    from quarry.llm.neardup import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"), width=2, percent=80)


@query("op8_ngram_perplexity_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import quality
    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.substrings import repeated_spans
    out = repeated_spans(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op2_source_mixture")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mixture
    return mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from quarry.llm.bpe import decoder, encode
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, P.PATTERN).drop("text")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2(decoder(ids, path)("ids"), 256).alias("decoded_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_toxicity_grammar")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import toxicity
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op5_license_notices")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.license import scan
    return scan(_table(spark, sf_dir, "documents")).drop("spans")


@query("op4_balanced_posting_lists")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.ann import search
    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_token_length_histogram")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length, which is also a context limit."""
    import public_tokenizers as P

    from quarry.llm.lengths import histogram, limits
    return limits(histogram(_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


@query("op9_page_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.langid import identify
    return identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


@query("op11_conversation_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the rebuilt conversations' trie."""
    from quarry.llm.convtrie import rebuild, trie, turns
    return trie(rebuild(turns(_table(spark, sf_dir, "conversations"))))


# crc32 is not a function of the oracle's engine: bit by bit over the decimal's bytes, lowest bit first
ORACLES["op11_conversation_prefix_trie"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT conv_id, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                lambda ch: list_transform(range(8), lambda j: (CAST(ascii(ch) AS BIGINT) >> CAST(j AS INTEGER)) & 1))) AS b
         FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
                lambda s, x: xor(s >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)), CAST(4294967295 AS BIGINT)) % 4 AS h,
             conv_id - conv_id % 20 AS base FROM bits),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
p AS (SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.part, r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS path
      FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, d AS depth, list_slice(path, 1, d) AS node, len(path) = d AS ends
      FROM (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT node, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
             (count(*) - 1) * CASE WHEN any_value(depth) = 0 THEN 0
               ELSE len(regexp_extract_all(any_value(node[len(node)].text), '[^\x20\x09-\x0D]+')) END AS saved
      FROM m GROUP BY node),
k AS (SELECT list_slice(node, 1, depth - 1) AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.node),
s AS (SELECT list_slice(node, 1, a) AS top, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
      FROM (SELECT node, saved, n_children, unnest(range(0, depth + 1)) AS a FROM f) GROUP BY top)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.top = f.node LEFT JOIN f u ON f.depth > 0 AND u.node = list_slice(f.node, 1, f.depth - 1)
"""


@query("op12_best_fit_sharding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes; equal texts stay together."""
    from quarry.llm.packing import assign
    return assign(_table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_phrase_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two and three words that occur ten times in their language."""
    from quarry.llm.collocations import collocations
    return collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, absorbed=50, top=2000)


ORACLES["op13_phrase_collocations"] = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (SELECT lang, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
          FROM (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (1), (2), (3)) v(n))),
f AS (SELECT lang, n, phrase, count(*) AS f, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3 FROM grams GROUP BY lang, n, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE n = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE n >= 2 AND f >= 10),
cuts AS (SELECT lang, n, phrase, f AS a, 1 AS k, w1 AS head, CASE n WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS tail FROM cand
         UNION ALL SELECT lang, n, phrase, f, 2, w1 || ' ' || w2, w3 FROM cand WHERE n = 3),
scored AS (SELECT c.lang, c.n, c.phrase, c.a, c.k, l.f AS l, r.f AS r,
                  (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head AND l.n = c.k
                       JOIN f r ON r.lang = c.lang AND r.phrase = c.tail AND r.n = c.n - c.k),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM cand WHERE n = 3
                                                UNION ALL SELECT lang, w2 || ' ' || w3, f FROM cand WHERE n = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.n = 2
         WHERE g.f IS NULL OR 100 * g.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT r.lang, CAST(r.rank AS BIGINT) AS rank, r.phrase, CAST(r.a AS BIGINT) AS a, CAST(r.l AS BIGINT) AS l, CAST(r.r AS BIGINT) AS r,
       CAST(t.n AS BIGINT) AS n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
