"""Registered routing queries (N1-N7) over the whole ``conversations`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import route as R
from quarry.plans.catalog import register, table

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
# the events table's columns: `ts` occurs (as a compact match) in the conversation texts
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _cond_sql(q: str, phrases: list[str]) -> str:
    parts = []
    for p in phrases:
        if p.startswith("\\b"):
            parts.append(f"regexp_matches({q}, '{p}')")
        else:
            parts.append(f"contains({q}, '{p}')")
    return "(" + " OR ".join(parts) + ")"


def _intent_case(q: str) -> str:
    whens = []
    for intent, conf, method, phrases, extra in R.INTENT_RULES:
        cond = _cond_sql(q, phrases)
        for g in extra:
            cond += " AND " + _cond_sql(q, g)
        m = f"'{method}'" if method else "NULL::VARCHAR"
        whens.append(f"WHEN {cond} THEN {{'intent': '{intent}', 'confidence': {conf}::DOUBLE, 'method': {m}}}")
    fb = R.FALLBACK_INTENT
    return f"CASE {' '.join(whens)} ELSE {{'intent': '{fb[0]}', 'confidence': {fb[1]}::DOUBLE, 'method': NULL::VARCHAR}} END"


@register("route_intents_conversations", f"""SELECT conv_id, turn, r.intent AS intent, r.confidence AS confidence,
    r.method AS method FROM (SELECT conv_id, turn, {_intent_case('lower(text)')} AS r FROM conversations)""")
def _intents(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.classify_intent(F.col("text")).alias("r")).select(
        "conv_id", "turn", "r.intent", "r.confidence", "r.method")


@register("route_intent_counts_conversations", f"""SELECT intent, count(*) AS n FROM (
    SELECT ({_intent_case('lower(text)')}).intent AS intent FROM conversations) GROUP BY 1""")
def _intent_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(R.classify_intent(F.col("text"))["intent"].alias("intent")).groupBy("intent").agg(
        F.count(F.lit(1)).alias("n"))


def _topic_case(c: str) -> str:
    whens = " ".join(f"WHEN {_cond_sql(c, words)} THEN '{topic}'" for topic, words in R.TOPIC_RULES)
    return f"CASE {whens} ELSE '{R.TOPIC_DEFAULT}' END"


@register("route_answer_topics_conversations", f"""SELECT conv_id, turn, {_topic_case('combined')} AS topic FROM (
    SELECT conv_id, turn, coalesce(array_to_string(list(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn
           ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ' '), '') || ' ' || lower(text) AS combined
    FROM conversations)""")
def _topics(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return R.answer_topics(c, "conv_id", "turn", "text").select("conv_id", "turn", "topic")


@register("route_code_blocks_conversations", """SELECT count(*) FILTER (WHERE regexp_matches(text, '(?is)```(?:python)?\\s*(.*?)```')
      AND trim(regexp_extract(text, '(?is)```(?:python)?\\s*(.*?)```', 1)) <> '') AS with_code,
    sum(length(trim(regexp_replace(text, '(?is)```(?:python)?\\s*(.*?)```', '', 'g'))))::BIGINT AS stripped_chars
    FROM conversations""")
def _code(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.agg(F.count(R.extract_code(F.col("text"))).alias("with_code"),
                 F.sum(F.length(R.strip_code(F.col("text")))).cast("long").alias("stripped_chars"))


@register("route_questions_conversations")
def _route(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("qid", F.concat_ws(":", "conv_id", "turn"))
    routed = R.route(c, "qid", "text", DOC_COLUMNS)
    return R.missing_roles(routed, ["doc_id", "n_chars", "quality", "toxic"], ["text", "lang", "source"]).select(
        "conv_id", "turn", "intent", "confidence", "method", "columns", "target", "predictors", "missing_roles")


def _mentions_sql(cols: list[str]) -> str:
    parts = []
    for c in cols:
        L = len(c)
        lc = c.lower()
        norm = "".join(ch for ch in lc if ch.isalnum() and ch.isascii())
        boundary = (f"list_filter(range(1, length(text) - {L} + 2), lambda i: lower(substr(text, i, {L})) = '{lc}' "
                    f"AND (i = 1 OR NOT regexp_matches(substr(text, i - 1, 1), '[A-Za-z0-9_]')) "
                    f"AND (i + {L} > length(text) OR NOT regexp_matches(substr(text, i + {L}, 1), '[A-Za-z0-9_]')))")
        compact = f"contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), '{norm}')" if norm else "false"
        parts.append(f"""SELECT conv_id, turn, '{c}' AS name, {L} AS l,
            CASE WHEN len({boundary}) > 0 THEN {boundary}[1] - 1
                 WHEN strpos(lower(text), '{lc}') > 0 THEN strpos(lower(text), '{lc}') - 1 ELSE 10000 END AS p,
            len({boundary}) > 0 OR {compact} AS hit FROM conversations""")
    return f"""SELECT c.conv_id, c.turn, coalesce(m.cols, []::VARCHAR[]) AS columns FROM conversations c LEFT JOIN (
        SELECT conv_id, turn, list(name ORDER BY p, l, name) AS cols FROM ({' UNION ALL '.join(parts)}) WHERE hit
        GROUP BY 1, 2) m ON c.conv_id = m.conv_id AND c.turn = m.turn"""


@register("route_column_mentions_conversations", _mentions_sql(EVENT_COLUMNS))
def _mentions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("qid", F.concat_ws(":", "conv_id", "turn"))
    return R.column_mentions(c, "qid", "text", EVENT_COLUMNS).select("conv_id", "turn", "columns")
