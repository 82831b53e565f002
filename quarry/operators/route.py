"""Question routing (N1-N7) as a Spark job over a table of utterances.

Each rule set is one ``when`` chain over ``lower(text)`` (first match wins).
Column mentions pair each question with the dataset's column names, a
broadcast table bounded by the schema width; the context of a conversation
turn is a bounded window (the previous four turns).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Intent rules in order (intent, confidence, method, any-of phrases,
# extra all-of groups).  A rule fires when the lower-cased question contains any
# phrase and, for every extra group, at least one of its words.
INTENT_RULES = [
    ("unknown/general_question", 0.55, None, ["show me the code", "show code", "python code", "how did you code"], []),
    ("recommended_analysis", 0.9, None, ["recommend", "what should", "explore next", "best visualization",
                                         "analyze first"], []),
    ("missing_values", 0.9, None, ["missing", "null", "na values"], []),
    ("data_quality", 0.85, None, ["quality", "clean", "duplicates"], []),
    ("outlier_detection", 0.9, None, ["outlier", "anomal"], []),
    ("chi_square_test", 0.95, None, ["chi", "chisquare", "chi-square"], []),
    ("anova", 0.95, None, ["anova", "analysis of variance"], []),
    ("mann_whitney", 0.95, None, ["mann", "whitney"], []),
    ("kruskal_wallis", 0.95, None, ["kruskal", "wallis"], []),
    ("t_test", 0.95, None, ["t-test", "ttest", " t test"], []),
    ("correlation", 0.95, "Spearman", ["spearman"], []),
    ("correlation", 0.95, "Pearson", ["pearson"], []),
    ("correlation_heatmap", 0.96, None, ["heatmap"], [["corr"]]),
    ("correlation", 0.9, None, ["strongest correlation", "top correlation"], []),
    ("correlation", 0.9, None, ["correlation"], [["strongest", "find", "rank"]]),
    ("correlation", 0.85, None, ["correlation", "correlat", "\\bcorr\\b"], []),
    ("feature_importance", 0.92, None, ["feature importance", "most important", "important for predicting",
                                        "features predict", "predictors"], []),
    ("random_forest", 0.93, None, ["random forest"], []),
    ("decision_tree", 0.9, None, ["decision tree"], []),
    ("logistic_regression", 0.93, None, ["logistic"], []),
    ("linear_regression", 0.9, None, ["regression model", "linear regression", "multiple regression",
                                      "build regression", "predict "], []),
    ("regression_plot", 0.9, None, ["regression"], [["plot", "scatter", "line"]]),
    ("scatter_matrix", 0.9, None, ["scatter matrix", "pair plot", "pairplot"], []),
    ("scatter_3d", 0.9, None, ["3d"], [["scatter"]]),
    ("scatter_plot", 0.87, None, ["scatter", " vs ", " versus "], []),
    ("histogram", 0.88, None, ["hist", "distribution"], []),
    ("kde_plot", 0.88, None, ["kde", "density"], []),
    ("boxplot", 0.82, None, ["box", "compare"], []),
    ("violin_plot", 0.9, None, ["violin"], []),
    ("cross_tabulation", 0.9, None, ["cross tab", "crosstab", "contingency"], []),
    ("stacked_bar_chart", 0.9, None, ["stack"], [["bar"]]),
    ("grouped_bar_chart", 0.86, None, ["group"], [["bar"]]),
    ("count_plot", 0.82, None, ["count"], []),
    ("bar_chart", 0.82, None, ["bar"], []),
    ("pie_chart", 0.86, None, ["pie"], []),
    ("line_plot", 0.78, None, ["line", "trend"], []),
    ("area_chart", 0.8, None, ["area"], []),
    ("descriptive_statistics", 0.86, None, ["describe", "statistics", "descriptive", "stats"], []),
    ("summary", 0.8, None, ["summarize", "summary", "overview"], []),
]
FALLBACK_INTENT = ("unknown/general_question", 0.2, None)

# Keyword patterns after which the target / the predictors are named.
TARGET_KEYWORDS = r"(?i)\b(predict|target|for|model(?:\s+for)?|explain)\b"
PREDICTOR_KEYWORDS = r"(?i)\b(using|with|from|based on|predictors?)\b"

# Answer topics in order, with the words that select them
# (substring tests over the last four turns plus the question).
TOPIC_RULES = [
    ("missing", ["missing", "null", "na", "quality", "clean", "cleanliness"]),
    ("correlation", ["correlation", "relationship", "related", "association", "strongest"]),
    ("visualization", ["visual", "chart", "plot", "graph"]),
    ("statistical_tests", ["statistical test", "t-test", "anova", "chi-square", "chi square", "p-value", "p value",
                           "significance", "hypothesis"]),
    ("ml_strategy", ["ml", "machine learning", "algorithm", "classifier", "classification", "train/test", "overfit"]),
    ("predictive_variables", ["predictive", "predictor", "important variable", "variables are most important",
                              "feature importance", "target"]),
    ("ml_strategy", ["model", "regression", "important", "importance", "predict"]),
    ("columns", ["column", "field", "variable", "dtype", "type"]),
    ("anomaly", ["outlier", "anomaly", "anomalies", "unusual", "risk", "suspicious", "skew", "kurtosis",
                 "multicollinearity", "imbalance"]),
    ("business_insights", ["business", "insight", "stand out", "decision", "advisor", "analyze first",
                           "what should i analyze first"]),
    ("categorical_frequencies", ["categor", "frequency", "frequencies", "count", "distribution"]),
]
TOPIC_DEFAULT = "summary"

# Code-block and line patterns.
CODE_BLOCK = r"(?is)```(?:python)?\s*(.*?)```"
IMPORT_LINE = r"(?m)^\s*(import\s+.+|from\s+.+\s+import\s+.+)\s*$"
FILE_IO_LINE = r"(?m)^\s*(open\(|to_csv\(|to_excel\(|savefig\(|plt\.savefig\().*$"
SHOW_LINE = r"(?m)^\s*plt\.show\(\)\s*$"

# Column roles each intent needs.
TWO_NUMERIC = ["correlation", "scatter_plot", "regression_plot"]
NUMERIC_BY_GROUP = ["boxplot", "violin_plot", "anova", "t_test", "mann_whitney", "kruskal_wallis"]
TWO_CATEGORICAL = ["chi_square_test", "cross_tabulation", "stacked_bar_chart"]
ONE_NUMERIC = ["histogram", "kde_plot", "outlier_detection"]
ONE_CATEGORICAL = ["count_plot", "pie_chart"]
MODELLING = ["linear_regression", "logistic_regression", "random_forest", "decision_tree", "feature_importance"]


def _has(q: Column, phrase: str) -> Column:
    if phrase.startswith("\\b"):
        return q.rlike(phrase)
    return q.contains(phrase)


def _any(q: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_has(q, p) for p in phrases])


def classify_intent(text: Column) -> Column:
    """struct(intent, confidence, method) by the ordered rules."""
    q = F.lower(text)
    out = None
    for intent, conf, method, phrases, extra in INTENT_RULES:
        cond = _any(q, phrases)
        for group in extra:
            cond = cond & _any(q, group)
        val = F.struct(F.lit(intent).alias("intent"), F.lit(conf).alias("confidence"),
                       F.lit(method).cast("string").alias("method"))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    fb = F.struct(F.lit(FALLBACK_INTENT[0]).alias("intent"), F.lit(FALLBACK_INTENT[1]).alias("confidence"),
                  F.lit(None).cast("string").alias("method"))
    return out.otherwise(fb)


def _normalise(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def mentions(text: Column, columns: list[str]) -> Column:
    """The columns named in a text, by position, then name length, then name: a
    boundary match (any case) or, failing that, a substring of the letters and digits.
    One expression per column of the dataset: routing is a projection."""
    plain, low = _normalise(text), F.lower(text)
    found = []
    for c in columns:
        name = re.sub("[^a-z0-9]+", "", c.lower())
        at = F.regexp_instr(text, F.lit("(?i)(?<![A-Za-z0-9_])" + re.escape(c) + "(?![A-Za-z0-9_])"))
        part = F.instr(plain, name) > 0 if name else F.lit(False)
        inside = F.instr(low, c.lower())
        place = F.when(at > 0, at - 1).when(inside > 0, inside - 1).otherwise(F.lit(10000))
        found.append(F.when((at > 0) | part, F.struct(place.alias("p"), F.lit(len(c)).alias("l"), F.lit(c).alias("n"))))
    if not found:
        return F.array().cast("array<string>")
    return F.transform(F.array_sort(F.array_compact(F.array(*found))), lambda m: m["n"])


def column_mentions(questions: DataFrame, id_col: str, text_col: str, columns: list[str],
                    out: str = "columns") -> DataFrame:
    """N2 over a table of texts: adds ``out``."""
    return questions.withColumn(out, mentions(F.col(text_col), columns))


def _suffix_after(text: Column, pattern: str) -> Column:
    start = F.regexp_instr(text, F.lit(pattern))
    m = F.regexp_extract(text, pattern, 0)
    return F.when(start > 0, F.substring(text, start + F.length(m), 1 << 30))


def route(questions: DataFrame, id_col: str, text_col: str, columns: list[str]) -> DataFrame:
    """Intent, confidence, method, mentioned columns, target and predictors."""
    q = questions.withColumn("_r", classify_intent(F.col(text_col)))
    q = q.withColumn("_tsuf", _suffix_after(F.col(text_col), TARGET_KEYWORDS)) \
        .withColumn("_psuf", _suffix_after(F.col(text_col), PREDICTOR_KEYWORDS))
    q = column_mentions(q, id_col, text_col, columns, "columns")
    q = column_mentions(q, id_col, "_tsuf", columns, "_tm")
    q = column_mentions(q, id_col, "_psuf", columns, "_pm")
    target = F.when(F.size("_tm") > 0, F.col("_tm")[0]).when(F.size("columns") > 0, F.col("columns")[0])
    q = q.withColumn("target", target)
    preds = F.when(F.size("_pm") > 0, F.filter("_pm", lambda c: c != F.coalesce(F.col("target"), F.lit("")))) \
        .when(F.col("target").isNotNull(), F.filter("columns", lambda c: c != F.col("target"))) \
        .otherwise(F.array().cast("array<string>"))
    return q.select(*questions.columns, F.col("_r.intent").alias("intent"), F.col("_r.confidence").alias("confidence"),
                    F.col("_r.method").alias("method"), "columns", "target", preds.alias("predictors"))


def missing_roles(routed: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Column roles still missing for each routed request."""
    num = F.array(*[F.lit(c) for c in numeric]) if numeric else F.array().cast("array<string>")
    cat = F.array(*[F.lit(c) for c in categorical]) if categorical else F.array().cast("array<string>")
    n_num = F.size(F.array_intersect("columns", num))
    n_cat = F.size(F.array_intersect("columns", cat))
    it = F.col("intent")
    roles = F.array_compact(F.array(
        F.when(it.isin(TWO_NUMERIC) & (n_num < 2), F.lit("numeric_columns")),
        F.when(it.isin(NUMERIC_BY_GROUP) & (n_num == 0), F.lit("numeric_column")),
        F.when(it.isin(NUMERIC_BY_GROUP) & (n_cat == 0), F.lit("group_column")),
        F.when(it.isin(TWO_CATEGORICAL) & (n_cat < 2), F.lit("categorical_columns")),
        F.when(it.isin(ONE_NUMERIC) & (n_num == 0), F.lit("numeric_column")),
        F.when(it.isin(ONE_CATEGORICAL) & (n_cat == 0), F.lit("categorical_column")),
        F.when(it.isin(MODELLING) & F.col("target").isNull(), F.lit("target_column")),
        F.when(it.isin(MODELLING) & (F.size("predictors") == 0), F.lit("predictor_columns"))))
    return routed.withColumn("missing_roles", roles)


def answer_topics(turns: DataFrame, conv: str, turn: str, text: str, context: int = 4) -> DataFrame:
    """Answer topic per turn from the previous ``context`` turns plus the
    turn itself (bounded window per conversation)."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(-context, -1)
    ctx = F.array_join(F.collect_list(F.lower(F.col(text))).over(w), " ")
    combined = F.concat(F.coalesce(ctx, F.lit("")), F.lit(" "), F.lower(F.col(text)))
    out = None
    for topic, words in TOPIC_RULES:
        cond = _any(F.col("_c"), words)
        out = F.when(cond, topic) if out is None else out.when(cond, topic)
    return turns.withColumn("_c", combined).withColumn("topic", out.otherwise(TOPIC_DEFAULT)).drop("_c")


def extract_code(text: Column) -> Column:
    """First fenced code block, trimmed; null when absent or empty."""
    m = F.regexp_extract(text, CODE_BLOCK, 1)
    has = text.rlike(CODE_BLOCK)
    return F.when(has & (F.trim(m) != ""), F.trim(m))


def strip_code(text: Column) -> Column:
    """Remove fenced code blocks."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), CODE_BLOCK, ""))


def sanitize_code(code: Column) -> Column:
    """Drop import, file-I/O and ``plt.show()`` lines; ensure tight_layout."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), IMPORT_LINE, ""), FILE_IO_LINE, "")
    c = F.regexp_replace(c, SHOW_LINE, "")
    c = F.when(c.contains("plt.tight_layout"), c).otherwise(F.concat(c, F.lit("\n\nplt.tight_layout()")))
    return F.trim(c)
