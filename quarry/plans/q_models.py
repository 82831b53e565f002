"""Registered modelling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import assoc as A
from quarry.operators import leastsq
from quarry.operators import model as M
from quarry.operators import neighbors as NB
from quarry.plans import fixtures as FX
from quarry.plans import sqlgen as S
from quarry.plans.catalog import register, rounded, sql_rounded, table

P = ("p_value", "slope_p_value")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@register("model_simple_regression_lineitem", sql_rounded(f"""
    SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, n, slope, intercept, r2,
      CASE WHEN abs(r) >= 1 THEN 0.0 ELSE {S.t_two_sided_p('(r * sqrt((n - 2) / (1 - r * r)))', '(n - 2)')} END
        AS slope_p_value
    FROM (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
                 regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2,
                 corr(l_quantity, l_extendedprice) AS r FROM lineitem)""",
    ["slope", "intercept", "r2", "slope_p_value"], ["x", "y", "n"], P))
def _simple(spark, sf_dir):
    return rounded(M.simple_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), P)


_OLS1 = f"""
WITH s AS (SELECT count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx,
                  regr_sxx(y, x) AS sxx FROM (SELECT l_quantity::DOUBLE AS x, l_extendedprice AS y FROM lineitem
                  WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)),
e AS (SELECT sum(pow(l_extendedprice - (a + b * l_quantity), 2)) AS ssr FROM lineitem, s
      WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
t AS (SELECT 'l_quantity' AS term, b AS coefficient, sqrt(ssr / (n - 2) / sxx) AS std_error, n FROM s, e
      UNION ALL SELECT 'const', a, sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)), n FROM s, e)
SELECT term, coefficient, std_error, coefficient / std_error AS t,
  {S.t_two_sided_p('(coefficient / std_error)', '(n - 2)')} AS p_value FROM t"""


@register("model_ols_one_predictor_lineitem", sql_rounded(_OLS1, ["coefficient", "std_error", "t", "p_value"],
                                                          ["term"], P))
def _ols1(spark, sf_dir):
    coef, _ = M.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(coef, P)


@register("model_ols_fit_one_predictor_lineitem", sql_rounded(f"""
WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b,
                  regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2
           FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
e AS (SELECT sum(pow(l_extendedprice - (a + b * l_quantity), 2)) AS ssr FROM lineitem, s)
SELECT n, r2, 1 - (1 - r2) * (n - 1) / (n - 2) AS adj_r2,
  -2 * (-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1)) + 2 * 2 AS aic,
  -2 * (-n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1)) + ln(n) * 2 AS bic, sqrt(ssr / (n - 2)) AS residual_std
FROM s, e""", ["r2", "adj_r2", "aic", "bic", "residual_std"], ["n"]))
def _ols1_fit(spark, sf_dir):
    _, fit = M.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(fit)


@register("model_ols_multiple_lineitem")
def _ols_multi(spark, sf_dir):
    coef, _ = M.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice",
                    ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return coef


@register("model_regression_metrics_simple_fit", sql_rounded("""
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM lineitem),
p AS (SELECT l_extendedprice AS actual, a + b * l_quantity AS predicted FROM lineitem, s)
SELECT count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse,
  1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)) AS r2 FROM p""",
    ["mae", "rmse", "r2"], ["n"]))
def _reg_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    fit = M.simple_regression(li, "l_quantity", "l_extendedprice").select("slope", "intercept")
    pred = li.crossJoin(fit).select(F.col("l_extendedprice").alias("actual"),
                                    (F.col("intercept") + F.col("slope") * F.col("l_quantity")).alias("predicted"))
    return rounded(M.regression_metrics(pred))


PR = FX.PREDS_SQL


@register("model_confusion_preds", f"""
WITH p AS (SELECT actual::VARCHAR AS actual, predicted::VARCHAR AS predicted FROM {PR}),
l AS (SELECT actual AS l FROM p UNION SELECT predicted FROM p)
SELECT a.l AS actual, b.l AS predicted, count(p.actual) AS "count" FROM l a CROSS JOIN l b
LEFT JOIN p ON p.actual = a.l AND p.predicted = b.l GROUP BY 1, 2""")
def _confusion(spark, sf_dir):
    return M.confusion(FX.preds(spark, sf_dir))


_REPORT = f"""
WITH p AS (SELECT actual::VARCHAR AS actual, predicted::VARCHAR AS predicted FROM {PR}),
l AS (SELECT actual AS label FROM p UNION SELECT predicted FROM p),
per AS (SELECT label,
  (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS tp,
  (SELECT count(*) FROM p WHERE actual = label) AS support,
  (SELECT count(*) FROM p WHERE predicted = label) AS pn FROM l),
m AS (SELECT label, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support FROM per),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM m)
SELECT label, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f"""


@register("model_classification_report_preds", sql_rounded(_REPORT, ["precision", "recall", "f1"],
                                                           ["label", "support"]))
def _report(spark, sf_dir):
    return rounded(M.classification_report(FX.preds(spark, sf_dir)))


@register("model_classification_metrics_preds", sql_rounded(f"""
SELECT (SELECT avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) FROM {PR}) AS accuracy,
       (SELECT count(*) FROM {PR}) AS n, precision AS precision_weighted, recall AS recall_weighted,
       f1 AS f1_weighted FROM ({_REPORT}) WHERE label = 'weighted avg'""",
    ["accuracy", "precision_weighted", "recall_weighted", "f1_weighted"], ["n"]))
def _cls_metrics(spark, sf_dir):
    return rounded(M.classification_metrics(FX.preds(spark, sf_dir)))


@register("model_roc_preds", sql_rounded(f"""
WITH s AS (SELECT score, sum(actual) AS pos, count(*) AS n FROM {PR} GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS cnt,
             sum(pos) OVER () AS P, sum(n) OVER () AS total FROM s)
SELECT score AS threshold, (cnt - tp) / (total - P) AS fpr, tp / P AS tpr FROM c
UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0""", ["threshold", "fpr", "tpr"], []))
def _roc(spark, sf_dir):
    return rounded(M.roc(FX.preds(spark, sf_dir)))


# two predictors by their centred moments
_OLS2 = f"""
WITH m AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxx(y, z) AS szz, regr_sxx(x, y) AS syy,
                  regr_sxy(z, x) AS sxz, regr_sxy(y, x) AS sxy, regr_sxy(y, z) AS szy
           FROM (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE AS z, l_extendedprice::DOUBLE AS y FROM lineitem)),
b AS (SELECT *, sxx * szz - sxz * sxz AS d, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2 FROM m),
e AS (SELECT *, syy - b1 * sxy - b2 * szy AS ssr, (syy - b1 * sxy - b2 * szy) / (n - 3) AS s2 FROM b)"""


@register("model_ols_two_predictors_lineitem", sql_rounded(_OLS2 + f""",
t AS (SELECT 'l_quantity' AS term, b1 AS coefficient, sqrt(s2 * szz / d) AS std_error, n FROM e
      UNION ALL SELECT 'l_discount', b2, sqrt(s2 * sxx / d), n FROM e
      UNION ALL SELECT 'const', my - b1 * mx - b2 * mz, sqrt(s2 * (1.0 / n + (mx * mx * szz - 2 * mx * mz * sxz + mz * mz * sxx) / d)), n FROM e)
SELECT term, coefficient, std_error, coefficient / std_error AS t, {S.t_two_sided_p('(coefficient / std_error)', '(n - 3)')} AS p_value FROM t""",
    ["coefficient", "std_error", "t", "p_value"], ["term"], P))
def _ols2(spark, sf_dir):
    return rounded(M.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])[0], P)


@register("model_ols_fit_two_predictors_lineitem", sql_rounded(_OLS2 + """
SELECT n, 1 - ssr / syy AS r2, 1 - ssr / syy * (n - 1) / (n - 3) AS adj_r2,
  n * (ln(2 * pi()) + ln(ssr / n) + 1) + 2 * 3 AS aic, n * (ln(2 * pi()) + ln(ssr / n) + 1) + ln(n) * 3 AS bic, sqrt(s2) AS residual_std FROM e""",
    ["r2", "adj_r2", "aic", "bic", "residual_std"], ["n"]))
def _ols2_fit(spark, sf_dir):
    return rounded(M.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])[1])


@register("model_collinear_terms_orders", """SELECT feature FROM (VALUES ('cents', (SELECT corr(o_totalprice, o_totalprice * 100 + o_custkey) FROM orders)),
    ('fixed', (SELECT CASE WHEN min(1) = max(1) THEN 1.0 END FROM orders))) v(feature, r) WHERE r IS NOT NULL""")
def _collinear(spark, sf_dir):
    """The columns that the error names: a combination of two others and a constant."""
    o = table(spark, sf_dir, "orders").withColumn("cents", F.col("o_totalprice") * 100 + F.col("o_custkey")).withColumn("fixed", F.lit(1.0))
    try:
        M.ols(o, "o_orderkey", ["o_custkey", "o_totalprice", "cents", "fixed"])
        found = []
    except leastsq.Collinear as e:
        found = e.columns
    return spark.createDataFrame([(c,) for c in found], "feature string")


@register("model_auc_preds", sql_rounded(f"""
WITH r AS (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk
           FROM {PR})
SELECT (sum(rk) FILTER (WHERE actual = 1) - count(*) FILTER (WHERE actual = 1) * (count(*) FILTER (WHERE actual = 1) + 1) / 2.0)
       / (count(*) FILTER (WHERE actual = 1) * count(*) FILTER (WHERE actual = 0)) AS roc_auc,
       count(*) FILTER (WHERE actual = 1) AS positives, count(*) FILTER (WHERE actual = 0) AS negatives FROM r""",
    ["roc_auc"], ["positives", "negatives"]))
def _auc(spark, sf_dir):
    return rounded(M.auc(FX.preds(spark, sf_dir)))


@register("model_split_sizes_lineitem", """SELECT is_test, count AS n FROM (
    SELECT true AS is_test, ceil(count(*) * 0.25)::BIGINT AS count FROM lineitem
    UNION ALL SELECT false, count(*) - ceil(count(*) * 0.25)::BIGINT FROM lineitem)""")
def _split(spark, sf_dir):
    sp = M.split(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return sp.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@register("model_stratified_split_sizes_orders", """SELECT o_orderstatus, is_test, n FROM (
    SELECT o_orderstatus, true AS is_test, floor(count(*) * 0.25 + 0.5)::BIGINT AS n FROM orders GROUP BY 1
    UNION ALL SELECT o_orderstatus, false, count(*) - floor(count(*) * 0.25 + 0.5)::BIGINT FROM orders GROUP BY 1)
    WHERE n > 0""")
def _ssplit(spark, sf_dir):
    sp = M.split(table(spark, sf_dir, "orders"), ["o_orderkey"], stratify="o_orderstatus")
    return sp.groupBy("o_orderstatus", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("model_cv_folds_orders", """SELECT f::INTEGER AS fold, count(*) // 5 + CASE WHEN f < count(*) % 5 THEN 1 ELSE 0 END AS n
    FROM orders, range(5) t(f) GROUP BY f""")
def _folds(spark, sf_dir):
    """Folds differ by one row at most."""
    f = M.fold_ids(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return f.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count("*").alias("n"))


@register("model_auto_predictors_orders", """SELECT 'o_orderkey' AS feature UNION ALL SELECT 'o_custkey'
    UNION ALL SELECT 'o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) <= 30
    UNION ALL SELECT 'o_orderpriority' FROM orders HAVING count(DISTINCT o_orderpriority) <= 30""")
def _auto(spark, sf_dir):
    cols = M.auto_predictors(table(spark, sf_dir, "orders"), "o_totalprice")
    return spark.createDataFrame([(c,) for c in cols], "feature string")


@register("model_problem_type_orders", """SELECT 'o_totalprice' AS target,
    CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'regression' ELSE 'classification' END AS problem_type FROM orders
    UNION ALL SELECT 'o_orderstatus', 'classification'""")
def _ptype(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(t, M.problem_type(o, t)) for t in ("o_totalprice", "o_orderstatus")],
                                 "target string, problem_type string")


@register("model_logistic_documents")
def _logit(spark, sf_dir):
    fit = M.fit_model(_docs(spark, sf_dir), "quality", ["n_chars", "lang"], "logistic", key=["doc_id"])
    return fit.metrics


@register("model_logistic_roc_documents")
def _logit_roc(spark, sf_dir):
    fit = M.fit_model(_docs(spark, sf_dir), "quality", ["n_chars", "lang"], "logistic", key=["doc_id"])
    return M.roc(fit.predictions)


@register("model_random_forest_orders")
def _rf(spark, sf_dir):
    fit = M.fit_model(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey", "o_orderpriority",
                                                                        "o_orderstatus"], "random_forest",
                      key=["o_orderkey"])
    return fit.metrics.crossJoin(fit.importance.limit(1).select(F.col("feature").alias("top_feature")))


@register("model_decision_tree_classifier_orders")
def _dt(spark, sf_dir):
    fit = M.fit_model(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice", "o_orderpriority"],
                      "decision_tree", key=["o_orderkey"])
    return fit.metrics


@register("model_svm_documents")
def _svm(spark, sf_dir):
    fit = M.fit_model(_docs(spark, sf_dir), "quality", ["n_chars", "lang", "source"], "svm", key=["doc_id"])
    return fit.metrics


@register("model_compare_classifiers_documents")
def _cmp(spark, sf_dir):
    return M.compare_models(_docs(spark, sf_dir), "quality", ["n_chars", "lang"], key=["doc_id"])


@register("model_cross_validation_orders")
def _cv(spark, sf_dir):
    return M.cross_validate(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey", "o_orderpriority"],
                            "linear", key=["o_orderkey"])


@register("model_cross_validation_one_pass_orders", sql_rounded("""
WITH t AS (SELECT (o_orderkey % 5)::INTEGER AS f, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders),
m AS (SELECT k.f, regr_slope(t.y, t.x) AS b, regr_intercept(t.y, t.x) AS a FROM (SELECT DISTINCT f FROM t) k JOIN t ON t.f <> k.f GROUP BY k.f),
s AS (SELECT t.f, sum(pow(y - (a + b * x), 2)) AS sse FROM t JOIN m ON m.f = t.f GROUP BY t.f)
SELECT s.f AS fold, 1 - sse / (SELECT var_pop(y) * count(*) FROM t WHERE t.f = s.f) AS score FROM s""", ["score"], ["fold"]))
def _cv_one_pass(spark, sf_dir):
    """Every fold under the fit of the other four, from the folds' factors."""
    o = table(spark, sf_dir, "orders").withColumn("part", F.col("o_orderkey") % 5)
    return rounded(M.cross_validate(o, "o_totalprice", ["o_custkey"], "linear", fold="part"))


@register("model_residual_summary_orders")
def _resid(spark, sf_dir):
    fit = M.fit_model(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey", "o_orderpriority"], "linear",
                      key=["o_orderkey"])
    return M.prediction_summary(fit.predictions)


@register("model_validation_notes_lineitem")
def _notes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    preds = ["l_quantity", "l_discount", "l_tax", "l_orderkey"]
    _, fit = M.ols(li, "l_extendedprice", preds)
    return M.validation_notes(fit, preds, A.vif_table(li, preds))


@register("model_summary_orders")
def _msum(spark, sf_dir):
    fit = M.fit_model(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_totalprice", "o_orderpriority"],
                      "logistic", key=["o_orderkey"])
    return M.model_summary(fit)


def _knn_sql(table_: str, id_: str, xs: list[str], label: str, answer: str) -> str:
    """Every row against every other one: squares summed in the order of the columns, ties to the smaller id."""
    d2 = " + ".join(f"(a.x{i} - b.x{i}) * (a.x{i} - b.x{i})" for i in range(len(xs)))
    rows = ", ".join(f"({x})::DOUBLE AS x{i}" for i, x in enumerate(xs))
    return f"""WITH t AS (SELECT {id_} AS id, {label} AS label, {rows} FROM {table_}),
      n AS (SELECT a.id, unnest(min(ROW({d2}, b.id), 5)) AS near FROM t a JOIN t b ON a.id <> b.id GROUP BY a.id),
      v AS (SELECT n.id, t.label FROM n JOIN t ON t.id = struct_extract(near, 2))
      {answer}"""


@register("knn_regression_customer_balance", sql_rounded(_knn_sql(
    "customer", "c_custkey", ["c_custkey", "c_nationkey * 40"], "c_acctbal",
    "SELECT id, avg(label) AS predicted FROM v GROUP BY id"), ["predicted"], ["id"]))
def _knn_reg(spark, sf_dir):
    """Mean balance of every customer's five nearest others."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("label"), F.array(
        F.col("c_custkey").cast("double"), (F.col("c_nationkey") * 40).cast("double")).alias("vec"))
    return rounded(NB.predict(c, c.select("id", "vec"), skip_self=True).select("id", "predicted"))


@register("knn_classification_orders_status", _knn_sql(
    "orders", "o_orderkey", ["o_totalprice / 100", "o_custkey"], "o_orderstatus",
    "SELECT id, label AS predicted FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS r FROM v GROUP BY id, label) WHERE r = 1"))
def _knn_cls(spark, sf_dir):
    """Most frequent status among every order's five nearest others."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.array(
        F.col("o_totalprice") / 100, F.col("o_custkey").cast("double")).alias("vec"))
    return NB.predict(o, o.select("id", "vec"), task="classification", skip_self=True).select("id", "predicted")


@register("model_knn_regressor_orders")
def _knn_fit(spark, sf_dir):
    fit = M.fit_model(table(spark, sf_dir, "orders"), "o_totalprice", ["o_custkey", "o_orderpriority"], "knn", key=["o_orderkey"])
    return fit.metrics


@register("model_knn_classifier_documents")
def _knn_fit_docs(spark, sf_dir):
    fit = M.fit_model(_docs(spark, sf_dir), "quality", ["n_chars", "lang"], "knn", key=["doc_id"])
    return fit.metrics
