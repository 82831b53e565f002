"""Public API (the reference's entry points, re-expressed on DataFrames).

    read_table / clean / column_roles      load, clean with audit, roles
    register / get / profile               dataset registry and profile tables
    stat_test / chart_data / fit_model     request types of the HTTP API
    analyse                                intent name -> DataFrame
    route_questions                        a table of questions -> routed rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.operators import assoc as A
from quarry.operators import charts as K
from quarry.operators import hypothesis as H
from quarry.operators import model as M
from quarry.operators import profile as P
from quarry.operators import quality as Q
from quarry.operators import route as R
from quarry.operators.clean import clean  # noqa: F401  (re-export)
from quarry.operators.roles import ColumnRoles, column_roles  # noqa: F401
from quarry.sources.io import get, read_table, register  # noqa: F401


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """Backend profile record as three tables: numeric, frequencies (top 20),
    correlation matrix (P21)."""
    roles = column_roles(df)
    return {"numeric": P.numeric_profile(df, roles.numeric),
            "frequencies": P.frequency_table(df, roles.categorical, top=20) if roles.categorical else None,
            "correlations": A.corr_matrix(df, roles.numeric) if len(roles.numeric) >= 2 else None}


TESTS = {
    "pearson": lambda df, x, y: A.pearson_test(df, x, y),
    "spearman": lambda df, x, y: A.spearman_test(df, x, y),
    "chi_square": lambda df, x, y: A.chi_square(df, x, y),
    "t_test": lambda df, x, y: H.welch_t_test(df, x, y),
    "anova": lambda df, x, y: H.anova(df, x, y),
    "mann_whitney": lambda df, x, y: H.mann_whitney(df, x, y),
    "kruskal": lambda df, x, y: H.kruskal(df, x, y),
}


def stat_test(df: DataFrame, test: str, x: str, y: str) -> DataFrame:
    """The seven tests of the API: x/y are (value, group) for grouped tests."""
    if test not in TESTS:
        raise ValueError(f"Unknown test {test!r}; choose one of {sorted(TESTS)}")
    return TESTS[test](df, x, y)


def chart_data(df: DataFrame, chart: str, x: str | None = None, y: str | None = None, color: str | None = None,
               agg: str = "mean") -> DataFrame:
    """Chart-data tables by chart name."""
    table = {
        "histogram": lambda: K.histogram(df, x, 40, color),
        "kde": lambda: K.kde(df, x, color),
        "box": lambda: K.box_stats(df, y or x, x if y else color),
        "violin": lambda: K.violin(df, y or x, x if y else color),
        "scatter": lambda: K.scatter(df, x, y, color),
        "joint": lambda: K.scatter(df, x, y, color),
        "hexbin": lambda: K.scatter(df, x, y, color),
        "regression": lambda: K.regression_lines(df, x, y, color),
        "heatmap": lambda: K.heatmap(df),
        "bar": lambda: K.bar(df, x, y, agg, color),
        "count": lambda: K.count_plot(df, x, color),
        "stacked": lambda: K.count_plot(df, x, color),
        "pie": lambda: K.pie(df, x),
        "line": lambda: K.line(df, x, y),
        "area": lambda: K.line(df, x, y),
        "scatter_matrix": lambda: K.scatter_matrix(df),
        "scatter_3d": lambda: K.scatter_3d(df, x, y, color),
        "geo": lambda: K.geo_points(df, x, y, color),
        "missing_heatmap": lambda: K.missing_heatmap(df),
        "over_time": lambda: K.over_time(df, x, "month", y),
    }
    if chart not in table:
        raise ValueError(f"Unknown chart {chart!r}")
    return table[chart]()


def fit_model(df: DataFrame, target: str, features: list[str], kind: str = "random_forest", **kw) -> M.Fit:
    return M.fit_model(df, target, features, kind, **kw)


def _pick(columns: list[str], pool: list[str], n: int) -> list[str]:
    got = [c for c in columns if c in pool]
    return (got + [c for c in pool if c not in got])[:n]


def analyse(df: DataFrame, intent: str, columns: list[str] | None = None, target: str | None = None,
            predictors: list[str] | None = None, method: str | None = None) -> DataFrame:
    """Run the analysis an intent names (the reference's 34 analyses); the
    first numeric / categorical columns (by name) fill unspecified roles."""
    roles = column_roles(df)
    cols = columns or []
    cats = sorted(set(roles.categorical + roles.binary))
    num = _pick(cols, roles.numeric, 3)
    cat = _pick(cols, cats, 2)
    x = num[0] if num else None
    y = num[1] if len(num) > 1 else None
    g = cat[0] if cat else None
    table = {
        "summary": lambda: P.dataset_summary(df),
        "descriptive_statistics": lambda: P.describe(df, roles.numeric),
        "correlation": lambda: (A.spearman_test(df, x, y) if method == "Spearman" else A.pearson_test(df, x, y))
        if x and y else A.ranked_pairs(df, roles.numeric),
        "correlation_heatmap": lambda: A.corr_matrix(df, roles.numeric),
        "scatter_plot": lambda: K.scatter(df, x, y, g),
        "regression_plot": lambda: K.regression_lines(df, x, y, g),
        "histogram": lambda: K.histogram(df, x, 10, None),
        "kde_plot": lambda: K.kde(df, x, g),
        "boxplot": lambda: K.box_stats(df, x, g),
        "violin_plot": lambda: K.violin(df, x, g),
        "bar_chart": lambda: K.bar(df, g, x, "mean"),
        "count_plot": lambda: K.count_plot(df, g),
        "grouped_bar_chart": lambda: K.bar(df, g, x, "mean", cat[1] if len(cat) > 1 else None),
        "line_plot": lambda: K.line(df, x, y),
        "pie_chart": lambda: K.pie(df, g, top=30),
        "stacked_bar_chart": lambda: K.count_plot(df, cat[0], cat[1] if len(cat) > 1 else None),
        "area_chart": lambda: K.line(df, x, y),
        "scatter_matrix": lambda: K.scatter_matrix(df),
        "scatter_3d": lambda: K.scatter_3d(df, *num[:3]),
        "cross_tabulation": lambda: A.crosstab(df, cat[0], cat[1]),
        "chi_square_test": lambda: A.chi_square(df, cat[0], cat[1]),
        "t_test": lambda: H.welch_t_test(df, x, g),
        "anova": lambda: H.anova(df, x, g),
        "mann_whitney": lambda: H.mann_whitney(df, x, g),
        "kruskal_wallis": lambda: H.kruskal(df, x, g),
        "linear_regression": lambda: M.ols(df, target or x, predictors or [c for c in roles.numeric
                                                                            if c != (target or x)])[0],
        "logistic_regression": lambda: M.fit_model(df, target, predictors or M.auto_predictors(df, target),
                                                   "logistic", min_rows=12).metrics,
        "random_forest": lambda: M.fit_model(df, target, predictors or M.auto_predictors(df, target),
                                             "random_forest", min_rows=12).metrics,
        "decision_tree": lambda: M.fit_model(df, target, predictors or M.auto_predictors(df, target),
                                             "decision_tree", min_rows=12).metrics,
        "feature_importance": lambda: M.fit_model(df, target, predictors or M.auto_predictors(df, target),
                                                  "random_forest", min_rows=12).importance,
        "missing_values": lambda: P.missing_report(df),
        "outlier_detection": lambda: Q.outlier_report(P.numeric_profile(df, [x] if x else roles.numeric)),
        "data_quality": lambda: Q.quality_bundle(df),
        "recommended_analysis": lambda: __import__("quarry.operators.findings", fromlist=["x"]).chart_recommendations(df),
    }
    if intent not in table:
        return P.dataset_summary(df)
    return table[intent]()


def route_questions(questions: DataFrame, id_col: str, text_col: str, df: DataFrame) -> DataFrame:
    """Routed rows (intent, confidence, method, columns, target, predictors,
    missing roles) for a table of questions about ``df``."""
    roles = column_roles(df)
    routed = R.route(questions, id_col, text_col, df.columns)
    return R.missing_roles(routed, roles.numeric, sorted(set(roles.categorical + roles.binary)))
