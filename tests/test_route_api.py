"""Golden table: the reference README's example questions (N1-N5) and the API."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import route as R
from quarry.plans import api

STUDENT = ("school string, sex string, address string, age int, Medu int, Fedu int, Mjob string, Fjob string, "
           "studytime int, failures int, absences int, G1 int, G2 int, G3 int")

GOLDEN = [
    ("Show me a correlation heatmap", "correlation_heatmap", None, [], None, []),
    ("Make a scatter plot of G2 vs G3", "scatter_plot", None, ["G2", "G3"], "G2", ["G3"]),
    ("Run Pearson correlation between G2 and G3", "correlation", "Pearson", ["G2", "G3"], "G2", ["G3"]),
    ("Run Spearman correlation between absences and G3", "correlation", "Spearman", ["absences", "G3"], "absences",
     ["G3"]),
    ("Show histogram of failures", "histogram", None, ["failures"], "failures", []),
    ("Show boxplot of G3 by school", "boxplot", None, ["G3", "school"], "G3", ["school"]),
    ("Run ANOVA for G3 by school", "anova", None, ["G3", "school"], "G3", ["school"]),
    ("Run chi-square test between Fjob and Mjob", "chi_square_test", None, ["Fjob", "Mjob"], "Fjob", ["Mjob"]),
    ("Build a regression model to predict G3 using G1, G2, studytime, failures, absences", "linear_regression", None,
     ["G3", "G1", "G2", "studytime", "failures", "absences"], "G3", ["G1", "G2", "studytime", "failures", "absences"]),
    ("Which features are most important for predicting G3?", "feature_importance", None, ["G3"], "G3", []),
    ("Find outliers in absences", "outlier_detection", None, ["absences"], "absences", []),
    ("What should I explore next?", "recommended_analysis", None, [], None, []),
]


@pytest.fixture(scope="module")
def student(spark):
    rows = [("GP", "F", "U", 18, 4, 4, "at_home", "teacher", 2, 0, 6, 5, 6, 6),
            ("GP", "F", "U", 17, 1, 1, "at_home", "other", 2, 0, 4, 5, 5, 6),
            ("MS", "M", "R", 15, 1, 1, "other", "other", 2, 3, 10, 7, 8, 10),
            ("MS", "F", "U", 15, 4, 2, "health", "services", 3, 0, 2, 15, 14, 15),
            ("GP", "M", "U", 16, 3, 3, "other", "other", 2, 0, 4, 6, 10, 10)]
    return spark.createDataFrame(rows, STUDENT)


def test_readme_questions_route_as_expected(spark, student):
    q = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, question string")
    out = {r["id"]: r for r in api.route_questions(q, "id", "question", student).collect()}
    for i, (_, intent, method, cols, target, preds) in enumerate(GOLDEN):
        r = out[i]
        assert (r["intent"], r["method"], list(r["columns"]), r["target"], list(r["predictors"])) == \
            (intent, method, cols, target, preds)


def test_substring_traps_are_kept(spark):
    df = spark.createDataFrame([("which machine is best",), ("draw a boxing chart",), ("a line or area",)], "t string")
    got = [r[0] for r in df.select(R.classify_intent(F.col("t"))["intent"]).collect()]
    assert got == ["chi_square_test", "boxplot", "line_plot"]


def test_analyse_dispatch(spark, student):
    assert api.analyse(student, "anova", ["G3", "school"]).first()["valid"] is True
    assert api.analyse(student, "missing_values").count() == 14
    assert api.stat_test(student, "kruskal", "G3", "school").first()["test"] == "kruskal"
    assert api.chart_data(student, "count", "school").count() == 2


def test_unsupported_format_and_unknown_dataset(spark, sf_dir):
    from quarry.sources import io as S
    with pytest.raises(ValueError):
        S.read_table(spark, "/nowhere/table.xlsx")
    with pytest.raises(KeyError):
        S.get(spark, "no_such_dataset_registered")
    S.register(spark.read.parquet(f"{sf_dir}/region.parquet"), "quarry_region_test", persist=False)
    assert S.get(spark, "quarry_region_test").count() == 5


def test_every_routed_topic_has_an_answer():
    from quarry.operators import findings as R
    from quarry.operators import route
    assert {t for t, _ in route.TOPIC_RULES} | {route.TOPIC_DEFAULT} == set(R.ANSWERS)


def test_answers_to_topics(spark):
    import pytest
    from quarry.operators import findings as R
    rows = [(i, float(i % 10), float(i % 10) * 2 + (i % 3), "a" if i % 10 else "b", None if i % 4 else 1.0, "same") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string, m double, k string")
    got = {}
    for r in R.topic_answers(df).collect():
        got.setdefault(r.topic, []).append((r.code, r.subject, r.other))
    assert ("missing", "m", None) in got["missing"] and ("low_variance", "k", None) in got["anomaly"] and ("multicollinear", "x", "y") in got["anomaly"]
    assert got["correlation"][0][:1] == ("pair",) and ("frequency", "g", "a") in got["categorical_frequencies"]
    with pytest.raises(ValueError, match="Unknown topics"):
        R.topic_answer(df, "charts")
