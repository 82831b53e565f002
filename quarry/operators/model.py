"""Modelling (M1-M30) on Spark ML, with exact splits and metrics as SQL-checkable
aggregations.

* Splits order rows by ``xxhash64(key, seed)``; the cut point (the k-th
  smallest hash, k = ceil(n * test_size)) comes from the ties-collapsed rank
  engine, so the test set has exactly k rows without a global sort, also where
  keys repeat (the one block of equal hashes at the cut is counted off).
* Imputation medians, modes and scaling moments are fitted on the training
  rows only, by aggregates; the fitted values are one row per feature.
* Metrics, confusion matrices, reports and ROC curves are group-bys over
  the prediction table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import dist
from quarry.operators import forest, leastsq, neighbors, ranks, screen
from quarry.operators.quality import ID_KEYWORDS, LEAKAGE_KEYWORDS, _any_sub
from quarry.operators.roles import distinct_counts, kind_of, missing_expr

SEED = 42
MAX_CLASSES = 1000
MAX_DEPTH = 30  # the deepest that Spark ML allows
SPREAD_LEAST, SPREAD_MOST = 1_000, 100_000  # rows of a task that fits or applies a model
FOREST_ROWS = 50_000  # training rows from which a regression forest is grown from sums (Spark ML holds two numbers a row and tree, and reads all at each level)


# ---- M11/M12 split ---------------------------------------------------------------------------

def split(df: DataFrame, key: list[str], test_size: float = 0.25, seed: int = SEED,
          stratify: str | None = None) -> DataFrame:
    """Add ``is_test``: exactly ceil(n * test_size) rows (per class when
    stratified, rounded half up) with the smallest ``xxhash64(key, seed)``."""
    h = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in key], F.lit(seed))) \
        .withColumn("_k", F.col(stratify).cast("string") if stratify else F.lit(""))
    cum = ranks.cumulative_counts(h.groupBy("_k", "_h").agg(F.count(F.lit(1)).alias("n")), ["_k"], value="_h")
    k = F.ceil(F.col("total") * test_size) if not stratify else F.floor(F.col("total") * test_size + 0.5)
    # the hash that holds position k of its class, and how many of its rows are still test rows
    cut = (cum.withColumn("_left", k - F.col("cum_before")).filter((F.col("_left") > 0) & (F.col("_left") <= F.col("n")))
           .select(F.col("_k").alias("_ck"), F.col("_h").alias("_cut"), "_left", F.col("n").alias("_block"))).checkpoint()
    out = h.join(cut, F.col("_k").eqNullSafe(F.col("_ck")), "left")
    whole = out.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False)))
    if cut.filter("_left < _block").isEmpty():
        return whole.select(*df.columns, "is_test")
    # a block of equal hashes (repeated keys) that is cut within: its rows are counted off one by one
    part = F.coalesce((F.col("_h") == F.col("_cut")) & (F.col("_left") < F.col("_block")), F.lit(False))
    tied = ranks.row_positions(out.filter(part).withColumn("_all", F.xxhash64(*df.columns)), ["_k"], ["_all"], "_at")
    return (whole.filter(~part).select(*df.columns, "is_test")
            .unionByName(tied.select(*df.columns, (F.col("_at") < F.col("_left")).alias("is_test"))))


def fold_ids(df: DataFrame, key: list[str], folds: int = 5, seed: int = SEED) -> DataFrame:
    """Folds whose sizes differ by one at most: the position by key hash, modulo ``folds``."""
    h = df.withColumn("_k", F.lit(0)).withColumn("_h", F.xxhash64(*[F.col(c) for c in key], F.lit(seed)))
    at = ranks.row_positions(h, ["_k"], ["_h"], "_at")
    return at.withColumn("fold", F.pmod(F.col("_at"), F.lit(folds))).select(*df.columns, "fold")


# ---- preprocessing (M6-M10) ------------------------------------------------------------------

@dataclass
class Prepared:
    data: DataFrame
    features: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    levels: list[int] = field(default_factory=list)  # of each categorical column


def prepare(train: DataFrame, data: DataFrame, predictors: list[str], scale: bool = False,
            drop_first: bool = False) -> Prepared:
    """Median (numeric) / mode (categorical) imputation and optional
    population-std scaling, fitted on ``train``; one-hot encoding with
    unknown levels -> all zeros (``drop_first``: dummy coding without the
    alphabetically first level).  Adds a ``features`` vector column."""
    kinds = {f.name: kind_of(f.dataType) for f in data.schema.fields}
    num = [c for c in predictors if kinds[c] == "numeric"]
    cat = [c for c in predictors if kinds[c] in ("categorical", "boolean")]
    out = data
    if num:
        counts = ranks.value_counts(train, num)
        med = ranks.exact_quantiles(ranks.cumulative_counts(counts, ["column"]), ["column"], [0.5], names=["m"])
        meds = {r["column"]: r["m"] for r in med.collect()}  # one row per feature
        # NaN counts as missing, as in the medians
        full = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(meds.get(c, 0.0))) for c in num}
        stats = train.agg(*[F.avg(full[c]).alias(f"a{i}") for i, c in enumerate(num)],
                          *[F.stddev_pop(full[c]).alias(f"s{i}") for i, c in enumerate(num)]).first()
        for i, c in enumerate(num):
            x = full[c]
            if scale:  # moments of the imputed training column
                x = (x - F.lit(stats[f"a{i}"] or 0.0)) / F.lit(stats[f"s{i}"] or 1.0)
            out = out.withColumn(c, x)
    stages, names = [], list(num)
    if cat:
        modes = (train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                                  for c in cat])).alias("p")).select("p.*")
                 .filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("v").alias("v")))["v"]
                                        .alias("mode")))
        mode = {r["column"]: r["mode"] for r in modes.collect()}  # one row per feature
        for c in cat:
            out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(mode.get(c, "Missing"))))
        # keep: unknown levels get their own slot, which dropLast removes (all
        # levels kept, unknown -> zeros).  Dummy coding: descending order and
        # dropLast removes the alphabetically first level.
        order = "alphabetDesc" if drop_first else "alphabetAsc"
        invalid = "error" if drop_first else "keep"
        for c in cat:
            stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__idx", stringOrderType=order,
                                        handleInvalid=invalid))
        stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__oh" for c in cat],
                                    dropLast=True, handleInvalid=invalid))
        names += [f"{c}__oh" for c in cat]
    stages.append(VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(_restrict(out))
    prepared = model.transform(out)
    levels = {st.getInputCol(): len(st.labels) for st in model.stages if hasattr(st, "labels")}
    return Prepared(prepared, feature_names(model, num, cat, drop_first), num, cat, [levels[c] for c in cat])


def _restrict(out: DataFrame) -> DataFrame:
    """Training rows of the transformed frame (split flag carried along)."""
    return out.filter(F.col("is_test") == False) if "is_test" in out.columns else out  # noqa: E712


def feature_names(model, num: list[str], cat: list[str], drop_first: bool = False) -> list[str]:
    """Names after encoding (numeric names, then ``col=level`` per kept level)."""
    names = list(num)
    for st in model.stages:
        if hasattr(st, "labels") and hasattr(st, "getInputCol") and st.getInputCol() in cat:
            labels = list(st.labels)[:-1] if drop_first else list(st.labels)
            names += [f"{st.getInputCol()}={lv}" for lv in labels]
    return names


# ---- estimators ------------------------------------------------------------------------------

REGRESSORS = ("linear", "random_forest", "decision_tree", "knn")
CLASSIFIERS = ("logistic", "random_forest", "decision_tree", "knn", "svm")
NEIGHBOURS = 5


def _estimator(kind: str, task: str, n_train: int, n_classes: int = 2, trees: int = 200):
    if task == "regression":
        return {"linear": LinearRegression(solver="normal", regParam=0.0),
                "random_forest": RandomForestRegressor(numTrees=trees, featureSubsetStrategy="all", seed=SEED,
                                                       maxDepth=MAX_DEPTH, cacheNodeIds=True),
                "decision_tree": DecisionTreeRegressor(seed=SEED, maxDepth=MAX_DEPTH)}[kind]
    if kind == "logistic":
        return LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False,
                                  maxIter=200)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", seed=SEED, maxDepth=MAX_DEPTH,
                                      cacheNodeIds=True)
    if kind == "decision_tree":
        return DecisionTreeClassifier(seed=SEED, maxDepth=MAX_DEPTH)
    svc = LinearSVC(regParam=1.0 / max(n_train, 1), maxIter=100)
    return svc if n_classes <= 2 else OneVsRest(classifier=svc)


def _spread(rows: DataFrame, n: int, most: int = SPREAD_MOST) -> DataFrame:
    """``n`` rows over the cluster's cores.  Their few bytes would be read by one task, but a row is worked on by every tree and
    level; small tables stay whole."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // most)
    return rows.repartition(max(1, min(parts, n // SPREAD_LEAST)))


def problem_type(df: DataFrame, target: str) -> str:
    """Numeric with more than 10 distinct values -> regression."""
    if kind_of(df.schema[target].dataType) == "numeric":
        d = df.agg(F.count_distinct(target)).first()[0]
        return "regression" if d > 10 else "classification"
    return "classification"


def auto_predictors(df: DataFrame, target: str, limit: int | None = None, max_levels: int = 30) -> list[str]:
    """Numeric columns and text columns with at most ``max_levels`` levels, in schema order (the first ``limit``, if given)."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields if f.name != target}
    text = [c for c, k in kinds.items() if k in ("categorical", "boolean")]  # numeric columns qualify regardless
    levels = distinct_counts(df, text).first().asDict() if text else {}
    return [c for c, k in kinds.items() if k == "numeric" or (c in levels and levels[c] <= max_levels)][:limit]


@dataclass
class Fit:
    task: str
    kind: str
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame
    model: object = None
    valid: bool = True
    message: str = ""


def fit_model(df: DataFrame, target: str, predictors: list[str], kind: str = "random_forest",
              task: str | None = None, test_size: float = 0.25, key: list[str] | None = None,
              seed: int = SEED, trees: int = 200, min_rows: int = 10) -> Fit:
    """Validity checks, split, preprocessing, fit, predictions, metrics
    and importances.  Rows with a missing target are dropped first (C13); ``min_rows`` must be left (12 for routed questions)."""
    spark = df.sparkSession
    if target in predictors:
        raise ValueError("The target cannot also be a predictor.")
    data = df.select(*predictors, target, *[k for k in (key or []) if k not in predictors and k != target]) \
        .na.drop(subset=[target])
    task = task or problem_type(data, target)
    n = data.count()
    if n < min_rows:
        raise ValueError(f"At least {min_rows} rows with a non-missing target are needed.")
    key = key or data.columns
    if task == "classification":
        data = data.withColumn(target, F.col(target).cast("string"))
        n_levels = data.agg(F.count_distinct(target)).first()[0]
        if n_levels > MAX_CLASSES:  # labels are read to the driver below: keep them bounded
            raise ValueError(f"{n_levels} classes; classification supports at most {MAX_CLASSES}.")
        levels = [r[0] for r in data.select(target).distinct().orderBy(target).collect()]  # <= MAX_CLASSES
        if len(levels) < 2:
            raise ValueError("Classification needs at least two classes.")
        min_class = data.groupBy(target).count().agg(F.min("count")).first()[0]
        data = split(data, key, test_size, seed, stratify=target if min_class >= 2 else None)
        data = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc") \
            .fit(data).transform(data)
    else:
        levels = []
        data = split(data, key, test_size, seed).withColumn("label", F.col(target).cast("double"))
    train = data.filter(~F.col("is_test"))
    n_train = train.count()
    scale = kind in ("linear", "logistic", "knn", "svm")
    prep = prepare(train, data, predictors, scale=scale)
    if kind == "knn":
        return _knn(prep, data, target, task, key, levels)
    model = None
    inputs, coded = ["features"], [*prep.numeric, *(f"{c}__idx" for c in prep.categorical)]
    if kind == "random_forest" and task == "regression" and n_train >= FOREST_ROWS:
        model = forest.fit(_spread(prep.data.filter(~F.col("is_test")).select(*coded, "label"), n_train, forest.TASK_ROWS),
                           prep.numeric, coded[len(prep.numeric):], prep.levels, trees, MAX_DEPTH, SEED)
        inputs = coded if model is not None else inputs
    if model is None:
        est = _estimator(kind, task, n_train, len(levels), trees)
        model = est.setFeaturesCol("features").setLabelCol("label").fit(_spread(prep.data.filter(~F.col("is_test")).select("features", "label"), n_train))
    pred = model.transform(_spread(prep.data.filter(F.col("is_test")).select(*inputs, *dict.fromkeys(["label", target])), n - n_train))
    if task == "classification":
        lv = F.array(*[F.lit(x) for x in levels])
        pred = pred.select(F.col(target).alias("actual"), F.element_at(lv, F.col("prediction").cast("int") + 1)
                           .alias("predicted"), *(["probability"] if "probability" in pred.columns else []))
        if "probability" in pred.columns and len(levels) == 2:
            pred = pred.withColumn("score", _vec_at(F.col("probability"), 1)).drop("probability")
        elif "probability" in pred.columns:
            pred = pred.drop("probability")
        pred = pred.checkpoint()  # read several times: the model answers once
        metrics = classification_metrics(pred)
    else:
        pred = pred.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted")) \
            .withColumn("residual", F.col("actual") - F.col("predicted")).checkpoint()
        metrics = regression_metrics(pred)
    imp = importance(model, prep.features, kind)
    return Fit(task, kind, pred, metrics.withColumn("model", F.lit(kind)), imp, model)


def _knn(prep: Prepared, data: DataFrame, target: str, task: str, key: list[str], levels: list[str]) -> Fit:
    """The exact nearest training rows of every test row; ties go by a hash of ``key``."""
    rows = prep.data.select(vector_to_array("features").alias("vec"), F.xxhash64(*key).alias("id"), "is_test",
                            F.col("label" if task == "regression" else target).alias("label"))
    binary = levels[1] if len(levels) == 2 else None
    pred = neighbors.predict(rows.where(~F.col("is_test")), rows.where("is_test").withColumnRenamed("label", "actual"), NEIGHBOURS, task, positive=binary)
    if task == "regression":
        pred = pred.select("actual", "predicted", (F.col("actual") - F.col("predicted")).alias("residual")).checkpoint()
        metrics = regression_metrics(pred)
    else:
        pred = pred.select("actual", "predicted", *(["score"] if binary is not None else [])).checkpoint()
        metrics = classification_metrics(pred)
    none = data.sparkSession.createDataFrame([], "feature string, importance double")
    return Fit(task, "knn", pred, metrics.withColumn("model", F.lit("knn")), none)


def _vec_at(v, i: int):
    return vector_to_array(v)[i]


def importance(model, names: list[str], kind: str) -> DataFrame:
    """Tree importances or |coefficient|, largest first."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    vals = []
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    rows = [(names[i] if i < len(names) else f"f{i}", float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(),
                                                                                    "feature")


# ---- M1-M4 OLS -------------------------------------------------------------------------------

def ols(df: DataFrame, target: str, predictors: list[str]) -> tuple[DataFrame, DataFrame]:
    """M1/M3/M4: OLS on complete cases with dummy coding (first level
    dropped): coefficient table (term, coefficient, std_error, t, p_value)
    and a one-row fit table (n, r2, adj_r2, aic, bic, residual_std).  Raises
    ``leastsq.Collinear``, which names the columns, for dependent predictors."""
    spark = df.sparkSession
    finite = [F.col(c) if kind_of(df.schema[c].dataType) != "numeric" else F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in (target, *predictors)]
    data = df.select(*finite).na.drop()
    k_min = max(10, len(predictors) + 3)
    size, low, high = data.agg(F.count(F.lit(1)), F.min(target), F.max(target)).first()
    if size < k_min:
        raise ValueError(f"Regression needs at least {k_min} complete rows.")
    if low == high:
        raise ValueError("The target is constant.")
    prep = prepare(data, data.withColumn("is_test", F.lit(False)).withColumn(target, F.col(target).cast("double")), predictors, drop_first=True)
    names = prep.features
    f = leastsq.factor(prep.data.select(F.concat(vector_to_array("features"), F.array(target)).alias("x")), names)
    dependent = f.dependent()
    if dependent:
        raise leastsq.Collinear(dependent, names)
    n, k = f.n, len(names) + 1
    y = f.r[:, -1]
    ssr, sst = float(y[-1] ** 2), float((y[1:] ** 2).sum())
    beta = np.linalg.solve(f.centred, y[1:-1])
    mean = f.r[0, 1:-1] / f.r[0, 0]
    s2, inv = ssr / (n - k), f.inverse()
    rows = [(x, float(beta[i]), math.sqrt(s2 * inv[i, i])) for i, x in enumerate(names)]
    rows.append(("const", float(y[0] / f.r[0, 0] - mean @ beta), math.sqrt(s2 * (1 / n + float(mean @ inv @ mean)))))
    coef = spark.createDataFrame(rows, "term string, coefficient double, std_error double")
    coef = coef.withColumn("t", F.try_divide("coefficient", "std_error")).withColumn("_dof", F.lit(float(n - k)))
    coef = coef.withColumn("p_value", dist.t_two_sided_p("t", "_dof")).drop("_dof")
    r2 = 1 - ssr / sst
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(max(ssr, 5e-324) / n) + 1)
    fit = spark.createDataFrame([(n, r2, 1 - (1 - r2) * (n - 1) / (n - k), -2 * llf + 2 * k, -2 * llf + math.log(n) * k, math.sqrt(s2))],
                                "n long, r2 double, adj_r2 double, aic double, bic double, residual_std double")
    return coef, fit


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """M2: slope, intercept, R^2 and the slope p-value, one aggregate."""
    base = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    one = base.agg(F.regr_count("y", "x").alias("n"), F.regr_slope("y", "x").alias("slope"),
                   F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
                   F.corr("x", "y").alias("r"))
    one = one.withColumn("_t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))) \
        .withColumn("_dof", F.col("n") - 2)
    return one.select(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col("n").cast("long").alias("n"), "slope",
                      "intercept", "r2", F.when(F.abs("r") >= 1, 0.0).otherwise(dist.t_two_sided_p("_t", "_dof"))
                      .alias("slope_p_value"))


# ---- metrics (M17-M21, M28) ------------------------------------------------------------------

def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R^2 of a prediction table, one aggregate."""
    e = F.col(actual) - F.col(predicted)
    one = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                   F.sum(e * e).alias("_sse"), F.var_pop(actual).alias("_var"))
    return one.select("n", "mae", "rmse",
                      (1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"))


def confusion(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts for every (actual, predicted) label pair, zero cells kept
    (labels x labels cells: the size of the matrix)."""
    p = pred.select(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted"))
    labels = p.select(F.col("actual").alias("l")).union(p.select(F.col("predicted").alias("l"))).distinct()
    grid = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))
    counts = p.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("long"))


def classification_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1, support per class (zero division -> 0),
    plus macro and weighted averages."""
    cm = confusion(pred, actual, predicted)
    tp = cm.filter(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("label"),
                                                                  F.col("count").alias("tp"))
    sup = cm.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"))
    prd = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("predicted_n"))
    per = (tp.join(sup, "label").join(prd, "label")
           .withColumn("precision", F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0))
           .withColumn("recall", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
           .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                    2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                       .otherwise(0.0))
           .select("label", "precision", "recall", "f1", F.col("support").cast("long").alias("support")))
    tot = per.agg(F.sum("support").alias("_t"))
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("long").alias("support")).withColumn("label", F.lit("macro avg"))
    weighted = per.crossJoin(tot).agg(
        (F.sum(F.col("precision") * F.col("support")) / F.first("_t")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.first("_t")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.first("_t")).alias("f1"),
        F.sum("support").cast("long").alias("support")).withColumn("label", F.lit("weighted avg"))
    return per.unionByName(macro).unionByName(weighted)


def classification_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy and weighted precision / recall / F1."""
    rep = classification_report(pred, actual, predicted).filter(F.col("label") == "weighted avg")
    acc = pred.agg(F.avg((F.col(actual).cast("string") == F.col(predicted).cast("string")).cast("double"))
                   .alias("accuracy"), F.count(F.lit(1)).alias("n"))
    return acc.crossJoin(rep.select(F.col("precision").alias("precision_weighted"),
                                    F.col("recall").alias("recall_weighted"), F.col("f1").alias("f1_weighted")))


def _scored(pred: DataFrame, actual: str, score: str) -> DataFrame:
    return pred.where(F.col(actual).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def roc(pred: DataFrame, actual: str = "actual", score: str = "score", positive="1") -> DataFrame:
    """ROC points at every distinct score (descending), from cumulative
    counts of the ties-collapsed score table, plus the (0, 0) start.  Rows without a score or a label are left out."""
    p = _scored(pred, actual, score).select((F.col(actual).cast("string") == str(positive)).cast("int").alias("y"),
                    (-F.col(score).cast("double")).alias("neg_score"))
    per = p.groupBy("neg_score").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")) \
        .withColumn("_k", F.lit(0))
    cum_n = ranks.cumulative_counts(per, ["_k"], value="neg_score")
    w = ranks.cumulative_counts(per.select("_k", "neg_score", F.col("pos").alias("n")), ["_k"], value="neg_score") \
        .select("neg_score", F.col("cum_before").alias("pos_before"), F.col("total").alias("_pos_total"))
    j = cum_n.join(w, "neg_score").withColumn("_neg_total", F.col("total") - F.col("_pos_total"))
    pts = j.select((-F.col("neg_score")).alias("threshold"),
                   F.try_divide((F.col("cum_before") + F.col("n")) - (F.col("pos_before") + F.col("pos")),
                                F.col("_neg_total")).alias("fpr"),
                   F.try_divide(F.col("pos_before") + F.col("pos"), F.col("_pos_total")).alias("tpr"))
    start = pred.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(pts)


def auc(pred: DataFrame, actual: str = "actual", score: str = "score", positive="1") -> DataFrame:
    """ROC AUC = U / (n1 n0) from the average-rank sum of positives.  Rows without a score or a label are left out."""
    p = _scored(pred, actual, score).select((F.col(actual).cast("string") == str(positive)).cast("int").alias("y"),
                    F.col(score).cast("double").alias("s"))
    per = p.groupBy("s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    cum = ranks.cumulative_counts(per, ["_k"], value="s")
    one = cum.agg(F.sum(F.col("pos") * ranks.average_rank(cum)).alias("r1"), F.sum("pos").alias("n1"),
                  F.sum(F.col("n") - F.col("pos")).alias("n0"))
    return one.select(F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2,
                                   F.col("n1") * F.col("n0")).alias("roc_auc"),
                      F.col("n1").cast("long").alias("positives"), F.col("n0").cast("long").alias("negatives"))


def prediction_summary(pred: DataFrame) -> DataFrame:
    """Residual summary of a regression prediction table."""
    from quarry.operators.profile import describe
    return describe(pred.select("residual"), ["residual"])


def compare_models(df: DataFrame, target: str, predictors: list[str], task: str | None = None,
                   kinds: tuple[str, ...] | None = None, **kw) -> DataFrame:
    """Fit every estimator (failures become rows with an error), sort by
    RMSE (regression) or -F1 (classification)."""
    task = task or problem_type(df, target)
    kinds = kinds or (REGRESSORS if task == "regression" else CLASSIFIERS)
    rows = []
    for kind in kinds:
        try:
            fit = fit_model(df, target, predictors, kind, task, **kw)
            rows.append(fit.metrics.withColumn("error", F.lit(None).cast("string")))
        except Exception as exc:  # noqa: BLE001 (a failing estimator is reported, not raised)
            rows.append(df.sparkSession.createDataFrame([(kind, str(exc)[:200])], "model string, error string"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    order = F.col("rmse").asc_nulls_last() if task == "regression" else F.col("f1_weighted").desc_nulls_last()
    return out.orderBy(order, "model")


def cross_validate(df: DataFrame, target: str, predictors: list[str], kind: str = "linear",
                   folds: int = 5, key: list[str] | None = None, fold: str | None = None) -> DataFrame:
    """K-fold scores (R^2 or accuracy) per fold.  ``fold`` names a column that has the folds (0 to ``folds`` - 1).

    A linear model of complete predictors takes one pass: every fold's triangular factor (``leastsq``), from which each
    fold is scored under the fit of the others.  Otherwise each fold has its own preprocessing and fit."""
    task = problem_type(df, target)
    data = df.na.drop(subset=[target])
    data = data.withColumn("fold", F.col(fold).cast("int")) if fold else fold_ids(data, key or df.columns, folds)
    if kind == "linear" and task == "regression":
        missing = reduce(lambda a, b: a | b, [missing_expr(data, c) for c in predictors])
        if data.where(missing).isEmpty():
            flat = data.withColumn("is_test", F.lit(False)).withColumn(target, F.col(target).cast("double"))
            prep = prepare(flat, flat, predictors)
            rows = prep.data.select(F.col("fold").alias("g"), F.concat(vector_to_array("features"), F.array(target)).alias("x"))
            width = rows.select(F.size("x")).first()  # slots for unknown levels included: they stay empty
            scores = leastsq.fold_scores(leastsq.group_factors(rows, width[0] + 1)) if width else {}
            return df.sparkSession.createDataFrame([(f, s) for f, (_, s) in sorted(scores.items())], "fold int, score double").select("score", "fold")
    out = []
    for f in range(folds):
        d = data.withColumn("is_test", F.col("fold") == f)
        train = d.filter(~F.col("is_test"))
        lab = d.withColumn("label", F.col(target).cast("double")) if task == "regression" else \
            StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc") \
            .fit(d.withColumn(target, F.col(target).cast("string"))) \
            .transform(d.withColumn(target, F.col(target).cast("string")))
        prep = prepare(train, lab, predictors, scale=kind in ("linear", "logistic", "svm"))
        m = _estimator(kind, task, train.count()).setFeaturesCol("features").setLabelCol("label") \
            .fit(prep.data.filter(~F.col("is_test")))
        pr = m.transform(prep.data.filter(F.col("is_test"))).select(F.col("label").alias("actual"),
                                                                     F.col("prediction").alias("predicted"))
        met = regression_metrics(pr).select(F.col("r2").alias("score")) if task == "regression" else \
            classification_metrics(pr).select(F.col("accuracy").alias("score"))
        out.append(met.withColumn("fold", F.lit(f)))
    return reduce(DataFrame.unionByName, out)


def validation_notes(metrics: DataFrame, predictors: list[str], vif: DataFrame | None = None) -> DataFrame:
    """Validation label (R^2 >= .7), ID / leakage-name predictors, high VIF."""
    spark = metrics.sparkSession
    names = spark.createDataFrame([(p,) for p in predictors], "feature string")
    low = F.lower(F.col("feature"))
    notes = names.select(F.when(_any_sub(low, ID_KEYWORDS), "identifier-like predictor")
                         .when(_any_sub(low, LEAKAGE_KEYWORDS), "possible leakage (outcome-like name)")
                         .alias("note"), "feature").filter(F.col("note").isNotNull())
    parts = [notes]
    if "r2" in metrics.columns:
        parts.append(metrics.select(F.when(F.col("r2") >= 0.7, "strong in-sample fit")
                                    .otherwise("limited explanatory power").alias("note"),
                                    F.lit(None).cast("string").alias("feature")))
    if vif is not None:
        parts.append(vif.filter(F.col("VIF") >= 10).select(F.lit("high VIF").alias("note"), "feature"))
    return reduce(DataFrame.unionByName, parts)


def risky_predictors(df: DataFrame, predictors: list[str]) -> DataFrame:
    """(feature, risk): the predictors that are among the table's possible IDs or outcome-like names, as intersections of name sets."""
    flags = screen.column_flags(df, near_constant=False)
    names = df.sparkSession.createDataFrame([(p,) for p in predictors], "feature string")
    sets = {"identifier": "possible_id", "leakage": "leakage_risk"}
    parts = [names.intersect(flags.where(flag).select(F.col("column").alias("feature"))).select("feature", F.lit(risk).alias("risk")) for risk, flag in sets.items()]
    return parts[0].unionByName(parts[1])


def model_summary(fit: Fit) -> DataFrame:
    """One sentence from the metrics and the top-3 features."""
    top = fit.importance.limit(3).agg(F.array_join(F.collect_list("feature"), ", ").alias("top"))
    m = fit.metrics
    if fit.task == "regression":
        txt = F.format_string("%s regression: R2=%.3f, RMSE=%.3f; strongest features: %s", F.col("model"),
                              F.col("r2"), F.col("rmse"), F.col("top"))
    else:
        txt = F.format_string("%s classifier: accuracy=%.3f, weighted F1=%.3f; strongest features: %s",
                              F.col("model"), F.col("accuracy"), F.col("f1_weighted"), F.col("top"))
    return m.crossJoin(top).select(txt.alias("summary"))

