"""Regression, partial correlation and classification with folds of whole tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shape_rmse
from ..functions.distributions import student_sf2
from ..sources.scratch import stored
from .order import beside, quantiles, running_sums
from .ranking import avg_rank, global_avg_rank, pick_order


def ols_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and n of y on x."""
    return df.dropna(subset=[x, y]).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def ols_residual(df: DataFrame, y: str, x: str, by: Sequence[str], out: str = "residual") -> DataFrame:
    """y less its fit on x within groups."""
    fit = ols_fit(df, y, x, by).select(*by, F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    rows = df.join(fit, list(by)) if by else df.crossJoin(F.broadcast(fit))  # one row
    return rows.withColumn(out, F.col(y) - F.col("_slope") * F.col(x) - F.col("_intercept")).drop("_slope", "_intercept")


def _partial(ab: Column, ac: Column, bc: Column) -> Column:
    return (ab - ac * bc) / F.sqrt((1 - ac * ac) * (1 - bc * bc))


def partial_corr(df: DataFrame, x: str, y: str, z: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Pearson r of x and y, and r given z and z squared, in closed form from six correlations; null below ``least`` rows. df = n - 4."""
    rows = df.dropna(subset=[x, y, z]).withColumn("_w", F.col(z) * F.col(z))
    c = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"), F.corr(x, "_w").alias("xw"), F.corr(y, "_w").alias("yw"), F.corr(z, "_w").alias("zw"))
    k = F.col
    xy, xw, yw = _partial(k("xy"), k("xz"), k("yz")), _partial(k("xw"), k("xz"), k("zw")), _partial(k("yw"), k("yz"), k("zw"))
    return c.select(*by, "n", k("xy").alias("r"), F.when(k("n") >= least, _partial(xy, xw, yw)).alias("partial_r"), (k("n") - 4).alias("df"))


def structure_report(df: DataFrame, metrics: Sequence[str], y: str, z: str, width: float, least: int) -> DataFrame:
    """Per metric naive r, partial r given z and z squared, and the mean over bins of z of r within the bin."""
    out = None
    for m in metrics:
        p = partial_corr(df, m, y, z)
        bins = df.dropna(subset=[m, y, z]).groupBy(F.ceil(F.col(z) / width).alias("_b")).agg(F.count("*").alias("_n"), F.corr(m, y).alias("_r")).where(F.col("_n") >= least).agg(F.avg("_r").alias("binned_r"), F.count("*").alias("bins"))
        part = p.crossJoin(bins).select(F.lit(m).alias("metric"), "n", "r", "partial_r", "binned_r", "bins")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


def cross_sensor_report(df: DataFrame, levels: dict[str, tuple[str, str]], z: str, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per level (name: truth, prediction) error metrics and partial r given z and z squared, over rows that pass ``keep``."""
    from .metrics import error_metrics

    parts = ", ".join(f"'{k}', {a}, {b}" for k, (a, b) in levels.items())
    long = df.where(keep).select(*by, z, F.expr(f"stack({len(levels)}, {parts}) as (level, truth, prediction)"))
    keys = [*by, "level"]
    return error_metrics(long, "truth", "prediction", keys).join(partial_corr(long, "truth", "prediction", z, keys).select(*keys, "partial_r"), keys)


def calibration_curve(df: DataFrame, y: str, x: str, bin_column: str) -> DataFrame:
    """Per bin n, means of x and y residuals' inputs, and the slope within the bin over the overall slope."""
    all_ = ols_fit(df, y, x).select(F.col("slope").alias("_s"))
    rows = df.dropna(subset=[x, y]).groupBy(bin_column).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.regr_slope(y, x).alias("slope"))
    return rows.crossJoin(F.broadcast(all_)).withColumn("slope_ratio", F.try_divide("slope", "_s")).drop("_s")  # one row


def sens_residual_corr(df: DataFrame, a: str, b: str, x: str, by: str) -> DataFrame:
    """Per group r of the residuals of a and b on x, their sd, and sd relative to all rows of the group."""
    rows = ols_residual(ols_residual(df, a, x, [by], "_ra"), b, x, [by], "_rb")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("r"), F.stddev_samp("_ra").alias("sd_a"), F.stddev_samp("_rb").alias("sd_b"), F.try_divide(F.stddev_samp("_ra"), F.stddev_samp(a)).alias("u"))


def interaction_test(df: DataFrame, y: str, sens: str, group: str) -> DataFrame:
    """Slope of y on sensitivity in either group, their difference (the interaction), its z, and ``p`` by Student's t with Welch's degrees of freedom."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.regr_slope(y, sens).alias("slope"), F.regr_syy(y, sens).alias("syy"), F.regr_sxx(y, sens).alias("sxx"), F.regr_sxy(y, sens).alias("sxy"))
    g = g.withColumn("v", (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2) / F.col("sxx"))
    of = lambda c, k: F.max(F.when(F.col(group) == k, F.col(c)))
    a, b = of("v", 1), of("v", 0)
    one = g.agg(
        of("slope", 1).alias("slope_high"), of("slope", 0).alias("slope_low"), (of("slope", 1) - of("slope", 0)).alias("interaction"), ((of("slope", 1) - of("slope", 0)) / F.sqrt(a + b)).alias("z"),
        F.try_divide((a + b) * (a + b), a * a / (of("n", 1) - 2) + b * b / (of("n", 0) - 2)).alias("_df"))
    return one.withColumn("p", student_sf2(F.col("z"), F.col("_df"))).drop("_df")


def bin_trend(df: DataFrame, bin_column: str, value: str) -> DataFrame:
    """Slope and Spearman correlation of bin means over bins."""
    means = avg_rank(avg_rank(df.groupBy(bin_column).agg(F.avg(value).alias("_m")).withColumn("_all", F.lit(1)), bin_column, ["_all"], "_rx"), "_m", ["_all"], "_ry")  # a row per bin
    return means.agg(F.count("*").alias("bins"), F.regr_slope("_m", bin_column).alias("slope"), F.corr("_rx", "_ry").alias("spearman"))


def fold_of(key: str, folds: int, seed: str = "fold") -> Column:
    """Fold of a whole tile."""
    return (F.conv(F.substring(pick_order(seed, key), 1, 8), 16, 10).cast("long") % folds).cast("int")


def auc(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Area under the ROC curve per group, ties counted half, from counts per score and running sums over ranges of them; null where a class is missing."""
    by = list(by)
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(*by, F.col(score).alias("_score")).agg(F.count_if(F.col(label) == 1).alias("_n1"), F.count_if(F.col(label) == 0).alias("_n0"))
    run = running_sums(counts, by, "_score", ["_n0"])
    n1, n0 = F.sum("_n1"), F.sum("_n0")
    u = F.sum(F.col("_n1").cast("double") * (F.col("before__n0") + F.col("_n0") / 2))
    return run.groupBy(*by).agg((n1 + n0).alias("n"), F.try_divide(u, n1.cast("double") * n0).alias("auc"))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df.dropna(subset=list(features)))


def out_of_fold(df: DataFrame, make, features: Sequence[str], label: str, tile: str, folds: int, out: str) -> DataFrame:
    """Predictions of each fold by a model of the others. make(): an unfitted estimator with features '_x'."""
    from pyspark.ml.functions import vector_to_array

    held = stored(df.withColumn("_fold", fold_of(tile, folds)), "folds")  # every fit and prediction reads the rows again
    rows = _assembled(held, features).withColumn("_label", F.col(label).cast("double"))
    out_df = None
    for k in range(folds):
        model = make().fit(rows.where(F.col("_fold") != k))
        part = model.transform(rows.where(F.col("_fold") == k))
        value = vector_to_array("probability")[1] if "probability" in part.columns else F.col("prediction")
        part = part.select(*df.columns, F.col("_fold").alias("fold"), value.alias(out))
        out_df = part if out_df is None else out_df.unionByName(part)
    return out_df


def grouped_cv_classify(df: DataFrame, features: Sequence[str], label: str, tile: str, folds: int, kind: str = "logistic") -> DataFrame:
    """Per fold n, AUC, balanced accuracy and F1 of a logistic model or forest, folds of whole tiles."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    make = {"logistic": lambda: LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=30), "forest": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_label", numTrees=20, seed=1)}[kind]
    p = out_of_fold(df, make, features, label, tile, folds, "score").withColumn("_hit", (F.col("score") >= 0.5).cast("int"))
    y = F.col(label)
    tp, tn = F.count_if((y == 1) & (F.col("_hit") == 1)), F.count_if((y == 0) & (F.col("_hit") == 0))
    n1, n0 = F.count_if(y == 1), F.count_if(y == 0)
    rest = p.groupBy("fold").agg(((F.try_divide(tp, n1) + F.try_divide(tn, n0)) / 2).alias("balanced_accuracy"), F.try_divide(2 * tp, tp + n1 + n0 - tn).alias("f1"))
    return auc(p, "score", label, ["fold"]).join(rest, "fold")


def _scores(p: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """n, AUC, balanced accuracy and F1 per group of out-of-fold scores; a score of one half or more counts as a hit."""
    by = list(by)
    hit, y = F.col("score") >= 0.5, F.col(label)
    tp, tn, n1, n0 = F.count_if((y == 1) & hit), F.count_if((y == 0) & ~hit), F.count_if(y == 1), F.count_if(y == 0)
    rest = p.groupBy(*by).agg(((F.try_divide(tp, n1) + F.try_divide(tn, n0)) / 2).alias("balanced_accuracy"), F.try_divide(2 * tp, tp + n1 + n0 - tn).alias("f1"))
    return beside(auc(p, "score", label, by), rest, by)


def cross_validated(df: DataFrame, features: Sequence[str], label: str, tile: str, folds: int | None, kind: str = "logistic", trees: int = 20) -> tuple[DataFrame, list[tuple[int, list[float]]]]:
    """Out-of-fold scores of every row with a label and features, and per fold the importance of each feature.

    folds None leaves out one tile at a time: a model per tile, so for few tiles. Otherwise folds are whole tiles by a hash. Classes weigh
    alike. A fold whose training rows lack a class is left out. Importance is the absolute coefficient of the standardised feature, or a forest's impurity importance.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    given = df.dropna(subset=[*features, label, tile])
    if folds is None:
        number = global_avg_rank(given.select(tile).distinct(), tile, "_k").select(tile, (F.col("_k") - 1).cast("int").alias("fold"))
        given = given.join(F.broadcast(number), tile)  # a row per fold, each of which has a model
    else:
        given = given.withColumn("fold", fold_of(tile, folds))
    rows = stored(_assembled(given, features).withColumn("_label", F.col(label).cast("double")), "assembled")
    counts = {(r["fold"], r["_label"]): r["n"] for r in rows.groupBy("fold", "_label").agg(F.count("*").alias("n")).collect()}  # two per fold
    total = {y: sum(n for (_, k), n in counts.items() if k == y) for y in (0.0, 1.0)}
    out, weights = None, []
    for k in sorted({f for f, _ in counts}):
        left = {y: total[y] - counts.get((k, y), 0) for y in total}
        if not all(left.values()):
            continue
        n = sum(left.values())
        train = rows.where(F.col("fold") != k).withColumn("_weight", F.when(F.col("_label") == 1, n / (2 * left[1.0])).otherwise(n / (2 * left[0.0])))
        if kind == "logistic":
            model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", maxIter=50).fit(train)
            sd = train.agg(*(F.stddev_pop(c).alias(c) for c in features)).first()
            weights.append((k, [abs(float(b)) * float(sd[c]) for b, c in zip(model.coefficients, features, strict=True)]))
        else:
            model = RandomForestClassifier(featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, seed=1).fit(train)
            weights.append((k, [float(x) for x in model.featureImportances.toArray()]))
        part = model.transform(rows.where(F.col("fold") == k)).select(*df.columns, "fold", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = given.select(*df.columns, "fold", F.lit(None).cast("double").alias("score")).where(F.lit(False))
    return stored(out, "scores"), weights


def classify_report(df: DataFrame, feature_sets: dict[str, Sequence[str]], label: str, tile: str, bin_column: str, folds: int | None, kind: str = "logistic") -> DataFrame:
    """(features, part, name, n, auc, balanced_accuracy, f1, importance): per feature set its folds, their means, the pooled scores, the pooled scores per bin, and the mean importance of each feature. See ``cross_validated``."""
    out = None
    for name, features in feature_sets.items():
        p, weights = cross_validated(df.select(*dict.fromkeys([*features, label, tile, bin_column])), features, label, tile, folds, kind)
        spark = df.sparkSession
        per = _scores(p, label, ["fold"])
        numbers = ["n", "auc", "balanced_accuracy", "f1"]
        as_part = lambda d, part, key: d.select(F.lit(part).alias("part"), key.cast("string").alias("name"), F.col("n").cast("double").alias("n"), *numbers[1:], F.lit(None).cast("double").alias("importance"))
        parts = as_part(per, "fold", F.col("fold"))
        parts = parts.unionByName(as_part(per.agg(*(F.avg(c).alias(c) for c in numbers)), "mean", F.lit("all")))
        parts = parts.unionByName(as_part(_scores(p, label, []), "pooled", F.lit("all")))
        parts = parts.unionByName(as_part(_scores(p, label, [bin_column]), "bin", F.col(bin_column)))
        means = [(f, sum(w[k] for _, w in weights) / len(weights)) for k, f in enumerate(features)] if weights else []
        told = spark.createDataFrame(means, "name string, importance double").select(F.lit("importance").alias("part"), "name", *(F.lit(None).cast("double").alias(c) for c in numbers), "importance")
        parts = parts.unionByName(told).withColumn("features", F.lit(name))
        out = parts if out is None else out.unionByName(parts)
    return out.where("n is not null or importance is not null")


def permutation_importance(df: DataFrame, features: Sequence[str], label: str, tile: str, folds: int, seed: str, *ids: str) -> DataFrame:
    """(feature, auc, permuted_auc, loss): AUC over all out-of-fold scores of a logistic fit, and with one feature's values dealt anew.

    A feature's values are permuted within tiles: the rows of a tile in the order of their ids get the values in the order of a hash. The models are those of the true values.
    """
    from pyspark.ml.classification import LogisticRegression

    given = df.dropna(subset=[*features, label, tile]).select(tile, *ids, *features, F.col(label).cast("double").alias("_label")).withColumn("fold", fold_of(tile, folds))
    w = Window.partitionBy(tile)  # the rows of a tile
    base = stored(given.withColumn("_at", F.row_number().over(w.orderBy(*ids))), "rows")
    tables = {None: base}
    for f in features:
        dealt = base.select(tile, F.row_number().over(w.orderBy(pick_order(f"{seed}|{f}", tile, *ids), *ids)).alias("_at"), F.col(f).alias("_dealt"))
        tables[f] = base.join(dealt, [tile, "_at"]).drop(f).withColumnRenamed("_dealt", f)
    models = {k: LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=50).fit(_assembled(base.where(F.col("fold") != k), features)) for k in range(folds)}
    # the model of a row's fold as columns, so that each table is read once for all folds
    of = lambda number: F.coalesce(*(F.when(F.col("fold") == k, F.lit(float(number(m)))) for k, m in models.items()))
    margin = sum((of(lambda m, j=j: m.coefficients[j]) * F.col(f).cast("double") for j, f in enumerate(features)), of(lambda m: m.intercept))
    out = None
    for f, table in tables.items():
        part = table.select(F.lit(f).alias("feature"), "_label", (1 / (1 + F.exp(-margin))).alias("score"))
        out = part if out is None else out.unionByName(part)
    found = auc(out, "score", "_label", ["feature"])
    whole = found.where("feature is null").select(F.col("auc").alias("_auc"))
    return found.where("feature is not null").crossJoin(F.broadcast(whole)).select("feature", F.col("_auc").alias("auc"), F.col("auc").alias("permuted_auc"), (F.col("_auc") - F.col("auc")).alias("loss"))  # one row


def class_sets_report(df: DataFrame, feature_sets: dict[str, Sequence[str]], label: str, tile: str, folds: int, kind: str = "logit") -> DataFrame:
    """``class_report_averages`` of out-of-fold predictions for every feature set. kind: multinomial ``logit``, or ``boosted`` trees, one class against the rest.

    Rows of one fold with equal features and class are one row with their number as its weight: the models are those of all rows, and read the rows themselves once.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest

    from .metrics import class_report_averages

    def make():
        if kind == "logit":
            return LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_times", family="multinomial", maxIter=20)
        return OneVsRest(classifier=GBTClassifier(featuresCol="_x", labelCol="_label", weightCol="_times", maxIter=5, maxDepth=3, seed=1), featuresCol="_x", labelCol="_label", weightCol="_times", parallelism=3)  # the classes' fits are short tasks: several at once

    out = None
    for name, features in feature_sets.items():
        given = df.dropna(subset=[label, *features]).select(*features, F.col(label).cast("double").alias("_label"), fold_of(tile, folds).alias("_fold"))
        counts = given.groupBy(*features, "_label", "_fold").agg(F.count("*").alias("_times"))
        rows = _assembled(stored(counts, "folds"), features)
        held = None
        for k in range(folds):
            part = make().fit(rows.where(F.col("_fold") != k)).transform(rows.where(F.col("_fold") == k)).select(F.col("_label").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), "_times")
            held = part if held is None else held.unionByName(part)
        one = class_report_averages(stored(held, "predictions"), "truth", "predicted", "_times").withColumn("features", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def multinomial_classify(df: DataFrame, feature_sets: dict[str, Sequence[str]], label: str, tile: str, folds: int) -> DataFrame:
    """Accuracy out of fold of a multinomial logit on each feature set."""
    from pyspark.ml.classification import LogisticRegression

    out = None
    for name, features in feature_sets.items():
        rows = _assembled(df, features).withColumn("_fold", fold_of(tile, folds)).withColumn("_label", F.col(label).cast("double"))
        for k in range(folds):
            model = LogisticRegression(featuresCol="_x", labelCol="_label", family="multinomial", maxIter=20).fit(rows.where(F.col("_fold") != k))
            part = model.transform(rows.where(F.col("_fold") == k)).select(F.lit(name).alias("features"), (F.col("prediction") == F.col("_label")).alias("_ok"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("features").agg(F.count("*").alias("n"), F.avg(F.col("_ok").cast("double")).alias("accuracy"))


def height_model_residual(df: DataFrame, reference: Column, height: str, target: str, kind: str = "forest", knots: Sequence[float] = ()) -> DataFrame:
    """Target less its prediction from height by a model fitted on the reference rows: forest, or linear on a truncated-power spline."""
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    basis = df.withColumns({f"_k{i}": F.pow(F.greatest(F.col(height) - k, F.lit(0.0)), 3) for i, k in enumerate(knots)})
    features = [height, *(f"_k{i}" for i in range(len(knots)))] if kind == "spline" else [height]
    rows = _assembled(basis, features).withColumn("_label", F.col(target).cast("double"))
    model = (LinearRegression(featuresCol="_x", labelCol="_label", regParam=1e-6) if kind == "spline" else RandomForestRegressor(featuresCol="_x", labelCol="_label", numTrees=20, seed=1)).fit(rows.where(reference))
    return model.transform(rows).withColumn("residual", F.col(target) - F.col("prediction")).select(*df.columns, "residual")


def oof_residual_corr(df: DataFrame, targets: tuple[str, str], x: str, tile: str, folds: int) -> DataFrame:
    """Correlation of two targets' out-of-fold residuals on x for a linear model and boosted trees."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    makers = {"linear": lambda: LinearRegression(featuresCol="_x", labelCol="_label"), "trees": lambda: GBTRegressor(featuresCol="_x", labelCol="_label", maxIter=5, seed=1)}
    held = stored(df.select(*dict.fromkeys([x, *targets]), fold_of(tile, folds).alias("_fold")), "folds")  # every fit and prediction reads the rows again
    rows = _assembled(held, [x])
    out = None
    for name, make in makers.items():
        both = None
        for k in range(folds):
            part = rows.where(F.col("_fold") == k)
            for y in targets:
                model = make().fit(rows.where(F.col("_fold") != k).withColumn("_label", F.col(y).cast("double")))
                part = model.transform(part).withColumn(f"_r_{y}", F.col(y) - F.col("prediction")).drop("prediction")
            part = part.select(*(F.col(f"_r_{y}") for y in targets))
            both = part if both is None else both.unionByName(part)
        part = both.agg(F.count("*").alias("n"), F.corr(*(F.col(f"_r_{y}") for y in targets)).alias("r")).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def random_intercept_fit(df: DataFrame, y: str, terms: Sequence[str], band: str, by: Sequence[str] = (), levels: dict[str, Sequence] | None = None) -> DataFrame:
    """Per fit ``by`` and term: coefficient of y on the terms with a random intercept per band (REML), se, normal 95 % interval and p.

    levels: categories and their values, each but the first an indicator; terms without spread are left out. ratio: variance of the
    intercepts over that of the residuals; with one band it is 0 and the fit is least squares. Rows with a null in any column are left out.

    Spark sums products of the centred columns per band; a task then holds one row per band of a fit, and searches the ratio.
    """
    import pandas as pd

    wide = df.withColumns({f"{c}={v}": (F.col(c) == v).cast("double") for c, values in (levels or {}).items() for v in list(values)[1:]})
    names = [*terms, *(c for c in wide.columns if c not in df.columns)]
    keys = list(by)
    given = wide.dropna(subset=[y, band, *names, *keys]).select(*keys, F.col(band).alias("_band"), *(F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate([*names, y])))
    columns = [f"_x{j}" for j in range(len(names) + 1)]
    means = stored(given.groupBy(*keys).agg(*(F.avg(c).alias(f"_m{c}") for c in columns)), "means")  # of known size, so that those of few fits are broadcast
    rows = given.join(means, keys) if keys else given.crossJoin(F.broadcast(means))  # one row
    rows = rows.withColumns({c: F.col(c) - F.col(f"_m{c}") for c in columns})
    pairs = [(j, k) for j in range(len(columns)) for k in range(j, len(columns))]
    sums = rows.groupBy(*keys, "_band").agg(F.count("*").cast("double").alias("_n"), *(F.sum(c).alias(c) for c in columns), *(F.sum(F.col(columns[j]) * F.col(columns[k])).alias(f"_g{j}_{k}") for j, k in pairs))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "term string", "coef double", "se double", "low double", "high double", "p double", "ratio double", "n bigint", "bands bigint"])

    def fit(held: pd.DataFrame) -> pd.DataFrame:
        found = [(*(held[k].iloc[0] for k in keys), *x) for x in reml(names, held["_n"].to_numpy(), held[columns].to_numpy(), {(j, k): held[f"_g{j}_{k}"].sum() for j, k in pairs})]
        return pd.DataFrame(found, columns=[*keys, "term", "coef", "se", "low", "high", "p", "ratio", "n", "bands"])

    return sums.withColumn("_all", F.lit(0)).groupBy("_all", *keys).applyInPandas(fit, schema)


def reml(names: Sequence[str], sizes, sums, products: dict[tuple[int, int], float]) -> list[tuple]:
    """Terms of a random-intercept fit from rows per band, sums per band of the centred columns (y last) and their products over all bands."""
    import math

    import numpy as np

    n, y = sizes.sum(), len(names)
    kept = [j for j in range(y) if products[j, j] > 1e-12 * n]
    s = np.column_stack([sizes, sums[:, kept]])
    xx = np.zeros((len(kept) + 1,) * 2)
    xx[0, 0] = n
    for a, j in enumerate(kept):
        for b, k in enumerate(kept):
            xx[a + 1, b + 1] = products[min(j, k), max(j, k)]
    scale = np.sqrt(np.diag(xx))
    s, xx = s / scale, xx / np.outer(scale, scale)
    xy, free = np.array([0.0, *(products[j, y] for j in kept)]) / scale, n - len(kept) - 1
    if free <= 0:
        return []

    def solved(ratio: float) -> tuple:
        w = ratio / (1 + sizes * ratio)
        a = xx - (s * w[:, None]).T @ s
        b = xy - s.T @ (w * sums[:, y])
        beta = np.linalg.solve(a, b)
        variance = max(products[y, y] - float(w @ sums[:, y] ** 2) - float(b @ beta), 1e-300) / free
        return free * math.log(variance) + float(np.log1p(sizes * ratio).sum()) + np.linalg.slogdet(a)[1], beta, variance, a

    ratio = 0.0
    if len(sizes) > 1:
        logs = np.linspace(-18.0, 9.0, 109)
        at = int(np.argmin([solved(math.exp(x))[0] for x in logs]))
        low, high = logs[max(at - 1, 0)], logs[min(at + 1, len(logs) - 1)]
        for _ in range(60):
            a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (low, b) if solved(math.exp(a))[0] < solved(math.exp(b))[0] else (a, high)
        best = math.exp((low + high) / 2)
        ratio = best if solved(best)[0] < solved(0.0)[0] else 0.0
    _, beta, variance, a = solved(ratio)
    se = np.sqrt(variance * np.diag(np.linalg.inv(a))) / scale
    beta = beta / scale
    return [(names[j], float(beta[i + 1]), float(se[i + 1]), float(beta[i + 1] - 1.959963985 * se[i + 1]), float(beta[i + 1] + 1.959963985 * se[i + 1]), math.erfc(abs(beta[i + 1]) / se[i + 1] / math.sqrt(2)) if se[i + 1] > 0 else 0.0, ratio, int(n), len(sizes)) for i, j in enumerate(kept)]


def shape_baselines(df: DataFrame, target: str, x: str, tile: str, folds: int) -> DataFrame:
    """RMSE out of fold of the mean, a linear model and a forest."""
    from pyspark.ml.regression import LinearRegression, RandomForestRegressor

    folded = stored(df.select(*dict.fromkeys([x, target]), fold_of(tile, folds).alias("_f")), "folds")  # every fit and prediction reads the rows again
    rows = _assembled(folded, [x]).withColumn("_label", F.col(target).cast("double"))
    sums = folded.groupBy("_f").agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    all_ = sums.agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_count"))
    mean = folded.join(F.broadcast(sums.crossJoin(F.broadcast(all_)).select("_f", ((F.col("_all") - F.col("_s")) / (F.col("_count") - F.col("_n"))).alias("_p"))), "_f").select(F.lit("mean").alias("model"), (F.col(target) - F.col("_p")).alias("_e"))
    makers = {"linear": lambda: LinearRegression(featuresCol="_x", labelCol="_label"), "forest": lambda: RandomForestRegressor(featuresCol="_x", labelCol="_label", numTrees=10, seed=1)}
    for name, make in makers.items():
        for k in range(folds):
            model = make().fit(rows.where(F.col("_f") != k))
            mean = mean.union(model.transform(rows.where(F.col("_f") == k)).select(F.lit(name), F.col(target) - F.col("prediction")))
    return mean.groupBy("model").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"))


def profile_baselines(df: DataFrame, profile: str, others: Sequence[str], height: str, tile: str, folds: int, bins: int = 20) -> DataFrame:
    """(model, n, rmse, and delta_<other> per other profile): shape RMSE on the tiles of fold 0 of profiles predicted from height by a fit on all other tiles, for all levels at once.

    Models: ``mean`` (the mean profile), ``linear`` (a line per level), ``bins`` (the mean profile of each of equal-count bins of height). The others are
    profiles that stand beside the true one; each has a row of its own, and delta = (rmse of the model - rmse of the other) / rmse of the model.
    A row's shape RMSE is over its levels. Rows with a null, or of another length than the shortest training profile, don't count.
    """
    rows = df.dropna(subset=[profile, height, tile, *others]).select(F.col(profile).alias("_y"), F.col(height).cast("double").alias("_h"), (fold_of(tile, folds) == 0).alias("_test"), *others)
    rows = stored(rows, "profiles")
    train = rows.where(~F.col("_test"))
    size = train.agg(F.min(F.size("_y"))).first()[0]
    edges = quantiles(train, "_h", [], [k / bins for k in range(1, bins)]).first()
    names = ["mean", "linear", "bins", *others]
    schema = "model string, n long, rmse double" + "".join(f", delta_{x} double" for x in others)
    if size is None or edges is None:
        return df.sparkSession.createDataFrame([], schema)
    cut = sorted(set(edges["q"]))
    at = F.size(F.filter(F.array(*map(F.lit, cut)), lambda e: e <= F.col("_h")))
    levels = lambda d: d.where(F.size("_y") == size).select("_h", at.alias("_b"), F.posexplode("_y").alias("_k", "_v"))
    long = levels(train)
    # one row for all levels of a model
    fits = long.groupBy("_k").agg(F.avg("_v").alias("mean"), F.regr_slope("_v", "_h").alias("b"), F.regr_intercept("_v", "_h").alias("a"))
    fits = fits.agg(F.array_sort(F.collect_list(F.struct("_k", "mean", F.coalesce("a", "mean").alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")))).alias("_f"))
    means = long.groupBy("_b", "_k").agg(F.avg("_v").alias("m")).groupBy("_b").agg(F.array_sort(F.collect_list(F.struct("_k", "m"))).alias("_m"))  # a row per bin
    test = rows.where(F.col("_test") & (F.size("_y") == size)).withColumn("_b", at).crossJoin(F.broadcast(fits)).join(means, "_b", "left")
    mean = F.transform("_f", lambda f: f["mean"])
    predicted = {"mean": mean, "linear": F.transform("_f", lambda f: f["a"] + f["b"] * F.col("_h")), "bins": F.coalesce(F.transform("_m", lambda m: m["m"]), mean), **{x: F.col(x) for x in others}}
    per = test.select(*(shape_rmse(predicted[x], F.col("_y")).alias(x) for x in names))
    one = per.agg(F.count("*").alias("n"), *(F.avg(x).alias(x) for x in names))
    told = F.explode(F.array(*(F.struct(F.lit(x).alias("model"), F.col("n"), F.col(x).alias("rmse"), *(F.try_divide(F.col(x) - F.col(o), F.col(x)).alias(f"delta_{o}") for o in others)) for x in names)))
    return one.select(told.alias("_t")).select("_t.*")
