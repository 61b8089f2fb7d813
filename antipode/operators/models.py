"""Feature assembly, model training and scoring with Spark ML.

Per-group linear models are fitted from summed cross products: map tasks add up
X'X and X'y per group, so a group of any size reaches its solver as one matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.functions.rules import PROPERTY_RULES, clamp_outcome, sensitivity
from antipode.functions.vectors import combine_vectors, one_hot
from antipode.operators.stats import binary_metrics, regression_metrics, spearman
from antipode.scale import group_row_number, materialize

SEED = 42
#: Feature lists of up to so many numbers are added up by Spark's own aggregates.
NARROW = 8


def assemble_features(df: DataFrame, vec: str, descriptors: Sequence[str], score: str, sign: str,
                      centers: str | None = None, ensemble: Sequence[str] = (), out: str = "features",
                      max_centers: int = 8) -> DataFrame:
    """Vector + descriptors + (score, sign) + center (score, sign) pairs + ensemble statistics.

    ``centers``: array of struct(score, sign) in site order, filled up with zeros to ``max_centers`` pairs;
    a row with more is an error.
    """
    parts = [F.col(vec), F.array(*[F.col(c).cast("double") for c in (*descriptors, score, sign)])]
    if centers:
        flat = F.flatten(F.transform(F.col(centers), lambda c: F.array(c["score"], c["sign"])))
        fits = F.when(F.size(centers) > max_centers, F.raise_error(F.lit(f"more than {max_centers} centers"))).otherwise(flat)
        parts.append(F.slice(F.concat(fits, F.array_repeat(F.lit(0.0), 2 * max_centers)), 1, 2 * max_centers))
    if ensemble:
        parts.append(F.array(*[F.col(c).cast("double") for c in ensemble]))
    return df.withColumn(out, array_to_vector(F.concat(*parts)))


def assemble_pair_features(df: DataFrame, a: str, b: str, descriptors: Sequence[str], tag: str, tags: Sequence[str],
                           extra: Sequence[str], out: str = "features") -> DataFrame:
    """Combined pair vector + descriptors + tag one-hot + further numbers."""
    tail = F.array(*[F.col(c).cast("double") for c in descriptors])
    more = F.array(*[F.col(c).cast("double") for c in extra])
    return df.withColumn(out, array_to_vector(
        F.concat(combine_vectors(F.col(a), F.col(b)), tail, one_hot(F.col(tag), tags), more)))


def pair_feature_names(dim: int, descriptors: Sequence[str], tags: Sequence[str], extra: Sequence[str]) -> list[str]:
    """Names of the pair features, in order."""
    blocks = [f"{p}_{i}" for p in ("a", "b", "product", "absdiff") for i in range(dim)]
    return [*blocks, *descriptors, *[f"tag_{t}" for t in sorted(tags)], *extra]


def regressor(kind: str = "forest", trees: int = 100, depth: int = 5, label: str = "label", features: str = "features"):
    """Random forest, gradient boosting, or boosting over coarse histogram bins; fixed seed."""
    shared = dict(labelCol=label, featuresCol=features, maxDepth=depth, seed=SEED)
    if kind == "forest":
        return RandomForestRegressor(numTrees=trees, **shared)
    if kind == "boosting":
        return GBTRegressor(maxIter=trees, **shared)
    if kind == "histogram":
        return GBTRegressor(maxIter=trees, maxBins=255, **shared)
    raise ValueError(f"unknown kind {kind}")


def fit_regressor(df: DataFrame, kind: str = "forest", trees: int = 100, depth: int = 5, min_rows: int = 5):
    """Fitted model; too few rows is an error."""
    if df.limit(min_rows).count() < min_rows:
        raise ValueError(f"at least {min_rows} rows are needed")
    return regressor(kind, trees, depth).fit(df)


def fit_global(df: DataFrame, vec: str, target: str, label: str, trees: int = 20, depth: int = 4):
    """One boosted model over all targets: pair vector + sparse target one-hot; unknown targets map to zeros."""
    data = df.withColumn("vec_features", array_to_vector(F.col(vec))).withColumn("label", F.col(label).cast("double"))
    return Pipeline(stages=[
        StringIndexer(inputCol=target, outputCol="_t", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCol="_t", outputCol="_one_hot", handleInvalid="keep"),
        VectorAssembler(inputCols=["vec_features", "_one_hot"], outputCol="features"),
        regressor("histogram", trees, depth),
    ]).fit(data)


def _summed_products(rows: DataFrame, size: int) -> DataFrame:
    """(g, s): sums of the products of (1, x) with itself, row after row, and with y. ``rows``: g, x of ``size`` numbers, y.

    One row per group and map task is exchanged, whatever the order of the rows.
    """
    fits = F.when(F.size("x") == size, F.col("x")).otherwise(F.raise_error(F.lit("feature lists of unequal length")))
    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("nan")))
    read = rows.withColumn("x", fits).select("g", F.lit(1.0).alias("x0"), *[
        number(F.col("x")[i]).alias(f"x{i + 1}") for i in range(size)], "y")
    pairs = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    sums = read.groupBy("g").agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
                                 *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"y{i}") for i in range(size + 1)])
    around = range(size + 1)
    return sums.select("g", F.array(*[f"p{min(i, j)}_{max(i, j)}" for i in around for j in around], *[f"y{i}" for i in around]).alias("s"))


def fit_per_group(df: DataFrame, group: str, features: str, label: str, ridge: float = 1.0,
                  min_records: int = 20, held: int = 4096, trained: DataFrame | None = None,
                  inverse: bool = False) -> DataFrame:
    """Ridge regression per group: group, n, intercept, coefficients.

    Feature lists of more than ``NARROW`` numbers are added up in Python; each task passes its partial sums on once it holds ``held`` groups. Groups listed in ``trained``, a
    table with the column ``group`` such as earlier models, are skipped. ``inverse`` adds the inverse of
    the penalised X'X, row after row.
    """
    size = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.size(features)).first()
    if trained is not None:
        done = trained.select(F.col(group).alias("_done")).distinct()
        df = df.join(done, F.col(group).eqNullSafe(F.col("_done")), "left_anti")
    g_type = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"g": list(sums), "s": list(sums.values())})
            sums.clear()
            return out

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.column_stack([np.ones(len(pdf)), np.stack([np.asarray(v, dtype=float) for v in pdf["x"]])])
            codes, keys = pd.factorize(pdf["g"])
            order = np.argsort(codes, kind="stable")
            x, y, codes = x[order], pdf["y"].to_numpy(dtype=float)[order], codes[order]
            step = max(1, 2_000_000 // (x.shape[1] ** 2))  # rows whose products fit in memory at once
            for i in range(0, len(x), step):
                a, b, c = x[i:i + step], y[i:i + step], codes[i:i + step]
                products = np.hstack([(a[:, :, None] * a[:, None, :]).reshape(len(a), -1), a * b[:, None]])
                starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                for code, s in zip(c[starts], np.add.reduceat(products, starts, axis=0)):
                    key = keys[code]
                    sums[key] = sums[key] + s if key in sums else s
            if len(sums) >= held:
                yield flush()
        if sums:
            yield flush()

    rows = df.select(F.col(group).alias("g"), F.col(features).alias("x"), F.col(label).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    if size is not None and size[0] <= NARROW:
        lists = _summed_products(rows, size[0])
    else:
        partials = rows.mapInPandas(partial, f"g {g_type}, s array<double>")
        summed = partials.select("g", F.posexplode("s").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v"))
        # d * d + d numbers per group, whatever its number of rows
        lists = summed.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
        lists = lists.select("g", F.transform("s", lambda x: x["v"]).alias("s"))
    lists = lists.withColumn("n", F.col("s")[0].cast("long")).where(F.col("n") >= min_records)

    @F.pandas_udf("array<double>")
    def solve(col: pd.Series) -> pd.Series:
        out = []  # intercept, coefficients, and the inverse if asked for
        for s in col:
            s = np.asarray(s)
            d = int((np.sqrt(4 * len(s) + 1) - 1) / 2)
            gram, xy = s[: d * d].reshape(d, d), s[d * d:]
            penalty = ridge * np.eye(d)
            penalty[0, 0] = 0.0
            c = np.linalg.lstsq(gram + penalty, xy, rcond=None)[0]
            out.append(np.concatenate([c, np.linalg.pinv(gram + penalty).ravel()]) if inverse else c)
        return pd.Series(out)

    d = ((F.sqrt(4 * F.size("s") + 1) - 1) / 2).cast("int")
    solved = lists.withColumn("c", solve("s")).withColumn("d", d)
    more = [F.slice("c", F.col("d") + 1, F.col("d") * F.col("d")).alias("inverse")] if inverse else []
    return solved.select(F.col("g").alias(group), "n", F.col("c")[0].alias("intercept"),
                         F.slice("c", F.lit(2), F.col("d") - 1).alias("coefficients"), *more)


def score_per_group(df: DataFrame, models: DataFrame, group: str, features: str, out: str = "predicted") -> DataFrame:
    """Prediction of each row by its group's model; rows of groups without one are left out."""
    products = F.zip_with(features, "coefficients", lambda x, c: x * c)
    value = F.col("intercept") + F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return df.join(models.drop("n"), group).withColumn(out, value).drop("intercept", "coefficients")


def leave_one_out(df: DataFrame, group: str, features: str, label: str, ridge: float = 0.0, min_records: int = 20,
                  out: str = "predicted") -> DataFrame:
    """Prediction of each row by the linear model of all other rows of its group.

    One fit per group: the residual over one minus the row's leverage is what a fit without the row leaves.
    Null where a group cannot do without the row; rows with a null feature list or label are left out.
    """
    models = fit_per_group(df, group, features, label, ridge, min_records, inverse=True).drop("n")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    product = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    x = F.concat(F.array(F.lit(1.0)), F.transform(features, lambda v: v.cast("double")))
    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).join(models, group).withColumn("_x", x)
    size = F.size("_x")
    leverage = total(F.transform("_x", lambda v, i: v * product(F.col("_x"), F.slice("inverse", i * size + 1, size))))
    residual = F.col(label) - product(F.col("_x"), F.concat(F.array("intercept"), "coefficients"))
    rest = 1 - leverage
    return rows.withColumn(out, F.when(rest > 1e-9, F.col(label) - residual / rest)).drop(
        "_x", "intercept", "coefficients", "inverse")


def with_fold(df: DataFrame, key: str, k: int) -> DataFrame:
    """A fold from the key's hash: the same in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(k)).cast("int"))


def with_stratified_fold(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Folds dealt out in turn within each class."""
    return group_row_number(df, [label], [F.asc(key)], "_i").withColumn(
        "fold", ((F.col("_i") - 1) % k).cast("int")).drop("_i")


def fold_values(df: DataFrame, fold: str) -> list:
    """The values of a fold column, one model to train for each."""
    return sorted(r[0] for r in df.select(fold).distinct().collect())


def out_of_fold(df: DataFrame, estimator, folds: Sequence, fold: str = "fold") -> DataFrame:
    """Predictions of each fold by the model of the other folds. ``folds`` lists the few fold values."""
    data = materialize(df, "folds")
    out = None
    for f in folds:
        model = estimator.fit(data.where(F.col(fold) != f))
        part = model.transform(data.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def kfold_scores(df: DataFrame, key: str, k: int, estimator) -> DataFrame:
    """R2 and MAE per fold; average and deviation follow with an aggregate."""
    predicted = out_of_fold(with_fold(df, key, k), estimator, range(k))
    return regression_metrics(predicted, "label", "prediction", ["fold"])


def kfold_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count(F.lit(1)).alias("k"), F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
                      F.avg("mae").alias("mean_mae"))


def leave_group_out(df: DataFrame, tag: str, tags: Sequence[str], estimator) -> DataFrame:
    """Error and rank correlation per tag, each tag predicted by a model of the others."""
    predicted = materialize(out_of_fold(df, estimator, tags, tag).select(tag, "label", "prediction"), "group-out")
    metrics = regression_metrics(predicted, "label", "prediction", [tag]).select(tag, "mae")
    rho = spearman(predicted, "label", "prediction", [tag])
    return rho.where(F.col("n") >= 2).join(metrics, tag)


def fit_strong_classifier(df: DataFrame, key: str, k: int = 5, trees: int = 20, depth: int = 3) -> DataFrame:
    """Quality of a boosted classifier over stratified folds. ``df``: key, label (0/1), features."""
    folded = with_stratified_fold(df, "label", key, k)
    estimator = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED)
    predicted = out_of_fold(folded, estimator, range(k)).withColumn("score", vector_to_array("probability")[1])
    return binary_metrics(materialize(predicted.select("label", "score"), "scores"), "label", "score")


def classifier_group_out(df: DataFrame, tag: str, tags: Sequence, trees: int = 20, depth: int = 3) -> DataFrame:
    """Quality of a boosted classifier where each tag is scored by the model of the other tags. ``df``: tag, label (0/1), features.

    Rows without a tag are not scored.
    """
    estimator = GBTClassifier(maxIter=trees, maxDepth=depth, seed=SEED)
    predicted = out_of_fold(df, estimator, tags, tag).withColumn("score", vector_to_array("probability")[1])
    return binary_metrics(materialize(predicted.select("label", "score"), "scores"), "label", "score")


def score_batch(model, df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Predictions with the sensitivity columns."""
    fold, confidence, flag = sensitivity(F.col("prediction"), threshold)
    return model.transform(df).withColumn("fold_change", fold).withColumn("confidence", confidence).withColumn(
        "is_sensitive", flag)


def score_outcomes(model, df: DataFrame) -> DataFrame:
    """Predictions with the clamped outcome columns."""
    size, side, confidence = clamp_outcome(F.col("prediction"))
    return model.transform(df).withColumn("ee", size).withColumn("major", side).withColumn("confidence", confidence)


def fit_property_models(df: DataFrame, min_records: int = 10, trees: int = 150, depth: int = 4) -> dict:
    """A boosted model per property class with enough records."""
    names = [r[0] for r in PROPERTY_RULES]
    data = materialize(df.where(F.col("property").isin(*names)), "properties")  # read once per model
    counts = {r["property"]: r["n"] for r in data.groupBy("property").agg(
        F.count(F.lit(1)).alias("n")).collect()}  # at most one row per property class
    return {p: regressor("boosting", trees, depth).fit(data.where(F.col("property") == p))
            for p in names if counts.get(p, 0) >= min_records}


def top_importances(model, names: Sequence[str], k: int = 10) -> list[tuple[str, float]]:
    """The ``k`` features a tree model uses most."""
    values = model.featureImportances.toArray()
    return [(names[i], float(values[i])) for i in np.lexsort((np.arange(len(values)), -values))[:k]]
