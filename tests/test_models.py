import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from antipode.operators import models as M
from antipode.operators import stats as T
from antipode.plans import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(0)
    n = 400
    g = np.where(rng.rand(n) < 0.4, "hot", rng.choice(list("abcde"), n))
    x = rng.randn(n, 3)
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.randn(n) * 0.1 + (g == "a")
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": list(x), "y": y})
    df = spark.createDataFrame([(int(i), str(a), list(map(float, b)), float(c)) for i, a, b, c in zip(pdf.id, g, x, y)],
                               "id long, g string, x array<double>, y double").repartition(4)
    return pdf, df


@pytest.mark.parametrize("held", [1, 4096])
def test_ridge_per_group(rows, held):
    pdf, df = rows
    got = {r.g: r for r in M.fit_per_group(df, "g", "x", "y", ridge=2.0, held=held).collect()}
    assert set(got) == {g for g, p in pdf.groupby("g") if len(p) >= 20}
    for g, part in pdf.groupby("g"):
        x, y = np.column_stack([np.ones(len(part)), np.stack(part.x)]), part.y.to_numpy()
        w = np.linalg.solve(x.T @ x + 2.0 * np.diag([0, 1, 1, 1]), x.T @ y)
        assert got[g].n == len(part)
        assert [got[g].intercept, *got[g].coefficients] == pytest.approx(w.tolist())


def test_scores_follow_the_models(rows):
    _, df = rows
    scored = M.score_per_group(df, M.fit_per_group(df, "g", "x", "y", ridge=0.0), "g", "x")
    assert T.regression_metrics(scored, "y", "predicted").first().mae < 0.2


def test_too_few_rows(spark, rows):
    with pytest.raises(ValueError):
        M.fit_regressor(rows[1].limit(3), "forest")


def test_fold_is_stable_and_stratified(rows):
    _, df = rows
    d = df.withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    counts = M.with_stratified_fold(d, "label", "id", 4).groupBy("label", "fold").count().toPandas()
    for _, part in counts.groupby("label"):
        assert part["count"].max() - part["count"].min() <= 1


def test_kfold_and_importances(rows):
    _, df = rows
    d = df.select("id", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    scores = M.kfold_scores(d, "id", 2, M.regressor("forest", 5, 4))
    s = M.kfold_summary(scores).first()
    assert s.k == 2 and s.mean_r2 > 0.3
    model = M.fit_regressor(d, "boosting", trees=5)
    assert M.top_importances(model, ["x0", "x1", "x2"], 1)[0][0] == "x1"


def test_feature_layout(spark):
    df = spark.createDataFrame([([1.0, 2.0], 5.0, 0.5, -1.0, [(0.1, 1.0)])], "v array<double>, d double, s double, g double, c array<struct<score:double,sign:double>>")
    got = M.assemble_features(df, "v", ["d"], "s", "g", "c").select(vector_to_array("features").alias("f")).first().f
    assert got[:7] == [1.0, 2.0, 5.0, 0.5, -1.0, 0.1, 1.0] and len(got) == 5 + 16


def test_pair_feature_names_match_length(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], 7.0, "b", 0.9)], "a array<double>, b array<double>, d double, t string, e double")
    names = M.pair_feature_names(2, ["d"], ["a", "b"], ["e"])
    got = M.assemble_pair_features(df, "a", "b", ["d"], "t", ["b", "a"], ["e"]).select(vector_to_array("features").alias("f")).first().f
    assert dict(zip(names, got))["tag_b"] == 1.0 and len(names) == len(got)
    assert got[4:8] == [3.0, 8.0, 2.0, 2.0]


def test_trained_groups_are_skipped_and_rows_left_out(rows):
    pdf, df = rows
    models = M.fit_per_group(df, "g", "x", "y")
    first = models.orderBy("g").limit(1)
    rest = M.fit_per_group(df, "g", "x", "y", trained=first)
    assert {r.g for r in rest.collect()} == {r.g for r in models.collect()} - {first.first().g}
    got = {r.id: r.predicted for r in M.leave_one_out(df, "g", "x", "y", ridge=2.0).collect()}
    part = pdf[pdf.g == first.first().g]
    x, y = np.column_stack([np.ones(len(part)), np.stack(part.x)]), part.y.to_numpy()
    for k in range(5):
        a, b = np.delete(x, k, 0), np.delete(y, k)
        w = np.linalg.solve(a.T @ a + 2.0 * np.diag([0, 1, 1, 1]), a.T @ b)
        assert got[part.id.iloc[k]] == pytest.approx(float(x[k] @ w))


def test_classifier_scored_by_other_groups(rows):
    _, df = rows
    d = df.select("g", array_to_vector("x").alias("features"), (F.col("y") > 0).cast("double").alias("label"))
    tags = M.fold_values(d, "g")[:2]
    few = d.where(F.col("g").isin(tags))
    assert M.classifier_group_out(few, "g", tags, trees=2).first().n == few.count()


def test_global_model_reads_the_texts_once(spark):
    scored = QUERIES["fit_global"](spark, "/root/testdata/sf0.001")
    assert scored.count() and not any("documents.parquet" in f for f in scored.inputFiles())


def test_narrow_ridge_exchanges_one_row_per_group_and_task(rows, monkeypatch):
    _, df = rows
    narrow = M.fit_per_group(df, "g", "x", "y", min_records=5)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "posexplode" not in plan
    monkeypatch.setattr(M, "NARROW", 0)
    wide = {r.g: r for r in M.fit_per_group(df, "g", "x", "y", min_records=5).collect()}
    found = narrow.collect()
    assert {r.g for r in found} == set(wide)
    for r in found:
        assert (r.n, r.intercept) == (wide[r.g].n, pytest.approx(wide[r.g].intercept, rel=1e-9))
        assert r.coefficients == pytest.approx(wide[r.g].coefficients, rel=1e-9)
