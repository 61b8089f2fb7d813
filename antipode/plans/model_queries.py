"""Training, validation and scoring jobs on the given tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from antipode.operators import models as M
from antipode.operators import stats as T
from antipode.plans.registry import query
from antipode.plans.rule_queries import property_rows
from antipode.functions.rules import property_class, risk_level
from antipode.plans.search_queries import DIM, vectors, with_centroid
from antipode.plans.standins import labelled_documents, table
from antipode.scale import materialize, spread


def document_rows(spark, d):
    """Documents with simple text counts as features and their length class as outcome."""
    text = F.col("text")
    counts = [F.length(F.regexp_replace(text, p, "")).cast("double") / F.greatest(F.length(text), F.lit(1))
              for p in ("[^a-z]", "[^A-Z]", "[^0-9]", "[^ ]", "[^.]")]
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array(*counts).alias("x"))
    return labelled_documents(spark, d).join(docs, "doc_id").select(
        "doc_id", "lang", "quality", "x", array_to_vector(F.col("x")).alias("features"), F.col("score").alias("label"))


@query("fit_per_group", """
SELECT l_suppkey, count(*) AS n, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS slope FROM lineitem GROUP BY 1 HAVING count(*) >= 20""")
def fit_per_group(spark, d):
    rows = spread(table(spark, d, "lineitem")).select("l_suppkey", F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = M.fit_per_group(rows, "l_suppkey", "x", "y", ridge=0.0)
    return m.select("l_suppkey", "n", F.round("intercept", 6).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope"))


@query("fit_pending_groups", """
SELECT l_suppkey, count(*) AS n, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS slope FROM lineitem
WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 200)
GROUP BY 1 HAVING count(*) >= 20""")
def fit_pending_groups(spark, d):
    """Models of the suppliers that a first run over returned items, 200 at least, has not trained."""
    rows = spread(table(spark, d, "lineitem")).select("l_suppkey", "l_returnflag", F.array("l_quantity").alias("x"),
                                                      (F.col("l_extendedprice") / 1000).alias("y"))
    first = M.fit_per_group(rows.where("l_returnflag = 'R'"), "l_suppkey", "x", "y", ridge=0.0, min_records=200)
    m = M.fit_per_group(rows, "l_suppkey", "x", "y", ridge=0.0, trained=first)
    return m.select("l_suppkey", "n", F.round("intercept", 6).alias("intercept"), F.round(F.col("coefficients")[0], 6).alias("slope"))


@query("leave_one_out", """
WITH m AS (SELECT l_suppkey, count(*) AS n, regr_intercept(l_extendedprice / 1000, l_quantity) AS a, regr_slope(l_extendedprice / 1000, l_quantity) AS b,
                  avg(l_quantity) AS mx, regr_sxx(l_extendedprice / 1000, l_quantity) AS sxx
           FROM lineitem GROUP BY 1 HAVING count(*) >= 20)
SELECT l_suppkey, count(*) AS n, round(sqrt(avg(pow((l_extendedprice / 1000 - a - b * l_quantity)
       / (1 - 1.0::DOUBLE / n - pow(l_quantity - mx, 2) / sxx), 2))), 5) AS rmse FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def leave_one_out(spark, d):
    rows = spread(table(spark, d, "lineitem")).select("l_suppkey", F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    scored = M.leave_one_out(rows, "l_suppkey", "x", "y")
    return T.regression_metrics(scored, "y", "predicted", ["l_suppkey"]).select("l_suppkey", "n", F.round("rmse", 5).alias("rmse"))


@query("score_per_group", """
WITH m AS (SELECT l_suppkey, regr_intercept(l_extendedprice / 1000, l_quantity) AS a, regr_slope(l_extendedprice / 1000, l_quantity) AS b
           FROM lineitem GROUP BY 1 HAVING count(*) >= 20)
SELECT l_suppkey, count(*) AS n, round(sqrt(avg(pow(l_extendedprice / 1000 - a - b * l_quantity, 2))), 6) AS rmse FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def score_per_group(spark, d):
    rows = spread(table(spark, d, "lineitem")).select("l_suppkey", F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    scored = M.score_per_group(rows, M.fit_per_group(rows, "l_suppkey", "x", "y", ridge=0.0), "l_suppkey", "x")
    return T.regression_metrics(scored, "y", "predicted", ["l_suppkey"]).select("l_suppkey", "n", F.round("rmse", 6).alias("rmse"))


@query("fit_per_group_ridge")
def fit_per_group_ridge(spark, d):
    """Ridge models per supplier over three features, most groups far above the minimum."""
    rows = spread(table(spark, d, "lineitem")).select("l_suppkey", F.array("l_quantity", "l_discount", "l_tax").alias("x"), "l_extendedprice")
    m = M.fit_per_group(rows, "l_suppkey", "x", "l_extendedprice")
    return m.select("l_suppkey", "n", F.round("intercept", 3).alias("intercept"),
                    F.array_join(F.transform("coefficients", lambda c: F.format_string("%.3f", c)), ",").alias("coefficients"))


@query("assemble_features", """
SELECT vec_id AS entity_id, (64 + 2 + 2 + 16 + 4)::INT AS n_features, round(list_sum(embedding::DOUBLE[]) + label + vec_id % 7 + 0.5 * (label % 3) + 3.0, 7) AS total FROM embeddings""")
def assemble_features(spark, d):
    key = F.col("entity_id")
    rows = vectors(spark, d).withColumn("d1", key % 7).withColumn("s", 0.5 * (F.col("label") % 3)).withColumn("sg", F.lit(0.0)).withColumn(
        "centers", F.array(F.struct(F.lit(1.0).alias("score"), F.lit(-1.0).alias("sign")))).withColumn("e", F.lit(0.75))
    f = M.assemble_features(rows, "vec", ["label", "d1"], "s", "sg", "centers", ["e"] * 4)
    a = vector_to_array("features")
    return f.select("entity_id", F.size(a).alias("n_features"),
                    F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 7).alias("total"))


def pair_features(spark, d):
    rows = with_centroid(spark, d).withColumn("tag", F.col("label").cast("string")).withColumn("div", F.col("sign"))
    tags = [str(i) for i in range(10)]
    names = M.pair_feature_names(DIM, ["label"], tags, ["div"])
    return M.assemble_pair_features(rows, "vec", "center", ["label"], "tag", tags, ["div"]), names


@query("assemble_pair_features", """
SELECT vec_id AS entity_id, (4 * 64 + 1 + 10 + 1)::INT AS n_features FROM embeddings""")
def assemble_pair_features(spark, d):
    f, names = pair_features(spark, d)
    return f.select("entity_id", F.size(vector_to_array("features")).alias("n_features"))


@query("fit_regressor")
def fit_regressor(spark, d):
    """Error of the three model kinds on their training rows."""
    rows = materialize(document_rows(spark, d), "training")
    out = None
    for kind in ("forest", "boosting", "histogram"):
        model = M.fit_regressor(rows, kind, trees=10, depth=3)
        m = T.regression_metrics(model.transform(rows), "label", "prediction").select(
            F.lit(kind).alias("kind"), "n", F.round("mae", 4).alias("mae"), F.round("r2", 4).alias("r2"))
        out = m if out is None else out.unionByName(m)
    return out


@query("fit_global")
def fit_global(spark, d):
    rows = materialize(document_rows(spark, d).drop("features"), "training")  # the texts are read once, not in every pass
    model = M.fit_global(rows, "x", "lang", "label", trees=5)
    scored = model.transform(rows.withColumn("vec_features", array_to_vector(F.col("x"))))
    return scored.select("doc_id", "lang", F.round("prediction", 4).alias("prediction"))


@query("fit_outcome_model")
def fit_outcome_model(spark, d):
    """A forest on the combined vector of each embedding and its label's mean, clamped to an outcome."""
    f, _ = pair_features(spark, d)
    rows = f.withColumn("label", (F.col("label") * 10).cast("double"))
    model = M.fit_regressor(rows, "forest", trees=5, depth=3)
    return M.score_outcomes(model, rows).select("entity_id", F.round("ee", 4).alias("ee"), "major", F.round("confidence", 4).alias("confidence"))


@query("kfold_scores")
def kfold_scores(spark, d):
    rows = document_rows(spark, d).select("doc_id", "features", "label")
    s = M.kfold_scores(rows, "doc_id", 3, M.regressor("forest", 5, 3))
    return s.select("fold", "n", F.round("r2", 4).alias("r2"), F.round("mae", 4).alias("mae"))


@query("leave_group_out")
def leave_group_out(spark, d):
    rows = document_rows(spark, d).select("doc_id", "lang", "features", "label")
    s = M.leave_group_out(rows, "lang", M.fold_values(rows, "lang"), M.regressor("forest", 5, 3))
    return s.select("lang", "n", F.round("rho", 4).alias("rho"), F.round("mae", 4).alias("mae"))


@query("strong_classifier")
def strong_classifier(spark, d):
    rows = document_rows(spark, d).select("doc_id", "features", F.col("quality").cast("double").alias("label"))
    m = M.fit_strong_classifier(rows, "doc_id", k=3, trees=3)
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query("classifier_group_out")
def classifier_group_out(spark, d):
    rows = document_rows(spark, d).select("lang", "features", F.col("quality").cast("double").alias("label"))
    m = M.classifier_group_out(rows, "lang", M.fold_values(rows.where("lang is not null"), "lang"), trees=3)
    return m.select("n", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "auc")])


@query("score_batch")
def score_batch(spark, d):
    rows = document_rows(spark, d)
    model = M.fit_regressor(rows.withColumn("label", F.col("label") * 10), "forest", trees=5, depth=3)
    s = M.score_batch(model, rows.drop("label"))
    return s.select("doc_id", F.round("fold_change", 4).alias("fold_change"), F.round("confidence", 4).alias("confidence"), "is_sensitive")


@query("fit_property_models")
def fit_property_models(spark, d):
    """A model per property class over the line items, with the risk its mean prediction means."""
    prop = property_class(F.col("kind"), F.col("assay_type"), F.col("target_name"))
    rows = property_rows(spark, d).select(prop.alias("property"), F.col("value").alias("label"), array_to_vector(F.array(
        (F.col("l_extendedprice") / 1000), F.col("l_partkey").cast("double"))).alias("features")).where(F.col("property").isNotNull())
    rows = materialize(spread(rows), "training")
    models = M.fit_property_models(rows, trees=5)
    out = None
    for name, model in models.items():
        p = model.transform(rows.where(F.col("property") == name)).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("value")).select(
            F.lit(name).alias("property"), "n", F.round("value", 4).alias("value"))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("risk", risk_level(F.col("property"), F.col("value")))


@query("top_importances")
def top_importances(spark, d):
    f, names = pair_features(spark, d)
    model = M.fit_regressor(f.withColumn("label", F.col("label").cast("double")), "forest", trees=5, depth=3)
    top = M.top_importances(model, names)
    return spark.createDataFrame([(i + 1, n, round(v, 4)) for i, (n, v) in enumerate(top)], "rank int, feature string, importance double")
