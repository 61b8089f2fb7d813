"""Tree models per group, over all rows and out of fold, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from antipode.functions.rules import clamp_outcome, property_class, risk_level, sensitivity
from antipode.operators import forests as T
from antipode.operators.stats import regression_metrics
from antipode.plans.registry import query
from antipode.plans.rule_queries import PROP_SQL, property_rows, risk_sql
from antipode.plans.stat_queries import spearman_sql
from antipode.plans.standins import table
from antipode.scale import spread

#: The tables hold at most 50 different quantities: every value is a cut and splits are exact.
BINS = 64
LEAF = 5

ITEMS_SQL = """
  SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, [l_quantity, l_discount, l_tax] AS x, l_extendedprice / 1000 AS y
  FROM lineitem"""


def items(spark, d):
    return spread(table(spark, d, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.array("l_quantity", "l_discount", "l_tax").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 5).alias("fold"))


def best_split_sql(cells: str, key: str) -> str:
    """CTEs ending in ``best``: the split of each ``key`` from sums (w, s) per feature f and value v."""
    return f"""
  run AS (SELECT {key}, f, v, sum(w) OVER o AS lw, sum(s) OVER o AS ls, sum(w) OVER a AS tw, sum(s) OVER a AS ts FROM {cells} WHERE w > 0
          WINDOW o AS (PARTITION BY {key}, f ORDER BY v), a AS (PARTITION BY {key}, f)),
  gains AS (SELECT *, ls * ls / lw + (ts - ls) * (ts - ls) / (tw - lw) - ts * ts / tw AS gain FROM run WHERE lw >= {LEAF} AND tw - lw >= {LEAF}),
  best AS (SELECT {key}, tw::BIGINT AS n, f AS feature, v AS cut, ls / lw AS lo, (ts - ls) / (tw - lw) AS hi, gain FROM gains
           WHERE round(gain, 8) > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(gain, 8) DESC, f, v) = 1)"""


def cells_sql(source: str, key: str, y: str = "y", size: int = 3) -> str:
    return (f"SELECT {key}, f, x[f + 1] AS v, count(*)::DOUBLE AS w, sum({y})::DOUBLE AS s FROM {source}, range({size}) AS t(f) GROUP BY ALL")


GROUP_CTE = f"items AS ({ITEMS_SQL}), cells AS ({cells_sql('items', 'l_suppkey')}), {best_split_sql('cells', 'l_suppkey')}"


@query("fit_per_group_trees", f"""
WITH {GROUP_CTE}
SELECT l_suppkey, n, feature::INT AS feature, cut, round(lo, 6) AS left_mean, round(hi, 6) AS right_mean, round(gain, 3) AS gain FROM best WHERE n >= 20""")
def fit_per_group_trees(spark, d):
    """The first split of every supplier's tree."""
    models = T.fit_per_group_trees(items(spark, d), "l_suppkey", "x", "y", depth=1, min_leaf=LEAF, bins=BINS)
    node = F.col("trees")[0]["nodes"][0]
    return models.where(node.isNotNull()).select(
        "l_suppkey", "n", node["feature"].alias("feature"), node["cut"].alias("cut"), F.round(node["left"], 6).alias("left_mean"),
        F.round(node["right"], 6).alias("right_mean"), F.round(node["gain"], 3).alias("gain"))


@query("score_per_group_trees", f"""
WITH {GROUP_CTE}, root AS (SELECT l_suppkey, avg(y) AS mean FROM items GROUP BY 1 HAVING count(*) >= 20)
SELECT l_suppkey, count(*) AS n, round(sqrt(avg(pow(y - coalesce(CASE WHEN x[feature + 1] > cut THEN hi ELSE lo END, mean), 2))), 6) AS rmse
FROM items JOIN root USING (l_suppkey) LEFT JOIN best USING (l_suppkey) GROUP BY 1""")
def score_per_group_trees(spark, d):
    rows = items(spark, d)
    models = T.fit_per_group_trees(rows, "l_suppkey", "x", "y", depth=1, min_leaf=LEAF, bins=BINS)
    scored = T.score_per_group_trees(rows, models, "l_suppkey", "x", depth=1)
    return regression_metrics(scored, "y", "predicted", ["l_suppkey"]).select("l_suppkey", "n", F.round("rmse", 6).alias("rmse"))


@query("group_forests")
def group_forests(spark, d):
    """Forests of eight trees per supplier; tested against exact splits on small data."""
    rows = items(spark, d).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    models = T.fit_per_group_trees(rows, "l_suppkey", "x", "y", depth=3, trees=8, key="key", share=0.7, bins=BINS)
    scored = T.score_per_group_trees(rows, models, "l_suppkey", "x", depth=3)
    return regression_metrics(scored, "y", "predicted", ["l_suppkey"]).select("l_suppkey", "n", F.round("rmse", 4).alias("rmse"))


# sums of all rows outside a fold: those of all folds minus the fold's own
def complement_sql(fold: str, y: str = "y") -> str:
    return f"""
  own AS ({cells_sql('items', fold, y)}), whole AS (SELECT f, v, sum(w) AS w, sum(s) AS s FROM own GROUP BY ALL),
  cells AS (SELECT k.{fold}, a.f, a.v, a.w - coalesce(o.w, 0) AS w, a.s - coalesce(o.s, 0) AS s
            FROM whole a CROSS JOIN (SELECT DISTINCT {fold} FROM own) k LEFT JOIN own o ON o.{fold} = k.{fold} AND o.f = a.f AND o.v = a.v),
  {best_split_sql('cells', fold)},
  root AS (SELECT {fold}, (sum(sum(y)) OVER () - sum(y)) / (sum(count(*)) OVER () - count(*)) AS mean FROM (SELECT {fold}, {y} AS y FROM items) GROUP BY 1),
  scored AS (SELECT items.*, coalesce(CASE WHEN x[feature + 1] > cut THEN hi ELSE lo END, mean) AS p
             FROM items JOIN root USING ({fold}) LEFT JOIN best USING ({fold}))"""


FOLDED_SQL = f"items AS (SELECT *, l_orderkey % 5 AS fold, (l_returnflag = 'R')::INT AS label FROM ({ITEMS_SQL}))"


@query("fold_tree_scores", f"""
WITH {FOLDED_SQL}, {complement_sql('fold')}
SELECT fold, count(*) AS n, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 6) AS mae FROM scored GROUP BY 1""")
def fold_tree_scores(spark, d):
    s = T.fold_scores(items(spark, d), "fold", "x", "y", depth=1, min_leaf=LEAF, bins=BINS)
    return s.select("fold", "n", F.round("r2", 6).alias("r2"), F.round("mae", 6).alias("mae"))


@query("tag_out_tree_scores", f"""
WITH items AS ({ITEMS_SQL}), {complement_sql('l_suppkey')}, e AS (SELECT l_suppkey, avg(abs(y - p)) AS mae FROM scored GROUP BY 1),
rho AS (WITH {spearman_sql('scored', 'y', 'p', 'l_suppkey')})
SELECT l_suppkey, n, round(rho, 6) AS rho, round(mae, 6) AS mae FROM rho JOIN e USING (l_suppkey) WHERE n >= 2""")
def tag_out_tree_scores(spark, d):
    """Every supplier predicted by the tree of all the others: as many models as suppliers, in one pass over the items."""
    s = T.tag_out_scores(items(spark, d), "l_suppkey", "x", "y", depth=1, min_leaf=LEAF, bins=BINS)
    return s.select("l_suppkey", "n", F.round("rho", 6).alias("rho"), F.round("mae", 6).alias("mae"))


@query("fold_tree_classifier", f"""
WITH {FOLDED_SQL}, {complement_sql('fold', 'label')},
 k AS (SELECT label, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scored),
 c AS (SELECT count(*) AS n, count_if(p >= 0.5 AND label = 1) / nullif(count_if(p >= 0.5), 0) AS precision,
              count_if(p >= 0.5 AND label = 1) / nullif(count_if(label = 1), 0) AS recall,
              (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)
                / nullif((sum(label) * (count(*) - sum(label)))::DOUBLE, 0) AS auc FROM k)
SELECT n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1,
       round(auc, 6) AS auc FROM c""")
def fold_tree_classifier(spark, d):
    rows = items(spark, d).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    m = T.fold_classifier(rows, "fold", "x", "label", depth=1, min_leaf=LEAF, bins=BINS)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "auc")])


TREE_CTE = f"""
  items AS ({ITEMS_SQL}), one AS ({cells_sql('(SELECT *, 1 AS node FROM items)', 'node')}), first AS (WITH {best_split_sql('one', 'node')} SELECT * FROM best),
  sides AS (SELECT items.*, CASE WHEN items.x[feature + 1] > cut THEN 3 ELSE 2 END AS node FROM items, first),
  two AS ({cells_sql('sides', 'node')}), second AS (WITH {best_split_sql('two', 'node')} SELECT * FROM best),
  nodes AS (SELECT * FROM first UNION ALL SELECT * FROM second),
  predicted AS (SELECT s.*, coalesce(CASE WHEN s.x[b.feature + 1] > b.cut THEN b.hi ELSE b.lo END, CASE WHEN s.node = 3 THEN a.hi ELSE a.lo END) AS p
                FROM sides s CROSS JOIN first a LEFT JOIN second b ON b.node = s.node)"""


def tree_model(spark, d):
    return T.fit_trees(items(spark, d), "x", "y", depth=2, min_leaf=LEAF, bins=BINS)


@query("regression_tree", f"""
WITH {TREE_CTE} SELECT node, feature::INT AS feature, cut, round(lo, 6) AS left_mean, round(hi, 6) AS right_mean FROM nodes""")
def regression_tree(spark, d):
    """Nodes of one tree of two levels over all items."""
    n = tree_model(spark, d).select(F.explode("trees").alias("t")).select(F.explode("t.nodes").alias("n")).where("n IS NOT NULL")
    return n.select("n.node", "n.feature", "n.cut", F.round("n.left", 6).alias("left_mean"), F.round("n.right", 6).alias("right_mean"))


@query("tree_importances", f"""
WITH {TREE_CTE} SELECT feature::INT AS feature, round(sum(gain) / sum(sum(gain)) OVER (), 6) AS importance FROM nodes GROUP BY feature""")
def tree_importances(spark, d):
    return T.importances(tree_model(spark, d)).select("feature", F.round("importance", 6).alias("importance"))


@query("tree_score_batch", f"""
WITH {TREE_CTE}, f AS (SELECT l_orderkey, l_linenumber, greatest(p / 10, 1.0) AS fold FROM predicted)
SELECT l_orderkey, l_linenumber, round(fold, 6) AS fold_change, round(least(fold / 6.0::DOUBLE, 1.0), 6) AS confidence, fold >= 3.0 AS is_sensitive FROM f""")
def tree_score_batch(spark, d):
    scored = T.score_trees(items(spark, d), tree_model(spark, d), "x", depth=2)
    fold, confidence, flag = sensitivity(F.col("predicted") / 10)
    return scored.select("l_orderkey", "l_linenumber", F.round(fold, 6).alias("fold_change"), F.round(confidence, 6).alias("confidence"),
                         flag.alias("is_sensitive"))


@query("tree_outcomes", f"""
WITH {TREE_CTE}, f AS (SELECT l_orderkey, l_linenumber, p - 40 AS q FROM predicted)
SELECT l_orderkey, l_linenumber, round(least(abs(q), 100.0), 6) AS ee, CASE WHEN q >= 0 THEN 'R' ELSE 'S' END AS major,
       round(least(least(abs(q), 100.0) / 100.0::DOUBLE, 1.0), 6) AS confidence FROM f""")
def tree_outcomes(spark, d):
    """Signed predictions as clamped outcomes."""
    scored = T.score_trees(items(spark, d), tree_model(spark, d), "x", depth=2)
    size, side, confidence = clamp_outcome(F.col("predicted") - 40)
    return scored.select("l_orderkey", "l_linenumber", F.round(size, 6).alias("ee"), side.alias("major"), F.round(confidence, 6).alias("confidence"))


@query("property_tree_models", f"""
WITH items AS (SELECT property, value AS y, [(l_linenumber)::DOUBLE, floor(l_extendedprice / 5000)] AS x FROM ({PROP_SQL}) WHERE property IS NOT NULL),
  cells AS ({cells_sql('items', 'property', size=2)}), {best_split_sql('cells', 'property')},
  root AS (SELECT property, count(*) AS n, avg(y) AS value FROM items GROUP BY 1 HAVING count(*) >= 10)
SELECT property, root.n, feature::INT AS feature, cut, round(lo, 6) AS left_mean, round(hi, 6) AS right_mean, {risk_sql('property', 'value')} AS risk
FROM root JOIN best USING (property)""")
def property_tree_models(spark, d):
    """A tree per property class, all in one pass, with the risk its mean means."""
    prop = property_class(F.col("kind"), F.col("assay_type"), F.col("target_name"))
    rows = property_rows(spark, d).select(prop.alias("property"), "value", F.array(
        F.col("l_linenumber").cast("double"), F.floor(F.col("l_extendedprice") / 5000).cast("double")).alias("x"))
    models = T.fit_per_group_trees(rows, "property", "x", "value", depth=1, min_records=10, min_leaf=LEAF, bins=BINS)
    tree = F.col("trees")[0]
    node = tree["nodes"][0]
    return models.where(node.isNotNull()).select(
        "property", "n", node["feature"].alias("feature"), node["cut"].alias("cut"), F.round(node["left"], 6).alias("left_mean"),
        F.round(node["right"], 6).alias("right_mean"), risk_level(F.col("property"), tree["value"]).alias("risk"))
