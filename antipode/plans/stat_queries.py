"""Corpus statistics, filters and rankings on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from antipode.operators import stats as T
from antipode.plans.registry import query
from antipode.plans.standins import (
    FOLD_SQL, OUT_SQL, STRUCT_CTE, labelled_documents, outcomes, structures, table,
)


def r(*names: str, digits: int = 9):
    return [F.round(n, digits).alias(n) for n in names]


RANGE_SQL = ("CASE " + " ".join(f"WHEN sg BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in T.RANGE_CLASSES)
             + " END")


def bins_sql(col, bins):
    return "CASE " + " ".join(f"WHEN {col} >= {lo} AND {col} < {hi} THEN {i}" for i, (lo, hi) in enumerate(bins)) + " END"


@query("counts_by", "SELECT coalesce(catalyst, 'unknown') AS catalyst, count(*) AS n FROM (" + OUT_SQL + ") GROUP BY 1")
def counts_by(spark, d):
    return T.counts_by(outcomes(spark, d), "catalyst")


@query("category_shares", """
SELECT p_type, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 9) AS pct FROM part GROUP BY 1""")
def category_shares(spark, d):
    return T.category_shares(table(spark, d, "part"), "p_type").select("p_type", "n", *r("pct"))


@query("value_summary", f"""
SELECT count(ee) AS n, round(avg(ee), 7) AS mean, count_if(ee > 90)::BIGINT AS n_above_90,
       count_if(ee > 95)::BIGINT AS n_above_95, round(quantile_cont(ee, 0.5), 7) AS median FROM ({OUT_SQL})""")
def value_summary(spark, d):
    return T.value_summary(outcomes(spark, d), "ee").select("n", *r("mean", "median", digits=7), "n_above_90", "n_above_95")


@query("by_range_class", f"""
WITH {STRUCT_CTE}
SELECT {RANGE_SQL} AS range_class, count(saturation) AS n, round(avg(saturation), 9) AS mean,
       round(stddev_samp(saturation), 9) AS stdev, round(quantile_cont(saturation, 0.5), 9) AS median
FROM st GROUP BY 1""")
def by_range_class(spark, d):
    return T.by_range_class(structures(spark, d), "sg", "saturation").select(
        "range_class", "n", *r("mean", "stdev", "median"))


@query("element_shares", f"""
WITH {STRUCT_CTE}, e AS (SELECT unnest(labels) AS label FROM st WHERE activity > 0.5)
SELECT label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM e), 9) AS pct
FROM e GROUP BY 1 ORDER BY n DESC, label LIMIT 15""")
def element_shares(spark, d):
    return T.label_shares(structures(spark, d).where(F.col("activity") > 0.5), "labels").select("label", "n", *r("pct"))


@query("group_mean_topn", f"""
WITH {STRUCT_CTE}
SELECT sg, count(*) AS n, round(avg(activity), 9) AS mean FROM st GROUP BY 1 HAVING count(*) >= 10
ORDER BY avg(activity) DESC, sg LIMIT 5""")
def group_mean_topn(spark, d):
    return T.group_mean_topn(structures(spark, d), "sg", "activity").select("sg", "n", *r("mean"))


BINS_SQL = f"""
WITH {STRUCT_CTE}, b AS (
  SELECT {bins_sql('activity', T.ACTIVITY_BINS)} AS bin, count(*) AS n, avg(activity) AS mean_x, avg(saturation) AS mean_y
  FROM st GROUP BY 1 HAVING count(*) >= 10 AND {bins_sql('activity', T.ACTIVITY_BINS)} IS NOT NULL)
"""


@query("bin_means", BINS_SQL + """
SELECT bin::INT AS bin, n, round(mean_x, 9) AS mean_x, round(mean_y, 9) AS mean_y FROM b""")
def bin_means(spark, d):
    return T.bin_means(structures(spark, d), "activity", "saturation", T.ACTIVITY_BINS).select(
        "bin", "n", *r("mean_x", "mean_y"))


@query("log_fit", BINS_SQL + """, l AS (SELECT mean_x, ln(1 - mean_y) AS ly FROM b WHERE mean_y < 1)
SELECT count(*) AS n_bins, round(regr_slope(ly, mean_x), 7) AS slope, round(regr_intercept(ly, mean_x), 7) AS intercept,
       round(regr_r2(ly, mean_x), 7) AS r2 FROM l""")
def log_fit(spark, d):
    b = T.bin_means(structures(spark, d), "activity", "saturation", T.ACTIVITY_BINS)
    return T.log_fit(b).select("n_bins", *r("slope", "intercept", "r2", digits=7))


@query("flag_rates", f"""
WITH {STRUCT_CTE}
SELECT n_atoms AS group_value, count(*) AS n, round(avg((sign < 0)::DOUBLE), 9) AS rate FROM st GROUP BY 1""")
def flag_rates(spark, d):
    return T.flag_rates(structures(spark, d), F.col("n_atoms"), F.col("sign") < 0).select("group_value", "n", *r("rate"))


@query("rate_contrast", f"""
WITH {STRUCT_CTE}, x AS (
  SELECT avg((sign < 0)::DOUBLE) FILTER (n_atoms = 10) AS a, avg((sign < 0)::DOUBLE) FILTER (n_atoms = 20) AS b FROM st)
SELECT round(a, 9) AS rate_first, round(b, 9) AS rate_second, round(b - a, 9) AS difference, round(b / nullif(a, 0), 9) AS ratio FROM x""")
def rate_contrast(spark, d):
    return T.rate_contrast(structures(spark, d), F.col("n_atoms"), F.col("sign") < 0, 10, 20).select(
        *r("rate_first", "rate_second", "difference", "ratio"))


@query("decile_histogram", f"""
WITH {STRUCT_CTE} SELECT least(floor(saturation * 10), 9)::INT AS bin, count(*) AS n FROM st WHERE saturation IS NOT NULL GROUP BY 1""")
def decile_histogram(spark, d):
    return T.decile_histogram(structures(spark, d), "saturation")


@query("histogram_peaks", f"""
WITH {STRUCT_CTE}, h AS (SELECT least(floor(saturation * 10), 9)::INT AS bin, count(*) AS n FROM st WHERE saturation IS NOT NULL GROUP BY 1),
 t AS (SELECT bin AS peak_bin, n AS peak_n FROM h ORDER BY n DESC, bin LIMIT 1)
SELECT peak_bin, peak_n, count_if(abs(bin - peak_bin) >= 3 AND n > 0.8 * peak_n)::BIGINT AS n_secondary FROM h, t GROUP BY ALL""")
def histogram_peaks(spark, d):
    return T.peaks(T.decile_histogram(structures(spark, d), "saturation"))


@query("pearson", f"WITH {STRUCT_CTE} SELECT round(corr(activity, saturation), 9) AS r FROM st")
def pearson(spark, d):
    return T.pearson(structures(spark, d), "activity", "saturation").select(*r("r"))


def spearman_sql(source, x, y, by=""):
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""
 p AS (SELECT {key}{x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
 q AS (SELECT {key}rank() OVER ({part}ORDER BY x) + (count(*) OVER (PARTITION BY {key}x) - 1) / 2.0::DOUBLE AS rx,
              rank() OVER ({part}ORDER BY y) + (count(*) OVER (PARTITION BY {key}y) - 1) / 2.0::DOUBLE AS ry FROM p)
SELECT {key}count(*) AS n, round(corr(rx, ry), 9) AS rho FROM q {'GROUP BY ' + by if by else ''}"""


@query("spearman", "WITH o AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem)," + spearman_sql("o", "a", "b"))
def spearman(spark, d):
    return T.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select("n", *r("rho"))


@query("spearman_by_group", "WITH o AS (SELECT * FROM lineitem)," + spearman_sql("o", "l_quantity", "l_discount", "l_returnflag"))
def spearman_by_group(spark, d):
    return T.spearman(table(spark, d, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]).select(
        "l_returnflag", "n", *r("rho"))


@query("quartile_contrast", f"""
WITH {STRUCT_CTE}, q AS (SELECT quantile_cont(activity, 0.25) AS q25, quantile_cont(activity, 0.5) AS q50, quantile_cont(activity, 0.75) AS q75 FROM st)
SELECT round(q25, 9) AS q25, round(q50, 9) AS q50, round(q75, 9) AS q75, count_if(activity < q25)::BIGINT AS n_low,
       count_if(activity > q75)::BIGINT AS n_high, round(avg(saturation) FILTER (activity < q25), 9) AS mean_low,
       round(avg(saturation) FILTER (activity > q75), 9) AS mean_high
FROM st, q GROUP BY q25, q50, q75""")
def quartile_contrast(spark, d):
    return T.quartile_contrast(structures(spark, d), "activity", "saturation").select(
        *r("q25", "q50", "q75"), "n_low", "n_high", *r("mean_low", "mean_high"))


@query("describe_metric", f"""
WITH {STRUCT_CTE}
SELECT sg, count(activity) AS n, round(avg(activity), 9) AS mean, round(stddev_pop(activity), 9) AS std,
       min(activity) AS min, max(activity) AS max, count_if(sign > 0) > count(*) / 2 AS majority
FROM st GROUP BY 1""")
def describe_metric(spark, d):
    s = structures(spark, d).withColumn("pos", F.col("sign") > 0)
    return T.describe_metric(s, "activity", "pos", ["sg"]).select("sg", "n", *r("mean", "std"), "min", "max", "majority")


@query("diversity_means", f"""
WITH {STRUCT_CTE}
SELECT len(list_distinct(labels))::INT AS n_distinct, count(*) AS n, round(avg(activity), 9) AS mean FROM st GROUP BY 1""")
def diversity_means(spark, d):
    return T.diversity_means(structures(spark, d), "labels", "activity").select("n_distinct", "n", *r("mean"))


VOLUME_BINS = ((0.0, 500.0), (500.0, 2000.0), (2000.0, 10000.0), (10000.0, 1e9))

VOLUME_SQL = """
WITH v AS (SELECT l_extendedprice AS price,
  l_quantity * (1 + l_linenumber) * (2 + l_quantity / 10) * sqrt(1 - pow(cos(radians(80 + l_linenumber)), 2)
    - pow(cos(radians(85 + l_tax * 100)), 2) - pow(cos(radians(90 - l_discount * 100)), 2)
    + 2 * cos(radians(80 + l_linenumber)) * cos(radians(85 + l_tax * 100)) * cos(radians(90 - l_discount * 100))) AS v
  FROM lineitem)"""


def cells(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    v = T.cell_volume(q, 1 + n, 2 + q / 10, 80 + n, 85 + F.col("l_tax") * 100, 90 - F.col("l_discount") * 100)
    return table(spark, d, "lineitem").select(v.alias("v"), F.col("l_extendedprice").alias("price"))


@query("cell_volume_bins", VOLUME_SQL + f"""
SELECT {bins_sql('v', VOLUME_BINS)}::INT AS bin, count(*) AS n, round(avg(v), 4) AS mean_x, round(avg(price), 4) AS mean_y
FROM v GROUP BY 1 HAVING count(*) >= 10 AND bin IS NOT NULL""")
def cell_volume_bins(spark, d):
    return T.bin_means(cells(spark, d), "v", "price", VOLUME_BINS).select("bin", "n", *r("mean_x", "mean_y", digits=4))


@query("cell_volume_corr", VOLUME_SQL + " SELECT round(corr(ln(v), price), 7) AS r FROM v")
def cell_volume_corr(spark, d):
    return cells(spark, d).agg(F.round(T.correlation(F.log("v"), "price"), 7).alias("r"))


@query("regression_metrics", f"""
WITH f AS ({FOLD_SQL})
SELECT lang, count(*) AS n, round(avg(abs(quality - score)), 9) AS mae, round(sqrt(avg(pow(quality - score, 2))), 9) AS rmse,
       round(1 - sum(pow(quality - score, 2)) / nullif(var_pop(quality) * count(*), 0), 9) AS r2,
       round(corr(quality, score), 9) AS r, count_if((score >= 0.5) = (quality = 1))::BIGINT AS n_class_match
FROM f GROUP BY 1""")
def regression_metrics(spark, d):
    m = T.regression_metrics(labelled_documents(spark, d), "quality", "score", ["lang"],
                             (F.col("score") >= 0.5) == (F.col("quality") == 1))
    return m.select("lang", "n", *r("mae", "rmse", "r2", "r"), "n_class_match")


@query("binary_metrics", f"""
WITH f AS ({FOLD_SQL}), k AS (SELECT quality, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM f),
 c AS (SELECT count(*) AS n, count_if(score >= 0.5 AND quality = 1) / nullif(count_if(score >= 0.5), 0) AS precision,
              count_if(score >= 0.5 AND quality = 1) / nullif(count_if(quality = 1), 0) AS recall,
              (sum(rk) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE)
                / nullif((sum(quality) * (count(*) - sum(quality)))::DOUBLE, 0) AS auc FROM k)
SELECT n, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1, round(auc, 9) AS auc FROM c""")
def binary_metrics(spark, d):
    return T.binary_metrics(labelled_documents(spark, d), "quality", "score").select(
        "n", *r("precision", "recall", "f1", "auc"))


@query("group_out_metrics", f"WITH f AS ({FOLD_SQL})," + spearman_sql("f", "quality", "score", "fold"))
def group_out_metrics(spark, d):
    """Per fold: rank correlation of actual and predicted."""
    return T.spearman(labelled_documents(spark, d), "quality", "score", ["fold"]).select("fold", "n", *r("rho"))


@query("mean_baseline", f"""
WITH f AS ({FOLD_SQL}), t AS (SELECT sum(score) AS s, count(*) AS n FROM f), g AS (SELECT fold, sum(score) AS s, count(*) AS n FROM f GROUP BY 1)
SELECT count(*) AS n, round(avg(abs(score - (t.s - g.s) / (t.n - g.n))), 9) AS mae FROM f JOIN g USING (fold), t""")
def mean_baseline(spark, d):
    return T.mean_baseline(labelled_documents(spark, d), "fold", "score").select("n", *r("mae"))


@query("shape_stats", f"""
WITH {STRUCT_CTE}, h AS (SELECT least(floor(saturation * 10), 9)::INT AS bin, count(*) AS n FROM st WHERE saturation IS NOT NULL GROUP BY 1)
SELECT count(saturation) AS n, round(avg(saturation), 9) AS mean, round(kurtosis_pop(saturation), 7) AS kurtosis,
       round(skewness(saturation) * (count(saturation) - 2) / sqrt(count(saturation) * (count(saturation) - 1)::DOUBLE), 7) AS skewness,
       round(quantile_cont(saturation, 0.5), 9) AS median, (SELECT bin FROM h ORDER BY n DESC, bin LIMIT 1) AS mode_bin FROM st""")
def shape_stats(spark, d):
    return T.shape_stats(structures(spark, d), "saturation").select(
        "n", *r("mean", "median"), *r("kurtosis", "skewness", digits=7), "mode_bin")


@query("row_count", "SELECT count(*) AS n_rows FROM lineitem")
def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))


@query("two_way_means", f"""
WITH {STRUCT_CTE}, c AS (SELECT {RANGE_SQL} AS range_class, * FROM st)
SELECT coalesce(range_class, 'Overall') AS range_class, count_if(sign > 0)::BIGINT AS n_flag, count_if(NOT sign > 0)::BIGINT AS n_other,
       round(avg(activity) FILTER (sign > 0), 9) AS mean_flag, round(avg(activity) FILTER (NOT sign > 0), 9) AS mean_other
FROM c GROUP BY GROUPING SETS ((range_class), ())""")
def two_way_means(spark, d):
    s = structures(spark, d).withColumn("range_class", T.range_class(F.col("sg")))
    return T.two_way_means(s, "range_class", F.col("sign") > 0, "activity").select(
        "range_class", "n_flag", "n_other", *r("mean_flag", "mean_other"))


@query("ordinal_rate_corr", f"""
WITH {STRUCT_CTE}, c AS (SELECT {RANGE_SQL} AS rc, min(sg) AS o, avg((sign < 0)::DOUBLE) AS rate FROM st GROUP BY 1)
SELECT count(*) AS n_classes, round(corr(o, rate), 9) AS r FROM c""")
def ordinal_rate_corr(spark, d):
    s = structures(spark, d).withColumn("range_class", T.range_class(F.col("sg")))
    return T.ordinal_rate_corr(s, "range_class", F.col("sg"), F.col("sign") < 0).select("n_classes", *r("r"))


@query("means_by_contained_label", f"""
WITH {STRUCT_CTE}, e AS (SELECT unnest(list_distinct(labels)) AS label, activity, saturation FROM st)
SELECT label, count(*) AS n, round(avg(activity), 9) AS mean_activity, round(avg(saturation), 9) AS mean_saturation
FROM e GROUP BY 1""")
def means_by_contained_label(spark, d):
    return T.means_by_contained_label(structures(spark, d), "labels", ["activity", "saturation"]).select(
        "label", "n", *r("mean_activity", "mean_saturation"))


@query("any_of_contrast", f"""
WITH {STRUCT_CTE}
SELECT list_has_any(labels, ['red', 'ring']) AS contains_any, count(*) AS n, round(avg(activity), 9) AS mean_activity FROM st GROUP BY 1""")
def any_of_contrast(spark, d):
    return T.any_of_contrast(structures(spark, d), "labels", ["red", "ring"], ["activity"]).select(
        "contains_any", "n", *r("mean_activity"))


@query("extreme_subset_stats", """
WITH t AS (SELECT * FROM lineitem WHERE l_discount = (SELECT max(l_discount) FROM lineitem))
SELECT count(*) AS n, round(avg(l_quantity), 9) AS mean, min(l_quantity) AS min, max(l_quantity) AS max,
       round(quantile_cont(l_quantity, 0.5), 9) AS median FROM t""")
def extreme_subset_stats(spark, d):
    return T.extreme_subset_stats(table(spark, d, "lineitem"), "l_discount", "l_quantity").select(
        "n", *r("mean", "median"), "min", "max")


SIZE_BINS = ((1, 10), (10, 25), (25, 51))


@query("ratio_by_size_bin", f"""
SELECT {bins_sql('l_quantity', SIZE_BINS)}::INT AS bin, count(*) AS n, round(avg(l_extendedprice / l_quantity), 5) AS mean_ratio
FROM lineitem GROUP BY 1 HAVING bin IS NOT NULL""")
def ratio_by_size_bin(spark, d):
    return T.ratio_by_size_bin(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", SIZE_BINS).select(
        "bin", "n", *r("mean_ratio", digits=5))


@query("group_by_nullable", f"""
SELECT coalesce(catalyst, 'unknown') AS catalyst, count(*) AS n, round(avg(ee), 9) AS mean_ee FROM ({OUT_SQL}) GROUP BY 1""")
def group_by_nullable(spark, d):
    o = outcomes(spark, d)
    return o.groupBy(F.coalesce("catalyst", F.lit("unknown")).alias("catalyst")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ee"), 9).alias("mean_ee"))


# ------------------------------------------------------- filters and pages

@query("mismatch_filter", f"""
WITH {STRUCT_CTE} SELECT id, activity, saturation FROM st WHERE saturation > 0.5 AND activity < 0.4 ORDER BY activity, id LIMIT 10""")
def mismatch_filter(spark, d):
    return T.mismatch_filter(structures(spark, d), "saturation", "activity", 0.5, 0.4).select("id", "activity", "saturation")


@query("list_page", """
SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders
WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40""")
def list_page(spark, d):
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    return T.list_page(o, "o_orderkey", 40, 20).select("o_orderkey", "o_custkey", "total")


@query("slim_page", """
SELECT o_orderkey, o_custkey, count(l_partkey)::BIGINT AS n_parts, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers,
       (SELECT count(*) FROM orders) AS total
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'
GROUP BY o_orderkey, o_custkey ORDER BY o_orderkey LIMIT 50 OFFSET 100""")
def slim_page(spark, d):
    """Orders with the numbers of their returned parts and the suppliers of those."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(
        F.collect_list("l_partkey").alias("parts"), F.collect_set("l_suppkey").alias("suppliers"))  # the few lines of an order
    o = table(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return T.slim_page(o, "o_orderkey", ["o_custkey"], ["parts", "suppliers"], 100, 50)


@query("member_flag", f"""
WITH {STRUCT_CTE} SELECT id, sg, sg IN {T.MEMBER_GROUPS} AS is_member FROM st""")
def member_flag(spark, d):
    return structures(spark, d).select("id", "sg", T.member_flag(F.col("sg")).alias("is_member"))


@query("topk_per_group", """
SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_extendedprice, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey) AS rank
  FROM lineitem) WHERE rank <= 20""")
def topk_per_group(spark, d):
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return T.top_rows(table(spark, d, "lineitem"), order, 20, ["l_returnflag"]).select(
        "l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "rank")


@query("top_rows", f"""
WITH {STRUCT_CTE} SELECT id, activity, saturation FROM st ORDER BY activity DESC, id LIMIT 20""")
def top_rows(spark, d):
    return T.top_rows(structures(spark, d), [F.desc("activity"), F.asc("id")], 20).select("id", "activity", "saturation")
