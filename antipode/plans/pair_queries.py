"""Pair discovery and differential screening on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.functions import labels as L
from antipode.operators import pairs as P
from antipode.operators import screening as S
from antipode.plans.registry import query
from antipode.scale import materialize
from antipode.plans.standins import (
    CUSTOMER_FORMS_SQL, KINDS, MEAS_SQL, PROFILE_CTE, bit_labels, customer_entities, lineitem_measurements,
    supplier_entities, table,
)

MIN_FOLD = 1.2


def supplier_pairs(spark, d) -> DataFrame:
    """The pair stage, written once: every supplier labels the same two sites."""
    return materialize(P.related_pairs(supplier_entities(spark, d), max_flips=1, uneven_sites=False), "pairs")


def profile(spark, d, pairs: DataFrame | None = None) -> DataFrame:
    pairs = supplier_pairs(spark, d) if pairs is None else pairs
    return S.pair_target_profile(pairs, lineitem_measurements(spark, d), KINDS)


def summary(spark, d) -> DataFrame:
    pairs = supplier_pairs(spark, d)
    return S.pair_summary(pairs, profile(spark, d, pairs), MIN_FOLD)


def hits(spark, d) -> DataFrame:
    return S.pair_hits(summary(spark, d))


def r6(name: str):
    return F.round(name, 6).alias(name)


def r8(name: str):
    return F.round(name, 8).alias(name)


@query("differential_summary", f"""
WITH {PROFILE_CTE}
SELECT class_key, a_id, b_id, relationship, n_shared, n_comparable, n_differential,
       round(max_fold, 6) AS max_fold, round(max_fold * n_differential, 6) AS priority
FROM summary WHERE n_differential > 0""")
def differential_summary(spark, d):
    s = summary(spark, d).where(F.col("n_differential") > 0)
    return s.select("class_key", "a_id", "b_id", "relationship", "n_shared", "n_comparable", "n_differential",
                    r6("max_fold"), F.round(F.col("max_fold") * F.col("n_differential"), 6).alias("priority"))


@query("enumerate_pairs", f"""
WITH forms AS ({CUSTOMER_FORMS_SQL})
SELECT x.class_key, least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id,
       bit_count(xor(x.code, y.code))::INT AS n_flips,
       CASE WHEN bit_count(xor(x.code, y.code)) = 3 THEN 'enantiomer' ELSE 'diastereomer' END AS relationship
FROM forms x JOIN forms y ON x.class_key = y.class_key AND x.code < y.code""")
def enumerate_pairs(spark, d):
    return P.related_pairs(customer_entities(spark, d), max_flips=2)


@query("near_code_pairs", """
WITH c AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS class_key, (c_custkey * 2654435761) & 1048575 AS code FROM customer),
 f AS (SELECT class_key, code, min(id) AS id FROM c GROUP BY ALL)
SELECT x.class_key, least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id, bit_count(xor(x.code, y.code))::INT AS n_flips,
       CASE WHEN bit_count(xor(x.code, y.code)) = 20 THEN 'enantiomer' ELSE 'diastereomer' END AS relationship
FROM f x JOIN f y ON x.class_key = y.class_key AND x.code < y.code AND (bit_count(xor(x.code, y.code)) <= 5 OR xor(x.code, y.code) = 1048575)""")
def near_code_pairs(spark, d):
    """Mirror pairs and pairs within five flips over twenty sites, by chunks of the codes."""
    key = F.col("c_custkey")
    bits = (key * F.lit(2654435761)).bitwiseAND(F.lit(1048575).cast("long"))
    forms = table(spark, d, "customer").select(
        key.alias("id"), bits.cast("string").alias("canonical"), F.col("c_nationkey").cast("long").alias("class_key"),
        F.lit(20).alias("n_centers"), bit_labels(bits, 20).alias("labels"))
    return P.related_pairs(forms, max_flips=5, uneven_sites=False)


@query("mirror_pairs", f"""
WITH forms AS ({CUSTOMER_FORMS_SQL})
SELECT x.class_key, least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id
FROM forms x JOIN forms y ON x.class_key = y.class_key AND x.code < y.code AND xor(x.code, y.code) = 7""")
def mirror_pairs(spark, d):
    pairs = P.pair_filter(P.related_pairs(customer_entities(spark, d)), include_partial=False)
    return pairs.select("class_key", "a_id", "b_id")


@query("classify_pair", """
WITH n AS (SELECT c_custkey AS a_id, c_custkey + 1 AS b_id, c_custkey & 7 AS x, (c_custkey + 1) & 7 AS y,
                  (c_custkey % 4 = 0)::INT AS gap
           FROM customer),
     c AS (SELECT *, CASE WHEN gap = 1 THEN 6 ELSE 7 END AS mask FROM n)
SELECT a_id, b_id,
       CASE WHEN xor(x, y) & mask = 0 THEN NULL WHEN xor(x, y) & mask = mask THEN 'enantiomer'
            ELSE 'diastereomer' END AS relationship
FROM c""")
def classify_pair(spark, d):
    """Each customer key against its successor; every fourth row lacks position 0 on one side."""
    key = F.col("c_custkey")
    cut = F.when(key % 4 == 0, F.slice(bit_labels(key + 1, 3), 2, 2)).otherwise(bit_labels(key + 1, 3))
    given = table(spark, d, "customer").select(
        key.alias("a_id"), (key + 1).alias("b_id"), bit_labels(key, 3).alias("a_labels"), cut.alias("b_labels"),
        F.lit(3).alias("a_n_centers"), F.lit(3).alias("b_n_centers"))
    return P.classify_pairs(given).select("a_id", "b_id", "relationship")


@query("relationship_counts", f"""
WITH forms AS ({CUSTOMER_FORMS_SQL}),
 p AS (SELECT x.class_key, bit_count(xor(x.code, y.code)) AS f FROM forms x
       JOIN forms y ON x.class_key = y.class_key AND x.code < y.code)
SELECT class_key, count_if(f = 3)::BIGINT AS n_enantiomer, count_if(f < 3)::BIGINT AS n_diastereomer
FROM p GROUP BY 1""")
def relationship_counts(spark, d):
    return P.relationship_counts(customer_entities(spark, d))


@query("class_sizes", """
WITH f AS (SELECT c_nationkey::BIGINT AS class_key, count(*) AS n_members,
                  count(DISTINCT c_custkey & 7) AS n_forms FROM customer GROUP BY 1)
SELECT class_key, n_members::BIGINT AS n_members, n_forms, (n_forms * (n_forms - 1) // 2)::BIGINT AS n_form_pairs
FROM f WHERE n_members >= 2""")
def class_sizes(spark, d):
    return P.class_sizes(customer_entities(spark, d))


@query("single_flip_pairs", f"""
WITH forms AS ({CUSTOMER_FORMS_SQL})
SELECT x.class_key, x.id AS from_id, y.id AS to_id, log2(xor(x.code, y.code))::INT AS site_no
FROM forms x JOIN forms y ON x.class_key = y.class_key AND bit_count(xor(x.code, y.code)) = 1""")
def single_flip_pairs(spark, d):
    return P.single_flip_pairs(customer_entities(spark, d))


@query("label_sign", """
SELECT c_custkey AS id, sign(2 * bit_count(c_custkey & 7) - 3)::DOUBLE AS label_sign,
       (c_custkey & 3) IN (1, 2) AS balanced
FROM customer""")
def label_sign(spark, d):
    """Sign over three sites; balance over the first two, which share a symmetry class."""
    e = customer_entities(spark, d)
    symmetry = F.create_map(F.lit(0), F.lit(1), F.lit(1), F.lit(1))
    first_two = F.slice("labels", 1, 2)
    return e.select("id", L.label_sign(F.col("labels")).alias("label_sign"),
                    L.balanced_labels(first_two, symmetry).alias("balanced"))


@query("label_configurations", """
SELECT c_custkey AS id, i::INT AS variant_no, (c_custkey & 7) = i AS is_original,
       (CASE WHEN i & 1 = 1 THEN 'R' ELSE 'S' END) || (CASE WHEN i & 2 = 2 THEN 'R' ELSE 'S' END)
         || (CASE WHEN i & 4 = 4 THEN 'R' ELSE 'S' END) AS variant_code
FROM customer, range(0, 8) t(i)""")
def label_configurations(spark, d):
    v = P.label_variants(customer_entities(spark, d))
    bit = lambda i: F.when(F.substring("variant_code", i + 1, 1) == "R", 2**i).otherwise(0)
    return v.select("id", (bit(0) + bit(1) + bit(2)).cast("int").alias("variant_no"), "is_original", "variant_code")


@query("pair_target_profile", f"""
WITH {PROFILE_CTE}
SELECT a_id, b_id, target_id, n_a, n_b, presence, kind, units, round(mean_a, 8) AS mean_a,
       round(mean_b, 8) AS mean_b, round(fold_change, 6) AS fold_change
FROM profile""")
def pair_target_profile(spark, d):
    return profile(spark, d).select("a_id", "b_id", "target_id", "n_a", "n_b", "presence", "kind", "units",
                                    r8("mean_a"), r8("mean_b"), r6("fold_change"))


@query("shared_targets", f"WITH {PROFILE_CTE} SELECT a_id, b_id, target_id FROM profile WHERE presence = 'shared'")
def shared_targets(spark, d):
    return S.shared_targets(profile(spark, d)).select("a_id", "b_id", "target_id")


@query("gap_targets", f"""
WITH {PROFILE_CTE} SELECT class_key, a_id, b_id, target_id, presence[1] AS side FROM profile WHERE presence <> 'shared'""")
def gap_targets(spark, d):
    return S.gap_targets(profile(spark, d))


@query("target_set_ops", f"""
WITH {PROFILE_CTE}
SELECT a_id, b_id, target_id,
       CASE presence WHEN 'shared' THEN 'a_and_b' WHEN 'a_only' THEN 'a_minus_b' ELSE 'b_minus_a' END AS set_name
FROM profile""")
def target_set_ops(spark, d):
    return S.target_set_ops(profile(spark, d))


@query("attach_measurements", f"""
WITH {PROFILE_CTE}
SELECT class_key, a_id, b_id, relationship, n_shared, n_gap_a, n_gap_b, n_measurements FROM summary""")
def attach_measurements(spark, d):
    return summary(spark, d).select("class_key", "a_id", "b_id", "relationship", "n_shared", "n_gap_a", "n_gap_b",
                                    "n_measurements")


@query("entity_target_means", f"""
WITH meas AS ({MEAS_SQL})
SELECT entity_id, target_id, kind, units, count(*)::BIGINT AS n, round(avg(norm_value), 8) AS norm_mean,
       round(avg(value) FILTER (value > 0), 8) AS mean_value
FROM meas GROUP BY ALL""")
def entity_target_means(spark, d):
    m = S.entity_target_means(lineitem_measurements(spark, d))
    return m.select("entity_id", "target_id", "kind", "units", "n",
                    F.round(F.col("norm_sum") / F.nullif(F.col("norm_n"), F.lit(0)), 8).alias("norm_mean"),
                    F.round(F.col("value_sum") / F.col("value_n"), 8).alias("mean_value"))


@query("gap_summary", f"""
WITH {PROFILE_CTE} SELECT hit_type, class_key, a_id, b_id, round(priority, 6) AS priority, description FROM gap_hits""")
def gap_summary(spark, d):
    return S.hits_flat(S.gap_hits(summary(spark, d)))


@query("union_screens", f"""
WITH {PROFILE_CTE} SELECT hit_type, class_key, a_id, b_id, round(priority, 6) AS priority, description FROM hits""")
def union_screens(spark, d):
    s = summary(spark, d)
    return S.hits_flat(S.rank_hits(S.union_screens(S.gap_hits(s), S.differential_hits(s))))


@query("best_per_type_and_class", f"""
WITH {PROFILE_CTE}
SELECT hit_type, class_key, a_id, b_id, round(priority, 6) AS priority, description FROM hits
QUALIFY row_number() OVER (PARTITION BY hit_type, class_key ORDER BY priority DESC, a_id, b_id) = 1""")
def best_per_type_and_class(spark, d):
    return S.hits_flat(S.best_per_type_and_class(hits(spark, d)))


@query("report_counts", f"""
WITH {PROFILE_CTE}
SELECT hit_type, count(*) AS n_hits, least(count(*), 20)::BIGINT AS n_shown, greatest(count(*) - 20, 0)::BIGINT AS n_more
FROM hits GROUP BY 1""")
def report_counts(spark, d):
    return S.report_counts(hits(spark, d))


@query("report_top", f"""
WITH {PROFILE_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY hit_type ORDER BY priority DESC, a_id, b_id) AS rank FROM hits)
SELECT hit_type, a_id, b_id, rank::INT AS rank, round(priority, 6) AS priority FROM r WHERE rank <= 20""")
def report_top(spark, d):
    return S.report_top(hits(spark, d)).select("hit_type", "a_id", "b_id", "rank", r6("priority"))


@query("differential_lines", f"""
WITH {PROFILE_CTE}
SELECT f.a_id, f.b_id, f.target_id, printf('  %s (%d): %.1fx differential', p_name, f.target_id, fold_change) AS line
FROM profile f LEFT JOIN part ON p_partkey = f.target_id WHERE fold_change >= 1.2""")
def differential_lines(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("target_name"))
    return S.differential_lines(profile(spark, d), names, MIN_FOLD).select("a_id", "b_id", "target_id", "line")


@query("target_datasets", f"""
WITH {PROFILE_CTE}
SELECT target_id, count(*) AS n_records, count_if(fold_change >= 1.2)::BIGINT AS n_differential,
       count_if(fold_change < 1.2)::BIGINT AS n_non_differential
FROM profile WHERE fold_change IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def target_datasets(spark, d):
    return S.target_datasets(profile(spark, d), MIN_FOLD, min_records=2)


@query("target_datasets_untested", f"""
WITH {PROFILE_CTE}, r AS (SELECT target_id, coalesce(fold_change, 1.0) AS fc FROM profile WHERE presence = 'shared')
SELECT target_id, count(*) AS n_records, count_if(fc >= 1.2)::BIGINT AS n_differential,
       count_if(fc < 1.2)::BIGINT AS n_non_differential
FROM r GROUP BY 1""")
def target_datasets_untested(spark, d):
    return S.target_datasets(profile(spark, d), MIN_FOLD, untested_as_negative=True)


@query("global_dataset", f"""
WITH {PROFILE_CTE}
SELECT a_id, b_id, target_id, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b,
       round(fold_change, 6) AS fold_change, fold_change >= 1.2 AS is_differential
FROM profile WHERE fold_change IS NOT NULL""")
def global_dataset(spark, d):
    return S.global_dataset(profile(spark, d), MIN_FOLD).select(
        "a_id", "b_id", "target_id", r8("mean_a"), r8("mean_b"), r6("fold_change"), "is_differential")


@query("stage_progress", f"""
WITH {PROFILE_CTE}
SELECT count(*) AS n_pairs, count_if(n_measurements > 0)::BIGINT AS n_with_data,
       count_if(n_differential > 0)::BIGINT AS n_with_differential,
       count_if(n_gap_a + n_gap_b > 0)::BIGINT AS n_with_gap,
       round(100.0::DOUBLE * count_if(n_measurements > 0) / count(*), 1) AS pct_with_data
FROM summary""")
def stage_progress(spark, d):
    return S.stage_progress(summary(spark, d))


@query("bounded_hits", f"""
WITH {PROFILE_CTE}
SELECT a_id, b_id, target_id, round(fold_change, 6) AS fold_change FROM profile
WHERE fold_change BETWEEN 3 AND 1000 ORDER BY profile.fold_change DESC, a_id, b_id, target_id LIMIT 500""")
def bounded_hits(spark, d):
    return S.bounded_hits(profile(spark, d), 3.0, 1000.0, 500).select("a_id", "b_id", "target_id", r6("fold_change"))


@query("best_fold_per_pair_target", f"""
WITH raw AS (SELECT l_suppkey AS a_id, l_orderkey AS b_id, l_partkey AS target_id, l_quantity AS fold_change,
                    l_extendedprice AS price FROM lineitem)
SELECT a_id, b_id, target_id, fold_change, price FROM raw
QUALIFY row_number() OVER (PARTITION BY a_id, b_id, target_id ORDER BY fold_change DESC, price) = 1""")
def best_fold_per_pair_target(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("a_id"), F.col("l_orderkey").alias("b_id"), F.col("l_partkey").alias("target_id"),
        F.col("l_quantity").alias("fold_change"), F.col("l_extendedprice").alias("price"))
    return S.best_fold_per_pair_target(raw, ["price"])


@query("distinct_both_sides", f"""
WITH {PROFILE_CTE} SELECT a_id AS entity_id FROM pairs UNION SELECT b_id FROM pairs""")
def distinct_both_sides(spark, d):
    return S.distinct_both_sides(supplier_pairs(spark, d))


@query("measurement_filter", f"""
SELECT l_suppkey AS entity_id, l_partkey AS target_id, l_returnflag AS kind,
       TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE l_extendedprice::VARCHAR END AS DOUBLE) AS value,
       TRY_CAST(CASE WHEN l_linenumber = 1 THEN '' ELSE l_discount::VARCHAR END AS DOUBLE) AS norm_value
FROM lineitem
WHERE l_returnflag IN ('A', 'R') AND TRY_CAST(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE l_extendedprice::VARCHAR END AS DOUBLE) IS NOT NULL""")
def measurement_filter(spark, d):
    raw = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("value"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.col("l_discount").cast("string")).alias("norm_value"))
    return S.measurement_filter(raw, ("A", "R"))


@query("with_defined_labels", """
SELECT c_custkey AS id, bit_count(c_custkey & 7)::INT AS n_labels FROM customer WHERE c_custkey & 7 <> 0""")
def with_defined_labels(spark, d):
    e = customer_entities(spark, d).withColumn("labels", F.filter("labels", lambda x: x["label"] == "R"))
    return P.with_defined_labels(e).select("id", F.size("labels").alias("n_labels"))
