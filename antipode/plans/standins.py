"""The library's record types read off the given tables, in Spark and in SQL.

Each ``*_SQL`` text is the body of a CTE with the same columns as the frame of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_labels(key: Column, bits: int) -> Column:
    """Label map over positions 0..bits-1 taken from the low bits of ``key``."""
    return F.array(*[
        F.struct(
            F.lit(i).cast("int").alias("pos"),
            F.when(F.shiftright(key, i).bitwiseAND(1) == 1, "R").otherwise("S").alias("label"),
        )
        for i in range(bits)
    ])


def supplier_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose class holds the four label maps over two sites."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"), key.cast("string").alias("canonical"),
        F.floor(key / 4).cast("long").alias("class_key"),
        F.lit(2).alias("n_centers"), bit_labels(key, 2).alias("labels"),
    )


def customer_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of few, large classes: many copies of at most eight forms per class."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.format_string("%d:%d", F.col("c_nationkey"), key.bitwiseAND(7)).alias("canonical"),
        F.col("c_nationkey").cast("long").alias("class_key"),
        F.lit(3).alias("n_centers"), bit_labels(key, 3).alias("labels"),
    )


CUSTOMER_FORMS_SQL = """
  SELECT c_nationkey::BIGINT AS class_key, (c_custkey & 7)::BIGINT AS code, min(c_custkey) AS id
  FROM customer GROUP BY ALL"""


def lineitem_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity_id"), F.col("l_partkey").alias("target_id"),
        F.col("l_returnflag").alias("kind"), value.alias("value"), F.col("l_linestatus").alias("units"),
        F.when(F.col("l_linenumber") % 3 != 0, F.log10(value)).alias("norm_value"),
    )


# Order in which the stand-in kinds are tried.
KINDS = ("A", "N", "R")

MEAS_SQL = """
  SELECT l_suppkey AS entity_id, l_partkey AS target_id, l_returnflag AS kind,
         l_extendedprice / l_quantity AS value, l_linestatus AS units,
         CASE WHEN l_linenumber % 3 <> 0 THEN log10(l_extendedprice / l_quantity) END AS norm_value
  FROM lineitem"""

# pairs of suppliers in one class of four, by comparing the two label bits
PAIRS_SQL = """
  SELECT x.s_suppkey // 4 AS class_key, x.s_suppkey AS a_id, y.s_suppkey AS b_id,
         bit_count(xor(x.s_suppkey & 3, y.s_suppkey & 3))::INT AS n_flips,
         CASE WHEN xor(x.s_suppkey & 3, y.s_suppkey & 3) = 3
              THEN 'enantiomer' ELSE 'diastereomer' END AS relationship
  FROM supplier x JOIN supplier y
    ON x.s_suppkey // 4 = y.s_suppkey // 4 AND x.s_suppkey < y.s_suppkey"""

PROFILE_CTE = f"""
  meas AS ({MEAS_SQL}),
  pairs AS ({PAIRS_SQL}),
  kinds AS (
    SELECT entity_id, target_id, kind, units, count(*) AS n, sum(norm_value) AS norm_sum,
           count(norm_value) AS norm_n, avg(value) FILTER (value > 0) AS mean_value,
           count(*) FILTER (value > 0) AS value_n
    FROM meas GROUP BY ALL),
  targets AS (
    SELECT entity_id, target_id, sum(n) AS n, sum(norm_sum) / nullif(sum(norm_n), 0) AS norm_mean
    FROM kinds GROUP BY ALL),
  both_kinds AS (
    SELECT p.a_id, p.b_id, x.target_id, x.kind, x.units, x.mean_value AS mean_a, y.mean_value AS mean_b,
           row_number() OVER (PARTITION BY p.a_id, p.b_id, x.target_id ORDER BY x.kind, x.units) AS rn
    FROM pairs p
    JOIN kinds x ON x.entity_id = p.a_id
    JOIN kinds y ON y.entity_id = p.b_id AND y.target_id = x.target_id AND y.kind = x.kind AND y.units = x.units
    WHERE x.value_n > 0 AND y.value_n > 0),
  a_side AS (SELECT p.*, t.target_id, t.n, t.norm_mean FROM pairs p JOIN targets t ON t.entity_id = p.a_id),
  b_side AS (SELECT p.*, t.target_id, t.n, t.norm_mean FROM pairs p JOIN targets t ON t.entity_id = p.b_id),
  profile AS (
    SELECT coalesce(a.class_key, b.class_key) AS class_key, coalesce(a.a_id, b.a_id) AS a_id,
           coalesce(a.b_id, b.b_id) AS b_id, coalesce(a.target_id, b.target_id) AS target_id,
           coalesce(a.n, 0)::BIGINT AS n_a, coalesce(b.n, 0)::BIGINT AS n_b,
           CASE WHEN a.n > 0 AND b.n > 0 THEN 'shared' WHEN a.n > 0 THEN 'a_only' ELSE 'b_only' END AS presence,
           CASE WHEN a.norm_mean IS NOT NULL AND b.norm_mean IS NOT NULL THEN 'norm' ELSE f.kind END AS kind,
           CASE WHEN a.norm_mean IS NULL OR b.norm_mean IS NULL THEN f.units END AS units,
           CASE WHEN a.norm_mean IS NOT NULL AND b.norm_mean IS NOT NULL THEN a.norm_mean ELSE f.mean_a END AS mean_a,
           CASE WHEN a.norm_mean IS NOT NULL AND b.norm_mean IS NOT NULL THEN b.norm_mean ELSE f.mean_b END AS mean_b,
           abs(a.norm_mean - b.norm_mean) AS diff,
           CASE WHEN a.norm_mean IS NOT NULL AND b.norm_mean IS NOT NULL
                THEN pow(10.0::DOUBLE, abs(a.norm_mean - b.norm_mean))
                ELSE greatest(f.mean_a, f.mean_b) / greatest(least(f.mean_a, f.mean_b), 1e-10) END AS fold_change
    FROM a_side a
    FULL JOIN b_side b ON a.a_id = b.a_id AND a.b_id = b.b_id AND a.target_id = b.target_id
    LEFT JOIN both_kinds f ON f.rn = 1 AND f.a_id = coalesce(a.a_id, b.a_id)
         AND f.b_id = coalesce(a.b_id, b.b_id) AND f.target_id = coalesce(a.target_id, b.target_id)),
  summary AS (
    SELECT p.class_key, p.a_id, p.b_id, p.relationship,
           coalesce(count_if(f.presence = 'shared'), 0)::BIGINT AS n_shared,
           coalesce(count_if(f.presence = 'a_only'), 0)::BIGINT AS n_gap_a,
           coalesce(count_if(f.presence = 'b_only'), 0)::BIGINT AS n_gap_b,
           coalesce(sum(f.n_a + f.n_b), 0)::BIGINT AS n_measurements,
           count(f.fold_change) AS n_comparable,
           coalesce(count_if(f.fold_change >= 1.2), 0)::BIGINT AS n_differential,
           max(f.fold_change) FILTER (f.fold_change >= 1.2) AS max_fold
    FROM pairs p LEFT JOIN profile f ON f.a_id = p.a_id AND f.b_id = p.b_id
    GROUP BY ALL),
  gap_hits AS (
    SELECT 'activity_gap' AS hit_type, class_key, a_id, b_id,
           (n_gap_a + n_gap_b) * (1 + 0.1::DOUBLE * n_measurements) AS priority,
           CASE WHEN n_gap_b = 0 THEN printf('%d tested on %d targets, %d untested. Recommend testing %d.', a_id, n_gap_a, b_id, b_id)
                WHEN n_gap_a = 0 THEN printf('%d tested on %d targets, %d untested. Recommend testing %d.', b_id, n_gap_b, a_id, a_id)
                ELSE printf('Activity gaps in both directions: %d unique targets=%d, %d unique targets=%d.', a_id, n_gap_a, b_id, n_gap_b)
           END AS description
    FROM summary WHERE n_gap_a + n_gap_b > 0),
  diff_hits AS (
    SELECT 'differential' AS hit_type, class_key, a_id, b_id, max_fold * n_differential AS priority,
           printf('%d sensitive target(s)', n_differential) AS description
    FROM summary WHERE n_differential > 0),
  hits AS (SELECT * FROM gap_hits UNION ALL SELECT * FROM diff_hits)"""


def structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure records from ``part``, with the mean line discount as saturation score."""
    cents = F.round(F.col("l_discount") * 100).cast("long")
    discount = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        (F.sum(cents) / F.count(F.lit(1)) / 10.0).alias("saturation"))
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), ((F.col("p_size") * 37) % 230 + 1).alias("sg"),
        F.format_string("%s%d", F.col("p_name"), F.col("p_size")).alias("formula"),
        F.array_compact(F.array(words[0], F.when(F.col("p_size") % 2 == 1, words[1]),
                                F.when(F.col("p_size") % 3 != 0, F.col("p_type")))).alias("labels"), F.col("p_size").alias("n_atoms"),
        ((F.col("p_retailprice") % 150) / 100).alias("activity"),
        (F.col("p_partkey") % 3 - 1).cast("double").alias("sign"), (F.col("p_size") != 7).alias("is_chiral"),
        F.when(F.col("p_size") == 13, "failed").alias("error"),
    ).join(discount, "id", "left")


STRUCT_CTE = """
  disc AS (SELECT l_partkey AS id, sum(round(l_discount * 100)::BIGINT) / count(*) / 10.0::DOUBLE AS saturation
           FROM lineitem GROUP BY 1),
  st AS (SELECT p_partkey AS id, (p_size * 37) % 230 + 1 AS sg, p_name || p_size AS formula,
                list_filter([string_split(p_name, ' ')[1], CASE WHEN p_size % 2 = 1 THEN string_split(p_name, ' ')[2] END,
                             CASE WHEN p_size % 3 <> 0 THEN p_type END], lambda x: x IS NOT NULL) AS labels, p_size AS n_atoms,
                (p_retailprice % 150) / 100 AS activity, (p_partkey % 3 - 1)::DOUBLE AS sign,
                p_size <> 7 AS is_chiral, CASE WHEN p_size = 13 THEN 'failed' END AS error, saturation
         FROM part LEFT JOIN disc ON disc.id = p_partkey)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome records from ``orders``."""
    cust = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 5000 - 5).alias("ee"),
        cust.cast("string").alias("catalyst"), F.col("o_orderpriority").alias("substrate"),
        F.concat_ws(">>", "o_orderpriority", "o_orderstatus").alias("reaction"),
    )


OUT_SQL = """
  SELECT o_orderkey AS id, o_totalprice / 5000 - 5 AS ee,
         CASE WHEN o_custkey % 10 <> 0 THEN o_custkey::VARCHAR END AS catalyst, o_orderpriority AS substrate,
         o_orderpriority || '>>' || o_orderstatus AS reaction
  FROM orders"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label, a length score in (0, 1) and a fold."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", "quality", "toxic", n.cast("double").alias("n_chars"),
        (n / (n + 2000)).alias("score"), (F.col("doc_id") % 5).cast("int").alias("fold"))


FOLD_SQL = """
  SELECT d.doc_id, lang, quality, toxic, n_chars::DOUBLE AS n_chars, n_chars / (n_chars + 2000) AS score,
         (d.doc_id % 5)::INT AS fold
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
