"""Sources, store and incremental runs on the given tables.

Files are written below the shared folder of the session and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from antipode.plans.registry import query
from antipode.plans.rule_queries import SCORE_SQL, part_scores
from antipode.plans.search_queries import vectors
from antipode.plans.standins import table
from antipode.scale import fresh_path
from antipode.sources import files as A
from antipode.sources import store as B
from antipode.streaming import incremental as J


@query("read_tsv_entities", """
SELECT 'C' || p_partkey AS structure, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS id FROM part""")
def read_tsv_entities(spark, d):
    path = fresh_path(spark, "tsv")
    head = F.concat(F.lit("C"), F.col("p_partkey").cast("string"))
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# note\n\n"), head)).otherwise(F.concat_ws("\t", head, "p_name"))
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return A.read_tsv_entities(spark, path, None)


@query("read_json_records", """
SELECT p_partkey AS id, p_name AS formula, p_size AS sg_number, p_size IN (1, 3, 4, 5, 16, 17, 18, 19, 20, 21, 22, 23, 24) AS is_member FROM part""")
def read_json_records(spark, d):
    from antipode.operators.stats import member_flag
    path = fresh_path(spark, "json")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("formula"), F.col("p_size").alias("sg_number"),
                                   F.lit("x").alias("unknown"), F.lit(False).alias("is_member")).write.json(path)
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string("id bigint, formula string, sg_number int")
    return A.read_json_records(spark, path, schema, {"is_member": member_flag(F.col("sg_number"))}, lines=True)


@query("write_read_table", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def write_read_table(spark, d):
    path = fresh_path(spark, "table")
    A.write_table(table(spark, d, "customer"), path)
    return A.read_table(spark, path).select("c_custkey", "c_name", "c_acctbal")


@query("flatten_nested_outcomes", """
SELECT event_id AS id, 'r' || event_type AS reaction, 'c' || user_id AS catalyst, event_type AS substrate, 'p2' AS product,
       json_extract(props, '$.k')::DOUBLE AS ee, CASE WHEN event_type <> 'click' THEN value END AS yield
FROM events WHERE event_type <> 'error'""")
def flatten_nested_outcomes(spark, d):
    """Events as nested documents: the EE value is read out of the JSON text; errors have none."""
    k = F.from_json("props", "k int")["k"].cast("double")
    ident = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
    meas = lambda t, s, v: F.struct(F.lit(t).alias("type"), F.lit(s).alias("subtype"), v.alias("value"))
    is_error, is_click = F.col("event_type") == "error", F.col("event_type") == "click"
    first = F.struct(F.array(ident("SMILES", F.lit("p1"))).alias("identifiers"),
                     F.array(meas("YIELD", "", F.lit(1.0)), meas("SELECTIVITY", "EE", F.lit(-1.0))).alias("measurements"))
    second = F.struct(F.array(ident("NAME", F.lit("n")), ident("SMILES", F.lit("p2"))).alias("identifiers"),
                      F.array(meas("SELECTIVITY", "EE", F.when(~is_error, k)), meas("SELECTIVITY", "DE", F.lit(5.0)),
                              meas("YIELD", "", F.when(~is_click, F.col("value")))).alias("measurements"))
    comp = lambda role, v: F.struct(F.lit(role).alias("role"), F.array(ident("SMILES", v)).alias("identifiers"))
    docs = table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.array(ident("REACTION_SMILES", F.concat(F.lit("r"), F.col("event_type")))).alias("identifiers"),
        F.array(F.struct(F.array(first, second).alias("products"))).alias("outcomes"),
        F.array(F.struct(F.array(comp("REACTANT", F.col("event_type")), comp("CATALYST", F.lit("x")),
                                 comp("REACTANT", F.lit("y")), comp("CATALYST", F.concat(F.lit("c"), F.col("user_id").cast("string")))
                                 ).alias("components"))).alias("inputs"),
        F.struct(F.lit("20 C").alias("temperature"), F.lit(None).cast("string").alias("solvent")).alias("conditions"),
        F.lit(None).cast("string").alias("doi"))
    return A.flatten_nested_outcomes(docs).select("id", "reaction", "catalyst", "substrate", "product", "ee", "yield")


@query("parse_catalog_rows", """
SELECT p_name AS formula, p_partkey::VARCHAR AS id, p_size AS sg_number, p_retailprice AS a, 0.0::DOUBLE AS b, p_size::DOUBLE AS c,
       90.0::DOUBLE AS alpha, CASE WHEN p_size % 2 = 0 THEN 90.0::DOUBLE ELSE 60.0::DOUBLE END AS beta
FROM part WHERE p_size <> 5 AND p_size <> 6""")
def parse_catalog_rows(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice").cast("string")
    raw = table(spark, d, "part").select(
        F.when(size == 6, " ").otherwise(F.col("p_partkey").cast("string")).alias("file"), F.col("p_name").alias("formula"),
        F.lit("P 1").alias("space_group"), size.cast("string").alias("sg_number"), F.when(size == 5, "bad").otherwise(price).alias("a"),
        F.lit(None).cast("string").alias("b"), size.cast("string").alias("c"), F.lit("").alias("alpha"),
        F.when(size % 2 == 1, "60").alias("beta"), F.lit("90").alias("gamma"))
    return A.parse_catalog_rows(raw).select("formula", "id", "sg_number", "a", "b", "c", "alpha", "beta")


@query("write_ranked_tsv", f"SELECT id, round(score, 4) AS score FROM ({SCORE_SQL})")
def write_ranked_tsv(spark, d):
    path = fresh_path(spark, "ranked")
    A.write_ranked_tsv(part_scores(spark, d).withColumn("score", F.round("score", 4)), path)
    return spark.read.schema("id bigint, score double").csv(path, sep="\t")


@query("upsert_metadata", """
SELECT user_id AS entity_id, event_type AS key, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def upsert_metadata(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("key"), "value",
                                         F.col("event_id").alias("seq"))
    return B.upsert_metadata(e)


@query("metadata_columns", """
WITH l AS (SELECT user_id AS entity_id, event_type AS key, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT entity_id, max(value) FILTER (key = 'click') AS click, max(value) FILTER (key = 'error') AS error FROM l GROUP BY 1""")
def metadata_columns(spark, d):
    return B.metadata_columns(upsert_metadata(spark, d), ["click", "error"])


@query("assign_ids", "SELECT count(DISTINCT text) AS n_texts, count(DISTINCT text) AS n_keys, 0::BIGINT AS n_collisions FROM documents")
def assign_ids(spark, d):
    return B.id_collisions(table(spark, d, "documents"), "text")


@query("append_vectors", "SELECT vec_id AS entity_id, label, 64 AS nbits, 'default' AS params_hash FROM embeddings")
def append_vectors(spark, d):
    """Two overlapping batches: the second adds only what is missing."""
    path = fresh_path(spark, "vectors")
    v = vectors(spark, d)
    B.append_vectors(v.where("label < 6"), path, 64, "default")
    B.append_vectors(v, path, 64, "default")
    return B.read_vectors(spark, path, 64, "default").select("entity_id", "label", "nbits", "params_hash")


def some_stored(spark, d):
    """The vectors, and a store that holds those of the labels below 6."""
    path = fresh_path(spark, "vectors")
    v = vectors(spark, d)
    B.append_vectors(v.where("label < 6"), path, 64, "default")
    return v, B.read_vectors(spark, path, 64, "default")


@query("missing_vectors", "SELECT vec_id AS entity_id, label FROM embeddings WHERE label >= 6 OR label IS NULL")
def missing_vectors(spark, d):
    """What a run over all entities still has to compute."""
    v, stored = some_stored(spark, d)
    return B.missing(v.select("entity_id", "label"), stored)


@query("lookup_vectors", """
SELECT vec_id AS entity_id, label, round(list_sum(embedding::DOUBLE[]), 9) AS total
FROM embeddings WHERE label < 6 AND vec_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)""")
def lookup_vectors(spark, d):
    """Stored vectors of the parts that were ordered in large lots, whatever the number of lots."""
    _, stored = some_stored(spark, d)
    wanted = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("entity_id"))
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return B.lookup_vectors(stored, wanted).select("entity_id", "label", F.round(total, 9).alias("total"))


@query("pending", """
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def pending(spark, d):
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return B.pending(table(spark, d, "customer").select("c_custkey", "c_name"), done, ["c_custkey"], "c_name")


@query("pending_either", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def pending_either(spark, d):
    done = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("key"))
    todo = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return B.pending_either(todo, done, ["l_partkey", "l_suppkey"])


def failing_documents(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text",
        F.when(F.length("text") > 2000, "too_long").when(F.length("text") < 20, "too_short").alias("error"))


@query("dead_letter_counts", """
SELECT CASE WHEN length(text) > 2000 THEN 'too_long' ELSE 'too_short' END AS reason, count(*) AS n FROM documents
WHERE length(text) > 2000 OR length(text) < 20 GROUP BY 1""")
def dead_letter_counts(spark, d):
    path = fresh_path(spark, "dead")
    B.write_dead_letter(failing_documents(spark, d), path)
    return B.dead_letter_counts(B.read_dead_letter(spark, path))


@query("retry_dead_letters", """
SELECT doc_id AS id, CASE WHEN length(text) > 5000 THEN 'too_long' WHEN length(text) <= 2000 THEN 'too_short' END AS reason,
       CASE WHEN length(text) BETWEEN 2001 AND 5000 THEN length(text)::INT END AS value
FROM documents WHERE length(text) > 2000 OR length(text) < 20""")
def retry_dead_letters(spark, d):
    """Failed documents tried again with a wider limit."""
    path = fresh_path(spark, "dead")
    B.write_dead_letter(failing_documents(spark, d), path)
    n = F.length("text")
    wider = lambda df: df.withColumn("error", F.when(n > 5000, "too_long").when(n < 20, "too_short")).withColumn("value", n)
    fixed, failing = J.retry_dead_letters(B.read_dead_letter(spark, path), wider)
    return fixed.select("id", F.lit(None).cast("string").alias("reason"), "value").unionByName(
        failing.select("id", "reason", F.lit(None).cast("int").alias("value")))


def run_events(spark, d):
    """The events enriched by the incremental job, run twice over the same files."""
    root = fresh_path(spark, "events")
    events = table(spark, d, "events")
    enrich = lambda df: df.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"), "value").withColumn(
        "error", F.when(F.col("event_type") == "error", "failed"))
    for _ in range(2):
        J.incremental_enrich(spark, f"{d}/events.parquet", events.schema, enrich, f"{root}/out", f"{root}/checkpoint",
                             ["event_id"], f"{root}/log")
    return root


@query("incremental_enrich", """
SELECT event_id, event_type, json_extract(props, '$.k')::INT AS k, value, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events""")
def incremental_enrich(spark, d):
    return spark.read.parquet(run_events(spark, d) + "/out").drop("run_id", "batch_id")


@query("progress_log", """
SELECT count(*) AS n_rows, count_if(event_type <> 'error')::BIGINT AS n_ok, count_if(event_type = 'error')::BIGINT AS n_failed FROM events""")
def progress_log(spark, d):
    log = spark.read.parquet(run_events(spark, d) + "/log")
    return log.agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_ok", "n_failed")])
