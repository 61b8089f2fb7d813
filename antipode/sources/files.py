"""Files in and out: entity lists, JSON records, catalog rows, nested outcomes, ranked lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv_entities(spark: SparkSession, path: str, default_prefix: str | None = "MOL_") -> DataFrame:
    """Lines of ``structure<TAB>name``: blank lines and ``#`` comments skipped.

    A missing name becomes the prefix and the 0-based line number in its file, or
    null without a prefix. Line numbers come from the counts per file block, so
    a large file is read in parallel.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"))
    if default_prefix is not None:
        # a block is one input split: the window never spans more than that
        lines = lines.withColumn("in_block", F.row_number().over(Window.partitionBy("file", "block").orderBy("mid")) - 1)
        blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("file").orderBy("block")
        blocks = blocks.withColumn("before", F.sum("n").over(w) - F.col("n")).drop("n")
        lines = lines.join(blocks, ["file", "block"]).withColumn("line_no", F.col("before") + F.col("in_block"))
    text = F.trim("value")
    parts = F.split(text, "\t")
    name = F.when(F.size(parts) > 1, F.trim(parts[1]))
    if default_prefix is not None:
        name = F.coalesce(name, F.concat(F.lit(default_prefix), F.col("line_no").cast("string")))
    return lines.where((text != "") & ~text.startswith("#")).select(F.trim(parts[0]).alias("structure"), name.alias("id"))


def read_json_records(spark: SparkSession, path: str, schema: T.StructType,
                      derived: Mapping[str, Column] | None = None, lines: bool = False) -> DataFrame:
    """JSON records as typed rows: unknown keys dropped, derived columns computed anew.

    A file holds one array, or with ``lines`` one record per line, which lets
    Spark split large files.
    """
    rows = spark.read.schema(schema).json(path, multiLine=not lines)
    for name, value in (derived or {}).items():
        rows = rows.withColumn(name, value)
    return rows


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A stage's records as Parquet."""
    df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_catalog_rows(df: DataFrame, key: str = "file") -> DataFrame:
    """Landed catalog rows: a key is required, lengths default to 0, angles to 90, the group to 0.

    A row with an unreadable number is dropped; a missing or empty one takes the default.
    """
    def number(name: str, default: float, kind: str) -> Column:
        raw = F.nullif(F.trim(F.col(name)), F.lit(""))
        return F.when(raw.isNull(), F.lit(default).cast(kind)).otherwise(raw.try_cast(kind)).alias(name)

    lengths = [number(c, 0.0, "double") for c in ("a", "b", "c")]
    angles = [number(c, 90.0, "double") for c in ("alpha", "beta", "gamma")]
    rows = df.where(F.coalesce(F.trim(key), F.lit("")) != "").select(
        F.trim(key).alias("id"), "formula", "space_group", number("sg_number", 0, "int"), *lengths, *angles)
    return rows.dropna(subset=["sg_number", "a", "b", "c", "alpha", "beta", "gamma"])


# Fixed schema of a nested outcome document.
OUTCOME_SCHEMA = """
  id string, identifiers array<struct<type:string,value:string>>,
  outcomes array<struct<products:array<struct<
    identifiers:array<struct<type:string,value:string>>,
    measurements:array<struct<type:string,subtype:string,value:double>>>>>>,
  inputs array<struct<components:array<struct<role:string,identifiers:array<struct<type:string,value:string>>>>>>,
  conditions struct<temperature:string,solvent:string>, doi string"""


def flatten_nested_outcomes(df: DataFrame) -> DataFrame:
    """One row per document with an EE value: last EE and yield, last product, last catalyst, first reactant."""
    products = F.flatten(F.transform("outcomes", lambda o: o["products"]))
    measured = F.flatten(F.transform(products, lambda p: F.coalesce(p["measurements"], F.array().cast(
        "array<struct<type:string,subtype:string,value:double>>"))))
    ids = F.flatten(F.transform(products, lambda p: F.coalesce(p["identifiers"], F.array().cast(
        "array<struct<type:string,value:string>>"))))
    components = F.flatten(F.transform("inputs", lambda i: i["components"]))

    def last(values: Column) -> Column:
        return F.try_element_at(values, F.lit(-1))

    def structures(role: str) -> Column:
        of_role = F.filter(components, lambda c: c["role"] == role)
        firsts = F.transform(of_role, lambda c: F.try_element_at(
            F.filter(c["identifiers"], lambda i: i["type"] == "SMILES"), F.lit(1))["value"])
        return F.filter(firsts, lambda x: x.isNotNull())

    ee = last(F.filter(measured, lambda m: (m["type"] == "SELECTIVITY") & (m["subtype"] == "EE")))["value"]
    return df.select(
        "id",
        F.coalesce(last(F.filter("identifiers", lambda i: i["type"] == "REACTION_SMILES"))["value"], F.lit("")).alias("reaction"),
        last(structures("CATALYST")).alias("catalyst"),
        F.try_element_at(structures("REACTANT"), F.lit(1)).alias("substrate"),
        last(F.filter(ids, lambda i: i["type"] == "SMILES"))["value"].alias("product"),
        ee.alias("ee"),
        last(F.filter(measured, lambda m: m["type"] == "YIELD"))["value"].alias("yield"),
        F.coalesce("conditions.temperature", F.lit("")).alias("temperature"),
        F.coalesce("conditions.solvent", F.lit("")).alias("solvent"),
        F.coalesce("doi", F.lit("")).alias("doi"),
    ).where(F.col("ee").isNotNull())


def write_ranked_tsv(df: DataFrame, path: str, key: str = "id", score: str = "score") -> None:
    """Key and score to 4 places, best first, tab separated."""
    df.orderBy(F.desc(score), key).select(key, F.format_string("%.4f", F.col(score)).alias(score)).write.mode(
        "overwrite").csv(path, sep="\t")
