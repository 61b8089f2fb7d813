"""The vector store, metadata and work lists as plain tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from antipode.operators.profiles import last_record
from antipode.scale import first_per_group, materialize


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str], order_by_length: str | None = None) -> DataFrame:
    """Rows of ``todo`` whose keys are not done; shortest first if asked."""
    rest = todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
    return rest.orderBy(F.length(order_by_length), *keys) if order_by_length else rest


def pending_either(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows for which none of several keys is found in ``done.key``."""
    rest = todo
    for k in keys:
        rest = rest.join(done.select(F.col("key").alias(k)).distinct(), k, "left_anti")
    return rest.select(*todo.columns)


def assign_ids(df: DataFrame, canonical: str, out: str = "entity_id") -> DataFrame:
    """A stable 64-bit key from the canonical text: no counter, the same in every run."""
    return df.withColumn(out, F.xxhash64(canonical))


def id_collisions(df: DataFrame, canonical: str) -> DataFrame:
    """Distinct texts, distinct keys and their difference."""
    keyed = df.select(canonical).distinct().withColumn("k", F.xxhash64(canonical))
    return keyed.agg(F.count(F.lit(1)).alias("n_texts"), F.countDistinct("k").alias("n_keys")).withColumn(
        "n_collisions", F.col("n_texts") - F.col("n_keys"))


#: Buckets of a new store; a bucket is the unit that one task reads, so size it by the store's final size.
BUCKETS = 64
SPEC = "buckets int, columns string"


def _folder(path: str, nbits: int, params_hash: str) -> str:
    return f"{path.rstrip('/')}/nbits={nbits}/params_hash={params_hash}"


def _stored_table(spark: SparkSession, folder: str, spec: Row | None = None) -> DataFrame | None:
    """The bucketed table over a kind's folder, or None where nothing was stored; ``spec`` begins a store.

    Buckets and columns are kept in the folder, so any session finds them; the catalog entry is named after the folder.
    """
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_store/_SUCCESS")
    known = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
    if not known and spec is None:
        return None
    if not known:
        spark.createDataFrame([spec], SPEC).coalesce(1).write.mode("overwrite").json(f"{folder}/_store")
    spec = spark.read.schema(SPEC).json(f"{folder}/_store").first()
    name = f"vectors_{hashlib.md5(folder.encode()).hexdigest()}"
    if not known:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # of a folder that was removed since
    where = folder.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({spec.columns}) USING parquet "
              f"CLUSTERED BY (entity_id) INTO {spec.buckets} BUCKETS LOCATION '{where}'")
    spark.catalog.refreshTable(name)  # other sessions may have added files
    return spark.table(name)


def append_vectors(df: DataFrame, path: str, nbits: int, params_hash: str, buckets: int = BUCKETS) -> None:
    """Adds the vectors not stored yet under (entity, nbits, params_hash).

    The store of a kind is bucketed by entity: one exchange of the new rows serves the choice among repeated
    rows, the look-up of what is stored and the write; stored rows stay where they are. The file commit makes a batch all-or-nothing.
    Null vectors and vectors of another length are refused before anything is written, as are columns
    other than the store's. Of rows that repeat an entity the smallest is stored. ``buckets`` counts for a
    new store only. One writer at a time: two that run at once may both add a key.
    """
    spark = df.sparkSession
    if not df.where(~F.size("vec").eqNullSafe(nbits) | F.col("vec").isNull()).isEmpty():
        raise ValueError(f"vectors must have {nbits} numbers")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    stored = _stored_table(spark, _folder(path, nbits, params_hash), Row(buckets=buckets, columns=columns))
    if sorted(stored.columns) != sorted(df.columns):
        raise ValueError(f"the store has the columns {stored.columns}")
    near = df.repartition(bucket_count(stored), "entity_id")
    rows = first_per_group(near, ["entity_id"], [*[c for c in df.columns if c not in ("entity_id", "vec")], "vec"])
    missing(rows, stored).select(*stored.columns).write.insertInto(
        f"vectors_{hashlib.md5(_folder(path, nbits, params_hash).encode()).hexdigest()}")


def bucket_count(stored: DataFrame) -> int:
    """How many buckets the table behind ``stored`` has."""
    return stored._jdf.queryExecution().analyzed().collectLeaves().head().relation().bucketSpec().get().numBuckets()


def missing(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose entity is not stored; only ``rows`` move."""
    return rows.join(stored.select("entity_id").hint("merge"), "entity_id", "left_anti")


def lookup_vectors(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored vectors of the wanted entities, each once; only ``wanted`` moves (or is broadcast where it is small)."""
    return stored.join(wanted.select("entity_id"), "entity_id", "left_semi")


def read_vectors(spark: SparkSession, path: str, nbits: int, params_hash: str) -> DataFrame | None:
    """Stored vectors of one kind, or None for a kind without any; bucketed by entity.

    A filter on one entity reads one bucket; joins and groups by entity leave the stored side in place.
    """
    stored = _stored_table(spark, _folder(path, nbits, params_hash))
    return stored if stored is None else stored.withColumn("nbits", F.lit(nbits)).withColumn("params_hash", F.lit(params_hash))


def upsert_metadata(changes: DataFrame) -> DataFrame:
    """Last value per (entity_id, key), by sequence."""
    return last_record(changes.select("entity_id", "key", "value", "seq"), ["entity_id", "key"], ["seq"]).select(
        "entity_id", "key", "value")


def metadata_columns(latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per entity with the named keys as columns."""
    return latest.groupBy("entity_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def write_dead_letter(df: DataFrame, path: str, error: str = "error", text: str = "text", key: str = "id") -> DataFrame:
    """Appends failed rows as JSON lines with reason and length; returns the rows that succeeded.

    The rows are written once and split from there, so nothing is computed twice or lost between both sides.
    """
    df = materialize(df, "letters")
    df.where(F.col(error).isNotNull()).select(
        key, text, F.col(error).alias("reason"), F.length(text).alias("length"), F.lit(1).alias("attempt")
    ).write.mode("append").json(path)
    return df.where(F.col(error).isNull())


def read_dead_letter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, text string, reason string, length int, attempt int").json(path)


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
