"""Resumable runs over arriving files.

The stream keeps which files were read and which keys it has met; each micro-batch overwrites its own
directory, so a batch repeated after a crash leaves one copy of its rows. Directories are
named by a run id that is kept with the checkpoint, so another checkpoint, or a new
one in the place of a lost one, never touches what an earlier run has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def _is_file(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isFile()


def _runs(spark: SparkSession, out: str) -> list[str]:
    """Ids of the runs that have a folder in ``out``."""
    if not _exists(spark, out):
        return []
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath)]
    return sorted(n.removeprefix("run_id=") for n in names if n.startswith("run_id="))


def run_of(spark: SparkSession, checkpoint: str, out: str) -> tuple[str, list[str]]:
    """Name of the run that a checkpoint belongs to, and of the runs that wrote to ``out`` before it began.

    Made up with the checkpoint and lost with it.
    """
    path = f"{checkpoint.rstrip('/')}/run"
    if not _exists(spark, path):
        spark.createDataFrame([(f"r{uuid.uuid4().hex}", _runs(spark, out))], "run_id string, earlier array<string>").coalesce(1).write.json(path)
    row = spark.read.schema("run_id string, earlier array<string>").json(path).first()
    return row.run_id, list(row.earlier or [])


def _counters(error: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(error).isNull()).alias("n_ok"),
            F.count_if(F.col(error).isNotNull()).alias("n_failed")]


def progress_row(df: DataFrame, batch_id: int, error: str = "error") -> DataFrame:
    """Counters of one batch."""
    return df.agg(*_counters(error)).withColumn("batch_no", F.lit(batch_id).cast("long"))


def write_counted(df: DataFrame, path: str, error: str = "error") -> dict[str, int]:
    """Write ``df`` and return the counters of ``progress_row``, observed by the write itself."""
    seen = Observation()
    df.observe(seen, *_counters(error)).write.mode("overwrite").parquet(path)
    return dict(seen.get)


ROW, NEW, STORED = 0, 1, 2  # what a row of the stream says of its key


def keyed_stream(arriving: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Each arriving row (ROW), one marker for each key never met before (NEW), and each key of ``stored`` (STORED).

    The keys met so far are held by Spark's streaming state, partitioned by key: a batch looks up its own keys
    and reads no history. A repeated batch starts from the same version of the state and marks the same keys.
    """
    kinds = {k: arriving.schema[k].dataType for k in keys}
    rows = arriving.select(*keys, F.struct(*arriving.columns).alias("_row"), F.lit(ROW).alias("_kind"))
    bare = lambda df, kind: df.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys],
                                      F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.lit(kind).alias("_kind"))
    met = bare(arriving, NEW)
    if stored is None:
        return rows.union(met.dropDuplicates(list(keys)))
    return rows.union(met.union(bare(stored, NEW)).dropDuplicates(list(keys))).union(bare(stored, STORED))


def fresh_rows(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The smallest arriving row of each key of a ``keyed_stream`` batch that is new and not stored, in one exchange."""
    kind = F.col("_kind")
    fields = batch.schema["_row"].dataType.fields
    order = [F.col("_row").getField(f.name) for f in fields if f.name not in keys and "map<" not in f.dataType.simpleString()]
    of = lambda k: F.count_if(kind == k)
    picked = batch.groupBy(*keys).agg(
        F.min_by("_row", F.when(kind == ROW, F.struct(*order) if order else F.lit(0))).alias("_row"),
        of(ROW).alias("_rows"), of(NEW).alias("_new"), of(STORED).alias("_stored"))
    return picked.where("_rows > 0 AND _new > 0 AND _stored = 0").select(*[F.col("_row").getField(f.name).alias(f.name) for f in fields])


def _start(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start with the state on disk (RocksDB, changes only per commit) where the session names no other store."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider"):
        return writer.start()
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return writer.start()  # the query keeps a copy of the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def incremental_enrich(spark: SparkSession, source: str, schema: T.StructType, enrich: Callable[[DataFrame], DataFrame],
                       out: str, checkpoint: str, keys: Sequence[str], log: str | None = None,
                       files_per_batch: int | None = None, error: str = "error") -> None:
    """Enriches the files that arrived since the last run, then stops.

    Rows whose keys an earlier batch of any run has written are skipped; of rows with one key in
    a batch the smallest stays; a null key is a key. ``enrich`` returns the keys and an error column
    that is null for good rows.

    A batch reads its own files only (``keyed_stream``). What other runs had written when a checkpoint was
    new is streamed into its state, each file once; only runs that began later are read by every batch. Runs
    into one folder take turns: two at once may both write a key. The state has as many partitions as
    ``spark.sql.shuffle.partitions`` at the first batch.
    """
    run, earlier = run_of(spark, checkpoint, out)
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = fresh_rows(batch, keys)
        later = [r for r in _runs(session, out) if r != run and r not in earlier]
        if later:
            seen = session.read.option("recursiveFileLookup", "true").parquet(*[f"{out}/run_id={r}" for r in later]).select(*[F.col(k).alias(f"_s_{k}") for k in keys])
            fresh = fresh.join(seen, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]), "left_anti")
        target = f"{out}/run_id={run}/batch_id={batch_id}"
        if not log:
            enrich(fresh).write.mode("overwrite").parquet(target)
            return
        n = write_counted(enrich(fresh), target, error)
        session.createDataFrame([(*(n.get(c, 0) for c in ("n_rows", "n_ok", "n_failed")), batch_id)],
                                "n_rows long, n_ok long, n_failed long, batch_no long").coalesce(1).write.mode("overwrite").parquet(
            f"{log}/run_id={run}/batch_id={batch_id}")

    folder, name = source.rstrip("/").rsplit("/", 1)
    if _is_file(spark, source):
        # a stream watches folders: pick the one file out of its folder
        reader, source = reader.option("pathGlobFilter", name), folder
    stored = None
    if earlier:
        # files below the folders of the runs, whatever their batch
        deep = {"recursiveFileLookup": "true"}
        kinds = spark.read.options(**deep).parquet(*[f"{out}/run_id={r}" for r in earlier]).select(*keys).schema
        stored = spark.readStream.schema(kinds).options(**deep).parquet(f"{out}/run_id={{{','.join(earlier)}}}")
    query = _start(
        keyed_stream(reader.parquet(source), stored, keys).writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True), spark)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def retry_dead_letters(letters: DataFrame, work: Callable[[DataFrame], DataFrame], max_attempts: int = 3):
    """(rows that now succeed, rows still failing with their reason and next attempt number).

    ``work`` adds ``value`` and ``error``. Rows at ``max_attempts`` are not tried
    again and stay among the failing ones.
    """
    tried = work(letters.where(F.col("attempt") < max_attempts))
    fixed = tried.where(F.col("error").isNull()).drop("reason", "error", "attempt")
    failing = tried.where(F.col("error").isNotNull()).select(
        *[c for c in letters.columns if c not in ("reason", "attempt")],
        F.col("error").alias("reason"), (F.col("attempt") + 1).alias("attempt"))
    return fixed, failing.unionByName(letters.where(F.col("attempt") >= max_attempts))
