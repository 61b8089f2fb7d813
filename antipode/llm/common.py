"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from antipode.scale import materialize

#: White space of the operator contracts: space and the ASCII controls 9 to 13.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text one Python batch works on at a time.
CHUNK_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str | StructType, work: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` for functions from batches of columns to batches of columns (name to list or array)."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(_columns(batches)):
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x, pa.Array) else pa.array(x, type=f.type)
                 for f, x in zip(arrow, (out[f.name] for f in arrow), strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task would keep it

    def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            # slices keep memory bounded when texts are long
            step = max(1, int(b.num_rows * CHUNK_BYTES / max(b.nbytes, CHUNK_BYTES)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield {n: part.column(j) for j, n in enumerate(part.schema.names)}

    return df.mapInArrow(run, schema)


def spread_files(df: DataFrame, key: str) -> DataFrame:
    """Deal a stored table with few splits out over the cores; larger tables pass unchanged."""
    spark = df.sparkSession
    files = df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores * 2, key) if len(files) == 1 and cores > 1 else df


def range_cuts(df: DataFrame, column: str, pieces: int) -> list[int]:
    """At most ``pieces - 1`` ascending split points of an integer column, from a quantile sketch."""
    if pieces < 2:
        return []
    probs = [i / pieces for i in range(1, pieces)]
    row = df.select(F.percentile_approx(F.col(column), probs, 20 * pieces)).first()
    return sorted(set(row[0] or []))


def bucket_of(column: str, cuts: Sequence[int]) -> Column:
    """How many of ``cuts`` are at most the value (null: -1), by binary search in generated code."""
    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < cuts[mid], pick(lo, mid)).otherwise(pick(mid + 1, hi))
    return F.when(F.col(column).isNull(), F.lit(-1)).otherwise(pick(0, len(cuts)))


def bucketed(df: DataFrame, column: str, buckets: int, **options: str) -> DataFrame:
    """Write ``df`` as a bucketed table in the warehouse and read it: later grouping by ``column`` needs no exchange."""
    name = f"stage_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).saveAsTable(name, format="parquet", **options)
    return df.sparkSession.table(name)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside join tables bucketed by one of several join keys where they lie, without an exchange."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform_of(text: Column) -> Column:
    """A number in [0, 1) fixed by a text: the first 32 bits of its md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


__all__ = ["ASCII_SPACE", "CHUNK_BYTES", "WORD_PATTERN", "bucket_of", "bucketed", "joined_in_place", "map_rows", "materialize",
           "range_cuts", "read_table", "shuffle_width", "spread_files", "uniform_of"]
