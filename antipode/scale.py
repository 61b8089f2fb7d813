"""Skew-safe building blocks shared by the operators.

Nothing here gathers a group in one task. Ranks and quantiles come from
aggregated distinct values cut into value ranges, row numbers from one range
shuffle, so a key that owns a third of the table is spread like any other.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ storage

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    A local-mode session without the setting gets one folder of its own, removed when Python ends; the
    session's settings stay as they are. On a cluster the setting is required.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        app = sc.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[app], ignore_errors=True)
        folder = _OWN_FOLDERS[app]
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and pins non-deterministic columns; the files survive the
    loss of any executor and keep column pruning for later reads.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over all cores when the input has fewer splits than cores.

    Meant for costly per-row work on a table stored in a few row groups. A table
    of many splits passes unchanged, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow frame for broadcast once a count has shown that it is small; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# ------------------------------------------------------------- value ranges

def range_count(spark: SparkSession) -> int:
    """How many value ranges to cut, following the shuffle width."""
    return max(4, min(1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def with_value_range(df: DataFrame, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add a range number that grows with ``value``.

    The split points are an approximate quantile sketch (at most ``ranges``
    numbers reach the driver). Splits only balance the work: any split points
    give the same result downstream.
    """
    ranges = ranges or range_count(df.sparkSession)
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.select(F.percentile_approx(F.col(value).cast("double"), probs, 20 * ranges)).first()[0]
    cuts = sorted({float(c) for c in cuts}) if cuts else []
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="_range_in", outputCol=out)
        .transform(df.withColumn("_range_in", F.col(value).cast("double")))
        .drop("_range_in")
    )


def is_number(value: str) -> Column:
    c = F.col(value).cast("double")
    return c.isNotNull() & ~F.isnan(c)


def cumulative_counts(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    weight: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Distinct values per group with their weight, the weight before them and the total.

    Output: groups, value, ``weight``, ``before``, ``total`` and the ``extra`` sums.
    """
    groups = list(groups)
    extra = extra or {}
    weight = F.lit(1) if weight is None else weight
    counts = (
        df.where(is_number(value))
        .groupBy(*groups, value)
        .agg(F.sum(weight).cast("long").alias("weight"), *[e.alias(n) for n, e in extra.items()])
    )
    ranged = with_value_range(counts, value, "_range")
    sizes = ranged.groupBy(*groups, "_range").agg(F.sum("weight").alias("_in_range"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    # one row per group and range, so at most `range_count` rows per window
    sizes = sizes.withColumn(
        "_before", F.sum("_in_range").over(by_group.orderBy("_range")) - F.col("_in_range")
    ).withColumn("total", F.sum("_in_range").over(by_group)).drop("_in_range")
    inner = Window.partitionBy(*groups, "_range").orderBy(value)
    running = ranged.withColumn("_run", F.sum("weight").over(inner))
    on = [*groups, "_range"]
    if groups:
        right = sizes.select(
            *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_range").alias("_r"), "_before", "total"
        )
        cond = F.col("_range") == F.col("_r")
        for g in groups:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        joined = running.join(right, cond)
    else:
        # the sizes table has one row per range: bounded by range_count
        joined = running.join(F.broadcast(sizes), on)
    return joined.select(
        *groups, value, "weight",
        (F.col("_before") + F.col("_run") - F.col("weight")).alias("before"),
        "total", *extra,
    )


def average_ranks(df: DataFrame, value: str, groups: Sequence[str] = (), weight: Column | None = None,
                  extra: dict[str, Column] | None = None, out: str = "rank") -> DataFrame:
    """Rank per distinct value, ties sharing their mean rank (1-based)."""
    return cumulative_counts(df, value, groups, weight, extra).withColumn(
        out, F.col("before") + (F.col("weight") + 1) / F.lit(2.0)
    )


SKETCH_K = 8192
#: Three times the rank error that a sketch of SKETCH_K keeps in 99 of 100 cases, as a share of the rows.
SKETCH_MARGIN = 3 * 2.296 / SKETCH_K**0.9021
SMALL_GROUP = 4096  # groups of up to so many rows are counted whole


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles per group in two reads, without holding a group in memory.

    The first read makes a mergeable sketch per group, which brackets each wanted rank. The second counts
    what lies below each bracket and the values inside, a fraction of a percent of the rows. Should a
    rank lie outside of its bracket, its group is counted whole.
    """
    groups = list(groups)
    rows = df.where(is_number(value)).select(*groups, F.col(value).cast("double").alias("_v"))
    sketched = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_v", SKETCH_K).alias("_s")).where("_n > 0")
    small = F.col("_n") <= SMALL_GROUP
    at = lambda rank, end: F.when(small, F.lit(end)).otherwise(
        F.kll_sketch_get_quantile_double("_s", F.lit(min(1.0, max(0.0, rank)))))
    wanted = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(float(p)).alias("p"), at(p - SKETCH_MARGIN, float("-inf")).alias("lo"),
        at(p + SKETCH_MARGIN, float("inf")).alias("hi")) for n, p in probs.items()])
    pos = F.col("_q.p") * (F.col("_n") - 1)
    need = sketched.withColumn("_q", F.explode(wanted)).select(
        *groups, F.col("_q.name").alias("_name"), F.floor(pos).alias("_first"), F.ceil(pos).alias("_last"), (pos - F.floor(pos)).alias("_frac"),
        F.col("_q.lo").alias("_lo"), F.col("_q.hi").alias("_hi"))
    need = materialize(need, "brackets")  # one row per group and quantile
    found = materialize(_ranked_within(rows, need, groups), "quantiles")
    missed = found.where("_a IS NULL OR _b IS NULL")
    if not missed.isEmpty():
        keys = missed.select(*[F.col(g).alias(f"_m_{g}") for g in groups], F.col("_name").alias("_m__name"))
        whole = need.join(keys, _same_keys([*groups, "_name"], "_m_"), "left_semi").withColumn(
            "_lo", F.lit(float("-inf"))).withColumn("_hi", F.lit(float("inf")))
        found = found.where("_a IS NOT NULL AND _b IS NOT NULL").unionByName(_ranked_within(rows, whole, groups))
    valued = found.withColumn("_value", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac"))
    return valued.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in probs])


def _ranked_within(rows: DataFrame, need: DataFrame, groups: list[str]) -> DataFrame:
    """The values at the ranks ``_first`` and ``_last`` of each bracket; null where they lie outside."""
    keyed = need.select(*[F.col(g).alias(f"_k_{g}") for g in groups], "_name", "_first", "_last", "_frac", "_lo", "_hi")
    inside = rows.join(broadcast_if_small(keyed), _same_keys(groups, "_k_") & (F.col("_v") <= F.col("_hi"))) if groups else rows.join(
        F.broadcast(keyed), F.col("_v") <= F.col("_hi"))  # one row per quantile
    ranked = [*groups, "_name", "_first", "_last", "_frac"]
    counts = inside.groupBy(*ranked, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*ranked).orderBy(F.asc_nulls_first("_x"))  # what lies below comes first
    counts = counts.withColumn("_end", F.sum("_c").over(run)).withColumn("_start", F.col("_end") - F.col("_c"))
    at = lambda which: F.max(F.when((F.col(which) >= F.col("_start")) & (F.col(which) < F.col("_end")), F.col("_x")))
    return counts.groupBy(*ranked).agg(at("_first").alias("_a"), at("_last").alias("_b"))


# -------------------------------------------------------------- row numbers

LARGE_GROUP = 1_000_000  # rows of a group that one task may sort


def _same_keys(groups: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return cond


def _number_sorted(df: DataFrame, groups: list[str], order: Sequence[Column], out: str) -> DataFrame:
    """Row numbers from one range shuffle on (groups, order).

    A large group spreads over many sorted pieces. The sorted rows are written
    once, and the counts per (group, piece) give each piece its offset.
    """
    ordered = df.orderBy(*[F.col(g) for g in groups], *order)
    stored = materialize(
        ordered.withColumn("_mid", F.monotonically_increasing_id()), "ordered"
    ).withColumn("_piece", F.shiftright("_mid", 33))
    pieces = stored.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_start"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    # one row per group and sorted piece; a group spans at most all pieces of the shuffle
    pieces = pieces.withColumn("_offset", F.sum("_n").over(w.orderBy("_piece")) - F.col("_n")).select(
        *[F.col(g).alias(f"_p_{g}") for g in groups], F.col("_piece").alias("_p_piece"), "_start", "_offset"
    )
    cond = (F.col("_piece") == F.col("_p_piece")) & _same_keys(groups, "_p_")
    return stored.join(pieces, cond).select(
        *df.columns, (F.col("_mid") - F.col("_start") + F.col("_offset") + 1).cast("long").alias(out)
    )


def group_row_number(df: DataFrame, groups: Sequence[str], order: Sequence[Column], out: str,
                     large: int = LARGE_GROUP, task_rows: int | None = None) -> DataFrame:
    """1-based position in each group, for groups of any size.

    Groups of up to ``large`` rows are numbered in one window. Larger ones, found
    by a count, take the range shuffle of ``_number_sorted``. ``order`` must be a
    total order. With ``task_rows`` a table too long for that many rows in each task of a
    shuffle is dealt to more tasks, so that what a task sorts, here and in later steps by the same groups, does not grow with the table.
    """
    groups = list(groups)
    if not groups:
        return _number_sorted(df, groups, order, out)
    w = Window.partitionBy(*groups).orderBy(*order)
    plain = lambda rows: rows.withColumn(out, F.row_number().over(w).cast("long"))
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    crowded = counts.where(F.col("_n") > large)
    rows, hot = counts.agg(F.sum("_n"), F.count_if(F.col("_n") > large)).first()
    tasks = -(-(rows or 0) // task_rows) if task_rows else 0
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        plain = lambda some: some.repartition(tasks, *groups).withColumn(out, F.row_number().over(w).cast("long"))
    if not hot:
        return plain(df)
    keys = materialize(crowded.select(*[F.col(g).alias(f"_k_{g}") for g in groups]), "crowded")
    rest = df.join(keys, _same_keys(groups, "_k_"), "left_anti")
    big = df.join(keys, _same_keys(groups, "_k_"), "left_semi")
    return plain(rest).unionByName(_number_sorted(big, groups, order, out))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int,
                  out: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their rank.

    The filter on the rank lets Spark keep ``k`` rows per group in each map task
    before the shuffle, so a large group sends only ``k`` rows per task.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` values per group, as an aggregate."""
    rest = [c for c in df.columns if c not in groups]
    key = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*groups).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return picked.select(*groups, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def one_value(df: DataFrame) -> Column:
    """The single value of a one-row, one-column frame, usable in any expression."""
    return df.scalar()
