"""Corpus statistics: grouped and binned means, shares, correlations, quality metrics.

Means, counts and sums combine in the map tasks. Medians, quartiles and ranks go
through ``antipode.scale`` and never hold a group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antipode.functions.text import TOKEN_PATTERN
from antipode.scale import average_ranks, exact_quantiles, is_number, materialize, one_value, top_per_group

# The seven lattice classes by group number.
RANGE_CLASSES = (
    ("Triclinic", 1, 2), ("Monoclinic", 3, 15), ("Orthorhombic", 16, 74), ("Tetragonal", 75, 142),
    ("Trigonal", 143, 167), ("Hexagonal", 168, 194), ("Cubic", 195, 230),
)

# The 65 group numbers that can host a one-handed structure.
MEMBER_GROUPS = (
    1, 3, 4, 5, 16, 17, 18, 19, 20, 21, 22, 23, 24, 75, 76, 77, 78, 79, 80,
    89, 90, 91, 92, 93, 94, 95, 96, 97, 98, 143, 144, 145, 146,
    149, 150, 151, 152, 153, 154, 155, 168, 169, 170, 171, 172, 173,
    177, 178, 179, 180, 181, 182, 195, 196, 197, 198, 199,
    207, 208, 209, 210, 211, 212, 213, 214,
)

# Edges of the activity bins.
ACTIVITY_BINS = ((0.0, 0.1), (0.1, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8), (0.8, 1.0), (1.0, 1.5))


def range_class(number: Column, classes: Sequence[tuple[str, int, int]] = RANGE_CLASSES) -> Column:
    """Name of the range that holds ``number``; null outside all ranges."""
    out = F.when(number.between(classes[0][1], classes[0][2]), classes[0][0])
    for name, low, high in classes[1:]:
        out = out.when(number.between(low, high), name)
    return out


def member_flag(number: Column) -> Column:
    return number.isin(*MEMBER_GROUPS)


def bin_index(value: Column, bins: Sequence[tuple[float, float]]) -> Column:
    """Index of the half-open bin that holds ``value``; null outside all bins."""
    low, high = bins[0]
    out = F.when((value >= low) & (value < high), 0)
    for i, (low, high) in enumerate(bins[1:], 1):
        out = out.when((value >= low) & (value < high), i)
    return out


def correlation(x: str | Column, y: str | Column) -> Column:
    """Linear correlation as an aggregate; null where a side does not vary."""
    both = lambda a, b: F.when(_column(b).isNotNull(), _column(a))
    spread = F.stddev_pop(both(x, y)) * F.stddev_pop(both(y, x))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def counts_by(df: DataFrame, col: str, unknown: str = "unknown") -> DataFrame:
    """Rows per value, null counted as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(unknown)).alias(col)).agg(
        F.count(F.lit(1)).alias("n")
    )


def category_shares(df: DataFrame, col: str) -> DataFrame:
    """Rows and percent of all rows per category."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = one_value(df.agg(F.count(F.lit(1))))
    return counts.withColumn("pct", 100.0 * F.col("n") / total)


def value_summary(df: DataFrame, value: str, above: Sequence[float] = (90.0, 95.0)) -> DataFrame:
    """Count, mean, median and counts above each threshold, in one row."""
    stats = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        *[F.count_if(F.col(value) > a).alias(f"n_above_{a:g}") for a in above],
    )
    median = exact_quantiles(df, value, {"median": 0.5})
    return stats.withColumn("median", one_value(median.select("median")))


def by_range_class(df: DataFrame, number: str, value: str) -> DataFrame:
    """n, mean, sample deviation and median of ``value`` per range class of ``number``."""
    rows = df.select(range_class(F.col(number)).alias("range_class"), value).where(F.col("range_class").isNotNull())
    stats = rows.groupBy("range_class").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev")
    )
    return stats.join(exact_quantiles(rows, value, {"median": 0.5}, ["range_class"]), "range_class", "left")


def label_shares(df: DataFrame, labels: str, k: int = 15) -> DataFrame:
    """Most frequent array elements with their share of all elements."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = one_value(df.agg(F.sum(F.greatest(F.size(labels), F.lit(0)))))
    return counts.withColumn("pct", 100.0 * F.col("n") / total).orderBy(F.desc("n"), "label").limit(k)


def formula_counts(df: DataFrame, key: str, text: str, number: str = "long") -> DataFrame:
    """Element counts per record for texts of any length: n per (key, element).

    Equal tokens of a text are counted before their numbers are read, so the
    patterns run once over the text and then on short distinct tokens only. A
    number that the type ``number`` cannot hold adds nothing; n is null where
    an element has no other.
    """
    tokens = df.select(key, F.explode(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))).alias("t"))
    counted = tokens.groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"))
    digits = F.regexp_extract("t", TOKEN_PATTERN, 2)
    times = F.when(digits == "", F.lit(1).cast("long")).otherwise(digits.try_cast(number).cast("long"))
    return counted.groupBy(key, F.regexp_extract("t", TOKEN_PATTERN, 1).alias("element")).agg(
        F.sum(F.col("n") * times).alias("n"))


def group_mean_topn(df: DataFrame, group: str, value: str, min_n: int = 10, top: int = 5) -> DataFrame:
    """Groups with at least ``min_n`` rows, by highest mean."""
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return means.where(F.col("n") >= min_n).orderBy(F.desc("mean"), group).limit(top)


def bin_means(df: DataFrame, x: str, y: str, bins: Sequence[tuple[float, float]], min_n: int = 10) -> DataFrame:
    """Mean x and y per bin of x."""
    rows = df.withColumn("bin", bin_index(F.col(x), bins)).where(F.col("bin").isNotNull())
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y")
    ).where(F.col("n") >= min_n)


def log_fit(binned: DataFrame) -> DataFrame:
    """Linear fit of ln(1 - mean_y) on mean_x over the bins: slope, intercept, R2."""
    rows = binned.where(F.col("mean_y") < 1).select("mean_x", F.log(1 - F.col("mean_y")).alias("ly"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_bins"), F.regr_slope("ly", "mean_x").alias("slope"),
        F.regr_intercept("ly", "mean_x").alias("intercept"), F.regr_r2("ly", "mean_x").alias("r2"),
    )


def flag_rates(df: DataFrame, group: Column, flag: Column, name: str = "group_value") -> DataFrame:
    """Share of rows with ``flag`` per group."""
    return df.groupBy(group.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(flag.cast("double")).alias("rate")
    )


def rate_contrast(df: DataFrame, group: Column, flag: Column, first, second) -> DataFrame:
    """Rates of two groups side by side, with difference and ratio."""
    rates = df.where(group.isin(first, second)).agg(
        F.avg(F.when(group == first, flag.cast("double"))).alias("rate_first"),
        F.avg(F.when(group == second, flag.cast("double"))).alias("rate_second"),
    )
    return rates.withColumn("difference", F.col("rate_second") - F.col("rate_first")).withColumn(
        "ratio", F.col("rate_second") / F.nullif(F.col("rate_first"), F.lit(0.0))
    )


def decile_histogram(df: DataFrame, value: str) -> DataFrame:
    """Counts in ten bins of [0, 1]; 1 falls in the top bin."""
    return df.where(F.col(value).isNotNull()).groupBy(
        F.least(F.floor(F.col(value) * 10), F.lit(9)).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def peaks(histogram: DataFrame, apart: int = 3, share: float = 0.8) -> DataFrame:
    """Peak bin (lowest on ties) and the number of other bins that rival it from afar."""
    top = histogram.agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("t")).select(
        F.struct(F.col("t.n").alias("n"), (-F.col("t.b")).cast("int").alias("bin"))
    )
    marked = histogram.withColumn("top", one_value(top))
    far = (F.abs(F.col("bin") - F.col("top.bin")) >= apart) & (F.col("n") > share * F.col("top.n"))
    return marked.agg(
        F.max("top.bin").alias("peak_bin"), F.max("top.n").alias("peak_n"), F.count_if(far).alias("n_secondary")
    )


def pearson(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(correlation(x, y).alias("r"))


def spearman(df: DataFrame, x: str, y: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with mean ranks for ties.

    Rows collapse to distinct (x, y) counts first; each distinct value is ranked
    once and joined back, so a heavy tie costs one row. Points with a null or NaN are
    left out; a null group is a group.
    """
    groups = list(groups)
    points = (
        df.where(is_number(x) & is_number(y))
        .groupBy(*groups, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def with_ranks(rows: DataFrame, col: str, out: str) -> DataFrame:
        r = average_ranks(points, col, groups, F.col("_n"), out=out)
        r = r.select(*[F.col(g).alias(f"_r_{g}") for g in groups], F.col(col).alias("_r"), out,
                     *(["total"] if out == "_rx" else []))
        same = F.col(col) == F.col("_r")
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        return rows.join(r, same).drop("_r", *[f"_r_{g}" for g in groups])

    points = materialize(points, "points")
    ranked = with_ranks(with_ranks(points, "_x", "_rx"), "_y", "_ry")
    mid = (F.col("total") + 1) / F.lit(2.0)
    dx, dy, n = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_n")
    return ranked.groupBy(*groups).agg(
        F.sum(n).alias("n"),
        (F.sum(n * dx * dy) / F.nullif(F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy)), F.lit(0.0))).alias("rho"),
    )


def quartile_contrast(df: DataFrame, x: str, y: str) -> DataFrame:
    """Quartiles of x and the mean of y below the first and above the third."""
    q = exact_quantiles(df, x, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    marked = df.select(x, y).withColumn("q", one_value(q.select(F.struct("q25", "q50", "q75"))))
    low, high = F.col(x) < F.col("q.q25"), F.col(x) > F.col("q.q75")
    return marked.agg(
        F.max("q.q25").alias("q25"), F.max("q.q50").alias("q50"), F.max("q.q75").alias("q75"),
        F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"),
        F.avg(F.when(low, F.col(y))).alias("mean_low"), F.avg(F.when(high, F.col(y))).alias("mean_high"),
    )


def describe_metric(df: DataFrame, value: str, flag: str, groups: Sequence[str] = ()) -> DataFrame:
    """n, mean, population deviation, range, and whether most rows carry ``flag``."""
    return df.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        (F.count_if(F.col(flag)) > F.count(F.lit(1)) / 2).alias("majority"),
    )


def diversity_means(df: DataFrame, labels: str, value: str) -> DataFrame:
    """Mean metric per number of distinct labels in the row."""
    rows = df.where(F.size(labels) > 0)
    return rows.groupBy(F.size(F.array_distinct(labels)).alias("n_distinct")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")
    )


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Volume of a cell from its edges and its angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def regression_metrics(df: DataFrame, actual: str, predicted: str, groups: Sequence[str] = (),
                       class_match: Column | None = None) -> DataFrame:
    """n, MAE, RMSE, R2 and correlation of predictions; rows without a prediction are left out."""
    rows = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    err = F.col(actual) - F.col(predicted)
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (1 - F.sum(err * err) / F.nullif(F.var_pop(actual) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"),
        correlation(actual, predicted).alias("r"),
    ]
    if class_match is not None:
        aggs.append(F.count_if(class_match).alias("n_class_match"))
    return rows.groupBy(*groups).agg(*aggs)


def binary_metrics(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """AUC in rank form, precision, recall and F1 at ``cut``. ``label`` is 0 or 1."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranks = average_ranks(rows, score, extra={"n_pos": F.sum(label)})
    area = ranks.agg(
        F.sum(F.col("n_pos") * F.col("rank")).alias("rank_sum"), F.sum("n_pos").alias("p"), F.max("total").alias("t")
    ).select(
        ((F.col("rank_sum") - F.col("p") * (F.col("p") + 1) / F.lit(2.0))
         / F.nullif((F.col("p") * (F.col("t") - F.col("p"))).cast("double"), F.lit(0.0))).alias("auc")
    )
    hit = F.col(score) >= cut
    true = F.count_if(hit & (F.col(label) == 1))
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        (true / F.nullif(F.count_if(hit), F.lit(0))).alias("precision"),
        (true / F.nullif(F.count_if(F.col(label) == 1), F.lit(0))).alias("recall"),
    )
    f1 = 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    return counts.withColumn("f1", f1).withColumn("auc", one_value(area))


def shape_stats(df: DataFrame, value: str) -> DataFrame:
    """Mean, median, fullest decile bin, skewness and excess kurtosis (population forms)."""
    stats = df.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"),
    )
    median = exact_quantiles(df, value, {"median": 0.5}).select("median")
    mode = peaks(decile_histogram(df, value)).select("peak_bin")
    return stats.withColumn("median", one_value(median)).withColumn("mode_bin", one_value(mode))


def two_way_means(df: DataFrame, group: str, flag: Column, value: str) -> DataFrame:
    """Mean of flagged and other rows per group, with an overall row."""
    aggs = [
        F.count_if(flag).alias("n_flag"), F.count_if(~flag).alias("n_other"),
        F.avg(F.when(flag, F.col(value))).alias("mean_flag"), F.avg(F.when(~flag, F.col(value))).alias("mean_other"),
    ]
    overall = df.agg(*aggs).select(F.lit("Overall").alias(group), "n_flag", "n_other", "mean_flag", "mean_other")
    return df.groupBy(group).agg(*aggs).unionByName(overall)


def ordinal_rate_corr(df: DataFrame, group: str, order: Column, flag: Column) -> DataFrame:
    """Correlation of the flag share per class with the order of the classes."""
    rates = df.groupBy(group).agg(F.avg(flag.cast("double")).alias("rate"), F.min(order).alias("ord"))
    return rates.agg(F.count(F.lit(1)).alias("n_classes"), correlation("ord", "rate").alias("r"))


def means_by_contained_label(df: DataFrame, labels: str, values: Sequence[str], min_n: int = 1) -> DataFrame:
    """Metric means over the rows that contain each label."""
    rows = df.select(F.explode(F.array_distinct(labels)).alias("label"), *values)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    ).where(F.col("n") >= min_n)


def any_of_contrast(df: DataFrame, labels: str, wanted: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Metric means of rows that contain any of ``wanted`` against the others."""
    has = F.arrays_overlap(F.col(labels), F.array(*[F.lit(w) for w in wanted]))
    return df.groupBy(has.alias("contains_any")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values]
    )


def extreme_subset_stats(df: DataFrame, value: str, size: str) -> DataFrame:
    """Rows at the maximum of ``value``: number, and the spread of their sizes."""
    top = df.where(F.col(value) == one_value(df.agg(F.max(value))))
    stats = top.agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean"), F.min(size).alias("min"), F.max(size).alias("max")
    )
    return stats.withColumn("median", one_value(exact_quantiles(top, size, {"m": 0.5}).select("m")))


def ratio_by_size_bin(df: DataFrame, value: str, size: str, bins: Sequence[tuple[float, float]]) -> DataFrame:
    """Mean of value / size per size bin."""
    rows = df.withColumn("bin", bin_index(F.col(size), bins)).where(F.col("bin").isNotNull())
    return rows.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(value) / F.col(size)).alias("mean_ratio")
    )


def mean_baseline(df: DataFrame, fold: str, target: str) -> DataFrame:
    """Error of predicting, for each fold, the mean of the other folds."""
    per_fold = df.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    total = one_value(df.agg(F.struct(F.sum(target).alias("s"), F.count(target).alias("n"))))
    means = per_fold.withColumn("all", total).select(
        fold, ((F.col("all.s") - F.col("s")) / F.nullif(F.col("all.n") - F.col("n"), F.lit(0))).alias("prediction")
    )
    means = means.withColumnRenamed(fold, "_fold")
    rows = df.select(fold, target).join(means, F.col(fold).eqNullSafe(F.col("_fold")))
    return rows.agg(F.count(target).alias("n"), F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))


def mismatch_filter(df: DataFrame, high: str, low: str, high_cut: float = 0.99, low_cut: float = 0.2,
                    k: int = 10, key: str = "id") -> DataFrame:
    """Rows high in one metric and low in the other, lowest first."""
    return df.where((F.col(high) > high_cut) & (F.col(low) < low_cut)).orderBy(low, key).limit(k)


def list_page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """One page in key order with the total number of rows."""
    total = one_value(df.agg(F.count(F.lit(1))))
    return df.withColumn("total", total).orderBy(key).offset(offset).limit(limit)


def slim_page(df: DataFrame, key: str, columns: Sequence[str], lists: Sequence[str], offset: int, limit: int) -> DataFrame:
    """A page that shows the length of each list, ``n_`` and its name, instead of the list; null counts as empty."""
    sizes = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}") for c in lists]
    return list_page(df.select(key, *columns, *sizes), key, offset, limit)


def top_rows(df: DataFrame, order: Sequence[Column], k: int, groups: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows overall or per group."""
    return top_per_group(df, groups, order, k) if groups else df.orderBy(*order).limit(k)
