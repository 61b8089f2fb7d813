"""Differential screening of pairs over their measurements.

Measurements are averaged per (entity, target, kind, units) before any join.
The pair sides are then attached to those averages and both sides of a pair meet
in one aggregate keyed by (pair, target): shared targets, gaps and fold changes
come out of the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antipode.scale import broadcast_if_small, top_per_group

# Fallback order of measurement kinds and smallest divisor of a ratio.
FALLBACK_KINDS = ("IC50", "Ki", "EC50")
FETCHED_KINDS = ("IC50", "Ki", "EC50", "Kd", "GI50")
SMALLEST = 1e-10

PAIR = ["a_id", "b_id"]


def measurement_filter(meas: DataFrame, kinds: Sequence[str] = FETCHED_KINDS) -> DataFrame:
    """Keep the known kinds with a numeric value; an unreadable normalised value becomes null."""
    return (
        meas.where(F.col("kind").isin(*kinds))
        .withColumn("value", F.expr("try_cast(value AS DOUBLE)"))
        .withColumn("norm_value", F.expr("try_cast(norm_value AS DOUBLE)"))
        .where(F.col("value").isNotNull())
    )


def entity_target_means(meas: DataFrame) -> DataFrame:
    """Sums and counts per (entity, target, kind, units): all later means derive from them."""
    positive = F.when(F.col("value") > 0, F.col("value"))
    return meas.groupBy("entity_id", "target_id", "kind", "units").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("norm_value").alias("norm_sum"),
        F.count("norm_value").alias("norm_n"),
        F.sum(positive).alias("value_sum"),
        F.count(positive).alias("value_n"),
    )


def fold_of_logs(a: Column, b: Column) -> Column:
    """Fold change of two log10 means."""
    return F.pow(F.lit(10.0), F.abs(a - b))


def fold_of_values(a: Column, b: Column) -> Column:
    """Larger over smaller, with a floor on the divisor."""
    return F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(SMALLEST))


def attach_measurements(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """Averages of both sides of every pair, one row per (pair, side, target, kind, units)."""
    side = F.explode(F.array(
        F.struct(F.col("a_id").alias("entity_id"), F.lit("a").alias("side")),
        F.struct(F.col("b_id").alias("entity_id"), F.lit("b").alias("side")),
    )).alias("s")
    sides = pairs.select("class_key", *PAIR, side).select("class_key", *PAIR, "s.entity_id", "s.side")
    return means.join(broadcast_if_small(sides), "entity_id")


def pair_target_profile(pairs: DataFrame, meas: DataFrame, kinds: Sequence[str] = FALLBACK_KINDS) -> DataFrame:
    """One row per (pair, target) measured on either side.

    ``presence`` is ``shared``, ``a_only`` or ``b_only``. For shared targets the
    fold change uses the normalised means of both sides, else the first kind in
    ``kinds`` with positive values in the same units on both sides, else null.
    """
    rows = attach_measurements(pairs, entity_target_means(meas))
    # one exchange serves both aggregates below; a hot pair is spread by its targets
    rows = rows.repartition(*PAIR, "target_id")

    def on(side: str, column: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col(column)))

    per_kind = rows.groupBy(*PAIR, "target_id", "kind", "units").agg(
        F.first("class_key").alias("class_key"),
        *[on(s, c).alias(f"{c}_{s}") for s in "ab" for c in ("n", "norm_sum", "norm_n", "value_sum", "value_n")],
    )
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    usable = (F.col("value_n_a") > 0) & (F.col("value_n_b") > 0) & F.col("kind").isin(*kinds)
    fallback = F.min_by(
        F.struct("kind", "units", (F.col("value_sum_a") / F.col("value_n_a")).alias("mean_a"),
                 (F.col("value_sum_b") / F.col("value_n_b")).alias("mean_b")),
        F.when(usable, F.struct(order[F.col("kind")].alias("k"), F.col("units").alias("u"))),
    )
    per_target = per_kind.groupBy(*PAIR, "target_id").agg(
        F.first("class_key").alias("class_key"),
        F.coalesce(F.sum("n_a"), F.lit(0)).alias("n_a"),
        F.coalesce(F.sum("n_b"), F.lit(0)).alias("n_b"),
        F.sum("norm_sum_a").alias("_sa"), F.sum("norm_n_a").alias("_na"),
        F.sum("norm_sum_b").alias("_sb"), F.sum("norm_n_b").alias("_nb"),
        fallback.alias("_f"),
    )
    log_a, log_b = F.col("_sa") / F.nullif(F.col("_na"), F.lit(0)), F.col("_sb") / F.nullif(F.col("_nb"), F.lit(0))
    has_logs = (F.col("_na") > 0) & (F.col("_nb") > 0)
    shared = (F.col("n_a") > 0) & (F.col("n_b") > 0)
    return per_target.select(
        "class_key", *PAIR, "target_id", "n_a", "n_b",
        F.when(shared, "shared").when(F.col("n_a") > 0, "a_only").otherwise("b_only").alias("presence"),
        F.when(has_logs, F.lit("norm")).otherwise(F.col("_f.kind")).alias("kind"),
        F.when(~F.coalesce(has_logs, F.lit(False)), F.col("_f.units")).alias("units"),
        F.when(has_logs, log_a).otherwise(F.col("_f.mean_a")).alias("mean_a"),
        F.when(has_logs, log_b).otherwise(F.col("_f.mean_b")).alias("mean_b"),
        F.when(has_logs, F.abs(log_a - log_b)).alias("diff"),
        F.when(has_logs, fold_of_logs(log_a, log_b))
        .otherwise(fold_of_values(F.col("_f.mean_a"), F.col("_f.mean_b"))).alias("fold_change"),
    )


def shared_targets(profile: DataFrame) -> DataFrame:
    """Targets measured on both sides."""
    return profile.where(F.col("presence") == "shared")


def gap_targets(profile: DataFrame) -> DataFrame:
    """Targets measured on one side only, with that side."""
    return profile.where(F.col("presence") != "shared").select(
        "class_key", *PAIR, "target_id", F.substring("presence", 1, 1).alias("side")
    )


def pair_summary(pairs: DataFrame, profile: DataFrame, min_fold: float = 3.0) -> DataFrame:
    """Counts per pair; pairs without measurements are kept with zeros."""
    is_diff = F.col("fold_change") >= min_fold
    stats = profile.groupBy(*PAIR).agg(
        F.count_if(F.col("presence") == "shared").alias("n_shared"),
        F.count_if(F.col("presence") == "a_only").alias("n_gap_a"),
        F.count_if(F.col("presence") == "b_only").alias("n_gap_b"),
        F.sum(F.col("n_a") + F.col("n_b")).alias("n_measurements"),
        F.count("fold_change").alias("n_comparable"),
        F.count_if(is_diff).alias("n_differential"),
        F.max(F.when(is_diff, F.col("fold_change"))).alias("max_fold"),
    )
    return pairs.join(stats, PAIR, "left").fillna(
        0, ["n_shared", "n_gap_a", "n_gap_b", "n_measurements", "n_comparable", "n_differential"]
    )


def _gap_text() -> Column:
    a, b = F.col("a_id").cast("string"), F.col("b_id").cast("string")

    def one_sided(tested: Column, untested: Column, n: str) -> Column:
        return F.format_string("%s tested on %d targets, %s untested. Recommend testing %s.",
                               tested, F.col(n), untested, untested)

    return (
        F.when(F.col("n_gap_b") == 0, one_sided(a, b, "n_gap_a"))
        .when(F.col("n_gap_a") == 0, one_sided(b, a, "n_gap_b"))
        .otherwise(F.format_string("Activity gaps in both directions: %s unique targets=%d, %s unique targets=%d.",
                                   a, F.col("n_gap_a"), b, F.col("n_gap_b")))
    )


def _differential_text() -> Column:
    return F.format_string("%d sensitive target(s)", F.col("n_differential"))


def gap_hits(summary: DataFrame) -> DataFrame:
    """Pairs with a target measured on one side only; priority = gaps * (1 + 0.1 * measurements)."""
    gaps = F.col("n_gap_a") + F.col("n_gap_b")
    return summary.where(gaps > 0).select(
        F.lit("activity_gap").alias("hit_type"), "class_key", *PAIR,
        (gaps * (1 + F.lit(0.1) * F.col("n_measurements"))).alias("priority"),
        _gap_text().alias("description"),
    )


def differential_hits(summary: DataFrame) -> DataFrame:
    """Pairs with a differential target; priority = largest fold change * number of them."""
    return summary.where(F.col("n_differential") > 0).select(
        F.lit("differential").alias("hit_type"), "class_key", *PAIR,
        (F.col("max_fold") * F.col("n_differential")).alias("priority"),
        _differential_text().alias("description"),
    )


def pair_hits(summary: DataFrame) -> DataFrame:
    """Gap hits and differential hits of a summary in one pass over it."""
    gaps = F.col("n_gap_a") + F.col("n_gap_b")
    both = F.array_compact(F.array(
        F.when(gaps > 0, F.struct(
            F.lit("activity_gap").alias("hit_type"),
            (gaps * (1 + F.lit(0.1) * F.col("n_measurements"))).alias("priority"), _gap_text().alias("description"))),
        F.when(F.col("n_differential") > 0, F.struct(
            F.lit("differential").alias("hit_type"),
            (F.col("max_fold") * F.col("n_differential")).alias("priority"), _differential_text().alias("description"))),
    ))
    rows = summary.select("class_key", *PAIR, F.explode(both).alias("h"))
    return rows.select("h.hit_type", "class_key", *PAIR, "h.priority", "h.description")


def differential_lines(profile: DataFrame, names: DataFrame | None = None, min_fold: float = 3.0) -> DataFrame:
    """The text line of every differential target: one row each, never gathered per pair."""
    rows = profile.where(F.col("fold_change") >= min_fold)
    if names is not None:
        rows = rows.join(names, "target_id", "left")
    name = F.coalesce(F.col("target_name"), F.lit("")) if names is not None else F.lit("")
    return rows.select(
        *PAIR, "target_id", "fold_change",
        F.format_string("  %s (%s): %.1fx differential", name, F.col("target_id").cast("string"),
                        F.col("fold_change")).alias("line"),
    )


def union_screens(*hits: DataFrame) -> DataFrame:
    """All hit lists under one schema."""
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def rank_hits(hits: DataFrame, keys: Sequence[str] = ("class_key", "a_id", "b_id", "hit_type")) -> DataFrame:
    """Highest priority first; ``keys`` settle ties."""
    return hits.orderBy(F.desc("priority"), *keys)


def best_per_type_and_class(hits: DataFrame) -> DataFrame:
    """Best hit per (hit_type, class_key)."""
    best = top_per_group(hits, ["hit_type", "class_key"], [F.desc("priority"), F.asc("a_id"), F.asc("b_id")], 1)
    return best.drop("rank")


def best_per_id(hits: DataFrame, id_col: str, screen_order: str) -> DataFrame:
    """Best hit per id over several screens; the earlier screen wins ties."""
    best = top_per_group(hits, [id_col], [F.desc("priority"), F.asc(screen_order)], 1)
    return best.drop("rank")


def best_fold_per_pair_target(rows: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """Row with the highest fold change per (a, b, target)."""
    best = top_per_group(rows, [*PAIR, "target_id"], [F.desc("fold_change"), *[F.asc(t) for t in tie]], 1)
    return best.drop("rank")


def hits_flat(hits: DataFrame) -> DataFrame:
    """Flat projection for export."""
    return hits.select("hit_type", "class_key", *PAIR, F.round("priority", 6).alias("priority"), "description")


def report_counts(hits: DataFrame, shown: int = 20) -> DataFrame:
    """Hits per type, how many the top list shows and how many more there are."""
    return hits.groupBy("hit_type").agg(F.count(F.lit(1)).alias("n_hits")).select(
        "hit_type", "n_hits",
        F.least("n_hits", F.lit(shown)).cast("long").alias("n_shown"),
        F.greatest(F.col("n_hits") - shown, F.lit(0)).cast("long").alias("n_more"),
    )


def report_top(hits: DataFrame, shown: int = 20) -> DataFrame:
    """Top hits per type."""
    return top_per_group(hits, ["hit_type"], [F.desc("priority"), F.asc("a_id"), F.asc("b_id")], shown)


def target_datasets(profile: DataFrame, min_fold: float = 3.0, min_records: int = 1,
                    untested_as_negative: bool = False) -> DataFrame:
    """Records, positives and negatives per target over all pairs.

    A shared target without comparable values counts as a negative only with
    ``untested_as_negative``.
    """
    rows = global_dataset(profile, min_fold, untested_as_negative)
    return rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if("is_differential").alias("n_differential"),
        F.count_if(~F.col("is_differential")).alias("n_non_differential"),
    ).where(F.col("n_records") >= min_records)


def global_dataset(profile: DataFrame, min_fold: float = 3.0, untested_as_negative: bool = False) -> DataFrame:
    """Training rows of all targets: (pair, target, fold_change, is_differential)."""
    rows = shared_targets(profile)
    if untested_as_negative:
        rows = rows.withColumn("fold_change", F.coalesce("fold_change", F.lit(1.0)))
    else:
        rows = rows.where(F.col("fold_change").isNotNull())
    return rows.select(
        *PAIR, "target_id", "mean_a", "mean_b", "fold_change",
        (F.col("fold_change") >= min_fold).alias("is_differential"),
    )


def target_set_ops(profile: DataFrame) -> DataFrame:
    """Set view of a pair's targets, in long form: one row per (pair, set, target)."""
    name = (
        F.when(F.col("presence") == "shared", "a_and_b")
        .when(F.col("presence") == "a_only", "a_minus_b").otherwise("b_minus_a")
    )
    return profile.select(*PAIR, name.alias("set_name"), "target_id")


def bounded_hits(hits: DataFrame, low: float, high: float, limit: int, size_col: str | None = None,
                 max_size: int | None = None) -> DataFrame:
    """Differential hits with the fold change in [low, high], size capped, first ``limit`` by priority."""
    kept = hits.where(F.col("fold_change").between(low, high))
    if size_col:
        kept = kept.where(F.col(size_col) <= max_size)
    return kept.orderBy(F.desc("fold_change"), "a_id", "b_id", "target_id").limit(limit)


def distinct_both_sides(pairs: DataFrame) -> DataFrame:
    """Distinct non-empty ids over both sides."""
    ids = pairs.select(F.col("a_id").alias("entity_id")).unionByName(pairs.select(F.col("b_id").alias("entity_id")))
    return ids.where(F.col("entity_id").isNotNull() & (F.col("entity_id").cast("string") != "")).distinct()


def stage_progress(summary: DataFrame) -> DataFrame:
    """One row: pairs in total, with data, with differential, with gap, percent with data."""
    return summary.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("n_measurements") > 0).alias("n_with_data"),
        F.count_if(F.col("n_differential") > 0).alias("n_with_differential"),
        F.count_if(F.col("n_gap_a") + F.col("n_gap_b") > 0).alias("n_with_gap"),
    ).withColumn("pct_with_data", F.round(100.0 * F.col("n_with_data") / F.col("n_pairs"), 1))
