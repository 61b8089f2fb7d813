"""Prediction profiles, comparisons of both sides, and candidate ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antipode.functions import labels as L
from antipode.functions import rules as R
from antipode.operators.pairs import single_flip_pairs
from antipode.scale import first_per_group, group_row_number, materialize, one_value, top_per_group

PAIR = ["a_id", "b_id"]
SMALLEST = 1e-10


def fold_of_sizes(a: Column, b: Column) -> Column:
    """Larger absolute value over the smaller one, with a floor on the divisor."""
    return F.greatest(F.abs(a), F.abs(b)) / F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(SMALLEST))


def profile_with_fallback(local: DataFrame, general: DataFrame) -> DataFrame:
    """Prediction per (pair, target): the target's own model where it has one, else the general model.

    A target with any local model never falls back, as in a per-target lookup;
    the two prediction tables meet in a full join on (pair, target).
    """
    modelled = local.select("target_id").distinct()
    rest = general.join(modelled, "target_id", "left_anti")
    return local.select(*PAIR, "target_id", "predicted", F.lit("per_target").alias("source")).unionByName(
        rest.select(*PAIR, "target_id", "predicted", F.lit("global").alias("source"))
    )


def profile_summary(profile: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Per pair: number of sensitive targets and the strongest target."""
    best = F.max_by(F.struct("target_id", "predicted"), F.struct("predicted", (-F.col("target_id")).alias("t")))
    return profile.groupBy(*PAIR).agg(
        F.count_if(F.col("predicted") >= threshold).alias("n_sensitive"), best.alias("_b")
    ).select(*PAIR, "n_sensitive", F.col("_b.target_id").alias("top_target"), F.col("_b.predicted").alias("top_fold"))


def flag_top_n(summary: DataFrame, value: str, count: str, hit_type: str, n: int = 50) -> DataFrame:
    """The ``n`` pairs with the highest value * count, out of all pairs with a count."""
    return summary.where(F.col(count) > 0).withColumn("priority", F.col(value) * F.col(count)).withColumn(
        "hit_type", F.lit(hit_type)
    ).orderBy(F.desc("priority"), *PAIR).limit(n)


def compare_profiles(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Both sides' predictions per (pair, property), with fold difference and risk levels."""
    a = predictions.select(F.col("entity_id").alias("a_id"), "property", F.col("value").alias("value_a"))
    b = predictions.select(F.col("entity_id").alias("b_id"), "property", F.col("value").alias("value_b"))
    rows = pairs.select(*PAIR).join(a, "a_id").join(b, ["b_id", "property"])
    prop = F.col("property")
    return rows.select(
        *PAIR, "property", "value_a", "value_b",
        fold_of_sizes(F.col("value_a"), F.col("value_b")).alias("fold_difference"),
        R.risk_level(prop, F.col("value_a")).alias("risk_a"), R.risk_level(prop, F.col("value_b")).alias("risk_b"),
    ).withColumn("risk_divergent", F.col("risk_a") != F.col("risk_b"))


def divergence_summary(compared: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Per pair: divergent properties, the worst fold difference, and what follows."""
    divergent = (F.col("fold_difference") >= threshold) | F.col("risk_divergent")
    return compared.groupBy(*PAIR).agg(
        F.count_if(divergent).alias("n_divergent"), F.max("fold_difference").alias("worst_divergence")
    ).withColumn("recommendation", F.when(F.col("n_divergent") > 0, "chirality_matters").otherwise("chirality_neutral"))


def risk_rollup(levels: DataFrame) -> DataFrame:
    """Per entity: high and moderate risks, and the worst level."""
    return levels.groupBy("entity_id").agg(
        F.count_if(F.col("risk") == "high_risk").alias("n_high"),
        F.count_if(F.col("risk") == "moderate_risk").alias("n_moderate"),
    ).withColumn("overall", F.when(F.col("n_high") > 0, "high_risk").when(F.col("n_moderate") > 0, "moderate_risk")
                 .otherwise("low_risk"))


def label_fate(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each (record, position): new, lost, retained, inverted or unchanged."""
    keys = ["record_id", "pos"]
    a = before.select(*keys, F.col("label").alias("label_before"))
    b = after.select(*keys, F.col("label").alias("label_after"))
    x, y = F.col("label_before"), F.col("label_after")
    return a.join(b, keys, "full_outer").withColumn(
        "fate",
        F.when(x.isNull(), "new").when(y.isNull(), "lost").when(x == y, "retained")
        .when(x.isin("R", "S") & y.isin("R", "S"), "inverted").otherwise("unchanged"),
    )


def last_record(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Row with the highest sequence per key, as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def both_sides_measured(pairs: DataFrame, records: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Last value of both sides per (pair, property), where both sides have one."""
    last = last_record(records.select("entity_id", "property", "value", *seq), ["entity_id", "property"], seq)
    a = last.select(F.col("entity_id").alias("a_id"), "property", F.col("value").alias("value_a"))
    b = last.select(F.col("entity_id").alias("b_id"), "property", F.col("value").alias("value_b"))
    return pairs.select(*PAIR).join(a, "a_id").join(b, ["b_id", "property"]).select(
        *PAIR, "property", "value_a", "value_b")


def property_datasets(meas: DataFrame, min_records: int = 10) -> DataFrame:
    """Numeric records per property class."""
    rows = meas.select(
        R.property_class(F.col("kind"), F.col("assay_type"), F.col("target_name")).alias("property"),
        F.col("value").cast("string").try_cast("double").alias("value"),
    ).where(F.col("property").isNotNull() & F.col("value").isNotNull())
    return rows.groupBy("property").agg(F.count(F.lit(1)).alias("n_records"), F.avg("value").alias("mean")).where(
        F.col("n_records") >= min_records
    )


def strategy_lookup(envs: DataFrame, strategies: DataFrame, default: str = "generic") -> DataFrame:
    """Strategies of each environment, those of ``default`` where it has none.

    Confidence is 0.8, and 0.3 for the default environment itself.
    """
    known = strategies.select("environment").distinct().withColumn("known", F.lit(True))
    keyed = envs.join(known, "environment", "left").select(
        *envs.columns, F.coalesce(F.when(F.col("known"), F.col("environment")), F.lit(default)).alias("_key"),
        F.when(F.col("environment") != default, 0.8).otherwise(0.3).alias("confidence"),
    )
    return keyed.join(strategies.withColumnRenamed("environment", "_key"), "_key").drop("_key")


def hits_for_query(results: DataFrame, pairs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Neighbours of a query turned into pair hits: one per class, best ``k`` per query.

    ``results``: query_id, entity_id, similarity, rank. ``counts``: entity_id, n.
    """
    side = F.explode(F.array(F.col("a_id"), F.col("b_id"))).alias("entity_id")
    sides = pairs.select("class_key", *PAIR, side)
    total = sides.join(counts, "entity_id").groupBy(*PAIR).agg(F.sum("n").alias("n_measurements"))
    found = results.join(sides, "entity_id").join(total, PAIR, "left").fillna(0, ["n_measurements"])
    best = top_per_group(found, ["query_id", "class_key"], [F.asc("rank"), F.asc("a_id"), F.asc("b_id")], 1, "_one")
    kept = top_per_group(best.drop("_one"), ["query_id"], [F.asc("rank"), F.asc("class_key")], k, "hit_rank")
    return kept.withColumn("priority", F.col("similarity") * (1 + 0.1 * F.col("n_measurements")))


def assign_rank(df: DataFrame, groups: Sequence[str], score: str, key: str, out: str = "rank") -> DataFrame:
    """Rank of every row in its group by score, for groups of any size."""
    return group_row_number(df, groups, [F.desc(score), F.asc(key)], out)


def canonical_dedup(candidates: DataFrame, min_score: float) -> tuple[DataFrame, DataFrame]:
    """(best-first candidates, counts): first per canonical key, at least ``min_score``."""
    first = first_per_group(candidates, ["canonical"], ["id"])
    kept = first.where(F.col("score") >= min_score)
    counts = candidates.agg(F.count(F.lit(1)).alias("input_count")).withColumn(
        "output_count", one_value(kept.agg(F.count(F.lit(1))))
    ).withColumn("filtered_count", F.col("input_count") - F.col("output_count"))
    return kept.orderBy(F.desc("score"), "canonical"), counts


def merge_manifests(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two lists of finished keys."""
    return first.unionByName(second).distinct()


def delta_rank(pairs: DataFrame, scores: DataFrame, n: int | None = None) -> DataFrame:
    """Score difference per pair, largest size first."""
    a = scores.select(F.col("entity_id").alias("a_id"), F.col("score").alias("score_a"))
    b = scores.select(F.col("entity_id").alias("b_id"), F.col("score").alias("score_b"))
    rows = pairs.select(*PAIR).join(a, "a_id").join(b, "b_id").withColumn("delta", F.col("score_b") - F.col("score_a"))
    ordered = rows.orderBy(F.desc(F.abs("delta")), *PAIR)
    return ordered if n is None else ordered.limit(n)


def improving_flips(entities: DataFrame, scores: DataFrame) -> DataFrame:
    """Single-site flips that raise the score, with the transition at the flipped site."""
    flips = single_flip_pairs(entities)
    known = entities.join(scores.select(F.col("entity_id").alias("id"), "score"), "id")
    a = known.select(F.col("id").alias("from_id"), F.col("labels").alias("_la"), F.col("score").alias("_sa"))
    b = known.select(F.col("id").alias("to_id"), F.col("labels").alias("_lb"), F.col("score").alias("_sb"))
    rows = flips.join(a, "from_id").join(b, "to_id").withColumn("delta", F.col("_sb") - F.col("_sa"))
    return rows.where(F.col("delta") > 0).select(
        "class_key", "from_id", "to_id", "delta", L.transition_text(F.col("_la"), F.col("_lb")).alias("transition"))


def hill_climb(entities: DataFrame, scores: DataFrame, max_iter: int = 5, eps: float = 0.01) -> DataFrame:
    """Climb from every entity at once; one trace row per seed and iteration.

    Iteration 0 moves to the best form of the class, later ones to the best
    single flip. A seed stops once its gain is below ``eps``. The moves table has one
    row per form; a step is one join with it, and all steps are one plan.
    """
    forms = materialize(
        entities.join(scores.select(F.col("entity_id").alias("id"), "score"), "id").select(
            "id", "class_key", "canonical", "n_centers", "labels", "score"), "forms")
    best_of = F.max_by(F.struct("id", "score"), F.struct("score", (-F.col("id")).alias("k")))
    class_best = forms.groupBy("class_key").agg(best_of.alias("m"))
    first_moves = class_best.select("class_key", F.col("m.id").alias("to_id"), F.col("m.score").alias("to_score"))
    flips = single_flip_pairs(forms).join(
        forms.select(F.col("id").alias("to_id"), F.col("score").alias("to_score")), "to_id")
    step = flips.groupBy("from_id").agg(
        F.max_by(F.struct("to_id", "to_score"), F.struct("to_score", (-F.col("to_id")).alias("k"))).alias("m"))
    moves = materialize(step.select(F.col("from_id").alias("at_id"), F.col("m.to_id").alias("to_id"),
                                    F.col("m.to_score").alias("to_score")), "moves")
    # one plan: every seed carries its own trace, a stopped seed stands nowhere and meets no move
    at = forms.select(F.col("id").alias("seed_id"), "class_key", F.col("id").alias("at_id"), F.col("score").alias("at_score"),
                      F.array().cast(_steps_type(forms)).alias("steps"))
    for i in range(max_iter):
        options = at.join(first_moves, "class_key", "left") if i == 0 else at.join(moves, "at_id", "left")
        better = F.coalesce(F.col("to_score") > F.col("at_score"), F.lit(False))
        gain = F.when(better, F.col("to_score") - F.col("at_score")).otherwise(F.lit(0.0))
        done = F.struct(F.lit(i).alias("iteration"), F.when(better, F.col("to_id")).otherwise(F.col("at_id")).alias("best_id"),
                        F.when(better, F.col("to_score")).otherwise(F.col("at_score")).alias("best_score"), gain.alias("gain"))
        live = F.col("at_id").isNotNull()
        at = options.select("seed_id", "class_key", F.when(live, done).alias("d"), "steps").select(
            "seed_id", "class_key", F.when(F.col("d.gain") >= eps, F.col("d.best_id")).alias("at_id"), F.col("d.best_score").alias("at_score"),
            F.when(F.col("d").isNotNull(), F.concat("steps", F.array("d"))).otherwise(F.col("steps")).alias("steps"))
    return at.select("seed_id", F.explode("steps").alias("s")).select("seed_id", "s.*")


def _steps_type(forms: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in forms.schema}
    return f"array<struct<iteration:int,best_id:{kind['id']},best_score:{kind['score']},gain:double>>"


def threshold_screen(df: DataFrame, metric: str, threshold: float, hit_type: str, key: str = "id",
                     error: str | None = "error") -> DataFrame:
    """Rows without an error and with the metric at or above the threshold."""
    rows = df.where(F.col(error).isNull()) if error else df
    return rows.where(F.col(metric) >= threshold).select(
        key, F.lit(hit_type).alias("hit_type"), F.col(metric).alias("priority"))


def member_or_pattern_screen(df: DataFrame, hit_type: str = "perovskite", pattern: str = "3",
                             groups: Sequence[int] = R.PEROVSKITE_GROUPS) -> DataFrame:
    """Chiral rows whose group is listed or whose formula contains the pattern."""
    hit = F.col("is_chiral") & (F.col("sg").isin(*groups) | F.trim("formula").contains(pattern))
    return df.where(F.col("error").isNull() & hit).select(
        "id", F.lit(hit_type).alias("hit_type"), (F.col("saturation") + F.col("activity")).alias("priority"))


def valid_outcomes(df: DataFrame) -> DataFrame:
    """Outcomes between 0 and 100."""
    return df.where(F.col("ee").between(0, 100))


def training_pairs(df: DataFrame) -> DataFrame:
    """Rows with both ids: size of the outcome and its side; a null outcome has neither."""
    present = (F.coalesce("catalyst", F.lit("")) != "") & (F.coalesce("substrate", F.lit("")) != "")
    return df.where(present).select(
        "id", "catalyst", "substrate", F.abs("ee").alias("ee"), F.when(F.col("ee") >= 0, "R").when(F.col("ee") < 0, "S").alias("major"))


def prediction_gap_screen(df: DataFrame, cut: float = 20.0) -> DataFrame:
    """Rows whose prediction misses the outcome by more than ``cut``."""
    gap = F.abs(F.col("predicted") - F.col("ee"))
    return df.where(gap > cut).select("id", F.lit("prediction_gap").alias("hit_type"), gap.alias("priority"))


def size_gate(df: DataFrame, text: str, limit: int = 300) -> tuple[DataFrame, DataFrame]:
    """(rows to process now, rows deferred with a reason): split on the text length."""
    n = F.length(text)
    return df.where(n <= limit), df.where(n > limit).withColumn("reason", F.lit("too_long")).withColumn("length", n)


def selected_report(pairs: DataFrame, local: DataFrame, probability: DataFrame, general: DataFrame) -> DataFrame:
    """Selected pairs with actual and predicted values; missing predictions stay null."""
    kept = pairs.where(R.selected_flag(F.col("div"), F.col("fc"), F.col("violations"), F.col("qed")))
    return kept.join(local, "id", "left").join(probability, "id", "left").join(general, "id", "left").select(
        "id", F.col("fc").alias("actual_fc"), F.log10("fc").alias("actual_log_fc"), "div", "qed",
        "predicted_log_fc", "high_probability",
        F.nullif(F.col("global_log_fc"), F.lit(float("nan"))).alias("global_log_fc"),
    ).orderBy(F.desc("actual_fc"), "id")
