import pytest
from pyspark.sql import functions as F

from antipode.operators import pairs as P
from antipode.operators import screening as S

MEAS = "entity_id string, target_id string, target_name string, assay_type string, kind string, value double, units string, norm_value double"


@pytest.fixture(scope="module")
def meas(spark):
    return spark.createDataFrame([
        ("CHEMBL_L_ALA", "CHEMBL_T1", "Target Alpha", "B", "IC50", 10.0, "nM", 8.0),
        ("CHEMBL_L_ALA", "CHEMBL_T2", "Target Beta", "B", "Ki", 50.0, "nM", 7.3),
        ("CHEMBL_D_ALA", "CHEMBL_T1", "Target Alpha", "B", "IC50", 1000.0, "nM", 6.0),
    ], MEAS)


def test_shared_gap_and_fold(acids, meas):
    prof = S.pair_target_profile(P.related_pairs(acids), meas).collect()
    by_target = {r.target_id: r for r in prof}
    assert by_target["CHEMBL_T1"].presence == "shared"
    assert by_target["CHEMBL_T1"].fold_change == pytest.approx(100.0)
    assert by_target["CHEMBL_T2"].presence == "b_only"  # L sorts after D, so it is side b
    assert by_target["CHEMBL_T2"].fold_change is None


@pytest.mark.parametrize("min_fold, hits", [(3.0, 1), (200.0, 0)])
def test_minimum_fold(acids, meas, min_fold, hits):
    pairs = P.related_pairs(acids)
    summary = S.pair_summary(pairs, S.pair_target_profile(pairs, meas), min_fold)
    assert summary.count() == 2  # the pair without data stays
    assert S.differential_hits(summary).count() == hits
    assert S.gap_hits(summary).count() == 1


def test_hit_texts_and_priorities(acids, meas):
    pairs = P.related_pairs(acids)
    hits = {r.hit_type: r for r in S.pair_hits(S.pair_summary(pairs, S.pair_target_profile(pairs, meas))).collect()}
    assert hits["activity_gap"].priority == pytest.approx(1 * (1 + 0.1 * 3))
    assert hits["activity_gap"].description == (
        "CHEMBL_L_ALA tested on 1 targets, CHEMBL_D_ALA untested. Recommend testing CHEMBL_D_ALA.")
    assert hits["differential"].priority == pytest.approx(100.0)


def test_fallback_kind_order_and_units(spark, acids):
    rows = [("CHEMBL_L_ALA", "T", "n", "B", "Ki", 5.0, "nM", None), ("CHEMBL_D_ALA", "T", "n", "B", "Ki", 20.0, "nM", None),
            ("CHEMBL_L_ALA", "T", "n", "B", "IC50", 1.0, "uM", None), ("CHEMBL_D_ALA", "T", "n", "B", "IC50", 9.0, "nM", None),
            ("CHEMBL_L_ALA", "U", "n", "B", "Kd", 5.0, "nM", None), ("CHEMBL_D_ALA", "U", "n", "B", "Kd", 20.0, "nM", None)]
    prof = S.pair_target_profile(P.related_pairs(acids), spark.createDataFrame(rows, MEAS)).collect()
    got = {r.target_id: (r.kind, r.fold_change) for r in prof}
    assert got["T"] == ("Ki", pytest.approx(4.0))  # IC50 comes first but in other units on each side
    assert got["U"] == (None, None)  # not one of the fallback kinds


def test_profile_splits_all_targets(acids, meas):
    prof = S.pair_target_profile(P.related_pairs(acids), meas)
    parts = S.shared_targets(prof).count() + S.gap_targets(prof).count()
    assert parts == prof.count() == prof.select("a_id", "b_id", "target_id").distinct().count()
    assert prof.where("fold_change < 1").count() == 0


def test_untested_targets_are_negatives_only_on_request(spark, acids):
    rows = [("CHEMBL_L_ALA", "U", "n", "B", "Kd", 5.0, "nM", None), ("CHEMBL_D_ALA", "U", "n", "B", "Kd", 20.0, "nM", None)]
    prof = S.pair_target_profile(P.related_pairs(acids), spark.createDataFrame(rows, MEAS))
    assert S.target_datasets(prof).count() == 0
    assert S.target_datasets(prof, untested_as_negative=True).first().n_non_differential == 1


def test_measurement_filter(spark):
    raw = spark.createDataFrame([("e", "t", "IC50", "5", "x"), ("e", "t", "IC50", "?", "1"), ("e", "t", "AC50", "5", "1")],
                                "entity_id string, target_id string, kind string, value string, norm_value string")
    rows = S.measurement_filter(raw).collect()
    assert [(r.value, r.norm_value) for r in rows] == [(5.0, None)]


def test_report_counts(spark):
    hits = spark.range(25).select(F.lit("t").alias("hit_type"), F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("id").cast("double").alias("priority"))
    r = S.report_counts(hits).first()
    assert (r.n_hits, r.n_shown, r.n_more) == (25, 20, 5)
    assert S.report_top(hits).count() == 20


def test_sides_are_joined_by_shuffle_when_not_small(acids, meas, monkeypatch):
    from antipode import scale
    monkeypatch.setattr(S, "broadcast_if_small", lambda df: scale.broadcast_if_small(df, 1))
    prof = S.pair_target_profile(P.related_pairs(acids), meas)
    assert prof.where("presence = 'shared'").count() == 1
