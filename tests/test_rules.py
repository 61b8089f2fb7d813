import numpy as np
import pytest
from pyspark.sql import functions as F

from antipode.functions import rules as R
from antipode.functions import spectra as Z
from antipode.functions import text as X
from antipode.operators import profiles as P
from antipode.operators import stats as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("kind, assay, name, want", [
    ("IC50", "B", "hERG potassium channel", "herg"), ("IC50", "B", "Cytochrome P450 3A4", "cyp_inhibition"),
    ("IC50", "B", "Some random receptor", None), ("CLint", "B", None, "metabolic_stability"),
    ("Ki", "A", "Serum albumin", "plasma_protein_binding"), ("Ki", "B", "Serum albumin", None),
    ("EC50", "A", "aqueous", "solubility"), (None, "A", "KCNH2", "herg"),
])
def test_property_class(spark, kind, assay, name, want):
    lit = lambda v: F.lit(v).cast("string")
    assert one(spark, R.property_class(lit(kind), lit(assay), lit(name))) == want


@pytest.mark.parametrize("prop, value, want", [
    ("herg", 5.0, "high_risk"), ("herg", 10.0, "moderate_risk"), ("herg", 30.0, "low_risk"),
    ("metabolic_stability", 150.0, "high_risk"), ("metabolic_stability", 100.0, "moderate_risk"),
    ("metabolic_stability", 30.0, "low_risk"), ("solubility", 0.5, "high_risk"), ("unknown", 0.0, "low_risk"),
])
def test_risk_level(spark, prop, value, want):
    assert one(spark, R.risk_level(F.lit(prop), F.lit(value))) == want


@pytest.mark.parametrize("name, want", [
    ("Frizzled-7", "Wnt"), ("Notch homolog with smad", "Notch"), ("BCL-2", "Bcl2"), ("nothing here", None),
])
def test_first_keyword(spark, name, want):
    assert one(spark, R.first_keyword_tag(F.lit(name))) == want


def test_default_score_is_neutral(spark):
    empty = F.lit(None).cast("double")
    assert one(spark, R.combined_score(empty, empty, empty)) == pytest.approx(0.45)


def test_clamp_and_sensitivity(spark):
    size, side, conf = R.clamp_outcome(F.lit(-130.0))
    assert one(spark, F.struct(size, side, conf)) == (100.0, "S", 1.0)
    fold, conf, flag = R.sensitivity(F.lit(0.2))
    assert tuple(one(spark, F.struct(fold, conf, flag))) == (1.0, pytest.approx(1 / 6), False)


def test_entries_and_tokens(spark):
    text = "2 sensitive target(s):\n  Target A (x) (CHEMBL12): 12.5x differential\n  B (CHEMBL3): 1e.2.3x differential\nC (CHEMBL4): 2x differential"
    assert [tuple(r) for r in one(spark, X.parse_entries(F.lit(text)))] == [("Target A (x)", "CHEMBL12", 12.5)]
    assert one(spark, X.formula_tokens(F.lit("- C2 H3 Na O -"))) == ["C", "C", "H", "H", "H", "Na", "O"]


def test_formula_counts_match_the_array_form(spark):
    df = spark.createDataFrame([(1, "C12 H5 C3 O"), (2, "")], "id int, f string")
    assert {(r.id, r.element): r.n for r in T.formula_counts(df, "id", "f").collect()} == {
        (1, "C"): 15, (1, "H"): 5, (1, "O"): 1}


def test_cell_parameters(spark):
    text = F.lit("_cell_length_a   10.25(3)\n_cell_angle_beta 95.1\n")
    row = spark.range(1).select(*X.cell_parameters(text)).first()
    assert tuple(row) == (10.25, 1.0, 1.0, 90.0, 95.1, 90.0)
    assert one(spark, X.strip_uncertainty(F.lit("1.23(5)"))) == "1.23"


def test_notes(spark):
    assert [tuple(x) for x in one(spark, R.label_from_note(F.lit("S=active")))] == [("R", 0.2), ("S", 1.0)]


def test_empty_spectra_are_inactive(spark):
    none = F.array().cast("array<double>")
    assert one(spark, F.struct(*Z.activity_index(none, none))) == (0.0, "inactive")
    assert one(spark, Z.saturation_score(none, none)) == 0.0
    assert one(spark, Z.edge_shift(none, none)) == 0.0


def test_member_groups():
    assert len(T.MEMBER_GROUPS) == len(set(T.MEMBER_GROUPS)) == 65


def test_structure_screens(spark):
    rows = spark.createDataFrame([("001", 0.5, 0.7, None), ("002", 0.1, 0.2, None), ("003", 0.8, 0.9, None), ("004", 0.9, 0.9, "bad")],
                                 "id string, activity double, saturation double, error string")
    hits = P.threshold_screen(rows, "activity", 0.3, "high").orderBy(F.desc("priority")).collect()
    assert [h.id for h in hits] == ["003", "001"]


def test_outcomes(spark):
    rows = spark.createDataFrame([("001", 95.0, "c", "s"), ("002", None, "c", "s"), ("003", 150.0, "c", "s"), ("004", 50.0, "", "s")],
                                 "id string, ee double, catalyst string, substrate string")
    kept = P.valid_outcomes(rows)
    assert [r.id for r in kept.orderBy("id").collect()] == ["001", "004"]
    assert [r.id for r in P.training_pairs(kept).collect()] == ["001"]


def test_label_fates(spark):
    schema = "record_id int, pos int, label string"
    before = spark.createDataFrame([(1, 1, "R"), (1, 2, "R"), (1, 3, "S"), (1, 5, "?")], schema)
    after = spark.createDataFrame([(1, 1, "R"), (1, 2, "S"), (1, 4, "S"), (1, 5, "R")], schema)
    fates = {r.pos: r.fate for r in P.label_fate(before, after).collect()}
    assert fates == {1: "retained", 2: "inverted", 3: "lost", 4: "new", 5: "unchanged"}


def test_local_models_replace_the_general_one(spark):
    schema = "a_id int, b_id int, target_id int, predicted double"
    local = spark.createDataFrame([(1, 2, 10, 4.0)], schema)
    general = spark.createDataFrame([(1, 2, 10, 1.0), (1, 2, 11, 5.0)], schema)
    prof = P.profile_with_fallback(local, general)
    assert {(r.target_id, r.predicted, r.source) for r in prof.collect()} == {(10, 4.0, "per_target"), (11, 5.0, "global")}
    top = P.profile_summary(prof).first()
    assert (top.n_sensitive, top.top_target, top.top_fold) == (2, 11, 5.0)


def test_strategies(spark):
    dim = spark.createDataFrame([("amine", "s1"), ("generic", "s2")], "environment string, strategy string")
    envs = spark.createDataFrame([(1, "amine"), (2, "odd"), (3, "generic")], "id int, environment string")
    got = {(r.id, r.strategy, r.confidence) for r in P.strategy_lookup(envs, dim).collect()}
    assert got == {(1, "s1", 0.8), (2, "s2", 0.8), (3, "s2", 0.3)}


def test_hill_climb_follows_single_flips(spark):
    """Class of four forms: SS 0.1, RS 0.5, SR 0.2, RR 0.9; the class best is reached at once."""
    codes = ["SS", "RS", "SR", "RR"]
    rows = [(i, c, "k", 2, [(0, c[0]), (1, c[1])]) for i, c in enumerate(codes)]
    ents = spark.createDataFrame(rows, "id long, canonical string, class_key string, n_centers int, labels array<struct<pos:int,label:string>>")
    scores = spark.createDataFrame(list(enumerate([0.1, 0.5, 0.2, 0.9])), "entity_id long, score double")
    trace = P.hill_climb(ents, scores).collect()
    first = {r.seed_id: (r.best_id, round(r.gain, 6)) for r in trace if r.iteration == 0}
    assert first == {0: (3, 0.8), 1: (3, 0.4), 2: (3, 0.7), 3: (3, 0.0)}
    assert {r.seed_id for r in trace if r.iteration == 1} == {0, 1, 2}  # seed 3 stopped
    assert all(r.gain == 0 for r in trace if r.iteration == 1)
    assert max(r.iteration for r in trace) == 1


def test_joined_numbers_print_as_format_string_without_parsing_a_format_per_number(spark):
    from antipode.functions.text import joined_numbers

    rng = np.random.default_rng(3)
    rows = [(i, x) for i, x in enumerate([
        None, [], [0.0, -0.0, -1e-9, 1e-9], [0.123455, 0.000005, -0.000005, 1.000005, 2.5], [1e7, 123456789.123455, -1e14, 1e16],
        [float("nan"), float("inf"), float("-inf"), None]] + [(rng.normal(size=4) * 10.0**e).tolist() for e in range(-8, 9)]
        + [(np.arange(i, i + 50) / 1e6).tolist() for i in range(0, 400, 50)])]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    want = F.array_join(F.transform("x", lambda v: F.format_string("%.5f", v)), ",")
    got = df.select("x", want.alias("want"), joined_numbers("x", 5).alias("got"))
    assert [(r.x, r.got) for r in got.collect() if r.got != r.want] == []
    assert "format_string" not in df.select(joined_numbers("x", 5))._jdf.queryExecution().toString()
