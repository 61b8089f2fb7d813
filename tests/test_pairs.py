import itertools
import random

import pytest
from pyspark.sql import functions as F

from antipode.functions import labels as L
from antipode.operators import pairs as P
from conftest import ENTITY


def relation(a, b):
    """Relationship of two label maps, straight from its definition."""
    if a["n"] != b["n"]:
        return None
    common = set(a["labels"]) & set(b["labels"])
    differ = sum(a["labels"][p] != b["labels"][p] for p in common)
    if not differ:
        return None
    return "enantiomer" if differ == len(common) else "diastereomer"


def brute(entities):
    first = {}
    for e in sorted(entities, key=lambda e: e["id"]):
        if e["labels"]:
            first.setdefault((e["class"], e["canonical"]), e)
    out = set()
    for a, b in itertools.combinations(sorted(first.values(), key=lambda e: e["id"]), 2):
        if a["class"] == b["class"] and relation(a, b):
            out.add((a["id"], b["id"], relation(a, b)))
    return out


def frame(spark, entities):
    return spark.createDataFrame(
        [(e["id"], e["canonical"], e["class"], e["n"], sorted(e["labels"].items())) for e in entities], ENTITY)


def random_entities(uneven, seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sites = rng.sample(range(5), 3) if uneven else [0, 2, 4]
        labels = {p: rng.choice("RS") for p in sites}
        canonical = f"{sorted(labels.items())}{rng.randint(0, 1)}"
        out.append({"id": f"e{i:03d}", "canonical": canonical, "class": rng.choice("xxxy"), "n": 3, "labels": labels})
    return out


def test_two_mirror_pairs(acids):
    rows = P.related_pairs(acids, max_flips=2).collect()
    assert {(r.a_id, r.b_id, r.relationship) for r in rows} == {
        ("CHEMBL_D_ALA", "CHEMBL_L_ALA", "enantiomer"), ("CHEMBL_R_IBU", "CHEMBL_S_IBU", "enantiomer")}


def test_equal_forms_collapse_and_give_no_pair(spark, acids):
    twice = acids.unionByName(acids.withColumn("id", F.concat("id", F.lit("_2"))))
    assert P.related_pairs(twice).count() == 2
    alone = acids.where("id = 'CHEMBL_L_ALA'")
    assert P.related_pairs(alone.unionByName(alone)).count() == 0


@pytest.mark.parametrize("uneven", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_match_brute_force(spark, uneven, seed):
    entities = random_entities(uneven, seed)
    got = P.related_pairs(frame(spark, entities), max_flips=3).collect()
    assert len(got) == len({(r.a_id, r.b_id) for r in got})
    assert {(r.a_id, r.b_id, r.relationship) for r in got} == brute(entities)


@pytest.mark.parametrize("uneven", [False, True])
def test_counts_match_brute_force(spark, uneven):
    entities = random_entities(uneven, 3)
    want = brute(entities)
    of_class = {e["id"]: e["class"] for e in entities}
    for r in P.relationship_counts(frame(spark, entities)).collect():
        mine = [x for x in want if of_class[x[0]] == r.class_key]
        assert r.n_enantiomer == sum(x[2] == "enantiomer" for x in mine)
        assert r.n_diastereomer == sum(x[2] == "diastereomer" for x in mine)


def test_only_mirror_pairs_without_flips(spark):
    entities = random_entities(False, 4)
    got = {(r.a_id, r.b_id) for r in P.pair_filter(P.related_pairs(frame(spark, entities)), False).collect()}
    assert got == {(a, b) for a, b, rel in brute(entities) if rel == "enantiomer"}


def test_given_pairs(spark):
    rows = spark.createDataFrame([
        (1, [(1, "R"), (2, "S")], [(1, "S"), (2, "R")], 2, 2), (2, [(1, "R"), (2, "S")], [(1, "S"), (2, "S")], 2, 2),
        (3, [(1, "R")], [(1, "R")], 1, 1), (4, [(1, "R")], [(2, "S")], 1, 1), (5, [(1, "R")], [(1, "S")], 1, 2),
    ], "k int, a_labels array<struct<pos:int,label:string>>, b_labels array<struct<pos:int,label:string>>, a_n_centers int, b_n_centers int")
    got = {r.k: r.relationship for r in P.classify_pairs(rows).collect()}
    assert got == {1: "enantiomer", 2: "diastereomer", 3: None, 4: None, 5: None}


def test_every_label_map_of_many_sites(spark, acids):
    wide = acids.limit(1).withColumn("labels", F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("R").alias("label")) for i in range(10)]))
    rows = P.label_variants(wide)
    assert rows.select("variant_code").distinct().count() == 1024 and rows.where("is_original").count() == 1
    codes = wide.select(F.explode(L.label_configurations(F.col("labels"))).alias("m")).select(L.label_code(F.col("m")).alias("c"))
    assert codes.distinct().count() == 1024
    with pytest.raises(Exception, match="more than 3"):
        wide.select(L.label_configurations(F.col("labels"), 3)).collect()


def test_all_pairs_by_default(spark):
    rows = [(f"e{k}", f"c{k}", "K", 3, [(p, "R" if k >> p & 1 else "S") for p in range(3)]) for k in range(8)]
    frame_ = spark.createDataFrame(rows, "id string, canonical string, class_key string, n_centers int, labels array<struct<pos:int,label:string>>")
    assert P.related_pairs(frame_).count() == 28
    assert P.related_pairs(frame_, max_flips=0).count() == 4


def many_sites(n_sites, n, seed, near):
    """Codes over many sites: random ones, and ones a few flips away from them, at one class."""
    rng = random.Random(seed)
    codes = []
    while len(codes) < n:
        code = [rng.choice("RS") for _ in range(n_sites)] if not codes or rng.random() > near else list(rng.choice(codes))
        for p in rng.sample(range(n_sites), rng.randint(0, 4)):
            code[p] = "R" if code[p] == "S" else "S"
        codes.append("".join(code))
    codes += ["".join("RS"[c == "R"] for c in codes[0])]
    return [{"id": f"m{i:03d}", "canonical": f"{c}{i % 2}", "class": "k", "n": 3, "labels": dict(enumerate(c))} for i, c in enumerate(codes)]


@pytest.mark.parametrize("max_flips", [1, 2, 3, 4])
def test_many_sites_by_chunks(spark, max_flips):
    """40 sites: 10,700 codes within three flips, of which none is built."""
    entities = many_sites(40, 60, max_flips, 0.8)
    code = {e["id"]: e["labels"] for e in entities}
    distance = lambda a, b: sum(code[a][p] != code[b][p] for p in range(40))
    want = {(a, b, rel, distance(a, b)) for a, b, rel in brute(entities) if rel == "enantiomer" or distance(a, b) <= max_flips}
    got = [(r.a_id, r.b_id, r.relationship, r.n_flips) for r in P.related_pairs(frame(spark, entities), max_flips=max_flips).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(rel == "enantiomer" for _, _, rel, _ in got) and len(got) > 5


def test_all_pairs_of_many_sites(spark):
    entities = many_sites(45, 25, 9, 0.5)
    got = {(r.a_id, r.b_id, r.relationship) for r in P.related_pairs(frame(spark, entities)).collect()}
    assert got == brute(entities)


def test_chunks_and_codes_agree(spark, monkeypatch):
    entities = random_entities(True, 7)
    want = {tuple(r) for r in P.related_pairs(frame(spark, entities), max_flips=2).collect()}
    monkeypatch.setattr(P, "MAX_LOOKUPS", 3)
    assert P._longest_looked_up(2) == 2
    assert {tuple(r) for r in P.related_pairs(frame(spark, entities), max_flips=2).collect()} == want


def test_packed_and_text_chunks_agree(spark, monkeypatch):
    """Codes as the bits of a long: the same pairs."""
    entities = frame(spark, many_sites(21, 80, 11, 0.6)).cache()
    run = lambda: P.related_pairs(entities, max_flips=3, uneven_sites=False)
    assert "bit_count" in run()._jdf.queryExecution().optimizedPlan().toString()
    want = {tuple(r) for r in run().collect()}
    monkeypatch.setattr(P, "PACKED_SITES", 0)
    assert {tuple(r) for r in run().collect()} == want and len(want) > 20
