import numpy as np
import pytest
from pyspark.sql import functions as F

from antipode.operators import search as S

VEC = "entity_id long, vec array<double>, sign double"
ONE, HALF = [1.0] * 64 + [0.0] * 64, [0.0] * 64 + [1.0] * 64


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([(1, ONE, -1.0), (2, [-x for x in ONE], 1.0), (3, HALF, 0.0)], VEC)


def ask(spark, vec):
    return spark.createDataFrame([(1, vec)], "query_id long, vec array<double>")


def test_nearest_first(spark, store):
    rows = S.cosine_topk(ask(spark, [0.9] * 64 + [0.1] * 64), store, 3).orderBy("rank").collect()
    assert [r.entity_id for r in rows] == [1, 3, 2]
    assert all(0 <= r.similarity <= 1 for r in rows)


def test_opposite_sign(spark, store):
    assert [r.entity_id for r in S.opposite_sign_topk(ask(spark, ONE), store, 5).collect()] == [2]
    assert S.opposite_sign_topk(ask(spark, HALF), store, 5).count() == 0  # best match has sign 0


@pytest.mark.parametrize("way", ["auto", "corpus", "queries", "tiles"])
def test_empty_store_and_zero_query(spark, store, way):
    assert S.cosine_topk(ask(spark, ONE), store.where("false"), 3, way=way).count() == 0
    assert S.cosine_topk(ask(spark, [0.0] * 128), store, 3, way=way).count() == 0


def test_novelty_without_corpus(spark, store):
    assert S.novelty(ask(spark, ONE), store.where("false")).first().novelty == 1.0
    assert S.novelty(ask(spark, ONE), store).first().novelty == pytest.approx(0.0)


@pytest.mark.parametrize("way", ["corpus", "queries", "cells", "tiles"])
@pytest.mark.parametrize("skip_self", [False, True])
def test_all_ways_match_brute_force(spark, way, skip_self):
    """Clustered vectors, a third of them copies of one vector, and blocks far smaller than the cells."""
    rng = np.random.RandomState(5)
    n, k = 300, 4
    m = rng.randn(12, 8)[rng.randint(0, 12, n)] + rng.randn(n, 8) * 0.2
    m[rng.rand(n) < 0.35] = m[0]
    corpus = spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "entity_id long, vec array<double>").repartition(3)
    queries = corpus.select(F.col("entity_id").alias("query_id"), "vec")
    got = S.cosine_topk(queries, corpus, k, skip_self, way=way, pivots=9, block=25).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round((np.clip(u @ u.T, -1, 1) + 1) / 2, 12)
    found = {(r.query_id, r.rank): (r.entity_id, r.similarity) for r in got}
    assert len(found) == len(got) == n * k
    for q in range(n):
        ids = [i for i in range(n) if not (skip_self and i == q)]
        best = sorted(ids, key=lambda i: (-round(sims[q, i], 9), i))[:k]
        mine = [found[q, r] for r in range(1, k + 1)]
        assert [s for _, s in mine] == pytest.approx([sims[q, i] for i in best], abs=1e-9)
        assert len({i for i, _ in mine}) == k


def test_cells_that_do_not_part_the_vectors_give_way_to_tiles(spark, monkeypatch):
    """Unclustered vectors: each query would go to nearly all of 60 cells, with a copy of its vector."""
    m = np.random.RandomState(2).randn(600, 16)
    corpus = spark.createDataFrame([(i, m[i].tolist()) for i in range(600)], "entity_id long, vec array<double>")
    queries = corpus.select(F.col("entity_id").alias("query_id"), "vec")
    written, write = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name="stage": written.append(name) or write(df, name))
    run = lambda way: {(r.query_id, r.rank): (r.entity_id, round(r.similarity, 9)) for r in S.cosine_topk(queries, corpus, 3, True, way=way, pivots=60).collect()}
    got = run("cells")
    assert "routes" not in written and got == run("tiles") and len(got) == 1800


def test_projection_is_fixed_and_unit():
    a, b = S.projection_matrix(16, 8), S.projection_matrix(16, 8)
    assert np.array_equal(a, b) and np.allclose(np.linalg.norm(a, axis=0), 1)


def test_precision(spark):
    results = spark.createDataFrame([(1, 2, 1), (2, 9, 1), (2, 1, 2)], "query_id long, entity_id long, rank int")
    expected = spark.createDataFrame([(1, 2), (2, 1), (3, 4)], "query_id long, expected_id long")
    p = S.precision_at_k(results, expected).first()
    assert p.precision_at_1 == pytest.approx(1 / 3) and p.precision_at_3 == pytest.approx(2 / 3)


def test_tiles_skip_on_vectors_with_few_directions(spark):
    """Eight of 48 directions carry nearly all length: most pairs end after the first coordinates."""
    rng = np.random.RandomState(2)
    m = rng.randn(900, 48) * np.r_[np.ones(8), np.full(40, 0.05)]
    turn = np.linalg.qr(rng.randn(48, 48))[0]
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m @ turn)], "entity_id long, vec array<double>")
    queries = corpus.select(F.col("entity_id").alias("query_id"), "vec")
    effort = S.search_effort(queries, corpus, 5).first()
    assert effort.pairs == 900 * 900 and effort.skipped > 0.4
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.sort(np.round((u @ u.T + 1) / 2, 9), axis=1)[:, ::-1][:, :5]
    got = S.cosine_topk(queries, corpus, 5, way="tiles").orderBy("query_id", "rank").toPandas()
    assert np.allclose(got.similarity.to_numpy().reshape(900, 5), want, atol=2e-9)


def test_tile_memory_is_bounded(monkeypatch):
    """Products never exceed the tile, whatever the block of vectors."""
    monkeypatch.setattr(S, "TILE_ROWS", 16)
    rng = np.random.RandomState(3)
    q, e = (S._unit(rng.randn(n, 6)) for n in (50, 70))
    tile = S._Tile(np.arange(50), q, np.full(50, -2.0), 4)
    sizes, met = [], S._Tile._meet
    monkeypatch.setattr(S._Tile, "_meet", lambda self, at, ids, rows, rest: (sizes.append((at.stop - at.start) * len(rows)), met(self, at, ids, rows, rest)))
    tile.meet(np.arange(70), e)
    assert max(sizes) <= 16 * 16 and tile.pairs == 50 * 70
    sims = np.round((np.clip(q @ e.T, -1, 1) + 1) / 2, 12)
    for i in range(50):
        assert tile.ids[i].tolist() == np.lexsort((np.arange(70), -sims[i]))[:4].tolist()


def test_best_match_without_sign_among_signed_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1.0), (2, [0.9, 0.1], None), (3, [0.0, 1.0], -1.0)], VEC)
    ask_two = spark.createDataFrame([(1, [0.9, 0.1]), (2, [1.0, 0.0])], "query_id long, vec array<double>")
    got = S.opposite_sign_topk(ask_two, rows, 2).collect()
    assert [(r.query_id, r.entity_id, r.rank) for r in got] == [(2, 3, 1)]


@pytest.mark.parametrize("way, most, rows", [("few", 16 << 20, 2048), ("sampled", 16 << 20, 40), ("tiles", 8 * 12 * 50, 40)])
def test_expected_ranks_are_those_of_the_whole_search(spark, monkeypatch, way, most, rows):
    """Copies, zero vectors, near copies of partners, partners that are missing; most pairs end in a sample, the others meet all rows."""
    rng = np.random.RandomState(8)
    m = rng.randn(700, 12)
    m[::7] = m[3]  # a hundred copies: only their ids tell them apart
    m[100:300] = np.round(m[100:300])
    m[301:500:2] = m[300:500:2] + 0.01 * rng.randn(100, 12)
    m[[50, 51, 120]] = 0
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "entity_id long, vec array<double>")
    queries = corpus.select(F.col("entity_id").alias("query_id"), "vec")
    expected = spark.createDataFrame([(i, i ^ 1) for i in range(700)] + [(1, 5000), (9, 9), (7, 14), (8, 3), (8, 14)], "query_id long, expected_id long")
    want = {(r.query_id, r.entity_id): r["rank"] for r in S.cosine_topk(queries, corpus, 30, skip_self=True, way="queries").join(
        expected.withColumnRenamed("expected_id", "entity_id"), ["query_id", "entity_id"]).collect()}
    for name, value in (("GROUP_BYTES", most), ("SAMPLE_ROWS", rows), ("TILE_ROWS", 64)):
        monkeypatch.setattr(S, name, value)
    rows_of = S.expected_ranks(queries, corpus, expected, 30).collect()
    assert {(r.query_id, r.entity_id): r["rank"] for r in rows_of} == want and len(rows_of) == len(want) > 150


def test_settled_pairs_do_not_meet_the_whole_corpus(spark, monkeypatch):
    """Unrelated partners: a sample shows thirty better rows for nearly all, so few pairs are left."""
    m = np.random.RandomState(9).randn(3000, 8)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "entity_id long, vec array<double>")
    queries = corpus.select(F.col("entity_id").alias("query_id"), "vec")
    left, few = [], S._rivals_of_few
    monkeypatch.setattr(S, "SAMPLE_ROWS", 500)
    monkeypatch.setattr(S, "_rivals_of_few", lambda asked, *rest: left.append(asked.count()) or few(asked, *rest))
    S.expected_ranks(queries, corpus, queries.select("query_id", F.col("query_id").bitwiseXOR(F.lit(1).cast("long")).alias("expected_id")), 30).collect()
    assert left and left[0] < 300
