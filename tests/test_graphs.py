import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from antipode.operators import graphs as G

PHI = (1 + 5 ** 0.5) / 2


def laplacian(n, edges):
    m = np.zeros((n, n))
    for u, v, w in edges:
        m[u, v] -= w
        m[v, u] -= w
        m[u, u] += abs(w)
        m[v, v] += abs(w)
    return m


def phased(n, edges, side):
    out = []
    for u, v, w in edges:
        d = math.log(u + 1) - math.log(v + 1) + (math.pi if v - u > 0.33 * n else 0)
        out.append((u, v, (math.cos(0.3 * d) * PHI if side == "cos" else math.sin(0.3 * d) * PHI ** 2) * w))
    return out


@pytest.fixture(scope="module")
def random_graphs():
    rng = np.random.RandomState(1)
    graphs = {}
    for g in range(12):
        n = int(rng.randint(1, 12))
        graphs[g] = (n, [(u, v, float(rng.randint(1, 4))) for u, v in itertools.combinations(range(n), 2) if rng.rand() < 0.4])
    return graphs


def tables(spark, graphs):
    edges = [(g, u, v, w) for g, (_, es) in graphs.items() for u, v, w in es]
    return (spark.createDataFrame(edges, "graph_id long, u int, v int, w double"),
            spark.createDataFrame([(g, n) for g, (n, _) in graphs.items()], "graph_id long, n_nodes int"))


def test_spectra_match_dense_solver(spark, random_graphs):
    edges, sizes = tables(spark, random_graphs)
    rows = {r.graph_id: r for r in G.spectra(edges, sizes).collect()}
    assert set(rows) == set(random_graphs)
    for g, (n, es) in random_graphs.items():
        for side, got in (("cos", rows[g].ev_cos), ("sin", rows[g].ev_sin)):
            want = np.linalg.eigvalsh(laplacian(n, phased(n, es, side)))
            assert want.min() > -1e-9  # absolute degrees keep the matrix positive
            first = min(1, n - 1)
            assert got == pytest.approx(want[first:first + 8].tolist(), abs=1e-9)


def test_large_graphs_are_reported(spark, random_graphs):
    edges, sizes = tables(spark, random_graphs)
    rows = G.spectra(edges, sizes, max_nodes=5).collect()
    assert len(rows) == len(random_graphs)
    assert {r.graph_id for r in rows if r.error == "too_large"} == {g for g, (n, _) in random_graphs.items() if n > 5}


def test_parallel_edges_add_up(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, 2.0), (1, 2, 2, 5.0)], "graph_id long, u int, v int, w double")
    assert [tuple(r) for r in G.simple_edges(edges).collect()] == [(1, 0, 1, 3.0)]


def test_order_by_atomic_degree_rank(spark):
    nodes = spark.createDataFrame([(1, 0, 6, 2), (1, 1, 6, 1), (1, 2, 8, 0), (1, 3, 6, 0)], "graph_id long, node int, atomic int, rank int")
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 0, 3, 1.0)], "graph_id long, u int, v int, w double")
    order = {r.node: r.pos for r in G.canonical_order(nodes, edges).collect()}
    assert order == {2: 0, 0: 1, 3: 2, 1: 3}


def test_shift_moves_each_neighbour_one_slot(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 2, 1.0), (1, 0, 3, 1.0)], "graph_id long, u int, v int, w double")
    pos = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (1, 2, 1), (1, 3, 3)], "graph_id long, node int, pos int")
    centers = spark.createDataFrame([(1, 0), (1, 1)], "graph_id long, center int")
    rows = G.shifted_order_per_center(edges, pos, centers).collect()
    moved = {(r.shift, r.node): r.pos for r in rows}
    assert {r.center for r in rows} == {0}  # node 1 has a single neighbour
    ring = [1, 2, 3]  # neighbours of the center in position order
    slots = [0, 1, 3]
    for shift in (1, -1):
        assert [next(n for n in ring if moved[shift, n] == s) for s in slots] == [ring[(i + shift) % 3] for i in range(3)]


def test_distance_edges_with_copies(spark):
    rng = np.random.RandomState(2)
    pts = [(g, i, *np.round(rng.rand(3) * 4, 1)) for g in range(3) for i in range(40)]
    pts += [(0, 100 + i, 1.0, 1.0, 1.0) for i in range(30)]  # one crowded spot
    df = spark.createDataFrame([(int(g), int(i), float(x), float(y), float(z)) for g, i, x, y, z in pts], "graph_id long, node int, x double, y double, z double")
    got = {(r.graph_id, r.u, r.v) for r in G.distance_edges(df, 1.03).collect()}
    want = set()
    for a, b in itertools.combinations(pts, 2):
        d = math.dist(a[2:], b[2:])
        if a[0] == b[0] and 0.1 < d <= 1.03:
            want.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    assert got == want


def test_normalized_laplacian(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2.0), (1, 1, 2, -2.0)], "graph_id long, u int, v int, w double")
    got = {(r.i, r.j): r.value for r in G.laplacian_entries(edges, normalized=True).collect()}
    assert got[1, 1] == 1.0 and got[0, 1] == pytest.approx(-2 / math.sqrt(8)) and got[1, 2] == pytest.approx(2 / math.sqrt(8))


def test_center_scores_match_direct_computation(spark):
    edges_list = [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 1.5), (2, 4, 1.0)]
    order = {0: 2, 1: 0, 2: 1, 3: 3, 4: 4}
    edges = spark.createDataFrame([(1, u, v, w) for u, v, w in edges_list], "graph_id long, u int, v int, w double")
    pos = spark.createDataFrame([(1, n, p) for n, p in order.items()], "graph_id long, node int, pos int")
    sizes = spark.createDataFrame([(1, 5), (2, 3)], "graph_id long, n_nodes int")
    labels = spark.createDataFrame([(1, 0, "R")], "graph_id long, node int, label string")

    def asym(position):
        es = [(min(position[u], position[v]), max(position[u], position[v]), w) for u, v, w in edges_list]
        c, s = (np.linalg.eigvalsh(laplacian(5, phased(5, es, side)))[1:9] for side in ("cos", "sin"))
        return np.abs(c - s).sum() / (np.abs(c) + np.abs(s)).sum()

    nb, slots = [1, 2, 3], [0, 1, 3]
    best = 0
    for shift in (1, -1):
        moved = dict(order)
        for i, s in enumerate(slots):
            moved[nb[(i + shift) % 3]] = s
        best = max(best, abs(asym(moved) - asym(order)))
    centers = G.center_scores(sizes, edges, pos, labels)
    assert centers.first().score == pytest.approx(best, abs=1e-9)
    scores = {r.graph_id: r for r in G.graph_scores(sizes, centers, labels).collect()}
    assert scores[2].score == 0.0 and not scores[2].is_chiral
    assert scores[1].sign == (1.0 if best > 0.003 else 0.0)


def test_raw_vector_sizes(spark, random_graphs):
    edges, sizes = tables(spark, random_graphs)
    plain = G.spectra(edges, sizes)
    raw = G.raw_vectors(plain, plain).select(*[F.size(c).alias(c) for c in ("full", "pure_diff", "chi_diff")]).distinct().collect()
    assert [tuple(r) for r in raw] == [(64, 16, 24)]
    vec = G.graph_vector(G.raw_vectors(plain, plain), "pure_diff", 16).first().vec
    assert vec == [0.0] * 16  # equal graphs differ nowhere


def test_graphs_without_spectra_keep_their_row(spark, random_graphs):
    edges, sizes = tables(spark, random_graphs)
    part = G.spectra(edges, sizes, max_nodes=5)
    rows = {r.graph_id: r.vec for r in G.graph_vector(G.raw_vectors(part, part), "full", 16).collect()}
    assert {g: v is None for g, v in rows.items()} == {g: n > 5 for g, (n, _) in random_graphs.items()}
    assert all(len(v) == 16 for v in rows.values() if v is not None)


# ------------------------------------------------------------ large graphs

def sparse_cases():
    rng = np.random.default_rng(3)
    grid = [(i * 15 + j, i * 15 + j + 1, 1.0) for i in range(15) for j in range(14)] + [
        (i * 15 + j, (i + 1) * 15 + j, 2.0) for i in range(14) for j in range(15)]
    mixed = [(int(min(i, j)), int(max(i, j)), float(rng.normal())) for i in range(400) for j in rng.integers(0, 400, 2) if i != j]
    return {"path": (600, [(i, i + 1, 1.0) for i in range(599)]), "grid": (225, grid), "signed": (400, mixed),
            "star": (300, [(0, i, 1.0) for i in range(1, 300)]), "islands": (250, [(0, 1, 1.0), (2, 3, 4.0)]), "bare": (220, []),
            "tiny": (1, []), "pair": (2, [(0, 1, 3.0)])}


@pytest.mark.parametrize("name", list(sparse_cases()))
def test_filtered_iteration_matches_dense_solver(name):
    n, es = sparse_cases()[name]
    u, v, w = (np.array([e[i] for e in es], dtype=t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
    got, residual = G._low_eigenvalues_sparse(n, u, v, w, 8)
    want = np.linalg.eigvalsh(laplacian(n, es))[min(1, n - 1):][:8]
    assert got == pytest.approx(want.tolist(), abs=1e-6) and residual < 1e-6


def test_alike_components_do_not_slow_the_iteration(monkeypatch):
    """Twenty copies of a graph, weights a little apart: their values lie closer together than one iteration can part soon."""
    rng = np.random.default_rng(5)
    n, copies = 100, 20
    one = sorted({(int(min(i, j)), int(max(i, j))) for i in range(n) for j in rng.integers(0, n, 3) if i != j})
    es = [(c * n + i, c * n + j, (1.0 + (i * j) % 7) * (1 + 1e-5 * c)) for c in range(copies) for i, j in one]
    u, v, w = (np.array([e[i] for e in es], dtype=t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
    products, multiply = [], G._SparseLaplacian.__matmul__
    monkeypatch.setattr(G._SparseLaplacian, "__matmul__", lambda m, x: products.append(m.n * x.shape[1]) or multiply(m, x))
    got, residual = G._low_eigenvalues_sparse(copies * n, u, v, -w, 8)
    assert got == pytest.approx(np.linalg.eigvalsh(laplacian(copies * n, [(i, j, -x) for i, j, x in es]))[1:9].tolist(), abs=1e-6)
    assert residual < 1e-6 and sum(products) < 10_000 * copies * n


def test_large_graphs_are_solved_from_their_edges(spark):
    graphs = {i: g for i, g in enumerate(sparse_cases().values())}
    edges, sizes = tables(spark, graphs)
    rows = {r.graph_id: r for r in G.spectra(edges, sizes, dense_nodes=210).collect()}
    for g, (n, es) in graphs.items():
        assert rows[g].error is None and (rows[g].residual is not None) == (n > 210)
        for side, got in (("cos", rows[g].ev_cos), ("sin", rows[g].ev_sin)):
            want = np.linalg.eigvalsh(laplacian(n, phased(n, es, side)))[min(1, n - 1):][:8]
            assert got == pytest.approx(want.tolist(), abs=1e-6)
    few = {r.graph_id: r.error for r in G.spectra(edges, sizes, dense_nodes=210, max_edges=500).collect()}
    assert {g for g, e in few.items() if e} == {g for g, (n, es) in graphs.items() if n > 210 and len(es) > 500}


def test_centers_in_parts_score_alike(spark, monkeypatch):
    rng = np.random.RandomState(4)
    es = [(1, int(u), int(v), float(rng.randint(1, 4))) for u, v in itertools.combinations(range(14), 2) if rng.rand() < 0.3]
    es += [(2, 0, 1, 1.0), (2, 1, 2, 2.0), (2, 1, 3, 1.0)]
    edges = spark.createDataFrame(es, "graph_id long, u int, v int, w double")
    nodes = [(g, i) for g, n in ((1, 14), (2, 4)) for i in range(n)]
    pos = spark.createDataFrame([(g, i, i) for g, i in nodes], "graph_id long, node int, pos int")
    sizes = spark.createDataFrame([(1, 14), (2, 4)], "graph_id long, n_nodes int")
    labels = spark.createDataFrame([(g, i, "RS"[i % 2]) for g, i in nodes], "graph_id long, node int, label string")
    run = lambda: {(r.graph_id, r.center): round(r.score, 9) for r in G.center_scores(sizes, edges, pos, labels).collect()}
    want = run()
    monkeypatch.setattr(G, "SHIFTED_CELLS", 300)
    assert len(want) > 5 and run() == want


@pytest.mark.parametrize("few", [0, 5, 64])
def test_distance_edges_of_small_and_large_structures(spark, monkeypatch, few):
    """Pairs by brute force, whether structures are cut into cubes or compared whole."""
    monkeypatch.setattr(G, "FEW_POINTS", few)
    rng = np.random.default_rng(3)
    points = [(g, i, *np.round(rng.uniform(0, 3, 3), 1).tolist()) for g, n in ((1, 40), (2, 4), (3, 1), (4, 5)) for i in range(n)]
    points += [(2, 9, *points[40][2:]), (4, 9, None, 1.0, 1.0)]  # a copy, and one without a place
    df = spark.createDataFrame(points, "graph_id long, node int, x double, y double, z double")
    got = G.distance_edges(df, 1.03)
    copies = got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    assert (copies == 0) == (few == 64)
    want = {}
    for a, b in itertools.combinations([p for p in points if None not in p], 2):
        d = math.dist(a[2:], b[2:])
        if a[0] == b[0] and 0.1 < d <= 1.03:
            want[a[0], min(a[1], b[1]), max(a[1], b[1])] = d
    assert {(r.graph_id, r.u, r.v): r.d for r in got.collect()} == pytest.approx(want)


def test_order_needs_no_join(spark, random_graphs):
    """Degrees reach the nodes through a window; order and renumbered edges agree with brute force."""
    edges, _ = tables(spark, random_graphs)
    nodes = [(g, i, (7 * i + g) % 3, i % 2) for g, (n, _) in random_graphs.items() for i in range(n)]
    pos = G.canonical_order(spark.createDataFrame(nodes, "graph_id long, node int, atomic int, rank int"), edges)
    moved = G.reorder_edges(edges, pos)
    assert "Join" not in pos._jdf.queryExecution().optimizedPlan().toString()
    assert dict(pos.dtypes) == {"graph_id": "bigint", "node": "int", "pos": "int"}
    place = {}
    for g, (n, es) in random_graphs.items():
        degree = [sum(i in e[:2] for e in es) for i in range(n)]
        ranked = sorted(range(n), key=lambda i: (-((7 * i + g) % 3), -degree[i], i % 2, i))
        place.update({(g, i): p for p, i in enumerate(ranked)})
    assert {(r.graph_id, r.node): r.pos for r in pos.collect()} == place
    want = sorted((g, *sorted((place[g, u], place[g, v])), w) for g, (_, es) in random_graphs.items() for u, v, w in es)
    assert sorted(map(tuple, moved.collect())) == want
