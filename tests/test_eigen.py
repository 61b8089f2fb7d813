"""Graphs beyond one task: their components, and the iteration in blocks."""

import numpy as np
import pytest
from test_graphs import laplacian, phased, tables

from antipode.operators import eigen as E
from antipode.operators import graphs as G


def random_edges(seed, first, n, degree):
    rng = np.random.default_rng(seed)
    pairs = {(int(min(i, j)), int(max(i, j))) for i in range(n) for j in rng.integers(0, n, degree) if i != j}
    return [(first + i, first + j, float(rng.uniform(0.5, 3))) for i, j in sorted(pairs)]


def test_components_of_many_graphs(spark, monkeypatch):
    monkeypatch.setattr(E, "FOREST_EDGES", 20)
    links = [(1, i, i + 1) for i in range(300) if i % 100 != 99] + [(2, i, 3 * i) for i in range(1, 100)]
    edges = spark.createDataFrame(links, "graph_id long, u int, v int").repartition(3)
    got = {(r.graph_id, r.node): r.part for r in E.components(edges, ["graph_id"]).collect()}
    want = {(1, i): i // 100 * 100 for i in range(300)}
    for i in range(1, 298):
        if i < 100 or i % 3 == 0:
            root = i
            while root % 3 == 0:
                root //= 3
            want[2, i] = root
    assert got == want


def test_graphs_beyond_one_task_are_solved_whole(spark, monkeypatch):
    """A graph with a component that fits no task, one that does and small ones; another graph whose parts all fit."""
    for module, name, value in ((G, "MAX_NODES", 100), (G, "MAX_EDGES", 2000), (G, "PACK_EDGES", 40), (E, "BLOCK_NODES", 50), (E, "TILE_EDGES", 300)):
        monkeypatch.setattr(module, name, value)
    graphs = {7: (240, random_edges(1, 0, 120, 10) + random_edges(2, 125, 80, 3) + [(210, 211, 1.0), (212, 215, 2.0)]),
              8: (130, [(i, i + 1, 1.0 + i % 3) for i in range(0, 120) if i % 10 != 9])}
    edges, sizes = tables(spark, graphs)
    rows = {r.graph_id: r for r in G.spectra(edges, sizes, k=40, dense_nodes=100).collect()}
    assert set(rows) == set(graphs)
    for g, (n, es) in graphs.items():
        assert rows[g].error is None and rows[g].residual < 1e-5
        for side, got in (("cos", rows[g].ev_cos), ("sin", rows[g].ev_sin)):
            assert got == pytest.approx(np.linalg.eigvalsh(laplacian(n, phased(n, es, side)))[1:41].tolist(), abs=1e-7)


def test_well_connected_graphs_take_few_products(monkeypatch):
    es = random_edges(7, 0, 1500, 4)
    u, v, w = (np.array([e[i] for e in es], dtype=t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
    products, multiply = [], G._SparseLaplacian.__matmul__
    monkeypatch.setattr(G._SparseLaplacian, "__matmul__", lambda m, x: products.append(x.shape[1]) or multiply(m, x))
    got, residual = G._low_eigenvalues_sparse(1500, u, v, w, 8)
    assert got == pytest.approx(np.linalg.eigvalsh(laplacian(1500, es))[1:9].tolist(), abs=1e-6) and residual < 1e-6
    assert sum(products) < 1600


def test_nodes_with_many_edges(monkeypatch):
    """Rows longer than ``STEPS`` entries, as products of the dense matrix."""
    es = [(0, i, 1.0 + i % 5) for i in range(1, 200)] + [(1, i, -2.0) for i in range(50, 150)] + random_edges(3, 0, 200, 2)
    u, v, w = (np.array([e[i] for e in es], dtype=t) for i, t in ((0, np.int64), (1, np.int64), (2, float)))
    m = G._SparseLaplacian(200, u, v, w)
    assert len(m.far_starts) >= 2
    assert np.linalg.eigvalsh(m @ np.eye(200)) == pytest.approx(np.linalg.eigvalsh(laplacian(200, es)), abs=1e-9)
