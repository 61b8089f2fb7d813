"""Graph featurization over node and edge tables of many graphs.

Nodes: graph_id, node. Edges: graph_id, u, v, w with one row per undirected edge.
Ordering, weighting and degrees are joins and aggregates; only the eigenvalues of
one small matrix at a time are computed in Python, batched by matrix size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antipode.functions import spectra as Z
from antipode.functions.vectors import pad
from antipode.operators import eigen as E
from antipode.operators.search import random_project
from antipode.scale import broadcast_if_small, group_row_number, materialize, top_per_group

# Weights per bond type, other types weigh 1.
BOND_WEIGHTS = (("SINGLE", 1.0), ("AROMATIC", 1.5), ("DOUBLE", 2.0), ("TRIPLE", 3.0))

# Phase frequency, share of the nodes beyond which an edge is twisted, and coupling.
OMEGA = 0.3
TWIST_SHARE = 0.33
COUPLING = (1.0 + math.sqrt(5.0)) / 2.0
EIGENVALUES = 8
CHIRAL_THRESHOLD = 0.003

# Graphs up to DENSE_NODES are solved densely and in batches, larger ones by iteration on the edges of one component
# at a time; above MAX_NODES or MAX_EDGES a graph or a component does not fit one task and is spread over many.
DENSE_NODES = 512
MAX_NODES = 1_000_000
MAX_EDGES = 4_000_000
# Edges of small components that are cut out together, and bytes of components that a task solves one after the other.
PACK_EDGES = 500_000
SOLVE_BYTES = 32 << 20
# Numbers per array while several small graphs are shifted and solved together.
SHIFTED_CELLS = 2_000_000
# Components of a large graph up to so many nodes are solved densely.
SMALL_PART = 64
# Numbers in a basis and its products, and rounds it may take before the filter does.
BASIS_CELLS = 40_000_000
GROWN_ROUNDS = 60
# Nodes of a structure up to so many are compared pair by pair, without cubes.
FEW_POINTS = 64


def edge_weight(bond_type: Column) -> Column:
    """Weight of a bond type."""
    out = F.when(bond_type == BOND_WEIGHTS[0][0], BOND_WEIGHTS[0][1])
    for name, w in BOND_WEIGHTS[1:]:
        out = out.when(bond_type == name, w)
    return out.otherwise(1.0)


def simple_edges(edges: DataFrame) -> DataFrame:
    """One row per undirected edge: parallel edges add up, loops go."""
    return edges.where(F.col("u") != F.col("v")).groupBy(
        "graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).agg(F.sum("w").alias("w"))


def label_modulated_weights(edges: DataFrame, labels: DataFrame, step: float = 0.5) -> DataFrame:
    """Adds ``step`` for each R endpoint and takes it away for each S endpoint."""
    signs = labels.select(
        "graph_id", F.col("node").alias("n"),
        F.when(F.col("label") == "R", step).when(F.col("label") == "S", -step).otherwise(0.0).alias("s"))
    a = signs.select("graph_id", F.col("n").alias("u"), F.col("s").alias("su"))
    b = signs.select("graph_id", F.col("n").alias("v"), F.col("s").alias("sv"))
    return edges.join(a, ["graph_id", "u"], "left").join(b, ["graph_id", "v"], "left").select(
        "graph_id", "u", "v", (F.col("w") + F.coalesce("su", F.lit(0.0)) + F.coalesce("sv", F.lit(0.0))).alias("w"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: graph_id, node, neighbour, w."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("neighbour")),
                             F.struct(F.col("v").alias("node"), F.col("u").alias("neighbour")))).alias("e")
    return edges.select("graph_id", "w", ends).select("graph_id", "e.node", "e.neighbour", "w")


def canonical_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """0-based position of each node by (atomic number desc, degree desc, rank, node).

    ``nodes``: graph_id, node, atomic, rank.
    """
    # nodes and ends of edges are read as one table: what already lies together by graph stays where it is
    own = nodes.select("graph_id", "node", "atomic", "rank", F.lit(True).alias("own"))
    ends = both_directions(edges).select("graph_id", "node", F.lit(False).alias("own"))
    degree = F.count_if(~F.col("own")).over(Window.partitionBy("graph_id", "node"))
    both = own.unionByName(ends, allowMissingColumns=True).withColumn("degree", degree).where("own")
    keyed = both.select("graph_id", F.col("node").cast(nodes.schema["node"].dataType).alias("node"), "atomic", "rank", "degree")
    order = [F.desc("atomic"), F.desc("degree"), F.asc("rank"), F.asc("node")]
    return group_row_number(keyed, ["graph_id"], order, "place").select(
        "graph_id", "node", (F.col("place") - 1).cast("int").alias("pos"))


def reorder_edges(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Renumbers the endpoints by position, smaller first."""
    a = positions.select("graph_id", F.col("node").alias("u"), F.col("pos").alias("pu"))
    b = positions.select("graph_id", F.col("node").alias("v"), F.col("pos").alias("pv"))
    return edges.join(a, ["graph_id", "u"]).join(b, ["graph_id", "v"]).select(
        "graph_id", F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), "w")


def graph_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("graph_id").agg(F.count(F.lit(1)).cast("int").alias("n_nodes"))


def phase_weights(u: Column, v: Column, w: Column, n: Column) -> tuple[Column, Column]:
    """Cos-side and sin-side weight of an edge between 0-based positions u < v of an n-node graph."""
    delta = F.log(u + F.lit(1.0)) - F.log(v + F.lit(1.0)) + F.when(v - u > n * TWIST_SHARE, math.pi).otherwise(0.0)
    return F.cos(OMEGA * delta) * w * COUPLING, F.sin(OMEGA * delta) * w * (COUPLING * COUPLING)


def phase_edges(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges with both phase weights."""
    cos_w, sin_w = phase_weights(F.col("u"), F.col("v"), F.col("w"), F.col("n_nodes"))
    return edges.join(sizes, "graph_id").select("graph_id", "u", "v", cos_w.alias("w_cos"), sin_w.alias("w_sin"))


def signed_degrees(edges: DataFrame, weight: str = "w") -> DataFrame:
    """Sum of absolute weights per node."""
    return both_directions(edges.withColumn("w", F.col(weight))).groupBy("graph_id", "node").agg(
        F.sum(F.abs("w")).alias("degree"))


def laplacian_entries(edges: DataFrame, weight: str = "w", normalized: bool = False) -> DataFrame:
    """Upper-triangle entries of D - A, or of I - D^-1/2 A D^-1/2."""
    degree = signed_degrees(edges, weight)
    off = edges.select("graph_id", F.col("u").alias("i"), F.col("v").alias("j"), F.col(weight).alias("w"))
    if not normalized:
        diagonal = degree.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").alias("value"))
        return diagonal.unionByName(off.select("graph_id", "i", "j", (-F.col("w")).alias("value")))
    scale = degree.select("graph_id", "node", F.when(F.col("degree") > 1e-12, 1 / F.sqrt("degree")).otherwise(0.0).alias("s"))
    a = scale.select("graph_id", F.col("node").alias("i"), F.col("s").alias("si"))
    b = scale.select("graph_id", F.col("node").alias("j"), F.col("s").alias("sj"))
    scaled = off.join(a, ["graph_id", "i"]).join(b, ["graph_id", "j"]).select(
        "graph_id", "i", "j", (-F.col("w") * F.col("si") * F.col("sj")).alias("value"))
    diagonal = degree.select("graph_id", F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("value"))
    return diagonal.unionByName(scaled)


def _low_eigenvalues(n: int, us, vs, ws, k: int, skip: int = 1) -> np.ndarray:
    """Eigenvalues after the first ``skip`` of the Laplacians of several n-node graphs, at most k each."""
    m = np.zeros((len(us), n, n))
    for g, (u, v, w) in enumerate(zip(us, vs, ws)):
        if len(u):
            u, v, w = np.asarray(u, dtype=int), np.asarray(v, dtype=int), np.asarray(w, dtype=float)
            np.add.at(m[g], (u, v), -w)
            np.add.at(m[g], (v, u), -w)
            np.add.at(m[g], (u, u), np.abs(w))
            np.add.at(m[g], (v, v), np.abs(w))
    first = min(skip, n - 1)
    return np.linalg.eigvalsh(m)[:, first:first + k]


class _SparseLaplacian:
    """D - A of one graph without bare nodes, with absolute degrees; rows by falling number of entries.

    The first ``STEPS`` entries of the rows are added up entry by entry over all rows, what longer rows hold beyond them row by row.
    """

    STEPS = 32

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        rows, columns, values = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w])
        count = np.bincount(rows, minlength=n)
        by_count = np.argsort(-count, kind="stable")
        place = np.empty(n, np.int64)
        place[by_count] = np.arange(n)
        rows = place[rows]
        order = np.argsort(rows, kind="stable")
        rows, columns, values = rows[order], place[columns[order]].astype(np.int32), values[order]
        starts = np.cumsum(count[by_count]) - count[by_count]
        step = np.arange(len(rows)) - starts[rows]
        self.n, self.diagonal = n, np.bincount(rows, np.abs(values), n)
        beyond = step >= self.STEPS
        self.far_columns, self.far_values = columns[beyond], values[beyond]
        self.far_starts = np.flatnonzero(step[beyond] == self.STEPS)
        near = np.flatnonzero(~beyond)
        near = near[np.argsort(step[near], kind="stable")]
        self.columns, self.values = columns[near], values[near]
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(step[near]))]).tolist() if len(near) else [0]

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = self.diagonal[:, None] * x
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            part = x.take(self.columns[a:b], axis=0)
            part *= self.values[a:b, None]
            out[:b - a] -= part
        if len(self.far_starts):
            for j in range(x.shape[1]):  # one column at a time keeps memory at the size of the edge list
                part = x[:, j].take(self.far_columns)
                part *= self.far_values
                out[:len(self.far_starts), j] -= np.add.reduceat(part, self.far_starts)
        return out

    def highest(self) -> float:
        """Bound of all eigenvalues."""
        return 2.0 * float(self.diagonal.max(initial=0.0))


def _filtered(m: _SparseLaplacian, x: np.ndarray, low: float, cut: float, high: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial that is small on [cut, high] and grows below, applied to ``x`` and scaled at ``low``."""
    half, mid = (high - cut) / 2, (high + cut) / 2
    first = scale = half / (low - mid)
    y = (m @ x - mid * x) * (scale / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - scale)
        x, y = y, 2 * (new / half) * (m @ y - mid * y) - scale * new * x
        scale = new
    return y


def _grown(m: _SparseLaplacian, wanted: int, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(lowest values, their vectors, largest residual of the ``wanted``) by a basis that grows by the residuals over the degrees.

    Divided by the degrees, the matrix of a well-connected graph has its values close together, so that a few dozen
    products do. The basis starts anew from its best vectors once it is full.
    """
    n, high = m.n, m.highest()
    block = wanted + 2
    most = int(np.clip(BASIS_CELLS // (2 * n), 3 * block, min(6 * block, n // 2)))
    over = 1 / np.maximum(m.diagonal, 1e-12 * high)[:, None]
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(n, block)) * over)[0]
    product = m @ basis
    for left in range(rounds, 0, -1):
        values, turn = np.linalg.eigh(basis.T @ product)
        x = basis @ turn[:, :block]
        rest = product @ turn[:, :block] - x * values[:block]
        sizes = np.linalg.norm(rest, axis=0)
        residual = float(sizes[:wanted].max())
        if residual <= tolerance * high or left == 1:
            break
        new = rest[:, sizes > tolerance * high / 2] * over
        if basis.shape[1] + new.shape[1] > most:
            kept = turn[:, :max(block, min(most // 2, most - new.shape[1]))]
            basis, product = basis @ kept, product @ kept
        for _ in range(3):  # what rounding leaves along the basis goes in the second and third turn
            new -= basis @ (basis.T @ new)
            new = np.linalg.qr(new)[0]
        basis, product = np.hstack([basis, new]), np.hstack([product, m @ new])
    return values[:block], x, residual


def _lowest_of_part(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, wanted: int, tolerance: float, rounds: int) -> tuple[np.ndarray, float]:
    """(``wanted`` lowest eigenvalues, largest residual) of one connected graph.

    A basis grown by residuals settles well-connected graphs soon; long thin ones go on by subspace iteration with a Chebyshev filter.
    """
    if n < 4 * (wanted + 2):
        return _low_eigenvalues(n, [u], [v], [w], wanted, 0)[0], 0.0
    m = _SparseLaplacian(n, u, v, w)
    high = m.highest()
    values, found, residual = _grown(m, wanted, tolerance, GROWN_ROUNDS)
    if residual <= tolerance * high:
        return values[:wanted], residual
    block = min(n, wanted + max(8, wanted - 1))
    x = np.linalg.qr(np.hstack([found, np.random.default_rng(1).normal(size=(n, max(0, block - found.shape[1])))])[:, :block])[0]
    for _ in range(rounds):
        product = m @ x
        values, turn = np.linalg.eigh(x.T @ product)
        x, product = x @ turn, product @ turn
        residual = float(np.linalg.norm(product[:, :wanted] - x[:, :wanted] * values[:wanted], axis=0).max())
        if residual <= tolerance * high or block == n:
            break
        cut = max(values[-1], 1e-12 * high)
        if cut >= high * (1 - 1e-9):
            cut = high / 2
        gap = max(cut - values[wanted - 1], 1e-9 * high)
        degree = int(np.clip(4 / (2 * np.sqrt(gap / (high - cut))), 12, 2000))
        x = np.linalg.qr(_filtered(m, x, min(values[0], 0.5 * cut), cut, high, degree))[0]
    return values[:wanted], residual


def _split(n: int, u: np.ndarray, v: np.ndarray, sides: Sequence[np.ndarray], wanted: int) -> tuple[list[np.ndarray], list[tuple]]:
    """(lowest values per side of the components solved densely, the larger components as n, u, v and the weights of each side).

    Components are solved one by one: alike components share near-equal values, which one iteration over all of them would
    have to tell apart.
    """
    root = E.connected(n, u, v)
    size = np.bincount(root, minlength=n)
    order = np.lexsort((np.arange(n), root))
    place = np.empty(n, np.int64)  # of a node within its component
    place[order] = np.arange(n) - np.repeat((np.cumsum(size) - size)[size > 0], size[size > 0])
    by_part = np.argsort(root[u], kind="stable")
    part, pu, pv, weights = root[u][by_part], place[u][by_part], place[v][by_part], [w[by_part] for w in sides]
    parts = np.flatnonzero(size > 1)
    starts, ends = np.searchsorted(part, parts), np.searchsorted(part, parts, side="right")
    lowest, larger = [np.zeros(min(wanted, int((size == 1).sum())))] * len(sides), []
    for count in np.unique(size[parts]).tolist():
        same = np.flatnonzero(size[parts] == count)
        if count > SMALL_PART:
            larger += [(count, pu[starts[j]:ends[j]], pv[starts[j]:ends[j]], [w[starts[j]:ends[j]] for w in weights]) for j in same]
            continue
        step = max(1, 4_000_000 // (count * count))
        for i in range(0, len(same), step):
            at = [slice(starts[j], ends[j]) for j in same[i:i + step]]
            for side, w in enumerate(weights):
                found = _low_eigenvalues(count, [pu[x] for x in at], [pv[x] for x in at], [w[x] for x in at], min(wanted, count), 0).ravel()
                lowest[side] = np.sort(np.concatenate([lowest[side], found]))[:wanted]
    return lowest, larger


def _low_eigenvalues_sparse(n: int, u: np.ndarray, v: np.ndarray, w: np.ndarray, k: int, skip: int = 1,
                            tolerance: float = 1e-9, rounds: int = 300) -> tuple[np.ndarray, float]:
    """(up to k eigenvalues after the first ``skip``, largest residual) of one large graph.

    Memory is the edge list and some dozens of vectors of a component. Each value lies within the residual of an eigenvalue.
    """
    wanted = min(k + skip, n)
    (lowest,), larger = _split(n, u, v, [w], wanted)
    residual = 0.0
    for count, pu, pv, (pw,) in larger:
        found, rest = _lowest_of_part(count, pu, pv, pw, min(wanted, count), tolerance, rounds)
        lowest, residual = np.sort(np.concatenate([lowest, found]))[:wanted], max(residual, rest)
    return np.maximum(lowest[min(skip, n - 1):wanted], 0.0) + 0.0, residual  # with absolute degrees none is negative


def without_crowded(edges: DataFrame, sizes: DataFrame, max_nodes: int = MAX_NODES) -> DataFrame:
    """Edges of the graphs that fit: those of a huge graph go before any shuffle by graph."""
    crowded = sizes.where(F.col("n_nodes") > max_nodes).select("graph_id").distinct()
    return edges.join(broadcast_if_small(crowded), "graph_id", "left_anti")


def _reported(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    none = F.lit(None).cast("array<double>")
    return sizes.select(*keys, "n_nodes", none.alias("ev_cos"), none.alias("ev_sin"), F.lit("too_large").alias("error"),
                        F.lit(None).cast("double").alias("residual"))


def spectra(edges: DataFrame, sizes: DataFrame, keys: Sequence[str] = ("graph_id",), k: int = EIGENVALUES,
            max_nodes: int | None = None, dense_nodes: int = DENSE_NODES, max_edges: int | None = None, skip: int = 1) -> DataFrame:
    """Lowest eigenvalues after the first ``skip`` on both phase sides, one row per graph (or per ``keys``).

    ``edges``: keys, u, v, w over positions, one row per edge. ``sizes``: keys, n_nodes. Graphs above
    ``dense_nodes`` are solved from their edges and carry the largest ``residual`` of their values; it is
    null for dense solutions. Graphs of any size are solved; those above a limit that the caller sets come out with an error text.
    """
    if max_nodes is None:
        return _solved(edges, sizes, keys, k, dense_nodes, max_edges, skip)
    fitting = sizes.where(F.col("n_nodes") <= max_nodes)
    return _solved(without_crowded(edges, sizes, max_nodes), fitting, keys, k, dense_nodes, max_edges, skip).unionByName(
        _reported(sizes.where(F.col("n_nodes") > max_nodes), keys))


def _solved(edges: DataFrame, fitting: DataFrame, keys: Sequence[str], k: int, dense_nodes: int = DENSE_NODES,
            max_edges: int | None = None, skip: int = 1) -> DataFrame:
    """Spectra of graphs within the limits on nodes."""
    large = fitting.where(F.col("n_nodes") > dense_nodes)
    if large.isEmpty():
        return _solved_dense(edges, fitting, keys, k, skip)
    names = [F.col(c).alias(f"_l_{c}") for c in keys]
    same = lambda: [F.col(c) == F.col(f"_l_{c}") for c in keys]
    rest = edges.join(broadcast_if_small(large.select(*names)), same(), "left_anti")
    return _solved_dense(rest, fitting.where(F.col("n_nodes") <= dense_nodes), keys, k, skip).unionByName(
        _solved_sparse(edges, materialize(large, "large"), keys, k, max_edges, skip))


def _solved_sparse(edges: DataFrame, large: DataFrame, keys: Sequence[str], k: int, max_edges: int | None, skip: int) -> DataFrame:
    """Spectra of large graphs, component by component; a graph above ``max_edges`` is reported, its edges stay where they are.

    A graph that fits one task is cut there, one that does not by a distributed search for its components. Each component and
    side is a task of its own; a component that does not fit one task is iterated on in blocks.
    """
    keys, wanted = list(keys), k + skip
    cos_w, sin_w = phase_weights(F.col("u"), F.col("v"), F.col("w"), F.col("n_nodes"))
    count = edges.join(broadcast_if_small(large), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    counted = materialize(large.join(count, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(0))), "counted")
    fits = F.lit(True) if max_edges is None else F.col("_m") <= max_edges
    chosen = counted.where(fits)
    rows = edges.join(broadcast_if_small(chosen), keys).select(
        *keys, "n_nodes", "_m", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), cos_w.alias("c"), sin_w.alias("s"))
    crowded = (F.col("n_nodes") > MAX_NODES) | (F.col("_m") > MAX_EDGES)
    whole, huge = rows.where(~crowded).withColumn("_part", F.lit(0).cast("long")).drop("n_nodes", "_m"), None
    if not chosen.where(crowded).isEmpty():
        parts, huge = _crowded_parts(materialize(rows.where(crowded).drop("n_nodes", "_m"), "crowded"), keys, wanted)
        whole = whole.unionByName(parts)
    packed = materialize(_packed(whole, keys, wanted).withColumn("_id", F.monotonically_increasing_id()), "packed")
    found = _light(packed, keys).unionByName(_heavy(packed, keys, wanted))
    if huge is not None:
        found = found.unionByName(huge)
    found = materialize(found, "found")
    best = top_per_group(found.select(*keys, "side", F.explode("lowest").alias("value")), [*keys, "side"], [F.asc("value")], wanted)
    side = lambda i: F.collect_list(F.when(F.col("side") == i, F.col("value")))
    lists = best.groupBy(*keys).agg(side(0).alias("_cos"), side(1).alias("_sin"))
    rest = found.groupBy(*keys).agg(F.sum("used").alias("_used"), F.max("residual").alias("residual"))
    first = F.least(F.lit(skip), F.col("n_nodes") - 1)
    # nodes without edges are components with the value 0
    bare = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.least(F.lit(wanted), F.col("n_nodes") - F.coalesce("_used", F.lit(0)))).cast("int"))
    low = lambda c: F.transform(F.slice(F.array_sort(F.concat(F.coalesce(c, F.array().cast("array<double>")), bare)), first + 1,
                                        (F.least(F.lit(wanted), F.col("n_nodes")) - first).cast("int")),
                                lambda x: F.greatest(x, F.lit(0.0)) + F.lit(0.0))  # with absolute degrees none is negative
    return chosen.join(lists, keys, "left").join(rest, keys, "left").select(
        *keys, "n_nodes", low("_cos").alias("ev_cos"), low("_sin").alias("ev_sin"), F.lit(None).cast("string").alias("error"),
        F.coalesce("residual", F.lit(0.0)).alias("residual")).unionByName(_reported(counted.where(~fits), keys))


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)


def _packed(rows: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """Per side of a group of edges (keys, _part) its ``used`` nodes and the ``lowest`` of its small components, and a row per larger component."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"], kind="stable")
        names, ends = np.unique(np.concatenate([pdf["u"].to_numpy(np.int64), pdf["v"].to_numpy(np.int64)]), return_inverse=True)
        lowest, larger = _split(len(names), ends[:len(pdf)], ends[len(pdf):], [pdf[c].to_numpy(float) for c in ("c", "s")], wanted)
        out = [[*key[:-1], side, 0 if side else len(names), lowest[side].tolist(), None, None, None, None] for side in (0, 1)]
        for n, u, v, weights in larger:
            u, v = u.astype(np.int32).tobytes(), v.astype(np.int32).tobytes()
            out += [[*key[:-1], side, 0, [], n, u, v, w.tobytes()] for side, w in enumerate(weights)]
        return pd.DataFrame(out, columns=[*keys, "side", "used", "lowest", "n", "u", "v", "w"]).astype({"n": "Int64"})

    return rows.groupBy(*keys, "_part").applyInPandas(
        pack, f"{_kinds(rows, keys)}, side int, used long, lowest array<double>, n long, u binary, v binary, w binary")


def _light(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.where("n IS NULL").select(*keys, "side", "used", "lowest", F.lit(0.0).alias("residual"))


def _heavy(packed: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """Lowest values of the larger components, the largest first, dealt out evenly."""
    heavy = packed.where("n IS NOT NULL")
    # numbers of rows, without what they carry
    ids = materialize(heavy.select("_id", F.length("w").alias("_bytes")).select(
        "_id", "_bytes", (F.row_number().over(Window.orderBy(F.desc("_bytes"), "_id")) - 1).alias("_place")), "places")
    count, size = ids.agg(F.count(F.lit(1)), F.sum("_bytes")).first()
    tasks = max(1, min(count, max(16 * packed.sparkSession.sparkContext.defaultParallelism, (size or 0) // SOLVE_BYTES)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_lowest_of_part(n, np.frombuffer(u, np.int32).astype(np.int64), np.frombuffer(v, np.int32).astype(np.int64),
                                     np.frombuffer(w), min(wanted, n), 1e-9, 300) for n, u, v, w in zip(pdf["n"], pdf["u"], pdf["v"], pdf["w"])]
            yield pdf[[*keys, "side"]].assign(used=0, lowest=[x.tolist() for x, _ in found], residual=[r for _, r in found])

    dealt = heavy.join(broadcast_if_small(ids.drop("_bytes")), "_id").repartitionById(tasks, (F.col("_place") % tasks).cast("int"))
    return dealt.select(*keys, "side", "n", "u", "v", "w").mapInPandas(
        solve, f"{_kinds(packed, keys)}, side int, used long, lowest array<double>, residual double")


def _crowded_parts(rows: DataFrame, keys: list[str], wanted: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges of graphs that do not fit one task, with the group ``_part`` of components that each goes to; values of components that fit none)."""
    labels = materialize(E.components(rows, keys), "labels")
    tagged = materialize(rows.join(labels.withColumnRenamed("node", "u"), [*keys, "u"]), "tagged")
    parts = materialize(tagged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_m")).join(
        labels.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("_n")), [*keys, "part"]), "parts")
    too_large, own = (F.col("_n") > MAX_NODES) | (F.col("_m") > MAX_EDGES), F.col("_m") > PACK_EDGES
    # components that fill a task are groups of their own, the others share some
    shared = parts.where(~own).groupBy(*keys).agg((F.floor(F.sum("_m") / PACK_EDGES) + 1).alias("_groups"))
    dealt = parts.where(~too_large).join(shared, keys, "left").select(*keys, "part", F.when(own, F.col("part")).otherwise(
        -1 - F.pmod(F.xxhash64("part"), F.col("_groups"))).alias("_part"))
    fitting = tagged.join(broadcast_if_small(dealt), [*keys, "part"]).select(*keys, "u", "v", "c", "s", "_part")
    kinds = f"{_kinds(rows, keys)}, side int, used long, lowest array<double>, residual double"
    found = []
    for row in parts.where(too_large).collect():  # each holds a million nodes or more
        same = F.lit(True)
        for c in [*keys, "part"]:
            same = same & (F.col(c) == F.lit(row[c]))
        nodes = group_row_number(labels.where(same).select("node"), [], [F.asc("node")], "at")
        end = lambda c: nodes.select(F.col("node").alias(c), (F.col("at") - 1).alias(f"_{c}"))
        edges = materialize(tagged.where(same).select("u", "v", "c", "s").join(end("u"), "u").join(end("v"), "v").select(
            F.col("_u").alias("u"), F.col("_v").alias("v"), "c", "s"), "edges")
        for side, w in enumerate(("c", "s")):
            values, residual = E.lowest(edges.select("u", "v", F.col(w).alias("w")), wanted)
            found.append([*[row[c] for c in keys], side, 0 if side else row["_n"], values.tolist(), residual])
    return fitting, rows.sparkSession.createDataFrame(found, kinds) if found else None


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _lengths(lists: pa.Array) -> np.ndarray:
    return _numbers(pc.list_value_length(lists), np.int64)


def _solved_dense(edges: DataFrame, fitting: DataFrame, keys: Sequence[str], k: int, skip: int = 1) -> DataFrame:
    """Spectra of graphs of at most ``DENSE_NODES`` nodes, batched by size."""
    keys = list(keys)
    cos_w, sin_w = phase_weights(F.col("u"), F.col("v"), F.col("w"), F.col("n_nodes"))
    lists = edges.join(fitting, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("u", "v", cos_w.alias("c"), sin_w.alias("s"))).alias("e"))
    ready = fitting.join(lists, keys, "left").select(
        *keys, "n_nodes", *[F.coalesce(F.col(f"e.{c}"), F.array().cast(t)).alias(c)
                            for c, t in (("u", "array<int>"), ("v", "array<int>"), ("c", "array<double>"), ("s", "array<double>"))])

    @F.arrow_udf("struct<ev_cos:array<double>,ev_sin:array<double>>")
    def solve(n: pa.Array, u: pa.Array, v: pa.Array, c: pa.Array, s: pa.Array) -> pa.Array:
        sizes = _numbers(n, np.int64)
        system = np.repeat(np.arange(len(sizes)), _lengths(u))
        ends = _numbers(u.flatten(), np.int64), _numbers(v.flatten(), np.int64)
        found = [_low_of_systems(sizes, system, *ends, _numbers(x.flatten(), float), k, skip, None) for x in (c, s)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts.astype(np.int32), values) for values, starts in found],
                                          ["ev_cos", "ev_sin"])

    return ready.withColumn("_s", solve("n_nodes", "u", "v", "c", "s")).select(
        *keys, "n_nodes", "_s.ev_cos", "_s.ev_sin", F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("residual"))


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def raw_vectors(plain: DataFrame, modulated: DataFrame, k: int = EIGENVALUES) -> DataFrame:
    """The padded spectra of the plain and the label-modulated graph, and their differences.

    Adds ``full`` (8k: spectra, differences, asymmetries), ``pure_diff`` (2k) and
    ``chi_diff`` (3k).
    """
    a = plain.select("graph_id", pad(F.col("ev_cos"), k).alias("sc"), pad(F.col("ev_sin"), k).alias("ss"))
    b = modulated.select("graph_id", pad(F.col("ev_cos"), k).alias("cc"), pad(F.col("ev_sin"), k).alias("cs"))
    sc, ss, cc, cs = (F.col(x) for x in ("sc", "ss", "cc", "cs"))
    diff = F.concat(_minus(cc, sc), _minus(cs, ss))
    return a.join(b, "graph_id").select(
        "graph_id",
        F.concat(sc, ss, cc, cs, diff, _minus(sc, ss), _minus(cc, cs)).alias("full"),
        diff.alias("pure_diff"), F.concat(diff, _minus(cc, cs)).alias("chi_diff"))


def graph_vector(raw: DataFrame, which: str = "full", nbits: int = 128, k: int = EIGENVALUES) -> DataFrame:
    """Projects a raw vector to ``nbits`` numbers with the fixed matrix; null for a graph without spectra."""
    dims = {"full": 8 * k, "pure_diff": 2 * k, "chi_diff": 3 * k}
    return random_project(raw, which, dims[which], nbits, "vec").select("graph_id", "vec")


def _shifts(edges: DataFrame, positions: DataFrame, centers: DataFrame) -> DataFrame:
    """``shifted_order_per_center`` with the position ``base`` each node comes from."""
    around = both_directions(edges).select("graph_id", F.col("node").alias("center"), F.col("neighbour").alias("node")).join(
        centers, ["graph_id", "center"]).join(positions, ["graph_id", "node"])
    placed = group_row_number(around.select("graph_id", "center", "node", "pos"), ["graph_id", "center"], [F.asc("pos")], "i")
    size = placed.groupBy("graph_id", "center").agg(F.count(F.lit(1)).alias("k"))
    asked = placed.join(size.where(F.col("k") >= 2), ["graph_id", "center"]).select(
        "graph_id", "center", "node", F.col("pos").alias("base"), "i", F.col("k"), F.explode(F.array(F.lit(1), F.lit(-1))).alias("shift")).select(
        "graph_id", "center", "shift", "node", "base", "k", (F.pmod(F.col("i") - 1 - F.col("shift"), F.col("k")) + 1).alias("i"))
    slots = placed.select("graph_id", "center", "i", "pos")
    return asked.join(slots, ["graph_id", "center", "i"]).select("graph_id", "center", "shift", "node", "base", "pos", "k")


def shifted_order_per_center(edges: DataFrame, positions: DataFrame, centers: DataFrame) -> DataFrame:
    """Cyclic shift of the neighbours' positions of each center, in both directions.

    ``centers``: graph_id, center. Centers with fewer than two neighbours give no
    row. Output: graph_id, center, shift, node, pos (moved nodes only), and the
    number ``k`` of neighbours.
    """
    return _shifts(edges, positions, centers).drop("base")


def _phased(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``phase_weights`` on arrays."""
    delta = np.log(u + 1.0) - np.log(v + 1.0) + np.where(v - u > n * TWIST_SHARE, np.pi, 0.0)
    return np.cos(OMEGA * delta) * w * COUPLING, np.sin(OMEGA * delta) * w * COUPLING * COUPLING


def _low_of_systems(sizes: np.ndarray, system: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, k: int, skip: int = 1,
                    dense_nodes: int | None = DENSE_NODES) -> tuple[np.ndarray, np.ndarray]:
    """Low eigenvalues after the first ``skip`` of many graphs given as one edge list, sorted by ``system``.

    Graphs of one size are solved together, densely up to ``dense_nodes`` nodes (None: any). Output: all
    values in a row and where those of each graph begin, with the end.
    """
    first = np.minimum(skip, sizes - 1)
    starts = np.concatenate([[0], np.cumsum(np.minimum(k, sizes - first))]).astype(np.int64)
    out = np.empty(starts[-1])
    ends = np.searchsorted(system, np.arange(len(sizes) + 1))
    for n in np.unique(sizes).tolist():
        members = np.flatnonzero(sizes == n)
        large = dense_nodes is not None and n > dense_nodes
        step = 1 if large else max(1, 4_000_000 // (n * n))
        for i in range(0, len(members), step):
            part = members[i:i + step]
            if large:
                at = slice(ends[part[0]], ends[part[0] + 1])
                out[starts[part[0]]:starts[part[0] + 1]] = _low_eigenvalues_sparse(n, u[at], v[at], w[at], k, skip)[0]
                continue
            counts = ends[part + 1] - ends[part]
            at = np.repeat(ends[part] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            slot, a, b, x = np.repeat(np.arange(len(part)) * n * n, counts), u[at], v[at], w[at]
            m = np.zeros(len(part) * n * n)
            for cells, values in ((slot + a * n + b, -x), (slot + b * n + a, -x), (slot + a * n + a, np.abs(x)), (slot + b * n + b, np.abs(x))):
                np.add.at(m, cells, values)
            few = min(skip, n - 1)
            found = np.linalg.eigvalsh(m.reshape(-1, n, n))[:, few:few + k]
            out[starts[part][:, None] + np.arange(found.shape[1])] = found
    return out, starts


class _Shifted:
    """Asymmetry of several graphs under their own numbering and under every shift of their centers, as flat arrays."""

    def __init__(self, sizes: np.ndarray, u: pa.Array, v: pa.Array, w: pa.Array, center: pa.Array, shift: pa.Array, base: pa.Array, pos: pa.Array):
        flat = lambda lists, kind: _numbers(lists.flatten(), kind)
        edges = _lengths(u)
        graph = np.repeat(np.arange(len(sizes)), _lengths(center))
        self.center = center.flatten().to_numpy(zero_copy_only=False)
        turn = flat(shift, np.int64)
        new = np.r_[True, (graph[1:] != graph[:-1]) | (self.center[1:] != self.center[:-1]) | (turn[1:] != turn[:-1])]
        variant = np.cumsum(new) - 1
        self.variant_graph, self.center = graph[new], self.center[new]
        # systems: the graphs as they are, then their variants
        of = np.concatenate([np.arange(len(sizes)), self.variant_graph])
        self.sizes = sizes[of]
        start = np.cumsum(self.sizes) - self.sizes
        order = np.arange(self.sizes.sum()) - np.repeat(start, self.sizes)
        order[start[len(sizes) + variant] + flat(base, np.int64)] = flat(pos, np.int64)
        count = edges[of]
        self.system = np.repeat(np.arange(len(of)), count)
        at = np.repeat((np.cumsum(edges) - edges)[of] - np.cumsum(count) + count, count) + np.arange(count.sum())
        a, b = (order[start[self.system] + flat(x, np.int64)[at]] for x in (u, v))
        self.lo, self.hi, self.weight = np.minimum(a, b), np.maximum(a, b), flat(w, float)[at]

    def scores(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(graph, center, change of asymmetry) per variant."""
        sides = [_low_of_systems(self.sizes, self.system, self.lo, self.hi, x, k)
                 for x in _phased(self.lo, self.hi, self.weight, self.sizes[self.system])]
        starts = sides[0][1]
        asym, lengths = np.empty(len(self.sizes)), np.diff(starts)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            asym[at] = _asymmetries(*(values[starts[at][:, None] + np.arange(n)] for values, _ in sides))
        graphs = len(self.sizes) - len(self.center)
        return self.variant_graph, self.center, np.abs(asym[graphs:] - asym[self.variant_graph])


def _asymmetries(cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """``spectral_asymmetry`` of each row."""
    size = (np.abs(cos) + np.abs(sin)).sum(1)
    return np.where(size < Z.EMPTY, 0.0, np.abs(cos - sin).sum(1) / np.where(size < Z.EMPTY, 1.0, size))


def center_scores(nodes_sizes: DataFrame, edges: DataFrame, positions: DataFrame, labels: DataFrame,
                  k: int = EIGENVALUES, threshold: float = CHIRAL_THRESHOLD, max_nodes: int = MAX_NODES) -> DataFrame:
    """How far each center's shift moves the spectral asymmetry: the larger of both directions.

    ``labels``: graph_id, node, label. Output per center: score, is_chiral,
    confidence, sign. A graph travels once, as its edges and the moves of its centers; each
    shifted numbering is applied where the graph is solved.
    """
    small = nodes_sizes.where(F.col("n_nodes") <= max_nodes)
    edges = without_crowded(edges, nodes_sizes, max_nodes)
    shifts = _shifts(edges, positions, labels.select("graph_id", F.col("node").alias("center")))
    # a graph with many centers is solved in several parts of them, each with its edges
    parts = small.join(labels.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_c")), "graph_id").select(
        "graph_id", "n_nodes", F.ceil(8.0 * F.col("_c") * F.col("n_nodes") / SHIFTED_CELLS).alias("_parts"))
    # two neighbours swap either way, so one direction is enough
    moved = shifts.where((F.col("shift") == 1) | (F.col("k") > 2)).join(parts, "graph_id").groupBy(
        "graph_id", "n_nodes", F.pmod(F.xxhash64("center"), "_parts").alias("_part")).agg(
        F.array_sort(F.collect_list(F.struct("center", "shift", "base", "pos"))).alias("m"))
    lists = reorder_edges(edges, positions).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "w"))).alias("e"))
    ready = moved.join(lists, "graph_id").select(
        "graph_id", "n_nodes", *[F.col(f"e.{c}").alias(c) for c in ("u", "v", "w")],
        *[F.col(f"m.{c}").alias(c) for c in ("center", "shift", "base", "pos")])
    kind = positions.schema["node"].dataType.simpleString()

    @F.arrow_udf(f"array<struct<center:{kind},score:double>>")
    def solve(n: pa.Array, u: pa.Array, v: pa.Array, w: pa.Array, center: pa.Array, shift: pa.Array, base: pa.Array, pos: pa.Array) -> pa.Array:
        sizes = _numbers(n, np.int64)
        cost = (1 + _lengths(center)) * (sizes + _lengths(u))
        block = (np.cumsum(cost) - cost) // SHIFTED_CELLS  # graphs worked together stay within a bounded size
        cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.zeros(1, int)
        parts, counts = [], [np.zeros(1, np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            graph, centers_, change = _Shifted(sizes[a:b], *(x.slice(a, b - a) for x in (u, v, w, center, shift, base, pos))).scores(k)
            # both shifts of a center lie together; the larger counts
            new = np.flatnonzero(np.r_[True, (graph[1:] != graph[:-1]) | (centers_[1:] != centers_[:-1])])
            parts.append(pa.StructArray.from_arrays([pa.array(centers_[new], type=center.type.value_type), pa.array(np.maximum.reduceat(change, new))],
                                                    ["center", "score"]))
            counts.append(np.bincount(graph[new], minlength=b - a))
        values = pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("center", center.type.value_type), ("score", pa.float64())]))
        return pa.ListArray.from_arrays(np.cumsum(np.concatenate(counts)).astype(np.int32), values)

    best = ready.select("graph_id", F.explode(solve("n_nodes", "u", "v", "w", "center", "shift", "base", "pos")).alias("s")).select(
        "graph_id", "s.center", "s.score")
    signs = labels.select("graph_id", F.col("node").alias("center"),
                          F.when(F.col("label") == "R", 1.0).when(F.col("label") == "S", -1.0).otherwise(0.0).alias("s"))
    chiral = F.col("score") > threshold
    return best.join(signs, ["graph_id", "center"]).select(
        "graph_id", "center", "score", chiral.alias("is_chiral"),
        F.greatest(F.col("score") / threshold - 1, F.lit(0.0)).alias("confidence"),
        F.when(chiral, F.col("s")).otherwise(0.0).alias("sign"))


def graph_scores(sizes: DataFrame, centers: DataFrame, labels: DataFrame, threshold: float = CHIRAL_THRESHOLD,
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """Best center of every graph; the sign tells which label is in the majority.

    A graph without a scored center has score 0. One above ``max_nodes`` has no
    score and an error text.
    """
    majority = labels.groupBy("graph_id").agg(
        F.signum((F.count_if(F.col("label") == "R") - F.count_if(F.col("label") == "S")).cast("double")).alias("s"))
    best = centers.groupBy("graph_id").agg(F.max("score").alias("best"))
    fits = F.col("n_nodes") <= max_nodes
    score = F.when(fits, F.coalesce("best", F.lit(0.0)))
    chiral = score > threshold
    return sizes.join(majority, "graph_id", "left").join(best, "graph_id", "left").select(
        "graph_id", score.alias("score"), chiral.alias("is_chiral"), (score / threshold - 1).alias("confidence"),
        F.when(chiral, F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("sign"),
        F.when(~fits, "too_large").alias("error"))


def compare_graphs(pairs: DataFrame, scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """A pair matches when both graphs are chiral, of opposite sign and of the same size."""
    side = scores.select("graph_id", "is_chiral", "sign").join(sizes, "graph_id")
    named = lambda p: side.select(*[F.col(c).alias(f"{p}_{n}") for c, n in (
        ("graph_id", "id"), ("is_chiral", "chiral"), ("sign", "sign"), ("n_nodes", "n"))])
    rows = pairs.select("a_id", "b_id").join(named("a"), "a_id").join(named("b"), "b_id")
    return rows.select("a_id", "b_id", (
        F.col("a_chiral") & F.col("b_chiral") & (F.col("a_sign") * F.col("b_sign") < 0) & (F.col("a_n") == F.col("b_n"))
    ).alias("is_match"))


def to_cartesian(fx: Column, fy: Column, fz: Column, cell: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Fractional to Cartesian coordinates for a cell (a, b, c, alpha, beta, gamma in degrees)."""
    a, b, c, alpha, beta, gamma = cell
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    v = F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)
    return a * fx + b * cg * fy + c * cb * fz, b * sg * fy + c * (ca - cb * cg) / sg * fz, c * v / sg * fz


def distance_edges(points: DataFrame, cutoff: float, shortest: float = 0.1) -> DataFrame:
    """Edges between the nodes of a structure at a distance in (shortest, cutoff], weight 1/d.

    ``points``: graph_id, node, x, y, z. The nodes of a structure of up to ``FEW_POINTS`` nodes are compared pair by pair.
    The space of larger ones is cut into cubes of the cutoff size
    and only neighbouring cubes meet. Nodes on the same spot share one site there, so
    copies are compared once and spread out again only for sites that are in range.
    """
    large = points.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW_POINTS).select("graph_id")
    if large.isEmpty():
        return _near_pairs(points, cutoff, shortest)
    large = broadcast_if_small(materialize(large, "large"))
    return _near_pairs(points.join(large, "graph_id", "left_anti"), cutoff, shortest).unionByName(
        _near_in_cubes(points.join(large, "graph_id", "left_semi"), cutoff, shortest))


def _distance() -> Column:
    """Distance of (x1, y1, z1) and (x2, y2, z2)."""
    squares = [(F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in ("x", "y", "z")]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def _near_pairs(points: DataFrame, cutoff: float, shortest: float) -> DataFrame:
    """``distance_edges`` of small structures: each row meets the others of its structure, without copies of rows."""
    side = lambda i: points.select("graph_id", F.col("node").alias(f"n{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("x", "y", "z")])
    near = side(1).join(side(2), "graph_id").where(F.col("n1") < F.col("n2")).withColumn("d", _distance())
    near = near.where((F.col("d") > shortest) & (F.col("d") > 0) & (F.col("d") <= cutoff))  # 0: copies on one spot
    return near.select("graph_id", F.col("n1").alias("u"), F.col("n2").alias("v"), "d", (1 / F.col("d")).alias("w"))


def _near_in_cubes(points: DataFrame, cutoff: float, shortest: float) -> DataFrame:
    """``distance_edges`` of large structures."""
    axes = ["x", "y", "z"]
    sites = points.groupBy("graph_id", *axes).agg(F.min("node").alias("site"))
    cubes = sites.select("graph_id", "site", *axes, *[F.floor(F.col(c) / cutoff).alias(f"c{c}") for c in axes])
    near = [F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])).alias(f"d{c}") for c in axes]
    asking = cubes
    for c, step in zip(axes, near):
        asking = asking.select("*", step).withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"d{c}")).drop(f"d{c}")
    left = asking.select("graph_id", "cx", "cy", "cz", F.col("site").alias("s1"), *[F.col(c).alias(f"{c}1") for c in axes])
    right = cubes.select("graph_id", "cx", "cy", "cz", F.col("site").alias("s2"), *[F.col(c).alias(f"{c}2") for c in axes])
    in_range = left.join(right, ["graph_id", "cx", "cy", "cz"]).where(F.col("s1") < F.col("s2")).withColumn("d", _distance()).where(
        (F.col("d") > shortest) & (F.col("d") <= cutoff)).select("graph_id", "s1", "s2", "d")
    members = points.join(sites, ["graph_id", *axes]).select("graph_id", "site", "node")
    a = members.select("graph_id", F.col("site").alias("s1"), F.col("node").alias("n1"))
    b = members.select("graph_id", F.col("site").alias("s2"), F.col("node").alias("n2"))
    return in_range.join(a, ["graph_id", "s1"]).join(b, ["graph_id", "s2"]).select(
        "graph_id", F.least("n1", "n2").alias("u"), F.greatest("n1", "n2").alias("v"), "d", (1 / F.col("d")).alias("w"))
