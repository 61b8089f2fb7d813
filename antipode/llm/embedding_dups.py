"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Two vectors with cosine c differ on
each direction by a normal amount of spread sqrt(2 - 2c), so a window of two spreads
around the query holds a true partner on almost every direction and a stranger on about
four of ten. Per direction the values are sorted and the window centred on each query is found by
binary search; the windows a pair shares are counted. Pairs that reach the count that a
partner at the threshold misses with probability ``MISS`` are verified by their cosine.

Vectors of a label meet in blocks: every pair of blocks is one group of bounded size, and a
large label is just more groups. A group works in tiles, and a tile leaves only link counts and a forest of
what it links, so neither pairs nor memory grow with a group of near copies. A block is
as large as a task can hold, because each vector travels once per block of its label. Equal vectors are one class from the start.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import materialize
from antipode.llm.components import connected_components

PROJECTIONS = 32
SPREADS = 2.0
MISS = 1e-4
#: Vectors of a block, and of a tile inside a pair of blocks. The first bounds a task's vectors, the second its counters.
BLOCK = 8192
TILE = 1024


def calibrated_count(projections: int = PROJECTIONS, spreads: float = SPREADS, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold falls short of with probability below ``miss``."""
    p = erf(spreads / sqrt(2))
    below = 0.0
    for c in range(projections + 1):
        below += comb(projections, c) * p**c * (1 - p) ** (projections - c)
        if below >= miss:
            return c
    return projections


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Gaussian directions, fixed by the dimension."""
    return np.random.default_rng([7, dim]).standard_normal((dim, projections))


def window_collisions(a: np.ndarray, b: np.ndarray, half: float) -> np.ndarray:
    """How many directions place row j of ``b`` within ``half`` of row i of ``a``: counts per (i, j)."""
    total = np.zeros((len(b), len(a)), np.int16)
    for d in range(a.shape[1]):
        order = np.argsort(b[:, d], kind="stable")
        ranked = b[order, d]
        lo = np.searchsorted(ranked, a[:, d] - half, "left")
        hi = np.searchsorted(ranked, a[:, d] + half, "right")
        marks = np.zeros((len(b) + 1, len(a)), np.int8)
        cols = np.arange(len(a))
        marks[lo, cols] += 1
        marks[hi, cols] -= 1
        total[order] += np.cumsum(marks[:-1], axis=0, dtype=np.int8)
    return total.T


def _pairs_in(a: np.ndarray, b: np.ndarray, along_a: np.ndarray, along_b: np.ndarray, same: bool,
              cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j) between two tiles of unit vectors, given with their projections."""
    half = SPREADS * sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    hits = window_collisions(along_a, along_b, half) >= calibrated_count(along_a.shape[1])
    if same:
        hits = np.triu(hits, 1)
    i, j = np.nonzero(hits)
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        keep[k:k + (1 << 16)] = np.einsum("ij,ij->i", a[i[k:k + (1 << 16)]], b[j[k:k + (1 << 16)]]) >= cosine
    return i[keep], j[keep]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def block_links(vec: np.ndarray, copies: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, cosine: float,
                projections: int = PROJECTIONS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each vector: copies of its partners, and the smallest index it reaches between two blocks.

    ``left`` and ``right`` are ascending indices into ``vec``; with ``same`` they are one block.
    """
    n = len(vec)
    along = vec @ directions(vec.shape[1], projections)
    links = np.zeros(n, np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for x in range(0, len(left), tile):
        for y in range(x if same else 0, len(right), tile):
            l, r = left[x:x + tile], right[y:y + tile]
            i, j = _pairs_in(vec[l], vec[r], along[l], along[r], same and x == y, cosine)
            if len(i):
                i, j = l[i], r[j]
                links += (np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)).astype(np.int64)
                root = _forest(i, j, n)
                child = np.flatnonzero(root != np.arange(n))
                ends.append((child, root[child]))
    if not ends:
        return links, np.arange(n)
    return links, _forest(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), n)


def vector_links(vectors: DataFrame, cosine: float = 0.93, projections: int = PROJECTIONS,
                 block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(id, links, parent) per block pair: weighted link counts, and a parent that joins what is linked.

    ``vectors``: id, label, dim, vec (valid), copies; one row per distinct vector.
    """
    sizes = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("label", "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = vectors.join(blocks, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = own.withColumn("other", other).select(
        "label", "dim", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "vec",
        "copies")

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # parents are smallest ids
        ids = table["id"].to_numpy()
        vec = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        vec = vec / np.abs(vec).max(axis=1, keepdims=True)
        vec /= np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        p, q, side = table["p"][0].as_py(), table["q"][0].as_py(), table["own"].to_numpy()
        left = np.flatnonzero(side == p)
        links, root = block_links(vec, table["copies"].to_numpy(), left, left if p == q else np.flatnonzero(side == q),
                                  p == q, cosine, projections, tile)
        hit = np.flatnonzero(links)
        return pa.table({"id": ids[hit], "links": links[hit], "parent": ids[root[hit]]})

    return dealt.groupBy("label", "dim", "p", "q").applyInArrow(meet, "id long, links long, parent long")


def near_duplicate_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", cosine: float = 0.93, projections: int = PROJECTIONS,
                           block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and they have as many components. Null, empty and
    zero vectors, and vectors with null or non-finite components, link with nothing, nor does a row with a null id. Rows that repeat a
    vector are copies and link with each other; an empty table gives an empty result.
    """
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(
        "vec", lambda x: x != 0)
    rows = materialize(table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
                       .withColumn("valid", F.coalesce(fine & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
                       .withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), F.col("vec"))), "vectors")
    key = ["label", "k1", "k2"]
    classes = materialize(
        rows.where("valid").groupBy(*key).agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"),
                                              F.count(F.lit(1)).alias("copies")), "classes")
    linked = materialize(vector_links(
        classes.select(F.col("rep").alias("id"), "label", F.size("vec").alias("dim"), "vec", "copies"),
        cosine, projections, block, tile), "vector_links")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    comp = materialize(connected_components(linked, "id", "parent"), "components")
    known = materialize(
        classes.drop("vec").join(counts, F.col("rep") == F.col("id"), "left").drop("id")
        .join(comp, F.col("rep") == F.col("node"), "left")
        .select(*key, F.lit(True).alias("valid"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id")), "known")
    return rows.join(known, [*key, "valid"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"))
