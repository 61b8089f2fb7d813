"""Exact cosine search.

Three ways to the same result, chosen by checked sizes:

* a small corpus travels to the queries, which then need no shuffle at all;
* a small set of queries travels to the corpus, and each task keeps its best k;
* otherwise both sides meet in tiles of bounded bytes. Vectors are rotated so that their
  first coordinates carry most of their length; a pair is dropped after those when even
  parallel rests could not lift it to the k-th best that a sample has shown for the query;
* on request (``way="cells"``), for clustered vectors: both sides are cut into cells around
  pivots. Angles obey the triangle inequality, so a query only visits cells that can hold
  one of its k nearest. Crowded cells are split into blocks of bounded size. Where the queries
  would visit so many cells that tiles send fewer vectors, tiles are taken.

Similarities are rounded to 12 digits before ranking, so that ties fall to the
smaller id whatever the order of the additions was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antipode.functions.vectors import ZERO_NORM, combine_vectors, l2_distance, norm
from antipode.scale import first_per_group, materialize, spread, top_per_group

SMALL_BYTES = 32 << 20  # largest vector set sent to every task
SMALL_ROWS = 2000
MAX_PIVOTS = 1024
BLOCK_ROWS = 20_000
ANGLE_SLACK = 1e-6
GROUP_BYTES = 16 << 20  # vectors of one side of a tile task, and of the routes a batch sends at once
TILE_ROWS = 1024  # rows per side multiplied at once: 8 MB of products
SAMPLE_ROWS = 2048  # corpus rows that give each query its first bound
DOT_SLACK = 1e-9
NEAR = 1e-11  # similarities this close are told apart by their rounded values


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of a against rows of b, both of unit length, mapped to [0, 1]."""
    return np.round((np.clip(a @ b.T, -1.0, 1.0) + 1.0) / 2.0, 12)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (similarity desc, id asc)."""
    if len(sims) > k:
        cut = np.partition(sims, len(sims) - k)[len(sims) - k]
        pos = np.flatnonzero(sims >= cut)
    else:
        pos = np.arange(len(sims))
    return pos[np.lexsort((ids[pos], -sims[pos]))][:k]


def _result_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("entity_id", corpus.schema["entity_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])


def _fits(df: DataFrame) -> bool:
    """True when the vectors are few and small enough to send to every task."""
    seen = df.select(F.size("vec").alias("n")).limit(SMALL_ROWS + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("dim")).first()
    return seen["rows"] <= SMALL_ROWS and seen["rows"] * (seen["dim"] or 0) * 8 <= SMALL_BYTES


def _collect_small(df: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a set already checked by ``_fits``."""
    pdf = df.select(id_col, "vec").toPandas()
    return pdf[id_col].to_numpy(), _unit(_stack(pdf["vec"])) if len(pdf) else np.zeros((0, 0))


def _frame(qid, eid, sim) -> pd.DataFrame:
    return pd.DataFrame({"query_id": qid, "entity_id": eid, "similarity": sim})


def _small_corpus(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, schema) -> DataFrame:
    ids, vectors = _collect_small(corpus, "entity_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            sims = _similarity(_unit(_stack(pdf["vec"])), vectors)
            q, e, s = [], [], []
            for i, qid in enumerate(pdf["query_id"].to_numpy()):
                row, own = sims[i], ids
                if skip_self:
                    keep = ids != qid
                    row, own = row[keep], ids[keep]
                pos = _best(row, own, k)
                q.append(np.repeat(qid, len(pos)))
                e.append(own[pos])
                s.append(row[pos])
            yield _frame(np.concatenate(q), np.concatenate(e), np.concatenate(s))

    return queries.select("query_id", "vec").mapInPandas(scan, schema)


def _small_queries(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, schema) -> DataFrame:
    ids, vectors = _collect_small(queries, "query_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_e = [np.zeros(0, dtype=object)] * len(ids)
        best_s = [np.zeros(0)] * len(ids)
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            own = pdf["entity_id"].to_numpy()
            sims = _similarity(vectors, _unit(_stack(pdf["vec"])))
            for i in range(len(ids)):
                row, e = sims[i], own
                if skip_self:
                    keep = own != ids[i]
                    row, e = row[keep], own[keep]
                pos = _best(row, e, k)
                s2, e2 = np.concatenate([best_s[i], row[pos]]), np.concatenate([best_e[i], e[pos]])
                pos = _best(s2, e2, k)
                best_s[i], best_e[i] = s2[pos], e2[pos]
        if len(ids):
            yield _frame(np.repeat(ids, [len(s) for s in best_s]), np.concatenate(best_e), np.concatenate(best_s))

    return corpus.select("entity_id", "vec").mapInPandas(scan, schema)


def _by_cells(queries: DataFrame, corpus: DataFrame, k: int, schema,
              pivots: int, block: int) -> DataFrame:
    # a fixed number of pivots, spread by hash: the choice steers the speed only
    rows = corpus.select("vec", F.xxhash64("entity_id").alias("h")).orderBy("h").limit(pivots).collect()
    centers = _unit(_stack(pd.Series([r["vec"] for r in rows])))
    e_type = schema["entity_id"].dataType.simpleString()
    q_type = schema["query_id"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            unit = _unit(_stack(pdf["vec"]))
            angles = np.arccos(np.clip(unit @ centers.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            yield pd.DataFrame({"entity_id": pdf["entity_id"], "unit": [row.tobytes() for row in unit], "cell": cell.astype("int32"),
                                "angle": angles[np.arange(len(cell)), cell]})

    placed = materialize(corpus.select("entity_id", "vec").mapInPandas(
        assign, f"entity_id {e_type}, unit binary, cell int, angle double"), "cells")
    # one row per pivot
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"),
                                       F.max("angle").alias("hi")).toPandas()
    used = stats["cell"].to_numpy()
    size, lo, hi = stats["n"].to_numpy(), stats["lo"].to_numpy(), stats["hi"].to_numpy()

    d = centers.shape[1]

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, unit vectors, which of the used cells each may have to visit), a bounded number of routes at a time."""
        rows = max(1, GROUP_BYTES // (8 * d * len(used)))
        for pdf in batches:
            for start in range(0, len(pdf), rows):
                part = pdf.iloc[start:start + rows]
                unit = _unit(_stack(part["vec"]))
                angles = np.arccos(np.clip(unit @ centers[used].T, -1.0, 1.0))
                farthest = angles + hi
                order = np.argsort(farthest, axis=1)
                enough = np.cumsum(size[order], axis=1) >= k
                first = np.where(enough.any(axis=1), enough.argmax(axis=1), len(used) - 1)
                bound = farthest[np.arange(len(unit)), order[np.arange(len(unit)), first]]
                bound = np.where(enough.any(axis=1), bound, np.inf)
                nearest = np.maximum(0.0, np.maximum(angles - hi, lo - angles))
                yield part["query_id"].to_numpy(), unit, nearest <= bound[:, None] + ANGLE_SLACK

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asking, _, go in visits(batches):
            yield pd.DataFrame({"queries": [len(asking)], "routes": [int(go.sum())]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asking, unit, go in visits(batches):
            q, c = np.nonzero(go)
            sent = [row.tobytes() for row in unit]
            yield pd.DataFrame({"query_id": asking[q], "q_unit": [sent[i] for i in q], "cell": used[c].astype("int32")})

    if not len(used):
        return queries.sparkSession.createDataFrame([], schema)
    cost = queries.select("query_id", "vec").mapInPandas(count, "queries long, routes long").agg(F.sum("queries").alias("n"), F.sum("routes").alias("routes")).first()
    side = int(np.ceil(queries.sparkSession.sparkContext.defaultParallelism ** 0.5))
    tiles = lambda rows: max(2, side, -(-rows * 8 * d // GROUP_BYTES))
    entities = int(size.sum())
    if (cost["routes"] or 0) > (cost["n"] or 0) * tiles(entities) + entities * tiles(cost["n"] or 0):
        # the cells hardly part these vectors: tiles send fewer copies of them
        return _by_tiles(queries, corpus, k, schema)
    routed = materialize(queries.select("query_id", "vec").mapInPandas(
        route, f"query_id {q_type}, q_unit binary, cell int"), "routes")
    asked = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = {int(c): (max(1, -(-int(n) // block)), max(1, -(-int(asked.get(int(c), 0)) // block)))
            for c, n in zip(used, size)}

    def per_cell(which: int):
        pairs = [x for c, v in cuts.items() for x in (F.lit(c), F.lit(v[which]))]
        return F.create_map(*pairs)[F.col("cell")]

    def copies(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = routed.withColumn("q_part", F.pmod(F.xxhash64("query_id"), per_cell(1)).cast("int")).withColumn(
        "e_part", copies(per_cell(0)))
    right = placed.select("entity_id", "unit", "cell").withColumn(
        "e_part", F.pmod(F.xxhash64("entity_id"), per_cell(0)).cast("int")).withColumn("q_part", copies(per_cell(1)))

    def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return _frame([], [], [])
        ids, asking = e["entity_id"].to_numpy(), q["query_id"].to_numpy()
        left, right = _joined(q["q_unit"], d), _joined(e["unit"], d)
        kept, values, rows = [], [], max(1, GROUP_BYTES // (8 * len(ids)))
        for start in range(0, len(left), rows):
            for row in _similarity(left[start:start + rows], right):
                kept.append(_best(row, ids, k))
                values.append(row[kept[-1]])
        return _frame(np.repeat(asking, [len(p) for p in kept]), ids[np.concatenate(kept)], np.concatenate(values))

    keys = ["cell", "q_part", "e_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _rotation(corpus: DataFrame, d: int) -> np.ndarray:
    """Orthogonal matrix to the axes of the unit vectors' second moments, longest first; d x d numbers reach the driver."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                unit = _unit(_stack(pdf["vec"]))
                total += unit.T @ unit
        yield pd.DataFrame({"i": np.arange(d), "v": list(total)})

    cells = corpus.select("vec").mapInPandas(sums, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    moments = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(
            F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s")).select("i", "s.v").collect():
        moments[r["i"]] = r["v"]
    return np.linalg.eigh(moments)[1][:, ::-1]


class _Tile:
    """Best ``k`` corpus rows of a block for a block of queries; counts the coordinates it did not multiply."""

    def __init__(self, asking: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, head: int | None = None):
        self.asking, self.q, self.bound, self.k = asking, q, bound.copy(), k
        self.head = head or max(1, q.shape[1] // 2)
        self.rest = np.sqrt(np.maximum(0.0, (q[:, self.head:] ** 2).sum(1)))
        self.ids = [np.zeros(0, dtype=object)] * len(q)
        self.sims = [np.zeros(0)] * len(q)
        self.pairs = self.skipped = 0

    def meet(self, ids: np.ndarray, e: np.ndarray) -> None:
        rest = np.sqrt(np.maximum(0.0, (e[:, self.head:] ** 2).sum(1)))
        for a in range(0, len(self.q), TILE_ROWS):
            for b in range(0, len(e), TILE_ROWS):
                self._meet(slice(a, min(a + TILE_ROWS, len(self.q))), ids[b:b + TILE_ROWS], e[b:b + TILE_ROWS], rest[b:b + TILE_ROWS])

    def _meet(self, at: slice, ids: np.ndarray, e: np.ndarray, rest: np.ndarray) -> None:
        q, h, d = self.q[at], self.head, self.q.shape[1]
        dots = q[:, :h] @ e[:, :h].T
        alive = dots + self.rest[at, None] * rest >= self.bound[at, None] - DOT_SLACK
        self.pairs += alive.size
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            self.skipped += alive.size * (d - h)
            return
        columns = np.flatnonzero(alive[rows].any(0))
        part = alive[np.ix_(rows, columns)]
        if 8 * part.sum() > part.size:  # many pairs left: multiply whole rows
            self.skipped += (alive.size - part.size) * (d - h)
            full = dots[np.ix_(rows, columns)] + q[rows, h:] @ e[columns, h:].T
            i, j = np.nonzero(full >= self.bound[at][rows, None] - DOT_SLACK)
            value = full[i, j]
            i, j = rows[i], columns[j]
        else:
            i, j = np.nonzero(alive)
            self.skipped += (alive.size - len(i)) * (d - h)
            value = dots[i, j] + np.einsum("pd,pd->p", q[i, h:], e[j, h:])
            keep = value >= self.bound[at][i] - DOT_SLACK
            i, j, value = i[keep], j[keep], value[keep]
        starts = np.searchsorted(i, np.arange(len(q) + 1))
        sims = np.round((np.clip(value, -1.0, 1.0) + 1.0) / 2.0, 12)
        for row in np.unique(i):
            own, n = slice(starts[row], starts[row + 1]), at.start + row
            s, found = np.concatenate([self.sims[n], sims[own]]), np.concatenate([self.ids[n], ids[j[own]]])
            pos = _best(s, found, self.k)
            self.sims[n], self.ids[n] = s[pos], found[pos]
            if len(pos) == self.k:
                self.bound[n] = max(self.bound[n], 2 * s[pos[-1]] - 1)

    def frame(self, effort: bool) -> pd.DataFrame:
        if effort:
            return pd.DataFrame({"pairs": [self.pairs], "skipped": [self.skipped], "coordinates": [self.pairs * self.q.shape[1]]})
        return _frame(np.repeat(self.asking, [len(x) for x in self.sims]), np.concatenate(self.ids), np.concatenate(self.sims))


def _best_head(shown: np.ndarray, k: int) -> int:
    """After how many coordinates to test a pair: where a sample of pairs saves most. Steers the speed only."""
    n, d = shown.shape
    if n <= k:
        return max(1, d // 2)
    q = shown[:: max(1, n // 128)]
    bound = np.partition(q @ shown.T, n - k, axis=1)[:, n - k]

    def saved(h: int) -> float:
        rest = np.sqrt(np.maximum(0.0, (q[:, h:] ** 2).sum(1)))[:, None] * np.sqrt(np.maximum(0.0, (shown[:, h:] ** 2).sum(1)))
        return float((q[:, :h] @ shown[:, :h].T + rest < bound[:, None]).mean()) * (d - h)

    return max(sorted({max(1, d * i // 16) for i in range(1, 16)}), key=saved)


def _by_tiles(queries: DataFrame, corpus: DataFrame, k: int, schema, pivots: int = 0, block: int = 0, effort: bool = False) -> DataFrame:
    """Candidates that hold the ``k`` best per query; with ``effort`` the work done per tile task instead."""
    first = corpus.select(F.size("vec").alias("d")).first()
    if first is None:
        return queries.sparkSession.createDataFrame([], schema)
    d = first["d"]
    turn = _rotation(corpus, d)
    sample = corpus.select("vec", F.xxhash64("entity_id").alias("_h")).orderBy("_h").limit(
        max(k, min(SAMPLE_ROWS, GROUP_BYTES // (8 * d)))).select("vec").toPandas()
    shown = _unit(_stack(sample["vec"])) @ turn
    head = _best_head(shown, k)
    q_type, e_type = (schema[c].dataType.simpleString() for c in ("query_id", "entity_id"))

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(_stack(pdf["vec"])) @ turn
                yield pd.DataFrame({"id": pdf["id"], "unit": [row.tobytes() for row in unit]})

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in turned(batches):
            unit, bound = _joined(pdf["unit"], d), np.full(len(pdf), -2.0)
            if len(shown) >= k:
                for a in range(0, len(unit), TILE_ROWS):
                    bound[a:a + TILE_ROWS] = np.partition(unit[a:a + TILE_ROWS] @ shown.T, len(shown) - k, axis=1)[:, len(shown) - k]
            yield pdf.assign(bound=bound)

    asked = materialize(queries.select(F.col("query_id").alias("id"), "vec").mapInPandas(bounded, f"id {q_type}, unit binary, bound double"), "asked")
    stored = materialize(corpus.select(F.col("entity_id").alias("id"), "vec").mapInPandas(turned, f"id {e_type}, unit binary"), "stored")
    side = max(2, int(np.ceil(queries.sparkSession.sparkContext.defaultParallelism ** 0.5)))
    parts = lambda df: max(side, -(-df.count() * 8 * d // GROUP_BYTES))
    nq, ne = parts(asked), parts(stored)
    piece = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q_part", piece(nq)).withColumn("e_part", copies(ne))
    right = stored.withColumn("e_part", piece(ne)).withColumn("q_part", copies(nq))

    def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({"pairs": [], "skipped": [], "coordinates": []}) if effort else _frame([], [], [])
        tile = _Tile(q["id"].to_numpy(), _joined(q["unit"], d), q["bound"].to_numpy(), k, head)
        tile.meet(e["id"].to_numpy(), _joined(e["unit"], d))
        return tile.frame(effort)

    keys = ["q_part", "e_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, "pairs long, skipped long, coordinates long" if effort else schema)


def _joined(units: pd.Series, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), d)


def search_effort(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Pairs of an exact tile search and the share of their coordinates that were not multiplied, in one row."""
    queries = queries.where(norm(F.col("vec")) >= ZERO_NORM)
    corpus = corpus.where(norm(F.col("vec")) >= ZERO_NORM)
    work = _by_tiles(queries, corpus, k, _result_schema(queries, corpus), effort=True)
    return work.agg(F.sum("pairs").alias("pairs"), (F.sum("skipped") / F.sum("coordinates")).alias("skipped"))


def _without_copies(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool, schema,
                    pivots: int | None, block: int, search=_by_cells) -> DataFrame:
    """Search over distinct vectors.

    Equal queries share one search, and of equal corpus rows only the smallest
    ids can be among the k best, so copies do not multiply the work.
    """
    need = k + (1 if skip_self else 0)
    few = top_per_group(corpus.select("entity_id", "vec"), ["vec"], [F.asc("entity_id")], need).drop("rank")
    asked = queries.groupBy("vec").agg(F.min("query_id").alias("rep"))
    if pivots is None and search is _by_cells:
        # about sqrt(n) / 2 cells, so that cells grow no faster than their number
        pivots = int(min(MAX_PIVOTS, max(8, few.count() ** 0.5 / 2)))
    found = search(asked.select(F.col("rep").alias("query_id"), "vec"), few, need, schema, pivots, block)
    best = top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("entity_id")], need).select(
        F.col("query_id").alias("rep"), "entity_id", "similarity")
    out = queries.select("query_id", "vec").join(asked, "vec").select("query_id", "rep").join(best, "rep")
    out = out.select("query_id", "entity_id", "similarity")
    return out.where(F.col("query_id") != F.col("entity_id")) if skip_self else out


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool = False, way: str = "auto",
                pivots: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` most similar corpus rows per query, zero vectors on either side left out.

    ``queries``: query_id, vec. ``corpus``: entity_id, vec. Output: query_id,
    entity_id, similarity in [0, 1], rank.
    """
    queries = queries.where(norm(F.col("vec")) >= ZERO_NORM)
    corpus = corpus.where(norm(F.col("vec")) >= ZERO_NORM)
    schema = _result_schema(queries, corpus)
    if way == "auto":
        way = "corpus" if _fits(corpus) else "queries" if _fits(queries) else "tiles"
    if way == "corpus":
        found = _small_corpus(queries, corpus, k, skip_self, schema)
    elif way == "queries":
        found = _small_queries(queries, corpus, k, skip_self, schema)
    else:
        found = _without_copies(queries, corpus, k, skip_self, schema, pivots, block, _by_cells if way == "cells" else _by_tiles)
    return top_per_group(found, ["query_id"], [F.desc("similarity"), F.asc("entity_id")], k)


def opposite_sign_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top-k among the rows whose sign opposes that of the query's best match.

    A best match with sign 0 gives no result.
    """
    # each corpus row is searched once: with its sign's rows, and for the best match only if it has none
    sign = F.coalesce("sign", F.lit(0.0))
    of = lambda rows, k, side: cosine_topk(queries, rows, k).withColumn("side", F.lit(side))
    found = of(corpus.where(sign > 0), k, 1.0).unionByName(of(corpus.where(sign < 0), k, -1.0))
    found = materialize(found.unionByName(of(corpus.where(sign == 0), 1, 0.0)), "sides")
    best = first_per_group(found.select("query_id", (-F.col("similarity")).alias("s"), "entity_id", F.col("side").alias("best_side")),
                           ["query_id"], ["s", "entity_id"]).select("query_id", "best_side")
    return found.join(best, "query_id").where(F.col("side") * F.col("best_side") < 0).select(
        "query_id", "entity_id", "similarity", "rank")


def novelty(candidates: DataFrame, corpus: DataFrame, skip_self: bool = False) -> DataFrame:
    """1 - similarity of the nearest corpus row; 1 where the corpus has none."""
    nearest = cosine_topk(candidates, corpus, 1, skip_self).select("query_id", "similarity")
    return candidates.select("query_id").join(nearest, "query_id", "left").select(
        "query_id", (1 - F.coalesce("similarity", F.lit(0.0))).alias("novelty"))


def novel_screen(outcomes: DataFrame, vectors: DataFrame, corpus: DataFrame, cut: float = 0.8) -> DataFrame:
    """First record of each catalyst that has a vector but no close corpus row; priority = ee / 100 + 0.5."""
    first = first_per_group(
        outcomes.where(F.coalesce("catalyst", F.lit("")) != "").select("catalyst", "id", "ee"), ["catalyst"], ["id"])
    known = first.join(vectors, "catalyst")
    near = cosine_topk(known.select(F.col("catalyst").alias("query_id"), "vec"), corpus, 1).select(
        F.col("query_id").alias("catalyst"), "similarity")
    return known.join(near, "catalyst", "left").where(
        F.col("similarity").isNull() | (F.col("similarity") < cut)
    ).select("id", "catalyst", F.lit("novel_catalyst").alias("hit_type"),
             (F.coalesce("ee", F.lit(0.0)) / 100 + 0.5).alias("priority"))


class _Rivals:
    """For asked pairs (query, expected row, their similarity): how many rows of a corpus come before the expected one, up to ``limit``."""

    def __init__(self, asked: pd.DataFrame, d: int, limit: int):
        self.query, self.expected, self.similarity = (asked[c].to_numpy() for c in ("query_id", "expected_id", "similarity"))
        self.units, self.limit = _joined(asked["unit"], d), limit
        self.seen = np.zeros(len(asked), np.int64)

    def meet(self, ids: np.ndarray, units: np.ndarray) -> None:
        for b in range(0, len(units), TILE_ROWS):
            some, e = ids[b:b + TILE_ROWS], units[b:b + TILE_ROWS]
            order = np.argsort(some)
            still = np.flatnonzero(self.seen < self.limit)
            for a in range(0, len(still), TILE_ROWS):
                self._meet(still[a:a + TILE_ROWS], some, order, e)

    def _meet(self, at: np.ndarray, ids: np.ndarray, order: np.ndarray, e: np.ndarray) -> None:
        dots, cosine = self.units[at] @ e.T, 2 * self.similarity[at] - 1
        place = order[np.minimum(np.searchsorted(ids, self.query[at], sorter=order), len(ids) - 1)]
        own = np.flatnonzero(ids[place] == self.query[at])
        dots[own, place[own]] = -2.0  # a query is no rival of its own
        above = dots > (cosine + 2 * NEAR)[:, None]
        self.seen[at] += above.sum(1)
        i, j = np.nonzero((dots >= (cosine - 2 * NEAR)[:, None]) & ~above)
        if len(i):  # too close to tell without the rounding
            rounded, known, mine = np.round((np.clip(dots[i, j], -1.0, 1.0) + 1.0) / 2.0, 12), self.similarity[at[i]], self.expected[at[i]]
            before = (ids[j] != mine) & ((rounded > known) | ((rounded == known) & (ids[j] < mine)))
            np.add.at(self.seen, at[i[before]], 1)


def expected_ranks(queries: DataFrame, corpus: DataFrame, expected: DataFrame, limit: int) -> DataFrame:
    """Ranks up to ``limit`` of the rows that queries expect, as ``cosine_topk`` would give them without the queries' own rows.

    ``expected``: query_id, expected_id. Output: query_id, entity_id, rank. A pair is settled once ``limit`` rows are known
    to come before: most are after a sample of the corpus, and only the others meet all of it.
    """
    queries = queries.where(norm(F.col("vec")) >= ZERO_NORM)
    corpus = corpus.where((norm(F.col("vec")) >= ZERO_NORM) & F.col("entity_id").isNotNull())
    repeated = lambda df, c: not df.groupBy(c).count().where("count > 1").isEmpty()
    if repeated(corpus, "entity_id") or repeated(queries, "query_id"):  # a rank of such an id is not one place
        return cosine_topk(queries, corpus, limit, skip_self=True).select("query_id", "entity_id", "rank")
    first = corpus.select(F.size("vec").alias("d")).first()
    schema = _result_schema(queries, corpus)
    q_type, e_type = (schema[c].dataType.simpleString() for c in ("query_id", "entity_id"))
    if first is None:
        return queries.sparkSession.createDataFrame([], f"query_id {q_type}, entity_id {e_type}, rank int")
    d = first["d"]

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                unit = _unit(_stack(pdf["vec"]))
                dots = np.einsum("pd,pd->p", unit, _unit(_stack(pdf["other"])))
                yield pd.DataFrame({"query_id": pdf["query_id"], "expected_id": pdf["expected_id"], "unit": [row.tobytes() for row in unit],
                                    "similarity": np.round((np.clip(dots, -1.0, 1.0) + 1.0) / 2.0, 12)})

    pairs = expected.where(F.col("query_id") != F.col("expected_id")).distinct().join(queries.select("query_id", "vec"), "query_id").join(
        corpus.select(F.col("entity_id").alias("expected_id"), F.col("vec").alias("other")), "expected_id")
    pair_kinds = f"query_id {q_type}, expected_id {e_type}"
    asked = materialize(pairs.select("query_id", "expected_id", "vec", "other").mapInPandas(pair, f"{pair_kinds}, unit binary, similarity double"), "asked")
    entities, most = corpus.count(), max(1, GROUP_BYTES // (8 * d))
    for rows in (SAMPLE_ROWS, 16 * SAMPLE_ROWS):
        if entities > 2 * min(rows, most):
            asked = _unsettled(asked, corpus, d, limit, min(rows, most))
    open_pairs = asked.count()
    if open_pairs <= most:
        counts = _rivals_of_few(asked, corpus, d, limit, f"{pair_kinds}, seen long")
    else:
        counts = _rivals_in_tiles(asked, corpus, d, limit, f"{pair_kinds}, seen long", open_pairs, entities)
    return counts.groupBy("query_id", "expected_id").agg(F.sum("seen").alias("seen")).where(F.col("seen") < limit).select(
        "query_id", F.col("expected_id").alias("entity_id"), (F.col("seen") + 1).cast("int").alias("rank"))


def _unsettled(asked: DataFrame, corpus: DataFrame, d: int, limit: int, rows: int) -> DataFrame:
    """Pairs that fewer than ``limit`` of some corpus rows come before."""
    sample = corpus.select("entity_id", "vec", F.xxhash64("entity_id").alias("_h")).orderBy("_h").limit(rows).select("entity_id", "vec").toPandas()
    ids, units = sample["entity_id"].to_numpy(), _unit(_stack(sample["vec"]))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rivals = _Rivals(pdf, d, limit)
                rivals.meet(ids, units)
                yield pdf[rivals.seen < limit]

    return materialize(spread(asked).mapInPandas(work, asked.schema), "asked")


def _rivals_of_few(asked: DataFrame, corpus: DataFrame, d: int, limit: int, kinds: str) -> DataFrame:
    """The pairs travel to the corpus."""
    pairs = asked.toPandas()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rivals = _Rivals(pairs, d, limit)
        for pdf in batches:
            if len(pdf):
                rivals.meet(pdf["entity_id"].to_numpy(), _unit(_stack(pdf["vec"])))
        yield pairs[["query_id", "expected_id"]].assign(seen=rivals.seen)

    return spread(corpus.select("entity_id", "vec")).mapInPandas(work, kinds)


def _rivals_in_tiles(asked: DataFrame, corpus: DataFrame, d: int, limit: int, kinds: str, n_asked: int, n_corpus: int) -> DataFrame:
    """Both sides meet in tiles of bounded bytes."""
    e_type = asked.schema["expected_id"].dataType.simpleString()

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "unit": [row.tobytes() for row in _unit(_stack(pdf["vec"]))]})

    stored = corpus.select("entity_id", "vec").mapInPandas(unit, f"entity_id {e_type}, unit binary")
    side = max(2, int(np.ceil(asked.sparkSession.sparkContext.defaultParallelism ** 0.5)))
    nq, ne = (max(side, -(-n * 8 * d // GROUP_BYTES)) for n in (n_asked, n_corpus))
    piece = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q_part", piece("query_id", nq)).withColumn("e_part", copies(ne))
    right = stored.withColumn("e_part", piece("entity_id", ne)).withColumn("q_part", copies(nq))

    def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        rivals = _Rivals(q, d, limit)
        if len(q) and len(e):
            rivals.meet(e["entity_id"].to_numpy(), _joined(e["unit"], d))
        return q[["query_id", "expected_id"]].assign(seen=rivals.seen)

    keys = ["q_part", "e_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, kinds)


def precision_at_k(results: DataFrame, expected: DataFrame, ks=(1, 3)) -> DataFrame:
    """Share of queries whose expected partner ranks within each k."""
    ranks = expected.join(results.select("query_id", F.col("entity_id").alias("expected_id"), "rank"),
                          ["query_id", "expected_id"], "left")
    return ranks.agg(F.count(F.lit(1)).alias("n_queries"), *[
        F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"precision_at_{k}") for k in ks])


def projection_matrix(raw_dim: int, nbits: int, seed: int = 42) -> np.ndarray:
    """Gaussian matrix with unit columns, the same for every run and in every engine.

    An entry depends on its place alone: the md5 of ``seed:row:column`` (from 0) gives two 32-bit numbers a
    and b, and the entry is sqrt(-2 ln((a + 1) / 2^32)) cos(2 pi b / 2^32) before its column is scaled.
    """
    digests = [hashlib.md5(f"{seed}:{i}:{j}".encode(), usedforsecurity=False).digest() for i in range(raw_dim) for j in range(nbits)]
    bits = np.frombuffer(b"".join(d[:8] for d in digests), ">u4").astype(float).reshape(raw_dim, nbits, 2) / 2.0**32
    m = np.sqrt(-2 * np.log(bits[..., 0] + 2.0**-32)) * np.cos(2 * np.pi * bits[..., 1])
    return m / np.linalg.norm(m, axis=0, keepdims=True)


def random_project(df: DataFrame, vec: str, raw_dim: int, nbits: int, out: str = "projected", seed: int = 42) -> DataFrame:
    """Multiply each vector by the fixed projection matrix; a missing vector stays missing."""
    matrix = projection_matrix(raw_dim, nbits, seed)

    @F.arrow_udf("array<double>")
    def project(col: pa.Array) -> pa.Array:
        known = col.is_valid().to_numpy(zero_copy_only=False)
        values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if set(col.value_lengths().drop_null().unique().to_pylist()) - {raw_dim}:
            raise ValueError(f"vectors of {raw_dim} numbers are expected")
        rows = values.reshape(-1, raw_dim) @ matrix
        starts = np.concatenate([[0], np.cumsum(known * nbits)]).astype(np.int32)
        return pa.ListArray.from_arrays(starts, rows.ravel(), mask=pa.array(~known))

    return df.withColumn(out, project(F.col(vec)))


def combined_outcome_vectors(df: DataFrame, a: str = "catalyst_vec", b: str = "substrate_vec") -> DataFrame:
    """Adds the combined vector of both sides, null where one is missing."""
    return df.withColumn("combined_vec", combine_vectors(F.col(a), F.col(b)))


def rank_ligands(candidates: DataFrame, substrate_vec: list[float], score: str = "score") -> DataFrame:
    """Score * 100 and distance to the substrate per candidate; failed rows get 0 and infinity."""
    target = F.array(*[F.lit(float(x)) for x in substrate_vec])
    ok = F.col("vec").isNotNull() & F.col(score).isNotNull()
    return candidates.select(
        "entity_id",
        F.when(ok, F.col(score) * 100).otherwise(0.0).alias("predicted"),
        F.when(ok, l2_distance(F.col("vec"), target)).otherwise(float("inf")).alias("distance"),
    )
