"""Regression trees and forests for all groups, trees and folds at once.

Features are cut into bins, so a node of a tree needs no rows, only sums per (feature, bin). A level of
every tree of every group comes from one pass: rows are sent to the region they are in, their sums per
(group, tree, region, fold, feature, bin) are added up in the map tasks, and each node picks its split
from the summed bins. A group of any size is spread over its bins, and a pass costs the same for one
group as for thousands. A forest of depth d takes d passes, however many trees it has.

Groups of up to ``SMALL_GROUP`` rows are grown, and scored, many together: each group's rows meet in a bucket of
some ``BUCKET_ROWS`` rows, where the sums of all its trees are added up in arrays. Such a row is exchanged once,
instead of once per tree, feature and level; larger groups take the passes above.

Models that leave a fold out are grown from complements: the sums of all rows of a region minus those
of the fold left out. Folds whose trees agree so far share their regions, so that the rows of a region
are added up once for all of them and the number of folds or tags adds bins, not passes over rows.

Rows without group, label or feature list are left out. A feature that is null or NaN is below every
cut. Rows without a fold train every model and are scored by none.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType, StringType, StructField, StructType, _parse_datatype_string

from antipode.operators.stats import binary_metrics, regression_metrics, spearman
from antipode.scale import broadcast_if_small, materialize

BINS = 32
#: Gains that agree to this many decimals are equal; the smaller feature, then the smaller cut, wins.
GAIN_DECIMALS = 8

NODES = "array<struct<node:int,feature:int,cut:double,left:double,right:double,gain:double>>"
#: Rows of a group that one task may hold, rows that groups meet by in a task, and rows whose trees grow together.
SMALL_GROUP, BUCKET_ROWS, BLOCK_ROWS = 100_000, 250_000, 50_000


# ---------------------------------------------------------------------- bins

def feature_cuts(df: DataFrame, features: str, bins: int = BINS) -> list[list[float]]:
    """Ascending cuts per feature, at most ``bins``: every value that is not rare, or else spread quantiles.

    One sketch per feature in one pass; features x bins numbers reach the driver.
    """
    values = df.select(F.posexplode(features).alias("f", "v")).select("f", F.col("v").cast("double").alias("v"))
    probs = [i / (4 * bins) for i in range(4 * bins + 1)]
    known = values.where(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = known.groupBy("f").agg(F.percentile_approx("v", probs, 10_000).alias("q")).collect()
    size = max((r.f for r in rows), default=-1) + 1
    cuts: list[list[float]] = [[] for _ in range(size)]
    for r in rows:
        q = sorted(set(r.q))
        cuts[r.f] = q if len(q) <= bins else [q[i] for i in sorted({round(k * (len(q) - 1) / (bins - 1)) for k in range(bins)})]
    return cuts


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles, null as NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def with_bins(df: DataFrame, features: str, cuts: Sequence[Sequence[float]], out: str) -> DataFrame:
    """Add the bin of every feature: 0 if it has no value, else one more than the number of cuts below it."""
    edges = [np.asarray(c, float) for c in cuts]

    @F.arrow_udf("array<smallint>")
    def bins(column: pa.Array) -> pa.Array:
        x = _matrix(column)
        found = np.zeros(x.shape, np.int16)
        for f, e in enumerate(edges[: x.shape[1]]):
            found[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], side="left"))
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return df.withColumn(out, bins(F.transform(features, lambda v: v.cast("double"))))


def _draw(key: Column, tree: Column) -> Column:
    """A number in [0, 1) fixed by the row's key and the tree."""
    return F.pmod(F.xxhash64(key, tree), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _weight(u: Column) -> Column:
    """How often a row is drawn for a tree: Poisson with mean 1, from its draw."""
    draw, reach, term = F.lit(8), 0.0, float(np.exp(-1))
    steps = []
    for k in range(8):
        reach += term
        steps.append((k, reach))
        term /= k + 1
    for k, r in reversed(steps):
        draw = F.when(u < r, k).otherwise(draw)
    return draw.cast("double")


# -------------------------------------------------------------------- growing

def _picked(cells: DataFrame, min_leaf: float) -> DataFrame:
    """Best split per node from sums per (feature, bin): one row per node that can be split."""
    node = ["group", "tree", "model", "node", "region"]
    run = Window.partitionBy(*node, "feature").orderBy("bin")
    whole = Window.partitionBy(*node, "feature")
    at = cells.select("*", F.sum("w").over(run).alias("lw"), F.sum("s").over(run).alias("ls"), F.sum("w").over(whole).alias("tw"),
                      F.sum("s").over(whole).alias("ts"))
    rw, rs = F.col("tw") - F.col("lw"), F.col("ts") - F.col("ls")
    gain = F.col("ls") * F.col("ls") / F.col("lw") + rs * rs / rw - F.col("ts") * F.col("ts") / F.col("tw")
    # sums are differences where folds are left out: weights are whole numbers and stay exact
    at = at.where((F.col("lw") >= min_leaf) & (rw >= min_leaf) & (F.col("w") > 0)).select(
        *node, "feature", "bin", gain.alias("gain"), (F.col("ls") / F.col("lw")).alias("left"), (rs / rw).alias("right"))
    at = at.where(F.round("gain", GAIN_DECIMALS) > 0)
    order = F.struct(F.round("gain", GAIN_DECIMALS).alias("g"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    best = at.groupBy(*node).agg(F.max_by(F.struct("feature", "bin", "left", "right", "gain"), order).alias("s"))
    return best.select(*node, "s.*")


def grow(rows: DataFrame, cuts: Sequence[Sequence[float]], depth: int, trees: int = 1, min_leaf: int = 5,
         share: float = 1.0, folds: bool = False) -> DataFrame:
    """(group, model, n, trees): one row per group, and per fold left out if ``folds``.

    ``rows``: group, x (bins), y, key, and fold if ``folds``. With several trees each draws its rows by
    the key and looks at ``share`` of the features. ``trees`` is a list of (value, nodes); node 1 is the
    root, 2 i and 2 i + 1 are left and right of i.
    """
    fold = F.col("fold") if folds else F.lit(None).cast("string")
    unit = ["group", "tree"]
    base = rows.select("group", fold.alias("fold"), "x", F.col("y").cast("double").alias("y"), "key")
    if trees > 1:
        base = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        base = base.withColumn("w", _weight(_draw(F.col("key"), F.col("tree")))).where("w > 0")
    else:
        base = base.withColumn("tree", F.lit(0)).withColumn("w", F.lit(1.0))
    base = base.withColumn("region", F.lit("")).drop("key")

    # roots: the mean of all rows, or of all rows outside a fold
    sums = base.groupBy(*unit, "fold").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    total = sums.groupBy(*unit).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    if folds:
        own = sums.where("fold IS NOT NULL").select(*unit, F.col("fold").alias("model"), F.col("w").alias("ow"), F.col("s").alias("os"))
        roots = total.join(own, unit).select(*unit, "model", (F.col("w") - F.col("ow")).alias("w"), (F.col("s") - F.col("os")).alias("s"))
    else:
        roots = total.select(*unit, F.lit(None).cast("string").alias("model"), "w", "s")
    roots = materialize(roots.where("w > 0"), "roots")
    nodes = roots.select(*unit, "model", F.lit(1).alias("node"), F.lit("").alias("region"))

    levels: list[DataFrame] = []
    where = base
    for level in range(depth):
        cells = where.select(*unit, "region", "fold", "w", "y", F.posexplode("x").alias("feature", "bin"))
        if trees > 1 and share < 1:
            cells = cells.where(F.pmod(F.xxhash64("tree", "feature"), F.lit(10_000)) < int(share * 10_000))
        cells = cells.groupBy(*unit, "region", "fold", "feature", "bin").agg(
            F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
        key = [*unit, "region", "feature", "bin"]
        all_ = cells.groupBy(*key).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        mine = nodes.join(all_, [*unit, "region"])
        if folds:
            own = cells.select(*key, F.col("fold").alias("model"), F.col("w").alias("ow"), F.col("s").alias("os"))
            mine = mine.join(own, [*key, "model"], "left").withColumn("w", F.col("w") - F.coalesce("ow", F.lit(0.0))).withColumn(
                "s", F.col("s") - F.coalesce("os", F.lit(0.0))).drop("ow", "os")
        best = materialize(_picked(mine, min_leaf), "splits")
        levels.append(best)
        if level + 1 == depth:
            break
        side = lambda right: F.concat("region", F.col("feature").cast("string"), F.lit(">" if right else "<"), F.col("bin").cast("string"), F.lit(" "))
        nodes = best.select(*unit, "model", F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), side(False).alias("region")),
            F.struct((2 * F.col("node") + 1).alias("node"), side(True).alias("region")))).alias("c")).select(*unit, "model", "c.*")
        # the cuts a region was split at, by any model: rows follow each of them
        asked = broadcast_if_small(best.select(*unit, "region", "feature", "bin").distinct())
        right = F.get("x", F.col("feature")) > F.col("bin")
        where = where.join(asked, [*unit, "region"]).withColumn("region", F.when(right, side(True)).otherwise(side(False))).drop("feature", "bin")

    table = F.from_json(F.lit(json.dumps([list(map(float, c)) for c in cuts])), "array<array<double>>")
    cut = F.when(F.col("bin") == 0, F.lit(float("-inf"))).otherwise(F.get(F.get(table, F.col("feature")), F.col("bin") - 1))
    grown = None
    for best in levels:
        part = best.select(*unit, "model", F.struct("node", "feature", cut.alias("cut"), "left", "right", "gain").alias("n"))
        grown = part if grown is None else grown.unionByName(part)
    grown = grown.groupBy(*unit, "model").agg(F.collect_list("n").alias("nodes"))
    keyed = [roots[c] == grown[c] for c in unit] + [roots["model"].eqNullSafe(grown["model"])]
    whole = roots.join(grown, keyed, "left").select(
        roots["group"], roots["tree"], roots["model"], "w", (F.col("s") / F.col("w")).alias("value"),
        F.coalesce("nodes", F.array().cast(NODES)).alias("nodes"))
    slots = F.sequence(F.lit(1), F.lit((1 << depth) - 1))
    by_node = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["node"], n)))
    heap = F.transform(slots, lambda i: F.try_element_at(by_node, i))
    tree = F.struct("tree", "value", heap.alias("nodes"))
    return whole.groupBy("group", "model").agg(F.max("w").cast("long").alias("n"), F.array_sort(F.collect_list(tree)).alias("trees"))


# ---------------------------------------------------- many small groups together

def _best_splits(node: np.ndarray, nodes: int, x: np.ndarray, w: np.ndarray, wy: np.ndarray, features: Sequence[int],
                 min_leaf: float) -> dict[str, np.ndarray]:
    """Best split of each of ``nodes`` nodes from the rows' node numbers, bins and weights; gain 0 where there is none."""
    best = {"gain": np.zeros(nodes), "feature": np.zeros(nodes, np.int32), "bin": np.zeros(nodes, np.int32),
            "left": np.zeros(nodes), "right": np.zeros(nodes)}
    for f in features:
        bins = int(x[:, f].max(initial=0)) + 1
        cell = node * bins + x[:, f]
        weight = np.bincount(cell, w, nodes * bins).reshape(nodes, bins)
        lw, ls = weight.cumsum(1), np.bincount(cell, wy, nodes * bins).reshape(nodes, bins).cumsum(1)
        rw, rs = lw[:, -1:] - lw, ls[:, -1:] - ls
        fits = (lw >= min_leaf) & (rw >= min_leaf) & (weight > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, ls * ls / lw + rs * rs / rw - ls[:, -1:] * ls[:, -1:] / lw[:, -1:], 0.0)
        rounded = np.round(gain, GAIN_DECIMALS)
        at = (np.arange(nodes), rounded.argmax(1))  # the first bin among equals
        better = rounded[at] > np.round(best["gain"], GAIN_DECIMALS)
        one = tuple(i[better] for i in at)
        best["gain"][better], best["feature"][better], best["bin"][better] = gain[one], f, one[1]
        best["left"][better], best["right"][better] = ls[one] / lw[one], rs[one] / rw[one]
    return best


def _grown_block(group: np.ndarray, groups: int, x: np.ndarray, y: np.ndarray, weights: np.ndarray, looks: np.ndarray, depth: int,
                 min_leaf: float) -> dict[str, np.ndarray]:
    """Trees of all ``groups``: ``w`` and ``value`` per (group, tree); per slot of the heap feature (-1: no split), bin and the rest."""
    trees, slots = weights.shape[1], (1 << depth) - 1
    shape = (groups, trees, slots)
    out = {"w": np.zeros(shape[:2]), "value": np.zeros(shape[:2]), "feature": np.full(shape, -1, np.int32), "bin": np.zeros(shape, np.int32),
           **{c: np.zeros(shape) for c in ("left", "right", "gain")}}
    for t in range(trees):
        at = np.flatnonzero(weights[:, t])
        g, bins, w = group[at], x[at], weights[at, t].astype(float)
        wy = w * y[at]
        out["w"][:, t] = np.bincount(g, w, groups)
        with np.errstate(divide="ignore", invalid="ignore"):
            out["value"][:, t] = np.bincount(g, wy, groups) / out["w"][:, t]
        node = np.zeros(len(g), np.int64)  # slot of the heap
        for _ in range(depth):
            keys, inverse = np.unique(g * slots + node, return_inverse=True)
            best = _best_splits(inverse, len(keys), bins, w, wy, np.flatnonzero(looks[t, : x.shape[1]]).tolist(), min_leaf)
            split = best["gain"] > 0
            split &= np.round(best["gain"], GAIN_DECIMALS) > 0
            to = (keys[split] // slots, t, keys[split] % slots)
            for c, values in best.items():
                out[c][to] = values[split]
            on = split[inverse]
            g, bins, w, wy, node, mine = g[on], bins[on], w[on], wy[on], node[on], inverse[on]
            node = 2 * node + 1 + (bins[np.arange(len(g)), best["feature"][mine]] > best["bin"][mine])
    return out


def _bucket(rows: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def _grow_small(rows: DataFrame, size: int, cuts: Sequence[Sequence[float]], depth: int, trees: int, min_records: int, min_leaf: int,
                share: float) -> DataFrame:
    """(group, n, trees) of groups that fit one task, as ``grow`` makes them; ``size``: rows of all of them."""
    spark, kind = rows.sparkSession, rows.schema["group"].dataType
    one = F.transform(F.array(*[_draw(F.col("key"), F.lit(t)) for t in range(trees)]), lambda u: _weight(u).cast("tinyint"))
    one = one if trees > 1 else F.array(F.lit(1).cast("tinyint"))
    dealt = rows.select("group", "x", "y", one.alias("w"), F.pmod(F.xxhash64("group"), F.lit(_bucket(size, spark))).alias("bucket"))
    looks = np.ones((trees, len(cuts)), bool)
    if trees > 1 and share < 1 and cuts:  # trees x features flags
        seen = [F.pmod(F.xxhash64(F.lit(t), F.lit(f)), F.lit(10_000)) < int(share * 10_000) for t in range(trees) for f in range(len(cuts))]
        looks = np.array(spark.range(1).select(F.array(*seen)).first()[0]).reshape(trees, len(cuts))
    edges = [np.concatenate([[-np.inf], np.asarray(c, float)]) for c in cuts]
    schema = StructType([StructField("group", kind), *_parse_datatype_string(
        f"n long, trees array<struct<tree:int,value:double,nodes:{NODES}>>").fields])
    arrow = to_arrow_schema(schema)
    tree_type = arrow.field("trees").type.value_type
    node_type = tree_type.field("nodes").type.value_type

    def block(names: pa.Array, counts: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        grown = _grown_block(group, len(names), x, y, w, looks, depth, min_leaf)
        kept = grown["w"].ravel() > 0
        slots = (1 << depth) - 1
        flat = {c: grown[c].reshape(-1, slots)[kept].ravel() for c in ("feature", "bin", "left", "right", "gain")}
        cut = np.full(len(flat["bin"]), -np.inf)
        for f, e in enumerate(edges):
            mine = flat["feature"] == f
            cut[mine] = e[flat["bin"][mine]]
        held = int(kept.sum())
        columns = [pa.array(np.tile(np.arange(1, slots + 1, dtype=np.int32), held)), pa.array(flat["feature"]), pa.array(cut),
                   *[pa.array(flat[c]) for c in ("left", "right", "gain")]]
        nodes = pa.StructArray.from_arrays(columns, fields=list(node_type), mask=pa.array(flat["feature"] < 0))
        heaps = pa.ListArray.from_arrays(pa.array(np.arange(held + 1, dtype=np.int32) * slots), nodes)
        number = np.tile(np.arange(w.shape[1], dtype=np.int32), len(names))[kept]
        forest = pa.StructArray.from_arrays([pa.array(number), pa.array(grown["value"].ravel()[kept]), heaps], fields=list(tree_type))
        ends = np.concatenate([[0], kept.reshape(len(names), -1).sum(1).cumsum()]).astype(np.int32)
        batch = pa.RecordBatch.from_arrays([names, pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), forest)], schema=arrow)
        return batch.filter(pa.array(np.diff(ends) > 0))

    def fit(table: pa.Table) -> pa.Table:
        coded = table["group"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        x, w = (_matrix(table[c].combine_chunks())[order].astype(np.int64) for c in ("x", "w"))
        y = table["y"].to_numpy()[order]
        counts = np.bincount(code, minlength=len(coded.dictionary))
        ends = np.cumsum(counts)
        part = (ends - counts) // BLOCK_ROWS
        out = []
        for i in np.unique(part).tolist():
            of = np.flatnonzero((part == i) & (counts >= min_records))
            if len(of):
                rows = np.concatenate([np.arange(ends[j] - counts[j], ends[j]) for j in of.tolist()])
                out.append(block(coded.dictionary.take(pa.array(of)), counts[of], np.repeat(np.arange(len(of)), counts[of]), x[rows], y[rows], w[rows]))
        return pa.Table.from_batches(out, schema=arrow)

    return dealt.groupBy("bucket").applyInArrow(fit, schema)


def _score_small(df: DataFrame, size: int, models: DataFrame, group: str, features: str, depth: int, out: str) -> DataFrame:
    """``score_per_group_trees`` of groups that fit one task: rows and models meet by bucket."""
    bucket = F.pmod(F.xxhash64("_group"), F.lit(_bucket(size, df.sparkSession))).alias("_bucket")
    rows = df.withColumn("_group", F.col(group)).withColumn("_x", F.transform(features, lambda v: v.cast("double"))).select("*", bucket)
    kept = models.select(F.col(group).alias("_group"), F.col("trees").alias("_trees")).select("*", bucket)
    schema = StructType([*df.schema.fields, StructField(out, _parse_datatype_string("double"))])
    arrow, df_columns = to_arrow_schema(schema), df.columns

    def score(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not (rows.num_rows and models.num_rows):
            return arrow.empty_table()
        known = models["_group"].combine_chunks()
        model = pc.index_in(rows["_group"].combine_chunks(), value_set=known, skip_nulls=True)
        valid = pc.is_valid(model)
        rows, model = rows.filter(valid), model.filter(valid).to_numpy()
        forests = models["_trees"].combine_chunks()
        counts = np.diff(forests.offsets.to_numpy())
        first = np.cumsum(counts) - counts
        trees = forests.flatten()
        heaps = trees.field("nodes")
        begin, slots = heaps.offsets.to_numpy()[:-1], np.diff(heaps.offsets.to_numpy())
        nodes, start = heaps.values, trees.field("value").to_numpy(zero_copy_only=False)
        column = lambda c: nodes.field(c).to_numpy(zero_copy_only=False).astype(float)
        there = pc.is_valid(nodes).to_numpy(zero_copy_only=False)
        feature = np.where(there, np.nan_to_num(column("feature")), 0).astype(np.int64)
        cut, left, right = (column(c) for c in ("cut", "left", "right"))
        lists = rows["_x"].combine_chunks()
        offsets = lists.offsets.to_numpy()
        lengths = np.where(pc.is_valid(lists).to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        flat = np.append(lists.values.to_numpy(zero_copy_only=False), np.nan)
        total, n = np.zeros(len(model)), counts[model]
        for t in range(int(n.max(initial=0))):
            has = np.flatnonzero(t < n)
            tree = first[model[has]] + t
            value, slot, on = start[tree].copy(), np.zeros(len(has), np.int64), np.arange(len(has))
            for _ in range(depth):
                on = on[slot[on] < slots[tree[on]]]
                at = begin[tree[on]] + slot[on]
                on, at = on[there[at]], at[there[at]]
                f, row = feature[at], has[on]
                v = flat[np.where(f < lengths[row], offsets[:-1][row] + f, len(flat) - 1)]
                go = v > cut[at]  # NaN and null go left
                value[on], slot[on] = np.where(go, right[at], left[at]), 2 * slot[on] + 1 + go
            total[has] += value
        return pa.Table.from_arrays([*(rows[c].cast(arrow.field(c).type) for c in df_columns), pa.chunked_array([total / n])], schema=arrow)

    return rows.groupBy("_bucket").cogroup(kept.groupBy("_bucket")).applyInArrow(score, schema)


def tree_value(x: Column, tree: Column, depth: int) -> Column:
    """Value of the leaf that the features ``x`` reach."""
    def step(at: Column, _: Column) -> Column:
        n = F.get(tree["nodes"], at["node"] - 1)
        v = F.get(x, n["feature"])
        right = F.coalesce((v > n["cut"]) & ~F.isnan(v), F.lit(False))
        return F.when(n.isNull(), at).otherwise(F.struct((2 * at["node"] + right.cast("int")).alias("node"),
                                                        F.when(right, n["right"]).otherwise(n["left"]).alias("value")))

    start = F.struct(F.lit(1).alias("node"), tree["value"].alias("value"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, step)["value"]


def forest_value(x: Column, trees: Column, depth: int) -> Column:
    return F.aggregate(trees, F.lit(0.0), lambda s, t: s + tree_value(x, t, depth)) / F.size(trees)


# ----------------------------------------------------------------------- fits

def _rows(df: DataFrame, group: Column, features: str, label: str, key: Column, fold: Column | None,
          cuts: Sequence[Sequence[float]] | None, bins: int) -> tuple[DataFrame, Sequence[Sequence[float]]]:
    columns = [group.alias("group"), F.col(features).alias("v"), F.col(label).cast("double").alias("y"), key.alias("key")]
    rows = df.select(*columns, *([fold.cast("string").alias("fold")] if fold is not None else [])).where(
        F.col("group").isNotNull() & F.col("v").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y"))
    rows = materialize(rows, "training")
    cuts = feature_cuts(rows, "v", bins) if cuts is None else cuts
    return materialize(with_bins(rows, "v", cuts, "x").drop("v"), "binned"), cuts


def _key(df: DataFrame, key: str | None, trees: int) -> Column:
    if trees > 1 and key is None:
        raise ValueError("several trees need a key that fixes each row's draws")
    return F.col(key) if key else F.lit(0)


def fit_per_group_trees(df: DataFrame, group: str, features: str, label: str, depth: int = 3, trees: int = 1, key: str | None = None,
                        min_records: int = 20, min_leaf: int = 5, share: float = 1.0, bins: int = BINS,
                        cuts: Sequence[Sequence[float]] | None = None, trained: DataFrame | None = None,
                        small: int = SMALL_GROUP) -> DataFrame:
    """A tree or forest per group with enough rows: group, n, trees.

    ``n`` counts rows; groups listed in ``trained``, a table with the column ``group``, are skipped.
    ``cuts`` fixes the cuts per feature. Groups above ``small`` rows are spread over their bins.
    """
    if trained is not None:
        done = trained.select(F.col(group).alias("_done")).distinct()
        df = df.join(done, F.col(group) == F.col("_done"), "left_anti")
    rows, cuts = _rows(df, F.col(group), features, label, _key(df, key, trees), None, cuts, bins)
    counts = materialize(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    few, large = _sizes(counts, small)
    found = []
    if few:
        above = broadcast_if_small(counts.where(F.col("n") > small).select("group"))
        found.append(_grow_small(rows.join(above, "group", "left_anti") if large else rows, few, cuts, depth, trees, min_records, min_leaf, share))
    if large or not few:
        big = counts.where(F.col("n") >= min_records)
        big = big.where(F.col("n") > small) if few else big
        # the keys are broadcast: an exchange of the rows by group would bring each group into one task
        models = grow(rows.join(broadcast_if_small(big.select("group")), "group", "left_semi"), cuts, depth, trees, min_leaf, share)
        found.append(models.drop("n").join(big, "group").select("group", "n", "trees"))
    return reduce(DataFrame.unionByName, found).select(F.col("group").alias(group), "n", "trees")


def _sizes(counts: DataFrame, small: int) -> tuple[int, int]:
    """(rows of groups of up to ``small`` rows, number of larger groups) of (group, n); groups whose key is not a plain value count as large."""
    few, large = counts.agg(F.sum(F.when(F.col("n") <= small, F.col("n"))), F.count_if(F.col("n") > small)).first()
    plain = isinstance(counts.schema["group"].dataType, (IntegralType, StringType, BooleanType))
    return (few or 0, large) if plain else (0, 1)


def score_per_group_trees(df: DataFrame, models: DataFrame, group: str, features: str, depth: int = 3, out: str = "predicted",
                          small: int = SMALL_GROUP) -> DataFrame:
    """Prediction of each row by its group's model; rows of groups without one are left out."""
    counts = materialize(df.groupBy(F.col(group).alias("group")).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    few, large = _sizes(counts, small)
    found = []
    if few:
        above = broadcast_if_small(counts.where(F.col("n") > small).select(F.col("group").alias("_above")))
        held = df.join(above, F.col(group) == F.col("_above"), "left_anti") if large else df
        found.append(_score_small(held, few, models, group, features, depth, out))
    if large or not few:
        kept = models.select(F.col(group).alias("_group"), F.col("trees").alias("_trees"))
        if few:
            above = broadcast_if_small(counts.where(F.col("n") > small).select(F.col("group").alias("_above")))
            kept = kept.join(above, F.col("_group") == F.col("_above"), "left_semi")
        found.append(df.join(kept, F.col(group) == F.col("_group")).withColumn(
            out, forest_value(F.col(features), F.col("_trees"), depth)).drop("_group", "_trees"))
    return reduce(DataFrame.unionByName, found)


def fit_trees(df: DataFrame, features: str, label: str, depth: int = 3, trees: int = 1, key: str | None = None, min_leaf: int = 5,
              share: float = 1.0, bins: int = BINS, cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """One tree or forest over all rows: a table of one row (n, trees); empty without rows."""
    return fit_per_group_trees(df.withColumn("_all", F.lit(0)), "_all", features, label, depth, trees, key, 1, min_leaf, share, bins,
                               cuts).drop("_all")


def score_trees(df: DataFrame, model: DataFrame, features: str, depth: int = 3, out: str = "predicted") -> DataFrame:
    """Prediction of each row by the model of ``fit_trees``."""
    one = model.select(F.col("trees").alias("_trees"), F.lit(0).alias("_all"))  # one row
    return df.withColumn("_all", F.lit(0)).join(F.broadcast(one), "_all").withColumn(
        out, forest_value(F.col(features), F.col("_trees"), depth)).drop("_all", "_trees")


def importances(models: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, feature, importance): share of the squared error that the splits on a feature took away, over all trees."""
    nodes = models.select(*groups, F.explode("trees").alias("t")).select(*groups, F.explode("t.nodes").alias("n")).where("n IS NOT NULL")
    gains = nodes.groupBy(*groups, F.col("n.feature").alias("feature")).agg(F.sum("n.gain").alias("gain"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # at most one row per feature
    return gains.select(*groups, "feature", (F.col("gain") / F.sum("gain").over(w)).alias("importance"))


# ---------------------------------------------------------------- out of fold

def out_of_fold_trees(df: DataFrame, fold: str, features: str, label: str, depth: int = 3, trees: int = 1, key: str | None = None,
                      group: str | None = None, min_leaf: int = 5, share: float = 1.0, bins: int = BINS,
                      cuts: Sequence[Sequence[float]] | None = None, out: str = "predicted") -> DataFrame:
    """Prediction of each row by the model of all rows outside its fold (of its group, if given).

    All folds are grown together from complements. Rows without fold, group or features, and rows whose
    fold is all there is, are left out.
    """
    of = F.col(group) if group else F.lit(0)
    rows, cuts = _rows(df, of, features, label, _key(df, key, trees), F.col(fold), cuts, bins)
    models = grow(rows, cuts, depth, trees, min_leaf, share, folds=True).select(
        F.col("group").alias("_group"), F.col("model").alias("_model"), F.col("trees").alias("_trees"))
    scored = df.withColumn("_of", of).withColumn("_fold", F.col(fold).cast("string")).where(F.col(features).isNotNull())
    return scored.join(models, (F.col("_of") == F.col("_group")) & (F.col("_fold") == F.col("_model"))).withColumn(
        out, forest_value(F.col(features), F.col("_trees"), depth)).drop("_of", "_fold", "_group", "_model", "_trees")


def fold_scores(df: DataFrame, fold: str, features: str, label: str, **settings) -> DataFrame:
    """Quality per fold of the models that left it out: fold, n, r2, mae and the rest of ``regression_metrics``."""
    return regression_metrics(out_of_fold_trees(df, fold, features, label, out="_predicted", **settings), label, "_predicted", [fold])


def tag_out_scores(df: DataFrame, tag: str, features: str, label: str, **settings) -> DataFrame:
    """Rows, error and rank correlation per tag, each tag predicted from the others; tags of one row are left out."""
    scored = materialize(out_of_fold_trees(df, tag, features, label, out="_predicted", **settings).select(tag, label, "_predicted"), "tag-out")
    metrics = regression_metrics(scored, label, "_predicted", [tag]).select(tag, "mae", "r2")
    return spearman(scored, label, "_predicted", [tag]).where(F.col("n") >= 2).join(metrics, tag)


def fold_classifier(df: DataFrame, fold: str, features: str, label: str, **settings) -> DataFrame:
    """Quality of probability trees (leaf means of a 0/1 label) scored out of fold."""
    scored = out_of_fold_trees(df, fold, features, label, out="score", **settings)
    return binary_metrics(materialize(scored.select(F.col(label).alias("label"), "score"), "scores"), "label", "score")
