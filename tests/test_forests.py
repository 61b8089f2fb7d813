import numpy as np
import pytest
from pyspark.sql import functions as F

from antipode.operators import forests as T

ROW = "id long, g string, x array<double>, y double, tag string"


def exact_tree(x, y, depth, min_leaf):
    """The best splits by trying every value of every feature: {node: (feature, cut, left mean, right mean)}."""
    out = {}

    def split(at, node, level):
        best = None
        for f in range(x.shape[1]):
            v = np.where(np.isnan(x[at, f]), -np.inf, x[at, f])
            for cut in np.unique(v)[:-1]:
                left = v <= cut
                if left.sum() < min_leaf or (~left).sum() < min_leaf:
                    continue
                gain = y[at][left].sum() ** 2 / left.sum() + y[at][~left].sum() ** 2 / (~left).sum() - y[at].sum() ** 2 / len(at)
                key = (round(gain, 8), -f, -cut)
                if round(gain, 8) > 0 and (best is None or key > best[0]):
                    best = (key, f, cut, at[left], at[~left])
        if best and level < depth:
            _, f, cut, a, b = best
            out[node] = (f, cut, y[a].mean(), y[b].mean())
            split(a, 2 * node, level + 1)
            split(b, 2 * node + 1, level + 1)

    split(np.arange(len(y)), 1, 0)
    return out


def exact_value(tree, mean, v):
    node, value = 1, mean
    while node in tree:
        f, cut, left, right = tree[node]
        go = not np.isnan(v[f]) and v[f] > cut
        node, value = 2 * node + go, right if go else left
    return value


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 500
    x = np.round(rng.normal(size=(n, 3)), 1).clip(-1.2, 1.2)
    x[::37, 1] = np.nan
    y = np.round(np.where(x[:, 0] > 0.3, 2.0, -1.0) * (x[:, 2] > 0) + 0.3 * rng.normal(size=n) + x[:, 0], 6)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcd"), n))
    g[:6] = "few"
    tag = rng.choice(["t1", "t2", "t3"], n)
    return x, y, g, tag


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y, g, tag = data
    rows = [(i, str(g[i]), [None if np.isnan(v) else float(v) for v in x[i]], float(y[i]), str(tag[i])) for i in range(len(y))]
    rows += [(900, None, [0.0] * 3, 1.0, "t1"), (901, "a", None, 1.0, "t1"), (902, "a", [0.0] * 3, None, "t2")]
    return spark.createDataFrame(rows, ROW).repartition(5)


def nodes_of(tree):
    return {n.node: (n.feature, n.cut, n.left, n.right) for n in tree.nodes if n is not None}


@pytest.mark.parametrize("depth", [1, 3])
def test_group_trees_equal_exact_splits(frame, data, depth):
    x, y, g, _ = data
    models = {r.g: r for r in T.fit_per_group_trees(frame, "g", "x", "y", depth=depth, min_leaf=4).collect()}
    assert set(models) == {"hot", "a", "b", "c", "d"}
    for name, m in models.items():
        at = g == name
        want = exact_tree(x[at], y[at], depth, 4)
        got = nodes_of(m.trees[0])
        assert m.n == at.sum() and set(got) == set(want)
        for node in want:
            assert got[node] == pytest.approx(want[node])
        assert len(m.trees[0].nodes) == 2**depth - 1


def test_scores_follow_the_trees(frame, data):
    x, y, g, _ = data
    models = T.fit_per_group_trees(frame, "g", "x", "y", depth=2, min_leaf=4)
    got = {r.id: r.predicted for r in T.score_per_group_trees(frame, models, "g", "x", depth=2).collect()}
    trees = {name: exact_tree(x[g == name], y[g == name], 2, 4) for name in "abcd"}
    for i in np.flatnonzero(np.isin(g, list("abcd"))):
        assert got[int(i)] == pytest.approx(exact_value(trees[g[i]], y[g == g[i]].mean(), x[i]))
    assert 900 not in got and 0 not in got  # no group; too few rows


def test_trained_groups_are_skipped(frame):
    first = T.fit_per_group_trees(frame.where("g IN ('a', 'b')"), "g", "x", "y", depth=1)
    rest = T.fit_per_group_trees(frame, "g", "x", "y", depth=1, trained=first)
    assert {r.g for r in rest.collect()} == {"hot", "c", "d"}


@pytest.mark.parametrize("depth", [1, 3])
def test_out_of_fold_equals_a_fit_per_fold(frame, data, depth):
    x, y, _, tag = data
    got = {r.id: r.predicted for r in T.out_of_fold_trees(frame.where("id < 900"), "tag", "x", "y", depth=depth, min_leaf=4).collect()}
    assert len(got) == len(y)
    for t in np.unique(tag):
        rest = tag != t
        tree = exact_tree(x[rest], y[rest], depth, 4)
        for i in np.flatnonzero(~rest):
            assert got[int(i)] == pytest.approx(exact_value(tree, y[rest].mean(), x[i]))


def test_out_of_fold_within_groups(frame, data):
    x, y, g, tag = data
    got = {r.id: r.predicted for r in T.out_of_fold_trees(frame, "tag", "x", "y", depth=2, min_leaf=4, group="g").collect()}
    for name in ("hot", "a"):
        for t in np.unique(tag):
            rest, own = (g == name) & (tag != t), (g == name) & (tag == t)
            tree = exact_tree(x[rest], y[rest], 2, 4)
            for i in np.flatnonzero(own)[:20]:
                assert got[int(i)] == pytest.approx(exact_value(tree, y[rest].mean(), x[i]))


def test_rows_without_fold_train_but_are_not_scored(spark):
    rows = [(i, "g", [float(i % 7)], float(i % 7 > 3), "a" if i < 20 else None) for i in range(60)]
    got = T.out_of_fold_trees(spark.createDataFrame(rows, ROW), "tag", "x", "y", depth=1, min_leaf=2).collect()
    assert sorted(r.id for r in got) == list(range(20)) and all(r.predicted == r.y for r in got)
    alone = spark.createDataFrame([(i, "g", [1.0], 1.0, "a") for i in range(5)], ROW)
    assert T.out_of_fold_trees(alone, "tag", "x", "y", depth=1).count() == 0


def test_forest_is_stable_and_better_than_its_mean(frame, data):
    x, y, g, _ = data
    settings = dict(depth=3, trees=12, key="id", share=0.8, min_leaf=3)
    models = T.fit_per_group_trees(frame, "g", "x", "y", **settings)
    first = {r.g: r.trees for r in models.collect()}
    again = {r.g: r.trees for r in T.fit_per_group_trees(frame.repartition(3), "g", "x", "y", **settings).collect()}
    assert set(first) == set(again)
    shape = lambda trees: [(t.tree, n.node, n.feature, n.cut) for t in trees for n in t.nodes if n is not None]
    for name in first:
        assert len(first[name]) == 12 and shape(first[name]) == shape(again[name])
        assert len({str(nodes_of(t)) for t in first[name]}) > 6
    scored = T.score_per_group_trees(frame.where("y IS NOT NULL"), models, "g", "x", depth=3).select("g", "y", "predicted").toPandas()
    hot = scored[scored.g == "hot"]
    assert ((hot.y - hot.predicted) ** 2).mean() < 0.4 * hot.y.var()
    with pytest.raises(ValueError):
        T.fit_per_group_trees(frame, "g", "x", "y", trees=2)


def test_one_tree_over_all_rows(spark, frame, data):
    x, y, _, _ = data
    rows = frame.where("id < 900")
    model = T.fit_trees(rows, "x", "y", depth=2, min_leaf=4)
    tree = exact_tree(x, y, 2, 4)
    got = {r.id: r.predicted for r in T.score_trees(rows, model, "x", depth=2).collect()}
    assert all(got[i] == pytest.approx(exact_value(tree, y.mean(), x[i])) for i in range(0, len(y), 7))
    share = {r.feature: r.importance for r in T.importances(model).collect()}
    assert sum(share.values()) == pytest.approx(1.0) and set(share) == {f for f, *_ in tree.values()}
    nothing = spark.createDataFrame([], ROW)
    assert T.fit_trees(nothing, "x", "y").count() == 0
    assert T.score_trees(rows, T.fit_trees(nothing, "x", "y"), "x").count() == 0


def test_constant_label_has_no_split(spark):
    rows = spark.createDataFrame([(i, "g", [float(i)], 2.5, "a") for i in range(30)], ROW)
    m = T.fit_per_group_trees(rows, "g", "x", "y", depth=2).first()
    assert nodes_of(m.trees[0]) == {} and m.trees[0].value == 2.5
    assert T.score_per_group_trees(rows, T.fit_per_group_trees(rows, "g", "x", "y", depth=2), "g", "x", 2).select(
        F.sum("predicted")).first()[0] == 75.0


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, "g", [float(v), 1.0], float(v > 0.25), "a") for i, v in enumerate(rng.random(4000))], ROW)
    cuts = T.feature_cuts(rows, "x", bins=16)
    assert len(cuts[0]) == 16 and cuts[0] == sorted(cuts[0]) and cuts[1] == [1.0]
    tree = T.fit_trees(rows, "x", "y", depth=1, bins=16).first().trees[0]
    assert abs(tree.nodes[0].cut - 0.25) < 0.07


def test_classifier_and_tag_scores(frame):
    rows = frame.where("id < 900").withColumn("label", (F.col("y") > 0).cast("double"))
    m = T.fold_classifier(rows, "tag", "x", "label", depth=2).first()
    assert m.n == 500 and m.auc > 0.85
    s = {r.tag: r for r in T.tag_out_scores(rows, "tag", "x", "y", depth=2).collect()}
    assert set(s) == {"t1", "t2", "t3"} and all(r.rho > 0.5 for r in s.values())
    f = T.fold_scores(rows, "tag", "x", "y", depth=2).collect()
    assert sum(r.n for r in f) == 500 and all(r.r2 > 0.4 for r in f)


@pytest.mark.parametrize("trees", [1, 5])
def test_small_groups_grow_and_score_as_large_ones(frame, trees):
    """All groups in buckets, all spread over their bins, and some of each give the same trees and predictions."""
    settings = {"depth": 3, "trees": trees, "key": "id", "share": 0.7 if trees > 1 else 1.0, "min_leaf": 4}
    got = []
    for small in (0, 60, 100_000):
        models = T.fit_per_group_trees(frame, "g", "x", "y", small=small, **settings)
        kept = {r.g: (r.n, r.trees) for r in models.collect()}
        scored = {r.id: r.predicted for r in T.score_per_group_trees(frame, models, "g", "x", 3, small=small).collect()}
        got.append((kept, scored))
    for kept, scored in got[1:]:
        assert {g: n for g, (n, _) in kept.items()} == {g: n for g, (n, _) in got[0][0].items()} and "few" not in kept
        for g, (_, forest) in kept.items():
            for a, b in zip(forest, got[0][0][g][1], strict=True):
                assert a.tree == b.tree and a.value == pytest.approx(b.value)
                for m, n in zip(a.nodes, b.nodes, strict=True):
                    assert (m is None) == (n is None)
                    assert m is None or tuple(m)[:3] == tuple(n)[:3] and tuple(m)[3:] == pytest.approx(tuple(n)[3:])
        assert scored == pytest.approx(got[0][1])


def test_rows_of_one_group_are_not_exchanged_by_it(spark, frame):
    """All rows as one large group: no exchange brings them together in one task."""
    seen = []
    grow = T.grow
    T.grow = lambda rows, *a: seen.append(rows) or grow(rows, *a)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        T.fit_per_group_trees(frame.withColumn("one", F.lit(0)), "one", "x", "y", depth=1, small=10)
    finally:
        T.grow = grow
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in seen[0]._jdf.queryExecution().executedPlan().toString()
