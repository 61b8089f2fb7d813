import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from antipode import scale
from antipode.operators import stats as T


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, and many ties on one value."""
    rng = np.random.RandomState(7)
    n = 3000
    group = np.where(rng.rand(n) < 0.4, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.rand(n) < 0.3, 5.0, np.round(rng.randn(n) * 10, 2))
    pdf = pd.DataFrame({"id": np.arange(n), "g": group, "x": value, "y": np.round(value + rng.randn(n) * 5, 1)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_quantiles_per_group(skewed):
    pdf, df = skewed
    got = scale.exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.99}, ["g"]).toPandas().set_index("g")
    want = pdf.groupby("g")["x"].quantile([0.1, 0.5, 0.99]).unstack()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.99)):
        assert np.allclose(got[name].sort_index(), want[p].sort_index())


def test_quantiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (2.0,), (4.0,)], "x double")
    assert scale.exact_quantiles(df, "x", {"m": 0.5}).first().m == 2.0


@pytest.mark.parametrize("margin", [0.1, 0.0, -0.4])
def test_quantiles_outside_their_bracket(skewed, monkeypatch, margin):
    """Coarse sketches and brackets that are too narrow: the group is counted whole."""
    pdf, df = skewed
    monkeypatch.setattr(scale, "SKETCH_K", 8)
    monkeypatch.setattr(scale, "SMALL_GROUP", 0)
    monkeypatch.setattr(scale, "SKETCH_MARGIN", margin)
    got = scale.exact_quantiles(df, "x", {"a": 0.2, "b": 0.5, "c": 1.0}, ["g"]).toPandas().set_index("g")
    want = pdf.groupby("g")["x"].quantile([0.2, 0.5, 1.0]).unstack()
    for name, p in (("a", 0.2), ("b", 0.5), ("c", 1.0)):
        assert np.allclose(got[name].sort_index(), want[p].sort_index())
    assert scale.exact_quantiles(df, "x", {"m": 0.5}).first().m == pytest.approx(pdf.x.median())


def test_quantiles_of_a_null_group_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 7.0), ("b", None)], "g string, x double")
    assert {r.g: r.m for r in scale.exact_quantiles(df, "x", {"m": 0.5}, ["g"]).collect()} == {None: 2.0, "a": 7.0}
    assert [r.m for r in scale.exact_quantiles(df.where("false"), "x", {"m": 0.5}).collect()] in ([], [None])


def test_quantiles_read_the_source_twice(spark, tmp_path):
    """One scan for the sketches, one for the brackets."""
    spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("x")).write.parquet(str(tmp_path / "t"))
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    df = spark.read.parquet(str(tmp_path / "t")).coalesce(1).mapInPandas(count, "x double")
    assert scale.exact_quantiles(df, "x", {"m": 0.5}).first().m == 499.5
    assert reads.value == 2


def test_quantile_of_one_row(spark):
    assert scale.exact_quantiles(spark.createDataFrame([(3.0,)], "x double"), "x", {"m": 0.5}).first().m == 3.0


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_spearman_matches_pandas(skewed, groups):
    pdf, df = skewed
    got = T.spearman(df, "x", "y", groups).toPandas()
    rho = lambda part: part["x"].rank().corr(part["y"].rank())
    if not groups:
        assert got.rho[0] == pytest.approx(rho(pdf))
    else:
        want = {g: rho(part) for g, part in pdf.groupby("g")}
        assert {r.g: r.rho for r in got.itertuples()} == pytest.approx(want)


@pytest.mark.parametrize("large", [10**6, 300, 1])
def test_row_numbers_with_a_hot_group(skewed, large):
    pdf, df = skewed
    got = scale.group_row_number(df, ["g"], [F.desc("x"), F.asc("id")], "rn", large=large).toPandas()
    want = pdf.sort_values(["x", "id"], ascending=[False, True])
    want = want.assign(rn=want.groupby("g").cumcount() + 1)
    assert got.set_index("id").rn.sort_index().equals(want.set_index("id").rn.sort_index())


def test_row_numbers_with_a_null_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(20)] + [("a", i) for i in range(3)], "g string, id long")
    got = scale.group_row_number(df, ["g"], [F.asc("id")], "rn", large=5).collect()
    assert sorted((r.g or "", r.id, r.rn) for r in got) == sorted(
        [("", i, i + 1) for i in range(20)] + [("a", i, i + 1) for i in range(3)])


def test_top_per_group_limits_before_the_shuffle(skewed):
    _, df = skewed
    top = scale.top_per_group(df, ["g"], [F.desc("x"), F.asc("id")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("g").count().where("count <> 2").count() == 0


def test_auc_with_ties(spark):
    rng = np.random.RandomState(3)
    y = (rng.rand(400) < 0.4).astype(int)
    s = np.round(rng.rand(400) * 0.5 + y * 0.2, 1)
    got = T.binary_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first()
    diff = s[y == 1][:, None] - s[y == 0][None, :]
    assert got.auc == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_shared_folder_follows_the_session(spark):
    assert scale.fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_rows_of_a_task_are_bounded(spark):
    """A long table is dealt to more tasks than the shuffle width, a short one is not; numbers stay the same."""
    df = spark.range(4000).select((F.col("id") % 900).alias("g"), F.col("id").alias("v"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = scale.group_row_number(df, ["g"], [F.asc("v")], "n", task_rows=100)
    short = scale.group_row_number(df, ["g"], [F.asc("v")], "n", task_rows=4000 // width + 1)
    assert long.rdd.getNumPartitions() == 40 > width and "REPARTITION_BY_NUM" not in short._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, short.collect())) == sorted((v % 900, v, v // 900 + 1) for v in range(4000))
