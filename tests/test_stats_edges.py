from pyspark.sql import functions as F

from antipode.functions.text import formula_tokens
from antipode.operators import stats


def test_rank_correlation_leaves_nan_out_and_keeps_the_null_group(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(g, *p) for g in ("a", None) for p in ((1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (nan, 0.0))],
                                 "g string, x double, y double")
    got = {r.g: (r.n, round(r.rho, 9)) for r in stats.spearman(rows, "x", "y", ["g"]).collect()}
    assert got == {"a": (3, 0.5), None: (3, 0.5)}


def test_baseline_counts_the_null_fold(spark):
    rows = spark.createDataFrame([("a", 1.0), (None, 3.0)], "f string, y double")
    assert stats.mean_baseline(rows, "f", "y").first().n == 2


def test_long_digit_runs(spark):
    rows = spark.createDataFrame([(1, "C12345678901 H2")], "k long, t string")
    assert {r.element: r.n for r in stats.formula_counts(rows, "k", "t").collect()} == {"C": 12345678901, "H": 2}
    assert rows.select(formula_tokens(F.col("t")).alias("x")).first().x[-2:] == ["H", "H"]


def test_formula_tokens_leaves_out_numbers_beyond_an_int(spark, tmp_path):
    import duckdb

    from antipode.plans import ORACLE, QUERIES

    texts = ["C12345678901 H2", "C99999999999999999999 C3 O2147483648 O2147483647", "N007 N", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE["formula_tokens"]).fetchall()
    got = [(r.doc_id, r.element, r.n) for r in QUERIES["formula_tokens"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert (0, "C", None) in got and (1, "C", 3) in got and (1, "O", 2147483647) in got
