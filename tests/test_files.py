import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from antipode.sources import files as A
from antipode.sources import store as B
from antipode.streaming import incremental as J


def test_tsv_names_and_line_numbers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# head\nCCO\tethanol\n\nCCN\n  CCC  \n")
    rows = A.read_tsv_entities(spark, str(tmp_path / "m.tsv")).collect()
    assert {(r.structure, r.id) for r in rows} == {("CCO", "ethanol"), ("CCN", "MOL_3"), ("CCC", "MOL_4")}
    rows = A.read_tsv_entities(spark, str(tmp_path / "m.tsv"), None).collect()
    assert {(r.structure, r.id) for r in rows} == {("CCO", "ethanol"), ("CCN", None), ("CCC", None)}


def test_line_numbers_across_blocks(spark, tmp_path):
    (tmp_path / "big.tsv").write_text("".join(f"C{i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = A.read_tsv_entities(spark, str(tmp_path / "big.tsv")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r.id == "MOL_" + r.structure[1:] for r in rows)


def test_json_array_drops_unknown_keys(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"id": 1, "name": "a", "x": 2}, {"id": 3}]))
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    rows = A.read_json_records(spark, str(tmp_path / "r.json"), schema, {"odd": F.col("id") % 2 == 1}).collect()
    assert [tuple(r) for r in rows] == [(1, "a", True), (3, None, True)]


def test_vectors_are_added_once(spark, tmp_path):
    path = str(tmp_path / "v")
    v = lambda ids: spark.createDataFrame([(i, [float(i), 1.0]) for i in ids], "entity_id long, vec array<double>")
    B.append_vectors(v([1, 2]), path, 2, "p")
    B.append_vectors(v([2, 3, 3]), path, 2, "p")
    B.append_vectors(v([1]), path, 2, "q")
    assert sorted(r.entity_id for r in B.read_vectors(spark, path, 2, "p").collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        B.append_vectors(v([9]), path, 3, "p")


def test_dead_letters_and_retry(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([(1, "ok", None), (2, "bad", "why"), (3, "worse", "why")], "id long, text string, error string")
    assert [r.id for r in B.write_dead_letter(df, path).collect()] == [1]
    letters = B.read_dead_letter(spark, path)
    assert B.dead_letter_counts(letters).collect()[0].n == 2
    work = lambda d: d.withColumn("value", F.length("text")).withColumn("error", F.when(F.col("id") == 3, "still"))
    fixed, failing = J.retry_dead_letters(letters, work)
    assert [(r.id, r.value) for r in fixed.collect()] == [(2, 3)]
    assert [(r.id, r.reason, r.attempt) for r in failing.collect()] == [(3, "still", 2)]
    _, given_up = J.retry_dead_letters(failing, work, max_attempts=2)
    assert [(r.id, r.attempt) for r in given_up.collect()] == [(3, 2)]


def test_incremental_run_resumes(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    schema = "id long, x double"
    enrich = lambda d: d.select("id", (F.col("x") * 2).alias("y"), F.when(F.col("x") < 0, "negative").alias("error"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        J.incremental_enrich(spark, src, spark.createDataFrame([], schema).schema, enrich, out, str(tmp_path / "cp"), ["id"], log)
        return sorted((r.id, r.y) for r in spark.read.parquet(out).collect())

    arrive([(1, 1.0), (2, -2.0)])
    assert run() == [(1, 2.0), (2, -4.0)]
    assert run() == [(1, 2.0), (2, -4.0)]  # nothing new
    arrive([(2, 9.0), (3, 3.0)])
    assert run() == [(1, 2.0), (2, -4.0), (3, 6.0)]  # key 2 is done already
    progress = spark.read.parquet(log).orderBy("batch_no").collect()
    assert [(r.n_rows, r.n_ok, r.n_failed) for r in progress] == [(2, 1, 1), (1, 1, 0)]


def test_pending_keeps_rows_with_null_in_done(spark):
    todo = spark.createDataFrame([("a",), ("bb",), ("c",)], "k string")
    done = spark.createDataFrame([("c",), (None,)], "k string")
    assert [r.k for r in B.pending(todo, done, ["k"], "k").collect()] == ["a", "bb"]


def test_catalog_rows(spark):
    cols = "file string, formula string, space_group string, sg_number string, a string, b string, c string, alpha string, beta string, gamma string"
    rows = spark.createDataFrame([("1", "C", "P1", "1", "2.5", None, "3", None, "95", ""), ("", "C", "P1", "1", "1", "1", "1", "1", "1", "1"),
                                  ("3", "C", "P1", "1", "x", "1", "1", "1", "1", "1")], cols)
    got = A.parse_catalog_rows(rows).collect()
    assert [(r.id, r.a, r.b, r.c, r.alpha, r.beta, r.gamma) for r in got] == [("1", 2.5, 0.0, 3.0, 90.0, 95.0, 90.0)]


def test_runs_with_other_checkpoints_keep_all_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    enrich = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    out = str(tmp_path / "out")
    for name, ids in (("one", [1, 2]), ("two", [2, 3])):
        spark.createDataFrame([(i, "x") for i in ids], schema).write.parquet(str(tmp_path / name))
        J.incremental_enrich(spark, str(tmp_path / name), schema, enrich, out, str(tmp_path / f"cp_{name}"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    # a lost checkpoint reads the files again and adds nothing
    J.incremental_enrich(spark, str(tmp_path / "one"), schema, enrich, out, str(tmp_path / "cp_new"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_null_vectors_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "entity_id long, vec array<double>")
    with pytest.raises(ValueError):
        B.append_vectors(rows, str(tmp_path / "v"), 2, "p")


def test_counters_come_from_the_write(spark, tmp_path):
    """The write counts its own rows: the source is evaluated once."""
    from antipode.streaming.incremental import progress_row, write_counted

    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            reads.add(len(pdf))
            yield pdf

    rows = spark.range(100).select(F.when(F.col("id") % 4 == 0, "bad").alias("error"), "id").mapInPandas(count, "error string, id long")
    n = write_counted(rows, str(tmp_path / "t"))
    assert n == {"n_rows": 100, "n_ok": 75, "n_failed": 25} and reads.value == 100
    again = progress_row(spark.read.parquet(str(tmp_path / "t")), 3).first()
    assert (again.n_rows, again.n_ok, again.n_failed, again.batch_no) == (100, 75, 25, 3)
    nothing = write_counted(spark.read.parquet(str(tmp_path / "t")).where("false"), str(tmp_path / "none"))
    assert nothing.get("n_rows", 0) == 0


def test_batches_read_their_own_files_only(spark, tmp_path):
    """Stored rows may be unreadable: a later batch of the same run never opens them."""
    schema = spark.createDataFrame([], "id long, v string").schema
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    enrich = lambda df: df.withColumn("error", F.lit(None).cast("string"))

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        J.incremental_enrich(spark, src, schema, enrich, out, cp, ["id"])

    go([(1, "b"), (1, "a"), (None, "n"), (2, None)])
    first = {p: p.read_bytes() for p in (tmp_path / "out").rglob("*.parquet")}
    for p in first:
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        p.write_bytes(b"not parquet")
    go([(2, "x"), (3, "c"), (None, "m")])
    for p, old in first.items():
        p.write_bytes(old)
    got = sorted(((r.id, r.v) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([(1, "a"), (2, None), (None, "n"), (3, "c")], key=str)


def test_batch_repeated_after_a_crash_leaves_one_copy(spark, tmp_path):
    """The job dies after its rows are written and before the batch is committed."""
    schema = spark.createDataFrame([], "id long, v string").schema
    src, out, cp, log = (str(tmp_path / n) for n in ("src", "out", "cp", "log"))
    enrich = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    go = lambda log: J.incremental_enrich(spark, src, schema, enrich, out, cp, ["id"], log)
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    arrive([(1, "a")])
    go(log)
    arrive([(1, "z"), (2, "b"), (2, "c")])
    (tmp_path / "file").write_text("")  # no folder can be made below a file: the log fails once the rows are there
    with pytest.raises(Exception):
        go(str(tmp_path / "file" / "log"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
    arrive([(3, "d")])
    go(log)
    go(log)
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_state_of_a_new_checkpoint_starts_from_what_others_stored(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    out = str(tmp_path / "out")
    enrich = lambda df: df.withColumn("error", F.lit(None).cast("string"))

    def go(src, cp, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / src))
        J.incremental_enrich(spark, str(tmp_path / src), schema, enrich, out, str(tmp_path / cp), ["id"])

    go("a", "cp_a", [(1, "x")])
    go("b", "cp_b", [(1, "y"), (2, "y")])
    go("a", "cp_a", [(2, "z"), (3, "z")])  # run b began later than run a
    go("b", "cp_b", [(3, "w"), (4, "w")])
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "w")]


def exchanges(df):
    """Lines of the physical plan that move rows, without the scans below them."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_stored_side_is_not_moved(spark, tmp_path):
    """Look-ups and the search for what is missing move the new side only, and one entity is one bucket."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = str(tmp_path / "v")
        v = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("entity_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
        B.append_vectors(v(0, 100), path, 2, "p", buckets=16)
        B.append_vectors(v(50, 150), path, 2, "p")
        stored = B.read_vectors(spark, path, 2, "p")
        assert stored.count() == stored.select("entity_id").distinct().count() == 150
        assert B.bucket_count(stored) == 16
        wide = v(100, 300).repartition(5)
        for df, n in ((B.missing(wide, stored), 150), (B.lookup_vectors(stored, wide), 50)):
            assert exchanges(df) == 1 and df.count() == n
        assert exchanges(stored.groupBy("entity_id").count()) == 0
        one = stored.where("entity_id = 7")
        files = list((tmp_path / "v").rglob("part-*.parquet"))
        assert len(files) <= 2 * 16  # a batch writes one file per bucket
        bucket = one.select(F.input_file_name()).first()[0].rsplit("_", 1)[1]
        for f in files:  # no other bucket is opened
            if not f.name.endswith(bucket):
                f.with_name(f".{f.name}.crc").unlink()
                f.write_bytes(b"not parquet")
        assert [r.vec for r in one.collect()] == [[7.0, 1.0]]
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_store_outlives_the_session_catalog(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(1, [0.0, 1.0], "a")], "entity_id long, vec array<double>, note string")
    assert B.read_vectors(spark, path, 2, "p") is None
    B.append_vectors(rows, path, 2, "p", buckets=3)
    for t in spark.catalog.listTables():
        if t.name.startswith("vectors_"):
            spark.sql(f"DROP TABLE {t.name}")
    B.append_vectors(rows.select("note", "vec", (F.col("entity_id") + 1).alias("entity_id")), path, 2, "p")  # columns in any order
    again = B.read_vectors(spark.newSession(), path, 2, "p")
    assert sorted((r.entity_id, r.note, r.nbits, r.params_hash) for r in again.collect()) == [(1, "a", 2, "p"), (2, "a", 2, "p")]
    with pytest.raises(ValueError):
        B.append_vectors(rows.drop("note"), path, 2, "p")
