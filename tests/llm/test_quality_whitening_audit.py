"""Quality scores, whitening and the filter audit against brute force, with null, empty, tied and repeated rows."""

import os
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from antipode.llm import filter_audit, quality, whitening
from antipode.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, part string, word string, failed int, x double"
LABELS = "doc_id long, quality int, toxic int"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


# -------------------------------------------------------------------- audit

def brute_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    texts = [(i, t or "", s or "") for i, t, s in rows]
    fails = []
    for i, t, _ in texts:
        w = words(t)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                      "D": bool(re.search(r"[#$%&*|]", t)),
                      "E": i is not None and any(o == t and j is not None and j < i for j, o, _ in texts)})
    out = set()
    for part in {s for _, _, s in texts}:
        mine = [(f, i in good, i in toxic) for f, (i, _, s) in zip(fails, texts) if s == part]
        taken = {}
        steps = []
        for order in permutations("ABCDE"):
            for k, letter in enumerate(order):
                before = order[:k]
                alive = [m for m in mine if not any(m[0][b] for b in before)]
                gone = [m for m in alive if m[0][letter]]
                taken[letter] = taken.get(letter, 0) + len(gone)
                steps.append((part, "".join(order), k + 1, len(alive) - len(gone), len(gone),
                              sum(m[0][letter] for m in mine) - len(gone), sum(m[0][letter] and sum(m[0].values()) == 1 for m in mine),
                              sum(m[1] for m in gone), sum(m[2] for m in gone), letter))
        out |= {(*s[:-1], taken[s[-1]]) for s in steps}
    return out


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def audited():
    rng = np.random.default_rng(3)
    say = lambda n, pool=400: " ".join(f"w{v}" for v in rng.integers(0, pool, n))
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n\x0b", None), (3, say(80, 10), "a"), (4, "LOUD " * 60, "b"), (None, "same", "b"),
            (None, "same", "b"), (5, "same", "b"), (6, "same", ""), (6, "same", "c"), (7, "x | y", "c"), (8, "größer als " * 40, "c"),
            (9, say(5000), "a"), (10, " wide　blank", "b")]
    rows += [(20 + i, say(60), "abc"[i % 3]) for i in range(20)] + [(50 + i, "one text of many copies " * 15, "a") for i in range(9)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (7, None, None)]
    return rows, labels


def test_audit_against_brute_force(spark, audited):
    rows, labels = audited
    docs = spark.createDataFrame([(i, t, s, "clash", "w", 31, 1.0) for i, t, s in rows], DOCS).repartition(4)
    got = filter_audit.audit_filters(docs, spark.createDataFrame(labels, LABELS))
    assert {tuple(r[c] for c in AUDIT) for r in got.collect()} == brute_audit(rows, labels)
    assert got.columns == list(AUDIT)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert filter_audit.audit_filters(empty, spark.createDataFrame([], LABELS)).count() == 0
    blocks, terms = filter_audit.document_term_matrix(empty)
    assert blocks.count() == terms.count() == 0


def test_audit_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    row = filter_audit.audit_filters(docs).where("filter_order = 'ABCDE' AND step = 1").first()
    assert (row.removed, row.good_lost, row.toxic_lost, row.shapley) == (1, 0, 0, 120)


def test_matrix_holds_every_word(spark, audited, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 2_000)  # several shards per task
    rows, _ = audited
    docs = spark.createDataFrame([(i, t, s, "", "", 0, 0.0) for i, t, s in rows], DOCS).repartition(3)
    blocks, terms = filter_audit.document_term_matrix(docs)
    spelled = {r.term: bytes(r.word).decode() for r in terms.collect()}
    assert sorted(spelled) == list(range(len(spelled))) and len(set(spelled.values())) == len(spelled)
    counted = []
    for b in blocks.collect():
        for k, i in enumerate(b.id):
            at = range(b.row_start[k], b.row_start[k + 1])
            assert len({b.term[j] for j in at}) == len(at)
            counted.append((i, {spelled[b.term[j]]: b.amount[j] for j in at}))
    want = []
    for i, t, _ in rows:
        found = {}
        for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""):
            found[w] = found.get(w, 0) + 1
        want.append((i, found))
    key = lambda v: (v[0] is not None, v[0] or 0, sorted(v[1].items()))
    assert sorted(counted, key=key) == sorted(want, key=key)


@tables
def test_audit_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    rel = con.execute(ORACLE["op13_filter_audit"])
    at = [[c[0] for c in rel.description].index(c) for c in AUDIT]
    want = {tuple(r[i] for i in at) for r in rel.fetchall()}
    assert {tuple(r[c] for c in AUDIT) for r in QUERIES["op13_filter_audit"](spark, SF_DIR).collect()} == want


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, label int, vec string, code string, n long"


def brute_whitening(rows, k=4):
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) and abs(c) < 2.0**54 for c in v)]
    d = max((len(v) for _, v in kept), default=0)
    kept = [(i, tuple(v + [0] * (d - len(v)))) for i, v in kept]
    fit = sorted({v for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    out = []
    for i, v in kept:
        for j in range(min(k, d)):
            e, u = values[::-1][j], vectors[:, ::-1][:, j]
            out.append((i, j + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums)),
                        abs(float((np.array(v, float) - np.array([s / n for s in sums])) @ u)) / np.sqrt(e), e / values.sum()))
    return out


def white(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "clash", "c", 9) for i, v in rows], VECTORS).repartition(3)
    return whitening.whiten(df, **settings).collect()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(12, 12)) * np.geomspace(1, 1e-2, 12)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=12) @ mix]) for i in range(300)]
    return rows + [(400, rows[0][1]), (400, rows[0][1]), (None, rows[1][1]), (401, None), (402, [1.0, None] + [0.0] * 10),
                   (403, [float("nan")] * 12), (404, [float("inf")] + [0.0] * 11), (405, [0.5, -0.25]), (406, []),
                   (407, [3e38] * 12), (408, [-0.0] * 12)]


def test_whitening_against_brute_force(spark, vectors):
    key = lambda v: (v[0] is not None, v[0] or 0, v[1])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in white(spark, vectors)), key=key)
    want = sorted(brute_whitening(vectors), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-7, atol=1e-9)


def test_whitened_covariance_is_the_identity(spark, vectors):
    rows = white(spark, vectors)
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9
    assert all((r.deviation is not None) and r.component <= 4 for r in rows)


def test_whitening_edges(spark):
    assert white(spark, []) == [] and white(spark, [(1, None)]) == [] and white(spark, [(1, []), (2, [])]) == []
    one = white(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    line = white(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in line} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float(np.float32(v)), float(np.float32(-v / 3))]) for i, v in enumerate((1e9, 2.5e9, 7e8, 3.1e9))]
    got = {(r.vec_id, r.component): r for r in white(spark, rows)}
    for i, c, n, deviation, w, e in brute_whitening(rows):
        assert got[i, c].n == n and got[i, c].deviation == (deviation if deviation < 2**63 else None)
        if c == 1:
            assert abs(abs(got[i, c].whitened) - w) < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (7, 7), (20, 20), (15, 6)):
        a = rng.normal(size=(d, rank)) * np.geomspace(1, 1e-3, rank)
        scatter = a @ a.T
        factor = whitening.pivoted_cholesky(scatter)
        np.testing.assert_allclose(factor @ factor.T, scatter, atol=1e-12 * scatter.max())
        columns = whitening.one_sided_jacobi(factor)
        gram = columns.T @ columns
        norms = np.sqrt(gram.diagonal())
        assert np.abs(gram / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13
        np.testing.assert_allclose((norms**2)[:rank], np.linalg.svd(a, compute_uv=False)[: len(norms)] ** 2, rtol=1e-6)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


# ------------------------------------------------------------------ quality

def labelled(n=600):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"{'abcdefgh'[v % 8]}{v:x}"[:6].replace("0", "o") for v in rng.integers(0, 5000, int(rng.integers(5, 120)))]
        bad = i % 4 == 0
        text = " ".join(w + "###" if bad and i % 8 else w for w in words)
        rows.append((i, " ".join(words[:5] * 10) if bad and i % 8 == 0 else text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def quality_of(spark, rows, labels, train=lambda f: f, **settings):
    docs = spark.createDataFrame([(i, t, "s", "p", "w", 0, 1.0) for i, t in rows], DOCS).repartition(3)
    features = quality.measured_once(docs)
    model = quality.fit(train(features), spark.createDataFrame(labels, LABELS), **settings)
    return model, quality.score(features, model).collect()


def test_quality_separates_held_out_rows(spark):
    rows, labels = labelled()
    model, got = quality_of(spark, rows, labels, lambda f: f.where("id % 3 != 1"))
    held = [(r.predicted, labels[r.id][1]) for r in got if r.id % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_edges(spark):
    rows, labels = labelled(200)
    rows += [(900, None), (901, ""), (902, " \n\t"), (None, "text"), (903, "x" * 200_000), (0, rows[0][1]), (904, "日本語")]
    labels += [(None, 1, 0), (5, None, 1), (7, 9, 0), (8, 1, 0), (8, 0, 0)]
    _, got = quality_of(spark, rows, labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r.score for r in got}
    assert by[900] == by[901] and len({r.score for r in got if r.id == 0}) == 1
    assert quality_of(spark, [], labels)[1] == []
    for some, share in (([], 0.5), ([x for x in labels if x[1] == 1], None)):
        _, got = quality_of(spark, rows, some)
        assert len({r.score for r in got}) == 1 and (share is None or got[0].score == share)


def test_quality_bound_on_fitted_rows(spark):
    rows, labels = labelled(300)
    _, got = quality_of(spark, rows, labels, max_rows=150)
    assert np.mean([r.predicted == labels[r.id][1] for r in got]) > 0.9


def test_model_is_a_sum_of_tables():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    x[::50, 2] = np.nan
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # an interaction no single feature shows
    model = quality.fit_model(x, y)
    p = model.score(x)
    assert np.mean((p >= 0.5) == y) > 0.9 and (0, 1) in model.pairs
    fine, coarse = quality._bins(x, model.edges), quality._bins(x, model.pair_edges)
    for i in range(0, 3000, 311):
        total = model.intercept + sum(t[fine[i, f]] for f, t in enumerate(model.tables))
        total += sum(t[coarse[i, a], coarse[i, b]] for (a, b), t in model.pairs.items())
        assert abs(1 / (1 + np.exp(-total)) - p[i]) < 1e-12


def test_trees_equal_a_search_over_all_cuts():
    rng = np.random.default_rng(9)
    g, h, n = rng.normal(size=9) * 20, rng.uniform(5, 9, 9), np.full(9, 30.0)
    loss = lambda cuts: -sum(g[a:b].sum() ** 2 / (h[a:b].sum() + quality.SMOOTH) for a, b in zip([0, *cuts], [*cuts, 9]))
    best = min(range(1, 9), key=lambda c: loss([c]))
    assert quality._cut(g, h, n) == best
    g2, h2, n2 = rng.normal(size=(5, 6)), rng.uniform(1, 2, (5, 6)), np.full((5, 6), 30.0)
    cells = {(i, j): sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + quality.SMOOTH)
                         for a in (slice(0, i + 1), slice(i + 1, 5)) for b in (slice(0, j + 1), slice(j + 1, 6)))
             for i in range(4) for j in range(5)}
    gain, leaf = quality._pair_tree(g2, h2, n2)
    assert abs(gain - (max(cells.values()) - g2.sum() ** 2 / (h2.sum() + quality.SMOOTH))) < 1e-9 and leaf.shape == (5, 6)


@tables
def test_quality_query_on_held_out_documents(spark):
    got = QUERIES["op11_quality"](spark, SF_DIR)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality IS NOT NULL")
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.9


@tables
def test_whitening_query_covers_the_table(spark):
    got = QUERIES["op12_whitening"](spark, SF_DIR)
    n = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    assert got.count() == 4 * n


def test_shards_get_their_terms_one_at_a_time(spark, monkeypatch):
    """Shards of a few documents: terms of the matrix spell the words of each."""
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 40)
    texts = {i: " ".join(f"w{(i * j) % 17}" for j in range(i % 9)) for i in range(60)}
    docs = spark.createDataFrame([*texts.items(), (60, None)], "doc_id long, text string").repartition(3)
    blocks, dictionary = filter_audit.document_term_matrix(docs)
    assert "FlatMapCoGroupsInArrow" in blocks._jdf.queryExecution().optimizedPlan().toString()
    word = {r.term: bytes(r.word).decode() for r in dictionary.collect()}
    found = {}
    for b in blocks.collect():
        for i, doc in enumerate(b.id):
            at = slice(b.row_start[i], b.row_start[i + 1])
            found[doc] = sorted(zip((word[t] for t in b.term[at]), b.amount[at]))
    split = {i: (t or "").split() for i, t in {**texts, 60: None}.items()}
    assert found == {i: sorted((w, t.count(w)) for w in set(t)) for i, t in split.items()}


def test_row_sums_come_with_the_block(spark):
    """The entries of a block are not sent to another worker to be counted."""
    docs = spark.createDataFrame([(1, "a b a", "s"), (2, None, None), (None, "c", "s")], "doc_id long, text string, source string")
    counts = filter_audit.row_counts(filter_audit.document_term_matrix(docs, part_col="source")[0])
    assert "MapInArrow" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.part, r.words, r.distinct_words) for r in counts.collect()} == {(1, "s", 3, 2), (2, None, 0, 0), (None, "s", 1, 1)}


def test_memory_of_the_audit_follows_rows_not_the_table(spark, monkeypatch):
    """A file of many shards is read shard by shard, and texts reach a worker some bytes at a time."""
    import glob

    import pyarrow.parquet as pq

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(filter_audit, "SHARD_BYTES", 500)
    monkeypatch.setattr(filter_audit, "BATCH_BYTES", 2_000)
    before, seen, store = spark.conf.get(name), [], filter_audit._stored_apart

    def stored(df, what):
        out = store(df, what)
        seen.extend((f, spark.conf.get(name)) for f in out.inputFiles())
        return out

    monkeypatch.setattr(filter_audit, "_stored_apart", stored)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(300)], "doc_id long, text string").coalesce(1)
    blocks, _ = filter_audit.document_term_matrix(docs)
    assert sum(len(b.id) for b in blocks.collect()) == 300
    files = [p for f, _ in seen for p in glob.glob(f.removeprefix("file://"))]
    groups = [m.row_group(i).num_rows for m in (pq.ParquetFile(f).metadata for f in files) for i in range(m.num_row_groups)]
    assert set(groups) == {1} and len(groups) >= 10  # shards end at batches, so batches were small too
    assert {c for _, c in seen} == {"2000"} and spark.conf.get(name) == before
