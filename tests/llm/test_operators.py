"""Operators and queries against brute force, with null, empty, long, tied and repeated rows."""

import hashlib
import os

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from antipode.llm import (embedding_dups, fingerprints, language, line_dedup, minhash, mixing, packing, page_text, repeats,
                          token_files)
from antipode.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies int, rank string"
tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables not present")


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta,", "gamma.", "delta", "épsilon", "zeta!", "eta", "Theta", "<|endoftext|>", "it's"]
    say = lambda n: " ".join(rng.choice(words, n))
    shared = say(40)
    texts = [None, "", " \t\n", "x", "one two", "...", shared, shared, shared + " tail", "head " + shared, say(3000),
             "a" * 350, "a" * 350, "line that is quite long enough\nb", "LINE that is quite long enough \nc",
             "c\n  line that is quite long enough", "日本語 テキスト。" * 20] + [
                 "\n".join(say(12) for _ in range(6)) for _ in range(12)]
    texts += [texts[-1].replace("eta", "iota", 1), texts[-2]]
    return dict(enumerate(texts))


def frame(spark, docs, extra=()):
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None, 7, "z") for i, t in docs.items()]
    return spark.createDataFrame(rows + list(extra), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return frame(spark, small).repartition(5)


def test_minhash_components(spark, docs, small):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=3, percent=85).collect()}
    assert got == brute.near_docs(small, 3, 85)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_chain_and_groups(spark):
    base = [f"w{i}" for i in range(200)]
    docs = {k: " ".join(base[:200 - k] + [f"n{k}_{j}" for j in range(k)]) for k in range(0, 60, 2)}
    docs |= {1000 + k: docs[k] for k in (0, 2, 4)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), width=3, percent=85).collect()}
    assert got == brute.near_docs(docs, 3, 85)


def test_minhash_border_pairs(spark):
    # pairs exactly at 0.8 with 28 or 29 equal coordinates of 48
    docs = {}
    for seed in (107, 2568, 3671):
        w = [f"v{seed}x{j}" for j in range(104)]
        docs |= {seed: " ".join(w[:94]), seed + 10_000: " ".join(w[:84] + w[94:])}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute.near_docs(docs, 5, 80)
    assert got[10_107] == (90, 107)


def test_match_threshold():
    assert [minhash.match_threshold(p) for p in (80, 85)] == [24, 27]
    assert minhash.match_threshold(1) == 1 and minhash.match_threshold(100) == 48


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    rows = [(i, (base[i % 6] * (1 + i) + rng.standard_normal(16) * 0.13 * np.abs(1 + i) * (i % 3)).tolist(), i % 2) for i in range(90)]
    rows += [(90, rows[0][1], 0), (91, None, 0), (92, [0.0] * 16, 0), (93, [float("nan")] * 16, 0), (94, rows[0][1], None),
             (95, [None] + rows[0][1][1:], 0), (96, [1.0, 2.0], 0), (97, [2.0, 4.0], 0), (98, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block, tile in ((16, 5), (8192, 16)):  # many blocks, and one block of many tiles
        found = embedding_dups.near_duplicate_vectors(table, block=block, tile=tile)
        assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == brute.near_vectors(rows, 0.93)
    assert embedding_dups.near_duplicate_vectors(table.limit(0)).count() == 0
    assert 0 < embedding_dups.calibrated_count() <= embedding_dups.PROJECTIONS


def test_repeats(spark, docs, small):
    small = {k: t for k, t in small.items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == brute.repeated_bytes(small)
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_around_shared_passages(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage = word(260)
    docs = {i: word(int(rng.integers(0, 150))) + passage[int(rng.integers(0, 60)):260 - int(rng.integers(0, 60))] + word(30)
            for i in range(60)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           repeats.remove_repeats(frame(spark, docs).repartition(7)).collect()}
    assert got == brute.repeated_bytes(docs)


def test_repeats_tell_regions_of_one_anchor_apart(spark):
    # pairs of heads whose regions agree in the anchor, both sides and 32 bits of the content hash, but are different
    passage = ("hugdbzxdkmburvmmkbpwuzpvxisreiaoyhmwmwdifukvgqffofcablgywfdvdthqyrytzjtfqodhwiiljffdwlxnvplbrrbepzmq"
               "mhzbwwidmxamytuvkkgitprtqltmenaszypqcvwvvjooflzczwfpdksjfecyhxtocqxvvumwavzofljg")
    heads = ["lzkxwzwkkvaxezbfpukdozywofrkljwrojhciaea", "qstjrkdsytpcwdjfwmtyjafkxqscxdajeqdqbotz",
             "nygseijqtjrinakemxjopvfpsvxdgkgeudhbbxdp", "tfftcztmkptpxdkphcixkossaovqhsdyybdzwacl",
             "blpmbnwmscvpplmivkvxmodkcncwlaletwkjabfq", "zaltjvtldzkaoyvvfantwtptavojoyhtjrytnapt"]
    rng = np.random.default_rng(4)
    tails = ["".join(chr(97 + x) for x in rng.integers(0, 26, 9000)) for _ in heads]
    pairs = {i: h + passage + t for i, (h, t) in enumerate(zip(heads, tails, strict=True))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           repeats.remove_repeats(frame(spark, pairs)).collect()}
    assert got == brute.repeated_bytes(pairs)


def test_fingerprints(spark, docs, small):
    rows = {r.doc_id: r for r in fingerprints.fingerprint_versions(docs).collect()}
    edits = brute.edited(small)
    order = sorted(small, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        assert rows[i].edited_sha256 == hashlib.sha256(edits[i].encode()).hexdigest()
        assert rows[i].near_edited == pytest.approx(brute.alike(small[i], edits[i])), i
        assert rows[i].near_next == pytest.approx(brute.alike(small[i], small[order[(k + 1) % len(order)]]))
        assert prints.setdefault(small[i], rows[i].fingerprint) == rows[i].fingerprint
        assert prints.setdefault(edits[i], rows[i].edited_fingerprint) == rows[i].edited_fingerprint
    assert fingerprints.fingerprint_versions(empty(spark)).count() == 0
    assert fingerprints.fingerprint_versions(frame(spark, {1: "a. b."}, [(1, "a. b.", None, None, None, 1, "")])).count() == 2


def test_fingerprints_are_not_exchanged(spark, docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fingerprints.fingerprint_versions(docs)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    below = lambda i: next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
    printed = [i for i, line in enumerate(plan) if "collect_list" in line]
    assert printed and not any("Exchange" in line and i < k < below(i) for i, line in enumerate(plan) for k in printed)


def test_retried_fingerprints_stay_where_they_are(spark, docs, monkeypatch):
    before, plans = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []

    def keep(df, column, *rest, stored=fingerprints.bucketed):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, column, *rest)
    monkeypatch.setattr(fingerprints, "bucketed", keep)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert fingerprints.fingerprint_versions(docs).select("near_next").where("near_next > 1").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    retries = plans[2:]
    assert retries and not any("Exchange" in p for p in retries)


def test_fingerprints_settle_near_versions_and_retry(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    line = " ".join(word() for _ in range(400))
    many = " ".join(f"{word()} {word()}." for _ in range(300))
    hanzi = lambda n: "".join(chr(0x4E00 + k) for k in rng.integers(0, 5000, n))
    cjk = "。".join(hanzi(9) for _ in range(80))
    texts = {9: line, 8: "x. y.", 7: cjk, 6: many, 5: hanzi(900) + "\U0001F600" * 3, 4: many + " and one more.", 3: None, 2: "é" * 500}
    writes = []
    monkeypatch.setattr(fingerprints, "bucketed", lambda *a, keep=fingerprints.bucketed: writes.append(a) or keep(*a))
    rows = {r.doc_id: r for r in fingerprints.fingerprint_versions(frame(spark, texts, [(None, "z.", None, None, None, 1, "")])).collect()}
    assert len(writes) > 2 and None in rows  # long beside short: more differs than the narrower print holds
    order, edits = sorted(texts, reverse=True), brute.edited({**texts, -1: "z."})
    settled = 0
    for k, i in enumerate(order):
        after = texts[order[k + 1]] if k + 1 < len(order) else "z."
        assert rows[i].near_edited == pytest.approx(brute.alike(texts[i], edits[i]))
        assert rows[i].near_next == pytest.approx(brute.alike(texts[i], after))
        got = brute.alike_by_prints(rows[i].fingerprint, rows[i].edited_fingerprint)
        settled += got is not None
        assert got is None or got == pytest.approx(rows[i].near_edited)
    assert settled >= 6
    assert min(rows[i].near_edited for i in (9, 7, 5, 6)) > 0.2  # one line, CJK marks, no mark at all


def test_line_dedup(spark, docs, small):
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[13].kept_text == "b" and out[14].kept_text == "c" and out[15].kept_text == small[15]
    assert (out[0].n_lines, out[0].n_dropped, out[0].kept_text) == (1, 0, "")
    assert "rank" in line_dedup.dedup_lines(docs).columns
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_runs_compact(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5):
        rows = spark.createDataFrame([(1, 1, 1, i), (i + 10, 0, 1, i)], "h1 long, h2 long, docs long, keeper long")
        run = index.add(rows)
        # a known hash takes over its count and keeper, a new one starts from nothing
        assert {(r.h1, r.docs, r.keeper) for r in run.collect()} == {(1, i + 1, i), (i + 10, 1, i)}
    assert [len(level) for level in index.levels] == [1, 0, 1]
    assert {(r.h1, r.docs, r.keeper) for r in index.entries().where("h1 = 1").collect()} == {(1, 5, 4)}


def test_mix(spark, docs):
    rows = mixing.mix_copies(docs).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_copies(docs.repartition(3)).collect()), key=str)
    by = {}
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    total = sum(v[2] for v in by.values())
    assert sum(v[0] for v in by.values()) == pytest.approx(total)
    assert all(v[0] <= 3 * v[2] + 1e-9 for v in by.values())
    assert mixing.mix_copies(empty(spark)).count() == 0


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    docs = {i: " ".join(["w"] * int(rng.integers(1, 80))) for i in range(900)}
    rows = mixing.mix_copies(frame(spark, docs)).collect()
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3 * 80


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1001)
    raw = token_files.pack_bits(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (token_files.unpack_bits(raw, bits, 1001) == ids).all()
    assert (token_files.unpack_bits(raw, bits, 77, 513) == ids[513:590]).all()


def test_token_files(spark, docs, small, tmp_path):
    path = str(tmp_path / "blocks")
    token_files.write_token_blocks(docs, path, block_ids=64)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, path).collect()}
    at = 0
    for i in sorted(small):
        ids = brute.tokens([small[i]], 2)[0]
        assert got[i] == (at, len(ids), brute.crc(ids))
        at += len(ids)
    assert (token_files.load_document(spark, path, 10) == brute.tokens([small[10]], 2)[0]).all()
    token_files.write_token_blocks(empty(spark), str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_packing(spark, docs, small):
    rows = packing.pack_documents(docs).collect()
    ids = dict(zip(small, brute.tokens(small.values(), 1), strict=True))
    seen = {i: np.zeros(len(x), int) for i, x in ids.items()}
    packs = {}
    for r in rows:
        assert brute.crc(ids[r.doc_id][r.start:r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id][r.start:r.start + r.length] += 1
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((x == 1).all() for x in seen.values())
    for p in packs.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(spark)).count() == 0


def test_shortest_pack_first():
    histogram = {5: 3, 3: 2, 2: 4, 1: 7}
    packs = packing.pack_histogram(histogram, 8)
    assert all(sum(p) <= 8 for p, _ in packs)
    used = {x: sum(p.count(x) * n for p, n in packs) for x in histogram}
    assert used == histogram and sum(n for _, n in packs) == 5
    with pytest.raises(ValueError):
        packing.pack_histogram({9: 1}, 8)


def test_language_mixture(spark):
    rng = np.random.default_rng(0)
    make = lambda syll, n: " ".join("".join(rng.choice(syll, 3)) for _ in range(n))
    syll = {"aa": ["ba", "lo", "mi"], "bb": ["tru", "ske", "vop"]}
    rows = [(i, make(syll[k], 60), k) for i, k in enumerate(["aa", "bb"] * 20)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]
    assert model.predict(make(syll["aa"], 40))[0] == "aa" and model.predict(make(syll["bb"], 5))[0] == "bb"
    a, b = make(syll["aa"], 400), make(syll["bb"], 200)
    both = model.predict(a + " " + b)
    assert both[0] == "aa" and set(both[2]) == {"aa", "bb"}
    assert both[2]["aa"] == pytest.approx(len(a) / (len(a) + len(b)), abs=0.05)  # shares of trigrams
    for text in (None, "", "123 ... ²"):
        assert model.predict(text)[:2] == ("und", 0.0)
    assert language.fit(spark.createDataFrame([], "text string, lang string")).predict("abc")[0] == "und"


def test_page_text():
    page = ("<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a href=x>Home</a></nav>"
            "<div class='cookie-notice'>We use cookies</div><article><h1>Title &amp; more</h1><p>First   text<br>goes"
            "<p>Second <b>bold</b> one.<ul><li>item</li></ul><div id='comments'><p>Reader says</p></div></article>"
            "<aside>side</aside><footer>&copy; foot</footer>")
    assert page_text.main_text(page) == "Title & more\n\nFirst text goes\n\nSecond bold one.\n\nitem"
    plain = "<body><div class=menu>m</div><div>" + "long text of the page " * 9 + "</div><div>Short end of it.</div></body>"
    assert page_text.main_text(plain).startswith("long text") and "m\n" not in page_text.main_text(plain)
    assert page_text.main_text(None) == page_text.main_text("") == page_text.main_text("<p></p>") == ""


def test_page_text_keeps_what_furniture_holds():
    say = "Running text of the page that goes on for a while, word after word. " * 4
    body = f"<h1>Title</h1><p>{say}</p><p>{say}</p>"
    menu = "<div class='menu'><a href=x>Home</a> <a href=y>News</a></div>"
    want = f"Title\n\n{say.strip()}\n\n{say.strip()}"
    for around in ("<div class='layout has-sidebar'>", "<div class='sidebar widget'>", "<form>", "<aside>",
                   "<div role='dialog'>", "<noscript>"):
        end = around[1:].split(" ")[0].strip(">")
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            assert page_text.main_text(f"<body>{menu}{around}{inner}</{end}></body>") == want
    assert page_text.main_text(f"<article><div id='content-header'><h1>Title</h1></div><p>{say}<p>{say}</article>") == want
    assert "x = 2" in page_text.main_text(f"<article><p>{say}</p><p>So <math><mi>x</mi> = 2</math> holds.</p></article>")
    # furniture inside of it, and furniture that holds little, still go
    side = "<div class='sidebar'><p>Side words.</p></div>"
    assert page_text.main_text(f"<body><form>{menu}{side}<article>{body}{side}</article></form>{side}</body>") == want
    assert page_text.main_text(f"<head><title>t</title></head><body>{side}{body}{side}<footer>foot</footer>") == want


def test_page_text_keeps_every_article_and_both_ends():
    long, short = "Long text of the first article that goes on and on. " * 30, "A short one."
    got = page_text.main_text(f"<article><p>{long}</p></article>" + "<div><a href=x>link</a></div>" * 4 + f"<article><p>{short}</p></article>")
    assert got == f"{long.strip()}\n\n{short}"
    # most of the text outside of the only article
    got = page_text.main_text(f"<body><div>{long}</div><div>{long}</div><article><p>{short}</p></article></body>")
    assert got == f"{long.strip()}\n\n{long.strip()}\n\n{short}"
    line = "A line of the text, of middling length, as they come. " * 3
    close = "".join(f"<div>{line}</div>" for _ in range(6)) + "<div>It ends here.</div>"
    assert page_text.main_text(f"<body>{close}</body>").endswith("It ends here.")
    linked = f"<div>{line}</div><div><a href=x>See the whole story here</a></div><div>{line}</div>"
    assert "See the whole story" in page_text.main_text(linked)


@tables
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.sql(ORACLE[name]).fetchall()
    columns = [d[0] for d in con.sql(ORACLE[name]).description]
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(want)


@tables
def test_language_is_right_on_held_out_documents(spark):
    found = QUERIES["op9_language"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98


@tables
def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    now = docs
    for name, stage in C.STAGES[:-1]:
        out = C.materialize(stage(spark, now, SF_DIR), name)
        assert out.columns == docs.columns
        if name == "near_duplicates":
            kept = brute.near_docs({r.doc_id: r.text for r in now.collect()}, 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in kept.items() if c == i}
        now = out
    packed = C.STAGES[-1][1](spark, now, SF_DIR)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_pipeline_carries_clashing_columns_and_odd_rows(spark, docs):
    import corpus_pipeline as C

    more = docs.unionByName(docs).withColumn("score", F.lit(1)).withColumn("kept_text", F.lit("k")).withColumn("lang_pred", F.lit("p"))
    own = ["_key", "_id", "_text", "_copies", "_copy", "_kept", "_row", "a.b"]
    more = more.select("*", *[F.lit(c).alias(c) for c in own])
    now = more
    for name, stage in C.STAGES[:-1]:
        out = C.materialize(stage(spark, now, ""), name)
        assert out.columns == more.columns
        assert out.where("kept_text <> 'k' or lang_pred <> 'p' or score <> 1 or copies <> 7").count() == 0
        assert out.where(" or ".join(f"`{c}` <> '{c}'" for c in own)).count() == 0
        now = out
    assert C.STAGES[-1][1](spark, now, "").count() > 0
    none = more.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, "").count() == 0
