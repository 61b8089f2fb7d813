"""Registered queries of the operators on the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from antipode.llm import (embedding_dups, filter_audit, fingerprints, language, line_dedup, minhash, mixing, packing,
                          page_text, quality, repeats, token_files, whitening)
from antipode.llm.common import read_table
from antipode.scale import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql.strip()
        return build
    return add


@query("op1_embedding_dups")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap
  FROM src),
filled AS (  -- sources full at their cap come in the order of cap per weight
  SELECT *, coalesce(sum(cap) OVER f, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS w_left,
         sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM ranked WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min_by((total - full_before)::DOUBLE / w_left::DOUBLE, k) AS l FROM filled
  WHERE w * ((total - full_before)::DOUBLE / w_left::DOUBLE) < cap),
targets AS (
  SELECT source, source_size, CASE WHEN l IS NULL OR w * l >= cap THEN cap::DOUBLE ELSE w * l END AS target
  FROM ranked CROSS JOIN level),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce('s' || d.source, '')), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + least(1, floor(k * (rate - floor(rate)) + u) - floor((k - 1) * (rate - floor(rate)) + u)))::BIGINT * size)::BIGINT AS taken
FROM placed
"""


@query("op2_source_mix", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token_blocks")
    token_files.write_token_blocks(read_table(spark, sf_dir, "documents"), path)
    read = token_files.read_documents(spark, path)
    return read.withColumnRenamed("id", "doc_id")


@query("op4_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(read_table(spark, sf_dir, "documents"))


@query("op5_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op7_minhash_dups")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, coalesce(h.keeper <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op8_line_dedup", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out("doc_id")).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op10_page_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_pages(read_table(spark, sf_dir, "pages"), keep=["url"])


OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
  FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS failed
  FROM words LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, k::INT AS step, (SELECT bit FROM letters WHERE letter = filter_order[k]) AS bit,
         coalesce((SELECT sum(bit) FROM letters WHERE contains(filter_order[1:k - 1], letter)), 0)::INT AS before
  FROM orders, range(1, 6) AS r(k)),
audit AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (failed & (bit | before) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (failed & bit <> 0 AND failed & before = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (failed & bit <> 0 AND failed & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audit
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op11_quality")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.measured_once(read_table(spark, sf_dir, "documents"))
    held_out = language.held_out("id")
    model = quality.fit(features.where(~held_out), read_table(spark, sf_dir, "labels"))
    scored = quality.score(features, model)
    return scored.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))
