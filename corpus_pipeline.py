"""A corpus pipeline over ``documents``: language, lines, near duplicates, mix, packing.

``run(spark, sf_dir)`` applies the stages in order; each stage's documents are written as
Parquet in the folder of ``spark.checkpoint.dir`` and read again as the next one's. All but the last
return the columns of ``documents``, extra columns included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antipode.llm import language, line_dedup, minhash, mixing, packing
from antipode.scale import materialize
from antipode.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one, so that no name of theirs can clash with a stage's own."""
    return docs.select("doc_id", "text", F.struct(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("_row"))


def _restored(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the documents again, some with new values."""
    old = lambda c: F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c)
    return rows.select(*[new.get(c, old(c)).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told; ``lang`` becomes the language found.

    Documents without a letter (null and empty texts too) go. The model learns from the labelled documents.
    """
    ship_package(spark)
    model = language.fit(docs.select("text", "lang"))
    found = language.identify(_carried(docs), model, "doc_id", "text", keep=["text", "_row"])
    return _restored(found.where(F.col("lang_pred") != language.UNDETERMINED), docs.columns, lang=F.col("lang_pred"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stay in a document with a larger id; every document stays, ``n_chars`` follows."""
    out = line_dedup.dedup_lines(_carried(docs))
    return _restored(out, docs.columns, text=F.col("kept_text"), n_chars=F.char_length("kept_text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the smallest id.

    Rows that repeat a kept id and text stay one row; documents without words are kept.
    """
    ship_package(spark)
    rows = _carried(docs)
    found = minhash.near_duplicates(rows.select("doc_id", "text"))
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rest = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return _restored(rest.dropDuplicates(["doc_id", "text"]), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    rows = _carried(docs).withColumn("_key", F.xxhash64("text"))
    copies = mixing.mix_copies(docs.select("doc_id", "text", "source")).where("copies > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), F.col("copies").alias("_copies")).dropDuplicates(["_id", "_text"])
    joined = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
    return _restored(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack),
]

#: Learned language models, MinHash and tokenizers are outside SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
