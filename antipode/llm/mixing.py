"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times in the
mix. The documents of a source are put in order of their size, the expected copies
are summed up along that order, one random offset per source is added, and a
document is taken once per integer boundary its share crosses. The order by
size makes neighbours alike, so the words taken stay within about one document's
size of the target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import WORD_PATTERN, materialize, uniform_of
from antipode.scale import group_row_number

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def word_count(text: str):
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code point order, null last. The total is
    shared by weight; a target above ``most`` times its source is cut there and the
    rest shared again, until none is above.
    """
    ranked = group_row_number(
        sizes.select("source", "source_size", F.lit(0).alias("_all")), ["_all"],
        [F.col("source").isNull(), F.col("source")], "_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int"))
    state = materialize(ranked.select("source", "source_size", weight.cast("long").alias("weight"),
                                      (most * F.col("source_size")).alias("cap")), "sources")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    capped_at = None
    while True:
        level = F.lit(None).cast("double") if capped_at is None else F.lit(capped_at)
        full = F.coalesce(F.col("weight") * level >= F.col("cap"), F.col("cap") == 0)
        row = state.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not row[1]:
            return state.select("source", "source_size", F.col("cap").cast("double").alias("target"))
        # the level is exact in the number of sources that are full, and only ever rises
        new = (total - (row[0] or 0)) / row[1]
        if capped_at is not None and new <= capped_at:
            break
        capped_at = new
    return state.select("source", "source_size", F.when(
        F.col("weight") * F.lit(capped_at) >= F.col("cap"), F.col("cap").cast("double")
    ).otherwise(F.col("weight") * F.lit(capped_at)).alias("target"))


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (words), text_key.

    Null texts and wordless texts have size 0 and may be taken too (0 words). Ties
    in size go by id, then by text; rows equal in all of them are interchangeable.
    A null source is a source of its own. Runs with the same ``seed`` agree.
    """
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.xxhash64(text_col).alias("text_key")), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = materialize(targets, "targets")
    placed = group_row_number(rows, ["source"], [F.col("size"), F.col("id"), F.col("text_key")], "k")
    right = targets.withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform_of(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))))
    part = F.col("rate") - F.floor("rate")
    crossed = F.floor(F.col("k") * part + F.col("u")) - F.floor((F.col("k") - 1) * part + F.col("u"))
    return (
        placed.join(right, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("rate", rate).withColumn("u", offset)
        .withColumn("copies", (F.floor("rate") + F.least(crossed, F.lit(1))).cast("long"))
        .select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"), "text_key")
    )
