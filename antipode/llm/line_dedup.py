"""Line de-duplication with levelled sorted runs of line hashes. DataFrame operations only.

The index is a set of runs: tables of (line hash, documents, keeper) sorted by hash.
A batch of documents is reduced to its line hashes. Hashes that a run holds are merged with
it: the batch's entry takes over the count and keeper found so far, so the newest entry of a hash
is the whole of what is known of it. Hashes that the merge-anti-join finds in no run start from nothing.
Both are added as a run of the batch's own. As soon as a level
holds ``fanout`` runs they are compacted into one run of the next level, where the newest entry of a hash stays,
so a hash is rewritten as often as there are levels. A batch costs one sorted pass over the
runs, however many documents came before it; no sum over all batches is ever taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antipode.llm.common import ASCII_SPACE, materialize

HASH = ["h1", "h2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """Levelled runs of line hashes; every run is a written table in the shared folder.

    Runs hold (h1, h2, docs, keeper, batch): what was known of a hash after ``batch``, one row per hash and run.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout, self.batches = spark, fanout, 0
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        return materialize(rows.repartition(*HASH).sortWithinPartitions(*HASH), "line_run")

    def add(self, batch: DataFrame) -> DataFrame:
        """Add (h1, h2, docs, keeper), one row per hash, of documents not added before; return the new run."""
        entries = batch.select(*HASH, "docs", "keeper")
        if self.runs():
            known = newest(self.runs()).select(*HASH, F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper")).hint("merge")
            new = entries.join(known.select(*HASH), HASH, "left_anti")
            again = entries.join(known, HASH).select(
                *HASH, (F.col("docs") + F.col("_docs")).alias("docs"), F.greatest("keeper", "_keeper").alias("keeper"))
            entries = new.unionByName(again)
        run = self._write(entries.withColumn("batch", F.lit(self.batches)))
        self.batches += 1
        self.levels[0].append(run)
        self._compact()
        return run

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._write(newest(level)))
                self.levels[i] = []

    def entries(self) -> DataFrame:
        """(h1, h2, docs, keeper) over all batches: the newest entry of each hash."""
        return newest(self.runs()).drop("batch")


def newest(runs: list[DataFrame]) -> DataFrame:
    """The latest entry of each hash in some runs, which share no hash within a batch."""
    if len(runs) == 1:
        return runs[0]
    rows = reduce(DataFrame.unionByName, runs)
    return rows.groupBy(*HASH).agg(F.max(F.struct("batch", "docs", "keeper")).alias("_e")).select(*HASH, "_e.docs", "_e.keeper", "_e.batch")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one-byte characters take the quicker built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row_key, pos, h1, h2) of every line whose key has ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("row_key"),
        F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(ASCII_SPACE))
    return lines.select("id", "row_key", "pos", key.alias("key")).where(F.char_length("key") >= min_chars).select(
        "id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose
    their lines in all documents but the one with the largest id. A null or empty
    text is one empty line; rows that share an id count as one document, a null id
    is a document smaller than all others. Keys are compared by 128-bit hashes.
    """
    lines = line_keys(docs, id_col, text_col, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    lines = materialize(lines, "lines")
    index = LineRuns(docs.sparkSession, fanout)
    for i in range(batches):
        # the first step spreads a line found everywhere over its documents
        per_doc = lines.where(F.col("batch") == i).groupBy(*HASH, "id").agg(F.lit(1).alias("one"))
        index.add(per_doc.groupBy(*HASH).agg(F.sum("one").alias("docs"), F.max("id").alias("keeper")))
    hot = materialize(index.entries().where(F.col("docs") >= min_docs).select(*HASH, "keeper"), "hot_lines")
    dropped = (
        lines.join(hot, HASH).where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row_key").agg(F.collect_set("pos").alias("drops"))
        .select(F.col("id").alias("_id"), F.col("row_key").alias("_row_key"), F.col("drops").alias("_drops"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.withColumn("_key", F.xxhash64(text)).join(
        dropped, (F.col("_key") == F.col("_row_key")) & F.col(id_col).eqNullSafe(F.col("_id")), "left")
    parts = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drops"))
    kept = F.when(F.col("_drops").isNull(), text).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.withColumn("_lines", parts).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
