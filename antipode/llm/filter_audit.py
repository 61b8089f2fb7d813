"""How five document filters act together, for every order of applying them.

The corpus becomes a sparse document-term matrix. Documents are cut into shards of some megabytes of
text. A shard is written with its words as local codes; the distinct words of all shards get
global column ids, and every shard's codes are exchanged for them, so the result is a table of
CSR blocks over one dictionary. Row sums of a block are the documents'
word counts and its stored entries per row their distinct words, which settles filters A and B;
C, D and the digest for E were noted while the shard was cut.

Filters, each true where a document fails it:

* A: under ``min_words`` words
* B: ``100 * distinct words < distinct_percent * words``
* C: ``100 * upper-case A-Z > upper_percent * code points``
* D: holds one of ``# $ % & * |``
* E: the same text belongs to a smaller id of the table

Defined results: a null text is empty (fails A, passes B, C and D). Rows of one id and text
are no copies of each other; rows with a null id never fail E and never make others fail.
A null part is the empty string. Of several label rows of an id any with the value 1 counts;
labels with a null id mean nothing. An empty table gives no rows. Other columns of the tables,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from antipode.llm.common import map_rows, materialize
from antipode.scale import fresh_path

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
# The signs that filter D looks for.
SIGNS = b"#$%&*|"
_UPPER = bytes(range(65, 91))
#: Text behind one shard (a longer document is a shard of its own); words that meet in one task; rows sent to a Python worker at once.
SHARD_BYTES, BUCKET_BYTES, BATCH_BYTES = 4_000_000, 4_000_000, 4_000_000
A, B, C, D, E = (1 << i for i in range(5))


# --------------------------------------------------------------------- memory

@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send Python workers ``BATCH_BYTES`` at a time, however many rows and however long these are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _stored_apart(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with each row a row group: writer and reader hold one row, not all that a file has."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.row.count.limit", "1").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------- document-term matrix

class _Shard:
    """Documents cut so far: one row of the shard table once ``SHARD_BYTES`` of text have come together."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.codes, self.amounts, self.ends, self.digests, self.flags = [], [], [0], [], []
        self.ids, self.parts, self.size = [], [], 0

    def add(self, text: bytes, chars: int, upper_percent: int) -> None:
        found = Counter(text.split())  # bytes split at exactly the white space of the contract
        known = self.known
        self.codes.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
        self.amounts.append(np.fromiter(found.values(), np.int32, len(found)))
        self.ends.append(self.ends[-1] + len(found))
        self.digests.append(hashlib.sha256(text).digest())
        upper = len(text) - len(text.translate(None, _UPPER))
        signs = len(text) - len(text.translate(None, SIGNS))
        self.flags.append(C * (100 * upper > upper_percent * chars) | D * (signs > 0))
        self.size += len(text)

    def row(self, shard: int) -> dict:
        """Local codes follow the hash of the words, so that any range of hashes is a run of codes."""
        words = list(self.known)
        order = np.argsort(_hashes(words), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)
        one = lambda values, kind: pa.array([values], type=pa.list_(kind))
        joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int32)
        listed = lambda chunks: pa.ListArray.from_arrays(pa.array([0, sum(map(len, chunks))], pa.int32()), pa.concat_arrays(chunks))
        return {"shard": [shard], "id": listed(self.ids), "part": listed(self.parts), "digest": one(self.digests, pa.binary()),
                "flags": one(self.flags, pa.int32()), "row_start": one(np.array(self.ends, np.int32), pa.int32()),
                "code": one(rank[joined(self.codes)], pa.int32()), "amount": one(joined(self.amounts), pa.int32()),
                "words": [b" ".join([words[i] for i in order.tolist()])]}


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _cut_shards(docs: DataFrame, upper_percent: int) -> DataFrame:
    """One row per shard: document columns as lists, CSR with local codes, and the words behind the codes, separated by blanks."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = (f"shard long, id array<{types['id']}>, part array<string>, digest array<binary>, flags array<int>, "
              "row_start array<int>, code array<int>, amount array<int>, words binary")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << 32  # unique: the table is written once
        shard = _Shard()
        for cols in batches:
            chars = pc.fill_null(pc.utf8_length(cols["text"].cast(pa.string())), 0).to_pylist()
            for text, n in zip(cols["text"].to_pylist(), chars, strict=True):
                shard.add(text or b"", n, upper_percent)
            shard.ids.append(cols["id"])
            shard.parts.append(cols["part"])
            if shard.size >= SHARD_BYTES:
                yield shard.row(number)
                number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.row(number)

    return map_rows(docs.select("id", F.col("text").cast("binary").alias("text"), "part"), schema, work)


def _encode(shards: DataFrame) -> DataFrame:
    """(bucket, shard, terms, words): global numbers of the words of all shards.

    Words meet in buckets of hash ranges, as one row per shard and bucket whatever the number of
    documents that use a word. A bucket numbers its distinct words from 0: ``terms`` are the numbers of
    a shard's words in the order of their codes; the row with shard null lists the bucket's ``words``.
    """
    size = shards.agg(F.sum(F.length("words"))).first()[0] or 0
    # as few as the cores and the bytes ask for: a bucket gets a row of every shard
    buckets = max(4 * shards.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    cuts = np.array([-(-(i << 32) // buckets) for i in range(1, buckets)], np.uint64)

    def deal(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            for shard, blob in zip(cols["shard"].to_pylist(), cols["words"].to_pylist(), strict=True):
                words = blob.split()
                at = np.concatenate([[0], np.searchsorted(_hashes(words).astype(np.uint64), cuts), [len(words)]])
                full = np.flatnonzero(np.diff(at))
                yield {"bucket": full, "shard": [shard] * len(full), "words": [b" ".join(words[at[i]:at[i + 1]]) for i in full]}

    def number(group: pa.Table) -> pa.Table:
        rows = group.sort_by("shard")
        lists = [blob.split() for blob in rows["words"].to_pylist()]
        coded = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        terms, ends = coded.indices.to_numpy(), np.cumsum([len(words) for words in lists])
        packed = [t.astype("<i4").tobytes() for t in np.split(terms, ends[:-1])]
        return pa.table({"bucket": [rows["bucket"][0].as_py()] * (len(lists) + 1), "shard": [*rows["shard"].to_pylist(), None],
                         "terms": [*packed, None], "words": [None] * len(lists) + [b" ".join(coded.dictionary.to_pylist())],
                         "n": [None] * len(lists) + [len(coded.dictionary)]}, schema=arrow)

    arrow = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("terms", pa.binary()), ("words", pa.binary()), ("n", pa.int64())])
    dealt = map_rows(shards.select("shard", "words"), "bucket long, shard long, words binary", deal)
    return dealt.groupBy("bucket").applyInArrow(number, "bucket long, shard long, terms binary, words binary, n long")


def _with_offset(encoded: DataFrame) -> DataFrame:
    """Add the number of words in all buckets before."""
    sizes = encoded.where("shard IS NULL").select(F.col("bucket").alias("_bucket"), "n")
    # one row per bucket, that is per BUCKET_BYTES of words
    before = sizes.select("_bucket", F.expr("sum(n) OVER (ORDER BY _bucket) - n").alias("offset"))
    return encoded.drop("n").join(F.broadcast(before), F.col("bucket") == F.col("_bucket")).drop("_bucket")


def document_term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str | None = None,
                         upper_percent: int = UPPER_PERCENT) -> tuple[DataFrame, DataFrame]:
    """(CSR blocks, dictionary).

    A block has one row per shard: ``shard``, the lists ``id``, ``part``, ``digest`` and ``flags`` with an entry
    per document, ``row_start`` (one more entry than documents), and per stored entry ``term`` and ``amount``.
    ``words`` and ``distinct_words`` are the sums and the entries of its rows.
    The dictionary has each word of the corpus once: (``word`` binary, ``term``), numbered from 0 without gaps.
    """
    part = F.col(part_col).cast("string") if part_col else F.lit(None).cast("string")
    with _small_batches(docs.sparkSession):
        shards = _stored_apart(_cut_shards(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.alias("part")),
                                           upper_percent), "shards")
        encoded = _with_offset(materialize(_encode(shards), "terms"))
    types = {f.name: f.dataType.simpleString() for f in shards.schema}
    kept = ("shard", "id", "part", "digest", "flags", "row_start", "amount")
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", term array<long>, words array<long>, distinct_words array<long>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def exchange(shard: pa.Table, runs: pa.Table) -> pa.Table:
        order = np.argsort(runs["bucket"].to_numpy())
        offsets, terms = runs["offset"].to_numpy(), runs["terms"]
        to = np.concatenate([np.empty(0, np.int64), *(offsets[i] + np.frombuffer(terms[i].as_py(), "<i4") for i in order.tolist())])
        one = shard.combine_chunks().to_batches()[0]
        values = lambda c: one.column(c)[0].values.to_numpy(zero_copy_only=False)
        start, running = values("row_start"), np.cumsum(values("amount"), dtype=np.int64)
        sums = np.diff(np.concatenate([[0], running])[start])
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(
            [*(one.column(c) for c in kept), listed(to[values("code")]), listed(sums), listed(np.diff(start))], schema=arrow)])

    # one shard at a time reaches a worker: as rows of a join they would come in batches of all that a task reads
    runs = encoded.where("shard IS NOT NULL").select("shard", "bucket", "offset", "terms")
    blocks = shards.drop("words").groupBy("shard").cogroup(runs.groupBy("shard")).applyInArrow(exchange, schema)

    def spell(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            for offset, blob in zip(cols["offset"].to_pylist(), cols["words"].to_pylist(), strict=True):
                words = blob.split()
                yield {"word": words, "term": np.arange(offset, offset + len(words))}

    return blocks, map_rows(encoded.where("shard IS NULL").select("offset", "words"), "word binary, term long", spell)


def row_counts(blocks: DataFrame) -> DataFrame:
    """(id, part, digest, flags, words, distinct_words) per document: row sums and stored entries of the CSR blocks.

    The sums came with the block, so its entries stay where they are and no second worker reads them.
    """
    per_document = ("id", "part", "digest", "flags", "words", "distinct_words")
    return blocks.select(F.inline(F.arrays_zip(*per_document)))


# --------------------------------------------------------------------- audit

def failed_filters(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source", min_words: int = MIN_WORDS, distinct_percent: int = DISTINCT_PERCENT,
                   upper_percent: int = UPPER_PERCENT) -> DataFrame:
    """(id, part, failed, good, toxic, rows): documents alike in all of these are one row; ``failed`` has bit 0 for A to bit 4 for E."""
    blocks, _ = document_term_matrix(docs, id_col, text_col, part_col, upper_percent)
    bits = (F.col("flags") + F.when(F.col("words") < min_words, A).otherwise(0)
            + F.when(100 * F.col("distinct_words") < distinct_percent * F.col("words"), B).otherwise(0))
    alike = row_counts(blocks).groupBy("id", F.coalesce("part", F.lit("")).alias("part"), "digest", bits.alias("bits")).agg(
        F.count(F.lit(1)).alias("rows"))
    with _small_batches(docs.sparkSession):
        alike = materialize(alike, "flagged")
    # the keeper of a text is found by its id too, so that a text with many copies is spread over them
    keepers = alike.where(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("_keeper", F.lit(True))
    marked = alike.join(keepers, ["digest", "id"], "left")
    copy = F.col("id").isNotNull() & F.col("_keeper").isNull()
    marked = marked.withColumn("failed", F.col("bits") + F.when(copy, E).otherwise(0))
    if labels is None:
        return marked.select("id", "part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "rows")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return marked.join(known, "id", "left").select("id", "part", "failed", no("good"), no("toxic"), "rows")


def _steps() -> Column:
    """All orders of the filters, step by step, as one literal: 120 x 5 entries, whatever the data."""
    steps = []
    for order in permutations(range(len(LETTERS))):
        before = 0
        for k, i in enumerate(order):
            steps.append({"filter_order": "".join(LETTERS[j] for j in order), "step": k + 1, "before": before, "bit": 1 << i})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,bit:int>>")


def audit_orders(failed: DataFrame) -> DataFrame:
    """One row per part, order and step from the rows of ``failed_filters``.

    The documents of a part shrink to one number per set of failed filters (32 at most) in the map tasks;
    each order and step is then a sum over those numbers.
    """
    cells = failed.groupBy("part", "failed").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("rows")).otherwise(0)).alias("toxic"))
    cells = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    steps = cells.select("part", "cells", F.explode(_steps()).alias("s")).select("part", "cells", "s.*")
    hit, seen = (lambda c: c["failed"].bitwiseAND(F.col("bit")) != 0), (lambda c: c["failed"].bitwiseAND(F.col("before")) != 0)

    def total(value: str, keep) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(keep(c), c[value]).otherwise(0))

    # a document counts for a filter in the orders that put it before the other filters it fails
    share = lambda c: F.lit(factorial(len(LETTERS))).cast("long") / F.bit_count(c["failed"])
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(
        hit(c), c["n"] * share(c).cast("long")).otherwise(0))
    removed = lambda c: hit(c) & ~seen(c)
    return steps.select(
        "part", "filter_order", "step", total("n", lambda c: ~hit(c) & ~seen(c)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda c: hit(c) & seen(c)).alias("redundant"),
        total("n", lambda c: c["failed"] == F.col("bit")).alias("unique_fails"), total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"), shapley.alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame | None = None, **settings) -> DataFrame:
    """The audit of ``docs``; ``settings`` as in ``failed_filters``."""
    return audit_orders(failed_filters(docs, labels, **settings))
