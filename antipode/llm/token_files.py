"""Token-id output: fixed-width bit packing in blocks, with random access.

Format: one row per block. ``payload`` holds the ids of the block, each in the minimum
number of bits of the vocabulary (``bits``), least significant bit first, padded to
whole bytes; ``doc_ids`` and ``doc_ends`` name the documents of the block and where
each ends in it; (``part``, ``block``) order the blocks and ``n_ids`` sums up to the
place of a block among all ids. A document starts and ends anywhere: one longer than a
block goes on in the next (``more`` on the last document). Blocks are stored as
Parquet rows, so any block is read alone by (``part``, ``block``) and any document by the
ranges of ``doc_ids`` kept in the file statistics (``first_id``, ``last_id``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from antipode.llm.common import bucket_of, map_rows, materialize, range_cuts, shuffle_width
from antipode.llm.tokens import encoder

BLOCK_IDS = 1 << 18
BLOCK_SCHEMA = ("part long, block long, bits int, n_ids long, first_id long, last_id long, "
                "doc_ids array<long>, doc_ends array<long>, more boolean, payload binary")


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, n: int, start: int = 0) -> np.ndarray:
    """``n`` ids from id number ``start`` of a payload, as unsigned 32-bit integers."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", n, start * 2).astype("<u4")
    first = start * bits // 8
    last = -(-(start + n) * bits // 8)
    raw = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    raw = raw[start * bits - first * 8:][:n * bits].reshape(n, bits).astype(np.uint32)
    return (raw << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


def write_token_blocks(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                       end_id: int = 2, block_ids: int = BLOCK_IDS, tokenizer: str | None = None) -> None:
    """Write the ids of all texts, each document followed by ``end_id``, in ascending id order to ``path``.

    Null texts are empty (their end id only), null ids come first, ties go by text. Ids are cut into
    ranges by a quantile sketch; every range is sorted, encoded and packed in one
    task, so nothing but the split points passes the driver.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = 2 * shuffle_width(docs.sparkSession)
    placed = narrow.withColumn("part", bucket_of("id", range_cuts(narrow, "id", pieces)).cast("long"))
    ordered = placed.repartition(pieces, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "text")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        words = encoder(tokenizer)
        bits = bits_for(max(words.size, end_id + 1))
        end = np.array([end_id], words.dtype)
        part, block, held, have, names, ends = None, 0, [], 0, [], []

        def flush(more: bool) -> dict:
            nonlocal block, held, have, names, ends
            row = {"part": [part], "block": [block], "bits": [bits], "n_ids": [have], "first_id": [names[0]],
                   "last_id": [names[-1]], "doc_ids": [names], "doc_ends": [ends], "more": [more],
                   "payload": [pack_bits(np.concatenate(held), bits)]}
            block, held, have, names, ends = block + 1, [], 0, [], []
            return row

        for cols in batches:
            parts, ids = cols["part"].to_pylist(), cols["id"].to_pylist()
            for p, doc, got in zip(parts, ids, words.encode(cols["text"].cast("binary").to_pylist()), strict=True):
                if p != part:
                    if have:
                        yield flush(False)
                    part, block = p, 0
                left = np.concatenate([got, end])
                while len(left):
                    room = block_ids - have
                    held.append(left[:room])
                    have += len(held[-1])
                    left = left[room:]
                    names.append(doc)
                    ends.append(have)
                    if have == block_ids:
                        yield flush(len(left) > 0)
        if have:
            yield flush(False)

    map_rows(ordered, BLOCK_SCHEMA, work).write.parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, before): how many ids come before each block."""
    sizes = blocks.select("part", "block", "n_ids")
    # one row per range in the first window, and the blocks of one range in the second
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")
    return sizes.withColumn("inner", inner).join(before, "part").select(
        "part", "block", (F.col("parts_before") + F.col("inner")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, unpacked from the blocks in ``path``.

    ``start`` is the number of ids before the document. One that spans blocks is put together from its
    pieces' checksums and lengths; its ids are never gathered, and no payload is shuffled.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            rows = {k: cols[k].to_pylist() for k in ("part", "block", "bits", "n_ids", "doc_ids", "doc_ends", "more",
                                                     "payload")}
            out: dict = {k: [] for k in ("id", "start", "n_tokens", "crc", "part", "block", "seq", "opens")}
            for i, payload in enumerate(rows["payload"]):
                raw = unpack_bits(payload, rows["bits"][i], rows["n_ids"][i])
                at, last = 0, len(rows["doc_ids"][i]) - 1
                for j, (doc, stop) in enumerate(zip(rows["doc_ids"][i], rows["doc_ends"][i], strict=True)):
                    for k, v in (("id", doc), ("start", at), ("n_tokens", stop - at),
                                 ("crc", zlib.crc32(raw[at:stop])), ("part", rows["part"][i]),
                                 ("block", rows["block"][i]), ("seq", j), ("opens", j == last and rows["more"][i])):
                        out[k].append(v)
                    at = stop
            yield out

    pieces = materialize(map_rows(
        blocks.select("part", "block", "bits", "n_ids", "doc_ids", "doc_ends", "more", "payload"),
        "id long, start long, n_tokens long, crc long, part long, block long, seq long, opens boolean", work), "slices")
    placed = pieces.join(block_starts(blocks), ["part", "block"]).withColumn("start", F.col("start") + F.col("before"))
    return _joined(placed.drop("before"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Put pieces of documents that span blocks together; whole documents pass untouched."""
    last = (pieces.where("opens").select("part", (F.col("block") + 1).alias("block"), F.lit(0).cast("long").alias("seq"),
                                         F.lit(True).alias("goes_on")))
    marked = pieces.join(last, ["part", "block", "seq"], "left")
    split = F.col("opens") | F.coalesce("goes_on", F.lit(False))
    whole = marked.where(~split).select("id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    run = Window.partitionBy("part").orderBy("block", "seq")
    parts = marked.where(split).withColumn(
        "n", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(run))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            ids, starts, n, crc = [], [], [], []
            for i, ps in zip(cols["id"].to_pylist(), cols["pieces"].to_pylist(), strict=True):
                ps = sorted(ps, key=lambda p: p["block"])
                total = ps[0]["crc"]
                for p in ps[1:]:
                    total = crc32_combine(total, p["crc"], p["n_tokens"] * 4)
                ids.append(i)
                starts.append(ps[0]["start"])
                n.append(sum(p["n_tokens"] for p in ps))
                crc.append(total)
            yield {"id": ids, "start": starts, "n_tokens": n, "ids_crc32": crc}

    grouped = parts.groupBy("part", "n", "id").agg(
        F.collect_list(F.struct("block", "start", "n_tokens", "crc")).alias("pieces"))
    return whole.unionByName(map_rows(grouped.select("id", "pieces"),
                                      "id long, start long, n_tokens long, ids_crc32 long", work))


def crc32_combine(a: int, b: int, n: int) -> int:
    """crc32 of two strings in a row from the crc32 of each and the length of the second."""
    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
            if not v:
                break
        return out

    op = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    op = [times(op, times(op, 1 << i)) for i in range(32)]  # two
    op = [times(op, times(op, 1 << i)) for i in range(32)]  # four
    while n:
        op = [times(op, op[i]) for i in range(32)]  # one byte, then doubled
        if n & 1:
            a = times(op, a)
        n >>= 1
    return a ^ b


def load_document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray:
    """Ids of one document, reading only the blocks whose id range holds it."""
    rows = (spark.read.schema(BLOCK_SCHEMA).parquet(path)
            .where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "block").collect())
    out = [np.empty(0, "<u4")]
    for r in rows:
        begins = [0, *r.doc_ends]
        for j, d in enumerate(r.doc_ids):
            if d == doc_id:
                out.append(unpack_bits(bytes(r.payload), r.bits, r.doc_ends[j] - begins[j], begins[j]))
    return np.concatenate(out)


__all__ = ["bits_for", "crc32_combine", "load_document", "pack_bits", "read_documents", "unpack_bits", "write_token_blocks"]
