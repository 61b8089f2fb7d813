"""Packing token pieces into sequences, shortest pack first over the length histogram.

Only the histogram of piece lengths (at most ``capacity`` numbers) decides the packing. Lengths are
placed longest first; each goes to the open pack that is shortest so far, and a whole
count of equal packs is updated at once. What comes out is a table of packing patterns
with counts. Pieces find their place by rank: the n-th piece of a length takes the n-th
slot that the patterns hold for that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import map_rows, materialize
from antipode.llm.tokens import encoder
from antipode.scale import group_row_number

CAPACITY = 2048


def pack_histogram(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack in order, how many such packs), shortest pack first, lengths longest first."""
    by_room: dict[int, Counter] = {}
    done: Counter = Counter()

    def put(pack: tuple[int, ...], count: int, room: int) -> None:
        if room:
            by_room.setdefault(room, Counter())[pack] += count
        else:
            done[pack] += count

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        left = histogram[length]
        while left and by_room and (room := max(by_room)) >= length:  # the most room: the shortest packs
            packs = by_room[room]
            pack, count = packs.popitem()
            if not packs:
                del by_room[room]
            taken = min(count, left)
            put((*pack, length), taken, room - length)
            if count > taken:
                put(pack, count - taken, room)
            left -= taken
        fits = capacity // length
        if left // fits:
            put((length,) * fits, left // fits, capacity - fits * length)
        if left % fits:
            put((length,) * (left % fits), 1, capacity - left % fits * length)
    for packs in by_room.values():
        done.update(packs)
    return sorted(done.items(), key=lambda x: (tuple(-y for y in x[0]), x[1]))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, times, offset): where ranks of a length go.

    A run of ``times`` equal lengths in a pattern is one slot: rank r of the slot is in pack
    r // times at place r % times.
    """
    used: Counter = Counter()
    out, base = [], 0
    for pack, count in patterns:
        at = 0
        runs: list[list[int]] = []
        for x in pack:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        for length, times in runs:
            out.append((length, used[length], used[length] + times * count - 1, base, times, at))
            used[length] += times * count
            at += times * length
        base += count
    return out


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                 capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document cut at multiples of ``capacity``.

    Null texts are empty: one piece with the end id alone. Rows that repeat an id are
    documents of their own.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        encode = encoder(tokenizer).encode
        for cols in batches:
            out: dict = {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc, got in zip(cols["id"].to_pylist(), encode(cols["text"].cast("binary").to_pylist()), strict=True):
                ids = np.append(got.astype("<u4"), np.array([end_id], "<u4"))
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    for k, v in (("id", doc), ("start", start), ("length", len(part)),
                                 ("ids_crc32", zlib.crc32(part.tobytes())), ("doc_tokens", len(ids))):
                        out[k].append(v)
            yield out

    return map_rows(narrow, "id long, start long, length long, ids_crc32 long, doc_tokens long", work)


def pack_pieces(pieces: DataFrame, order: list[Column], length_col: str = "length",
                capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``order`` ranks pieces of equal length.

    Pieces must be a stored table: they are read for the histogram and for the ranks. Lengths above
    ``capacity`` are an error; an empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # at most capacity rows
    table = slots(pack_histogram(histogram, capacity))
    names = "_length long, _first long, _last long, _base long, _times long, _offset long"
    where = spark.createDataFrame(table, names)
    ranked = group_row_number(pieces, [length_col], order, "_rank")
    at = F.col("_rank") - 1 - F.col("_first")
    # the slots follow from at most `capacity` lengths, so their number is bounded
    joined = ranked.join(F.broadcast(where), (F.col(length_col) == F.col("_length"))
                         & (F.col("_rank") - 1).between(F.col("_first"), F.col("_last")))
    return joined.select(
        *[F.col(f"`{c}`") for c in pieces.columns],
        (F.col("_base") + F.floor(at / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_times")) * F.col(length_col)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                   capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document: where its ids lie in which sequence."""
    pieces = materialize(token_pieces(docs, id_col, text_col, end_id, capacity, tokenizer), "pieces")
    packed = pack_pieces(pieces, [F.col("id"), F.col("start"), F.col("ids_crc32"), F.col("doc_tokens")],
                         "length", capacity)
    return packed.withColumnRenamed("id", id_col)
