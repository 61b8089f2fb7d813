"""Repeated byte strings across documents.

Every string of ``width`` bytes that also starts earlier is found exactly, without sorting suffixes:

1. Each window of ``width`` bytes names an anchor, the smallest hash among its short grams. Equal windows name
   the same gram at the same place, and windows in a row share anchors, so a text
   shrinks to about one region per 39 bytes: the windows of one anchor.
2. Regions meet by anchor, sorted by content and then by place. A region equal to an earlier one is a repeat as a
   whole. Only where different regions share an anchor is the answer open.
3. Every window holds the 38 bytes before the gram or the 38 bytes after it. So an open region has repeats only on
   the sides on which another region with its anchor agrees so far; the rest is settled.
4. The windows on those sides meet by content; all but the first are repeats.

Both meetings are streams over sorted partitions with one row of memory, so neither a passage that stands in every
document nor a group of copies is ever held. Equality is by hashes of 128 bits: of windows two of their content, of
regions the anchor's and the content's, so regions that share an anchor are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.llm.common import bucketed, map_rows, materialize, shuffle_width

WIDTH, GRAM = 100, 24
_TIE_BITS, _AT_BITS, _EXT_BITS = 16, 33, 14
_LOWEST = -(2**63)
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the 24 bytes at every place."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    at = lambda i: np.ndarray((n,), "<u8", raw, i, (1,))
    return _mix(at(0) * _A + _mix(at(8) * _B + at(16) * _C))


def _spans(h: np.ndarray, lo: np.ndarray, size: np.ndarray | int, salt: int) -> np.ndarray:
    """Hash of ``size`` bytes from each place, put together from gram hashes."""
    out = np.full(len(lo), salt, np.uint64)
    last = lo + size - GRAM
    for j in range(0, int(np.max(size, initial=0)) - GRAM + GRAM, GRAM):
        out = _mix(out * _A + h[np.minimum(lo + j, last)])
    return out


def regions(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, sides, document, first window, anchor place, windows) of each region.

    ``sides`` holds 16 bits each of the gram with what stands before and after it (0 where no window of the region
    reaches so far). It only says where to look for repeats; regions are equal by the 64 bits of their content.

    ``raw`` holds the documents one after another; ``offsets`` where each starts and the end. No window crosses documents.
    """
    h = gram_hashes(raw)
    count = width - GRAM + 1
    n = len(raw) - width + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int32, np.int64, np.int64, np.int64, np.int64))
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    v = np.concatenate([v, np.full(-len(v) % count, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, count)
    ahead = np.minimum.accumulate(v, axis=1).ravel()
    back = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[count - 1:count - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:] - width + 1
    full = ends > starts
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full], -1)
    s = np.flatnonzero(np.cumsum(inside)[:n])
    a = anchor[s]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(s) else np.empty(0, np.int64)
    lo = s[first]
    windows = np.diff(np.concatenate([first, [len(s)]]))
    a = a[first]
    doc = np.searchsorted(offsets, lo, "right") - 1
    # empty documents share an offset with the text after them; the last of them is that text
    side = (width - GRAM) // 2
    left = np.where(a - lo >= side, _spans(h, np.maximum(a - side, lo), np.minimum(side, a - lo) + GRAM, 4), 0)
    end = lo + windows - 1 + width
    right = np.where(end - a - GRAM >= side, _spans(h, a, np.minimum(side + GRAM, end - a), 5), 0)
    whole = _mix(_spans(h, lo, windows - 1 + width, 1) ^ _mix(((a - lo) * 128 + windows).astype(np.uint64)))
    sides = ((left >> np.uint64(48) << np.uint64(16)) | (right >> np.uint64(48))).astype(np.uint32).view(np.int32)
    return h[a], whole, sides, doc, lo, a - lo, windows


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a batch of texts, null as empty."""
    column = pa.array(column.cast(pa.large_binary()).fill_null(b""))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _pack(tie: np.ndarray, at: np.ndarray, ext: np.ndarray) -> np.ndarray:
    return (tie << (_AT_BITS + _EXT_BITS)) | (at << _EXT_BITS) | ext


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> (_AT_BITS + _EXT_BITS), (packed >> _EXT_BITS) & ((1 << _AT_BITS) - 1), packed & ((1 << _EXT_BITS) - 1)


def _first_of(key: list[np.ndarray], doc: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key, doc, packed: index of the first row of the key, and whether a row lies after that place."""
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
    first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    return new, (doc != doc[first]) | (packed != packed[first])


_SPAN = ["doc", "tie", "lo", "hi"]
_FOUND = ", ".join(f"{c} long" for c in _SPAN)
_OPEN = ", open boolean, place long, g long, sides int"
_KEYED = "g long, c long, doc long, packed long, done boolean"


def _region_rows(docs: DataFrame, width: int) -> DataFrame:
    """Regions of all texts; what repeats within a batch already has its answer (``done``)."""
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            raw, offsets = _raw(cols["text"])
            g, c, sides, d, lo, place, windows = regions(raw, offsets, width)
            doc = cols["doc"].to_numpy(zero_copy_only=False)[d]
            tie = cols["tie"].to_numpy(zero_copy_only=False)[d]
            ext = (place << 7) | (windows - 1)
            packed = _pack(tie, lo - offsets[d], ext)
            g, c = g.view(np.int64), c.view(np.int64)
            order = np.lexsort((packed, doc, c, g))
            g, c, doc, packed = g[order], c[order], doc[order], packed[order]
            if len(g):
                _, done = _first_of([g, c], doc, packed)
                yield {"g": g, "c": c, "doc": doc, "packed": packed, "done": done, "sides": sides[order]}

    return map_rows(docs, _KEYED + ", sides int", work)


def _stream(rows: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """One pass over rows sorted by ``keys``, doc, packed. Rows after the first of their (g, c) repeat it.

    ``whole``: also tell which firsts share g with another c (``open``).
    """
    def work(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict | None = None
        names = ["g", "c", "doc", "packed", "done", *(["sides"] if whole else [])]

        def out(r: dict, pick: np.ndarray, opened: np.ndarray) -> dict:
            tie, at, ext = _unpack(r["packed"][pick])
            span = {"doc": r["doc"][pick], "tie": tie, "lo": at, "hi": at + (ext & 127)}
            if not whole:
                return span
            hidden = ~opened[pick]
            keys = {k: pa.array(r[k][pick], mask=hidden) for k in ("g", "sides")}  # needed for open rows only
            return {**span, "open": opened[pick], "place": at + (ext >> 7), **keys}

        shared = False
        for cols in batches:
            r = {k: cols[k].to_numpy(zero_copy_only=False) for k in names}
            if not len(r["g"]):
                continue
            if held is not None:  # the first row of the key that the last batch ended in
                r = {k: np.concatenate([held[k], r[k]]) for k in names}
            new, repeat = _first_of([r["g"], r["c"]], r["doc"], r["packed"])
            opened = np.zeros(len(new), bool)
            repeat = repeat | r["done"]
            if whole:
                heads = np.flatnonzero(new)
                same = r["g"][heads][1:] == r["g"][heads][:-1]
                opened[heads[1:]] |= same
                opened[heads[:-1]] |= same
                opened[0] |= shared
            last = int(np.flatnonzero(new)[-1])
            if held is not None:
                repeat[0] = False  # told already, or told below
            # the last head may still find a partner: it is told when the next one is known
            told = repeat | opened
            told[last] = False
            if last and opened[last]:
                shared = True
            elif last:
                shared = False
            yield out(r, told, opened & ~repeat)
            held = {k: r[k][last:last + 1] for k in names}
        if held is not None and (shared or held["done"][0]):
            yield out(held, np.array([True]), np.array([shared]) & ~held["done"])

    parts = rows.repartition(shuffle_width(rows.sparkSession), *keys[:1]).sortWithinPartitions(*keys, "doc", "packed")
    return map_rows(parts, _FOUND + _OPEN if whole else _FOUND, work)


def _open_sides(opened: DataFrame, width: int) -> DataFrame:
    """(doc, tie, lo, hi): the windows of open regions on sides that another region with the anchor shares."""
    side = (width - GRAM) // 2
    cut = F.col("place") - side
    halves = opened.select("doc", "tie", "g", F.inline(F.array(
        F.struct(F.lit(0).alias("s"), F.shiftright("sides", 16).bitwiseAND(0xFFFF).alias("k"), F.col("lo"),
                 F.least("hi", cut).alias("hi")),
        F.struct(F.lit(1).alias("s"), F.col("sides").bitwiseAND(0xFFFF).alias("k"), F.greatest("lo", cut).alias("lo"),
                 F.col("hi"))))).where("lo <= hi")
    shared = materialize(halves.groupBy("g", "s", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
                         "shared_sides")
    return halves.join(shared, ["g", "s", "k"], "left_semi").select("doc", "tie", "lo", "hi")


def _window_rows(docs: DataFrame, opened: DataFrame, width: int) -> DataFrame:
    """Every window of the open regions: (g, c) the two halves of its hash."""
    lists = opened.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("tie", "lo", "hi"))).alias("ranges"))
    joined = docs.join(lists, "doc")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            raw, offsets = _raw(cols["text"])
            h = gram_hashes(raw)
            ranges = cols["ranges"]
            sizes = np.diff(ranges.offsets.to_numpy())
            flat = ranges.flatten()
            tie, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            d = np.repeat(np.arange(len(sizes)), sizes)
            own = tie == cols["tie"].to_numpy(zero_copy_only=False)[d]
            d, lo, hi = d[own], lo[own], hi[own]
            n = hi - lo + 1
            d, lo = np.repeat(d, n), np.repeat(lo, n)
            if not len(lo):
                continue
            at = lo + np.arange(len(lo)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            g = _spans(h, at + offsets[d], width, 2).view(np.int64)
            c = _spans(h, at + offsets[d], width, 3).view(np.int64)
            doc = cols["doc"].to_numpy(zero_copy_only=False)[d]
            packed = _pack(cols["tie"].to_numpy(zero_copy_only=False)[d], at, np.zeros(len(at), np.int64))
            order = np.lexsort((packed, doc, c, g))
            g, c, doc, packed = g[order], c[order], doc[order], packed[order]
            _, done = _first_of([g, c], doc, packed)
            yield {"g": g, "c": c, "doc": doc, "packed": packed, "done": done}

    return map_rows(joined, _KEYED, work)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("doc"), text.alias("text"),
                       F.xxhash64(text).bitwiseAND((1 << _TIE_BITS) - 1).alias("tie"))


def repeated_spans(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, tie, lo, hi): windows of ``width`` bytes that start at lo to hi and all repeat an earlier string."""
    found = materialize(_stream(_region_rows(keyed, width), ["g", "c"], True), "regions")
    ranges = materialize(_open_sides(found.where("open"), width), "open_sides")
    windows = materialize(_stream(_window_rows(keyed, ranges, width), ["g", "c"], False), "windows")
    return found.where("not open").select(*_SPAN).unionByName(windows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes, null is empty. A byte goes if a ``width``-byte string over it also starts earlier: in a smaller id or
    before in the same document. A null id is the smallest. Rows that share an id are in the order of
    a hash of their texts; rows that repeat id and text count as one document.
    """
    texts = bucketed(_keyed(docs, id_col, text_col).repartition(width_ := shuffle_width(docs.sparkSession), "doc"),
                     "doc", width_, compression="zstd")
    spans = repeated_spans(texts, width)
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("tie", "lo", "hi")).alias("ranges"))
    joined = texts.join(lists, "doc", "left")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            out: dict = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            ranges, texts = cols["ranges"], cols["text"].cast(pa.binary()).to_pylist()
            ties = cols["tie"].to_pylist()
            for i, raw in enumerate(texts):
                gone = np.zeros(len(raw) + 1, np.int32)
                if ranges[i].is_valid:
                    flat = ranges[i].values
                    own = flat.field(0).to_numpy(zero_copy_only=False) == ties[i]
                    lo, hi = (flat.field(k).to_numpy(zero_copy_only=False)[own] for k in (1, 2))
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, hi + width, -1)
                cover = np.cumsum(gone)[:len(raw)] > 0
                rest = np.frombuffer(raw, np.uint8)[~cover].tobytes()
                for k, x in (("n_bytes", len(raw)), ("n_removed", int(cover.sum())),
                             ("n_spans", int((cover & ~np.concatenate([[False], cover[:-1]])).sum()) if len(raw) else 0),
                             ("kept_sha256", hashlib.sha256(rest).hexdigest()), ("kept", rest)):
                    out[k].append(x)
            yield {"doc": cols["doc"], **out}

    rows = map_rows(joined.select("doc", "tie", "text", "ranges"),
                    "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", work)
    return rows.select(F.when(F.col("doc") == _LOWEST, None).otherwise(F.col("doc")).alias(id_col), "n_bytes",
                       "n_removed", "n_spans", "kept_sha256", "kept")
