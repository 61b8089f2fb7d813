"""Near-duplicate documents: a signature-coordinate inverted join.

Every document is posted under each (coordinate, value) of its MinHash signature.
Collisions per pair are what the postings of two documents share. With a match
threshold T of K coordinates two rules keep the lists short and lose no pair:

* prefix: a pair with T matches shares a posting among the K - T + 1 rarest
  postings of either side, so only those are merged; a document with fewer than T
  postings that anybody shares leaves at once;
* skip: a list whose documents are already linked with each other is skipped. Each
  list is first merged around pivots, the links found are contracted, and only
  pairs across what is still apart are merged, if their members leave room for a link. So a group of thousands
  of near copies costs a few passes over its members, not all its pairs.

Candidates are confirmed on their full shingle sets. Documents with equal sets are
one class from the start and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antipode.llm.common import map_rows, materialize
from antipode.llm.components import connected_components
from antipode.scale import broadcast_if_small

COORDINATES = 48
#: A pair exactly at the threshold is lost with this probability at most.
MISS_RATE = 1e-6
PIVOT_ROUNDS = 3
RARE = 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    A-Z are lower-cased; words are runs other than ASCII white space. Fewer words
    than ``width`` are one shingle; no word gives an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n] + np.uint64(i + 1))
    return np.unique(out)


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return (rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, k, dtype=np.uint64))


def match_threshold(percent: int, k: int = COORDINATES, miss: float = MISS_RATE) -> int:
    """Most matches of ``k`` coordinates that a pair of ``percent`` similarity reaches but for the rate ``miss``; 1 at least.

    Matches of such a pair are binomial: 24 of 48 at 80 percent (8e-7 lost), 27 at 85 (4e-7).
    """
    p, below = percent / 100, 0.0
    for t in range(k):
        below += comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, k: int = COORDINATES) -> DataFrame:
    """(id, n_shingles, k1, k2, sig): set size, 128-bit key of the set, MinHash values (null for empty sets)."""
    a, b = _coefficients(k)

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            sets = [shingle_set(t, width) for t in cols["text"].to_pylist()]
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            sig = np.zeros((len(full), k), np.int64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                k1[full] = np.add.reduceat(_mix(every), starts).view(np.int64)
                k2[full] = np.bitwise_xor.reduceat(_mix(every + np.uint64(77)), starts).view(np.int64)
                for i in range(k):
                    sig[:, i] = np.minimum.reduceat(every * a[i] + b[i], starts).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, k, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.ravel()),
                                             mask=pa.array(n == 0))
            yield {"id": cols["id"], "n_shingles": n, "k1": k1, "k2": k2, "sig": lists}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                    "id long, n_shingles long, k1 long, k2 long, sig array<long>", work)


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, members) of the documents named in ``ids``; one row per id."""
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(
        broadcast_if_small(ids), "id", "left_semi")

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for cols in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in cols["text"].to_pylist()]
            yield {"id": cols["id"], "members": sets}

    return map_rows(wanted, "id long, members array<long>", work)


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs (a, b) that share ``matches`` coordinates and whose full sets are similar enough."""
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    close = pairs.join(left, "a").join(right, "b").where(same >= matches).select("a", "b")
    close = materialize(close, "candidates")
    common = F.size(F.array_intersect("ma", "mb"))
    return (
        close.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
        .where(100 * common >= percent * (F.size("ma") + F.size("mb") - common))
        .select("a", "b")
    )


def _last_pairs(lists: DataFrame, sets: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs (a, b) of different components that can still reach the threshold. ``lists``: id, post, c.

    Members that at most ``rare`` of these documents have are rare, the others common. A pair that
    shares no rare member has at most the common members of either side in common, which bounds
    the merge of the lists. A pair that shares some meets in the prefixes of the rare
    members, rarest first: the first shared one stands before as many members as
    the pair still needs. Both are exact, for any value of ``rare``.
    """
    comp = lists.select("id", "c").distinct()
    members = sets.join(comp, "id").select("id", "c", F.size("members").alias("n"), F.explode("members").alias("s"))
    df = members.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    doc = Window.partitionBy("id")
    common = F.sum((F.col("df") > rare).cast("int"))
    tagged = members.join(df, "s").withColumn("e", common.over(doc)).withColumn("r", F.count(F.lit(1)).over(doc) - F.col("e"))
    tagged = tagged.withColumn("k", F.row_number().over(doc.orderBy("df", "s")))
    need = F.greatest(F.ceil(F.col("n") * percent / 100) - F.col("e"), F.lit(1))  # rare members to share, at least
    in_prefix = (F.col("df") <= rare) & (F.col("k") <= F.col("r") - need + 1)
    ranked = materialize(tagged.withColumn("p", in_prefix).where("p or k = 1"), "ranked")

    def meet(rows: DataFrame, key: str, keep: Column) -> DataFrame:
        other = rows.select(*[F.col(c).alias(c if c == key else f"_{c}") for c in rows.columns])
        close = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
        return rows.join(other, [key]).where((F.col("id") < F.col("_id")) & (F.col("c") != F.col("_c")) & close & keep).select(
            F.col("id").alias("a"), F.col("_id").alias("b"))

    by_rare = meet(ranked.where("p").select("id", "c", "n", "s"), "s", F.lit(True))
    sizes = ranked.where("k = 1").select("id", "n", "e").where(100 * F.col("e") >= percent * F.col("n"))
    posts = lists.groupBy("id").agg(F.collect_set("post").alias("posts"))  # a prefix: fewer than the coordinates
    by_list = meet(
        lists.join(sizes, "id").join(posts, "id").select("id", "c", "n", "e", "posts", "post"), "post",
        ((100 + percent) * F.least("e", "_e") >= percent * (F.col("n") + F.col("_n")))
        & (F.col("post") == F.array_min(F.array_intersect("posts", "_posts"))))  # once per pair
    return by_rare.unionByName(by_list).distinct()


def near_duplicate_links(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80,
                         k: int = COORDINATES, matches: int | None = None,
                         rounds: int = PIVOT_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` has (id, n_shingles, rep) per row, ``links`` (a, b) between reps.

    ``rep`` is the smallest id with the same shingle set, null for empty sets. The
    links join what is connected; pairs inside an already connected group need not
    all be listed. Rows with a null id keep ``rep`` null. Documents need unique ids
    to be told apart; rows repeating an id and text fall into one class. ``matches`` is
    ``match_threshold`` of ``percent`` and ``k`` if not given.
    """
    matches = match_threshold(percent, k) if matches is None else matches
    rows = materialize(signatures(docs, id_col, text_col, width, k), "signatures")
    filled = rows.where("n_shingles > 0 and id is not null")
    key = ["k1", "k2", "n_shingles"]
    classes = materialize(filled.groupBy(*key).agg(F.min("id").alias("rep"), F.min_by("sig", "id").alias("sig")),
                          "classes")
    members = rows.join(classes.drop("sig"), key, "left").select(
        "id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("rep")).alias("rep"))

    sigs = classes.select(F.col("rep").alias("id"), "sig")
    posts = sigs.select("id", F.posexplode("sig").alias("i", "v")).select("id", F.xxhash64("i", "v").alias("post"))
    shared = materialize(posts.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    kept = posts.join(shared, "post")
    by_doc = Window.partitionBy("id")
    prefix = materialize(
        kept.withColumn("n", F.count(F.lit(1)).over(by_doc)).where(F.col("n") >= matches)
        .withColumn("r", F.row_number().over(by_doc.orderBy("df", "post")))
        .where(F.col("r") <= F.col("n") - (matches - 1)).select("id", "post").distinct(), "prefixes")

    ids = materialize(prefix.select("id").distinct(), "in_prefix")
    sigs = materialize(sigs.join(broadcast_if_small(ids), "id", "left_semi"), "prefix_signatures")
    sets = materialize(_sets_of(docs, ids, id_col, text_col, width).dropDuplicates(["id"]), "sets")

    links = None
    for turn in range(rounds + 1):
        lists = prefix if links is None else prefix.join(
            connected_components(links, "a", "b"), F.col("id") == F.col("node"), "left").select(
                "id", "post", F.coalesce("component", "id").alias("c"))
        if links is None:
            lists = lists.withColumn("c", F.col("id"))
        # a list that lies in one component is skipped
        lists = materialize(lists, "lists")
        open_lists = lists.groupBy("post").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
        if turn < rounds:
            order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
            pivots = lists.groupBy("post").agg(F.min_by(F.struct("id", "c"), order).alias("p"))
            pivots = materialize(pivots.join(open_lists, "post", "left_semi"), "pivots")
            pairs = lists.join(pivots, "post").where(F.col("c") != F.col("p.c")).select(
                F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        else:
            left = materialize(lists.join(open_lists.select("post"), "post", "left_semi"), "open_lists")
            pairs = _last_pairs(left, sets, percent)
        found = _confirmed(materialize(pairs, "pairs"), sigs, sets, matches, percent)
        links = materialize(found if links is None else links.unionByName(found), "links")
    return members, links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, k: int = COORDINATES, matches: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Linked are documents whose shingle sets satisfy
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest id
    reachable over links, ``kept`` marks the document that stands for its component.
    Null or wordless texts have an empty set and link with nothing, a null id links
    with nothing and is kept. An empty table gives an empty result.
    """
    members, links = near_duplicate_links(docs, id_col, text_col, width, percent, k, matches)
    comp = materialize(connected_components(links, "a", "b"), "components")
    return members.join(comp, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.coalesce("component", "rep", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "rep", "id") == F.col("id"), F.lit(True)).alias("kept"))
