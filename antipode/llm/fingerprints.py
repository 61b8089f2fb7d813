"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame operations only.

A document is a set of 64-bit digests of its paragraphs (lines, cut after sentence marks, Latin and CJK; a
piece longer than ``CUT_ABOVE`` is cut further at words, or in a very long word at characters, that their own
hash picks, so an edit moves no cut elsewhere). A sketch has three rows of cells; each digest is added to one
cell per row, as a count, an exclusive-or of digests and an exclusive-or of check values. The width of a
fingerprint grows with its document. To compare two, the wider is folded to the width of the narrower and
they are subtracted cell by cell: what they share is gone, and cells left with a single digest give it away.
Peeling takes such digests out of their other cells, row by row, until all cells are empty. If some stay, the
two texts differ in more than their fingerprints hold, and the pair is tried again with larger sketches and new
hashes.

Cells are rows of a table that is dealt out by document, so building, folding, subtracting and peeling all
run where the document lies, without another exchange. Digests are written once; pairs that failed are read again,
and the digests are dealt out once more for the fingerprints that are printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antipode.llm.common import bucket_of, bucketed, joined_in_place, range_cuts, shuffle_width

ROWS = 3
#: Pieces of more code points than this are cut further, words of more than ``WORD_ABOVE`` too.
CUT_ABOVE, WORD_ABOVE = 160, 64
#: One word, or one character of a long word, in so many ends a piece.
WORDS_PER_PIECE, CHARS_PER_PIECE = 12, 24
MARKS = "[.!?\\n。．！？；｡।]+"
_CUT = "\x01"
#: Rounds of peeling; each takes one row of cells, so three passes over all.
PEELS = 9
#: Shares of a range of documents; several small shares in a task even out what ranges of long texts would bring into one.
SHARES = 4
_LOWEST = -(2**63)


def _picked(unit: Column, one_in: int) -> Column:
    return F.when(F.pmod(F.xxhash64(unit), F.lit(one_in)) == 0, F.lit(_CUT)).otherwise(F.lit(""))


def _cut_long(piece: Column) -> Column:
    """Parts of a long piece, cut after words (characters of long words) that their hash picks; white space becomes one space."""
    by_char = lambda w: F.array_join(F.transform(F.split(w, ""), lambda c: F.concat(c, _picked(c, CHARS_PER_PIECE))), "")
    word = lambda w: F.concat(F.when(F.char_length(w) > WORD_ABOVE, by_char(w)).otherwise(w), _picked(w, WORDS_PER_PIECE))
    return F.split(F.array_join(F.transform(F.split(piece, "\\s+"), word), " "), _CUT)


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text: pieces between line ends and sentence marks, long ones cut, trimmed."""
    parts = F.flatten(F.transform(F.split(text, MARKS), lambda p: F.when(
        F.char_length(p) > CUT_ABOVE, _cut_long(p)).otherwise(F.array(p))))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _cell(digest: Column, row: int, width: Column, seed: int) -> Column:
    """Number of the cell of a digest in a row; widths are powers of two, so cells of a wide sketch fold into a narrow one."""
    return F.xxhash64(F.lit(31 * seed + row), digest).bitwiseAND(width.cast("long") - 1) * ROWS + row


def _check(digest: Column) -> Column:
    return F.xxhash64(F.lit(9973), digest)


def _width(n: Column, grow: int) -> Column:
    """Cells in a row for n differing digests: n or a little more, a power of two, doubled ``grow`` times."""
    return F.pow(F.lit(2), F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1)) * 0.75))) + F.lit(grow)).cast("long")


def subtract_cells(pairs: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Cells of sketch(own) minus sketch(other) of each pair: (keys, w, cell, n, x, c).

    ``pairs``: keys, w (cells in a row), own, other.
    """
    side = lambda col, sign: F.transform(F.col(col), lambda d: F.struct(d.alias("d"), F.lit(sign).alias("s")))
    rows = pairs.select(*keys, "w", F.inline(F.concat(side("own", 1), side("other", -1))))
    cells = rows.select(*keys, "w", "d", "s", _check(F.col("d")).alias("c"),
                        F.explode(F.array(*[_cell(F.col("d"), r, F.col("w"), seed) for r in range(ROWS)])).alias("cell"))
    return cells.groupBy(*keys, "w", "cell").agg(
        F.sum("s").alias("n"), F.bit_xor("d").alias("x"), F.bit_xor("c").alias("c"))


def sketch_cells(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Cells of the sketches of digest columns, each as wide as its document asks: (keys, w0.., side, cell, n, x, c).

    ``side`` is the place of the column in ``columns``; ``w0``.. are the widths of all of them.
    """
    widths = [_width(F.size(c), 1).alias(f"w{i}") for i, c in enumerate(columns)]
    side = lambda i, col: F.transform(F.col(col), lambda d: F.struct(d.alias("d"), F.lit(i).alias("side")))
    rows = table.select(*keys, *widths, F.inline(F.concat(*[side(i, c) for i, c in enumerate(columns)])))
    own = F.element_at(F.array(*[F.col(f"w{i}") for i in range(len(columns))]), F.col("side") + 1)
    by = [*keys, *[f"w{i}" for i in range(len(columns))], "side"]
    cells = rows.select(*by, "d", _check(F.col("d")).alias("c"),
                        F.explode(F.array(*[_cell(F.col("d"), r, own, 0) for r in range(ROWS)])).alias("cell"))
    return cells.groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("d").alias("x"), F.bit_xor("c").alias("c"))


def printed_sketches(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Fingerprints of the first sides as text, all that ``fold_and_subtract`` needs: width, then cells in order: (keys, names)."""
    text = F.concat(F.hex("cell"), F.lit("."), F.hex("n"), F.lit("."), F.hex("x"), F.lit("."), F.hex("c"))
    entry = F.struct("cell", text.alias("t"))
    return cells.where(F.col("side") < len(names)).groupBy(*keys, *[f"w{i}" for i in range(len(names))]).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("side") == i, entry))).alias(f"_{i}") for i in range(len(names))
    ]).select(*keys, *[
        F.when(F.size(f"_{i}") == 0, F.lit("")).otherwise(F.concat(
            F.hex(f"w{i}"), F.lit("|"), F.array_join(F.transform(F.col(f"_{i}"), lambda e: e.t), ":"))).alias(name)
        for i, name in enumerate(names)])


def fold_and_subtract(cells: DataFrame, keys: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Differences of sketches, the wider folded to the narrower: (keys, kind, w, cell, n, x, c); pair ``kind`` is (side, side)."""
    part = lambda kind, a, b, sign: F.struct(
        F.lit(kind).alias("kind"), F.least(f"w{a}", f"w{b}").alias("w"), (F.col("n") * sign).alias("n"))
    uses: dict[int, list[Column]] = {}
    for kind, (a, b) in enumerate(pairs):
        uses.setdefault(a, []).append(part(kind, a, b, 1))
        uses.setdefault(b, []).append(part(kind, a, b, -1))
    chosen = None
    for side, structs in uses.items():
        here = F.col("side") == side
        chosen = F.when(here, F.array(*structs)) if chosen is None else chosen.when(here, F.array(*structs))
    rows = cells.select(*keys, "cell", "x", "c", F.inline(chosen))
    folded = F.floor(F.col("cell") / ROWS).bitwiseAND(F.col("w") - 1) * ROWS + F.col("cell") % ROWS
    return rows.groupBy(*keys, "kind", "w", folded.alias("cell")).agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"))


def peel(cells: DataFrame, keys: list[str], seed: int, peels: int = PEELS) -> DataFrame:
    """(keys, only_a, only_b, ok): recovered digests on either side, and whether every cell came out empty.

    A round takes the cells of one row of the sketch that hold a
    single digest: a digest has one cell per row, so none is taken out twice. What was
    recovered is summed up in a cell of its own, numbered -1.
    """
    now = cells.select(*keys, "w", "cell", "n", "x", "c", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("m"))
    zero = F.lit(0).cast("long")
    for i in range(peels):
        row = i % ROWS
        pure = (F.col("cell") % ROWS == row) & (F.col("cell") >= 0) & (F.abs("n") == 1) & (F.col("c") == _check(F.col("x")))
        entry = lambda cell, n, x, c, p, m: F.struct(cell.alias("cell"), n.alias("n"), x.alias("x"), c.alias("c"),
                                                     p.alias("p"), m.alias("m"))
        taken = F.array(
            entry(F.lit(-1).cast("long"), zero, zero, zero, (F.col("n") == 1).cast("long"), (F.col("n") == -1).cast("long")),
            *[entry(_cell(F.col("x"), r, F.col("w"), seed), -F.col("n"), F.col("x"), F.col("c"), zero, zero)
              for r in range(ROWS) if r != row])
        stays = F.array(entry(F.col("cell"), F.col("n"), F.col("x"), F.col("c"), F.col("p"), F.col("m")))
        now = now.select(*keys, "w", F.inline(F.when(pure, taken).otherwise(stays)))
        now = now.groupBy(*keys, "w", "cell").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c"),
                                                  F.sum("p").alias("p"), F.sum("m").alias("m"))
        now = now.where("cell < 0 or n <> 0 or x <> 0 or c <> 0")
    return now.groupBy(*keys).agg(F.sum("p").alias("only_a"), F.sum("m").alias("only_b"), F.max("cell").alias("_top")).select(
        *keys, "only_a", "only_b", (F.col("_top") < 0).alias("ok"))


def with_next_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, pos, id, text, digests, next_text, next) with ``next`` the digests of the next text: the next document by descending id, the first after the last.

    Ids are cut into ranges by a quantile sketch. Each range also gets the first document of the
    range below it, so one exchange of the texts puts every document beside its
    successor. Null ids come last; ties go by the text's hash.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = 2 * shuffle_width(spark)
    cuts = range_cuts(narrow, "id", pieces)
    placed = narrow.withColumn("bucket", bucket_of("id", cuts))
    # at most `pieces` rows: the largest id of each range
    tops = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.max("id")).collect())
    if not tops:
        tops = [(0, 0)]
    above = {tops[i][1]: tops[(i + 1) % len(tops)][0] for i in range(len(tops))}
    extra = spark.createDataFrame([(k, v) for k, v in above.items()], "top long, upper int")
    first = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    both = F.array(first, F.struct(F.col("upper").alias("bucket"), F.lit(1).alias("guest")))
    dealt = (
        placed.join(F.broadcast(extra), F.col("id") == F.col("top"), "left")
        .select("id", "text", F.explode(F.when(F.col("upper").isNull(), F.array(first)).otherwise(both)).alias("at"))
        .select(F.col("at.bucket").alias("bucket"), F.col("at.guest").alias("guest"), "id", "text")
        .repartition(pieces, "bucket").withColumn("row_key", F.xxhash64("text"))
    )
    down = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc(), "row_key")
    return (
        dealt.withColumn("digests", paragraph_digests(F.col("text")))
        .withColumn("next_text", F.lead("text").over(down)).withColumn("next", F.lead("digests").over(down))
        .withColumn("pos", F.row_number().over(down)).where("guest = 0").drop("guest"))


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as many code points from the start of the next one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def likeness(own: Column, other: Column, only_own: Column, only_other: Column) -> Column:
    """Shared digests over all digests; two empty sets are alike."""
    union = own + only_other
    return F.when(union == 0, F.lit(1.0)).otherwise((own - only_own) / union)


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text's are.

    Output: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty. Texts without a
    paragraph have the empty fingerprint and are alike. Rows that repeat an id
    are documents of their own; null ids come last. The likenesses come from subtracting the printed fingerprints;
    a pair that these cannot settle is tried with sketches for the digests of both, then at twice the size until none is left.
    """
    spark = docs.sparkSession
    rows = with_next_text(docs, id_col, text_col).withColumn("bucket", F.col("bucket") * SHARES + F.pmod("pos", F.lit(SHARES)))
    keys = ["bucket", "pos"]
    base = rows.select(*keys, "id", F.char_length("text").cast("long").alias("n_chars"),
                       F.col("digests").alias("own"), "next",
                       edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    base = base.select(*keys, "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next",
                       paragraph_digests(F.col("edited")).alias("changed"))
    buckets = 2 * shuffle_width(spark)
    stored = bucketed(base, "bucket", buckets)
    by = [*keys, "kind"]
    sides = ["own", "changed", "next"]
    prints = sketch_cells(stored, keys, sides)
    tried = bucketed(peel(fold_and_subtract(prints, keys, [(0, 1), (0, 2)]), by, seed=0), "bucket", buckets)
    table = stored.select(*keys, F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), "own", F.col("changed").alias("other")),
        F.struct(F.lit(1).alias("kind"), "own", F.col("next").alias("other")))))
    found, grow = tried.where("ok").drop("ok"), 0
    while not (failed := tried.where("not ok").select(*by)).isEmpty():
        sized = table.join(failed, by, "left_semi").withColumn("w", _width(F.size("own") + F.size("other"), grow))
        grow += 1
        with joined_in_place(spark):  # both tables are bucketed alike
            tried = bucketed(peel(subtract_cells(sized, by, seed=grow), by, seed=grow), "bucket", buckets)
        found = found.unionByName(tried.where("ok").drop("ok"))
    near = found.repartition(buckets, *keys).groupBy(*keys).agg(*[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}_{k}")
                                      for k in (0, 1) for c in ("only_a", "only_b")])
    # the digests are dealt out as the last join needs them, so that no fingerprint, ten times their size, is exchanged
    placed = stored.select(*keys, "own", "changed").repartition(buckets, *keys)
    printed = printed_sketches(sketch_cells(placed, keys, sides[:2]), keys, ["fingerprint", "edited_fingerprint"])
    sizes = [F.size(c).alias(f"n_{c}") for c in sides]
    out = stored.select(*keys, "id", "n_chars", "edited_sha256", *sizes).repartition(buckets, *keys)
    out = out.join(near, keys, "left").join(printed, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.when(F.col("id") == _LOWEST, None).otherwise(F.col("id")).alias(id_col), "n_chars", "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("n_own"), F.col("n_changed"), zero("only_a_0"), zero("only_b_0")).alias("near_edited"),
        likeness(F.col("n_own"), F.col("n_next"), zero("only_a_1"), zero("only_b_1")).alias("near_next"))
