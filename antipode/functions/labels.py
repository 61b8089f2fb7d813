"""Label maps: ``ARRAY<STRUCT<pos: INT, label: STRING>>`` with labels R and S."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_list(labels: Column) -> Column:
    """Sorted positions that carry a label."""
    return F.array_sort(F.transform(labels, lambda x: x["pos"]))


def site_key(labels: Column) -> Column:
    """Text key of the labelled positions."""
    return F.array_join(F.transform(site_list(labels), lambda p: p.cast("string")), ",")


def label_code(labels: Column) -> Column:
    """Labels in position order, such as ``RSR``."""
    return F.array_join(F.transform(F.array_sort(labels), lambda x: x["label"]), "")


def code_at(labels: Column, positions: Column) -> Column:
    """Labels in position order, restricted to ``positions``."""
    kept = F.filter(F.array_sort(labels), lambda x: F.array_contains(positions, x["pos"]))
    return F.array_join(F.transform(kept, lambda x: x["label"]), "")


def mirror(code: Column) -> Column:
    """Every label swapped."""
    return F.translate(code, "RS", "SR")


def _flip(code: Column, p: Column) -> Column:
    return F.concat(
        F.substring(code, F.lit(1), p - 1),
        mirror(F.substring(code, p, F.lit(1))),
        F.substring(code, p + 1, F.length(code)),
    )


def _one_more_flip(d: int, all_positions: Column):
    """Extends a code with d - 1 flips by every later position."""
    def extend(s: Column) -> Column:
        return F.transform(
            F.filter(all_positions, lambda p: p > s["last"]),
            lambda p: F.struct(F.lit(d).alias("flips"), _flip(s["code"], p).alias("code"), p.alias("last")),
        )
    return extend


def flipped_codes(code: Column, max_flips: int, with_mirror: bool = True) -> Column:
    """Codes that differ from ``code`` in 1..max_flips positions, plus the full mirror.

    Array of ``struct(flips, code)``. The full mirror appears once, whatever
    ``max_flips`` is.
    """
    n = F.length(code)
    all_positions = F.sequence(F.lit(1), n)
    level = F.transform(
        F.when(n > 0, all_positions).otherwise(F.array().cast("array<int>")),
        lambda p: F.struct(F.lit(1).alias("flips"), _flip(code, p).alias("code"), p.alias("last")),
    )
    levels = [level] if max_flips > 0 else []
    for d in range(2, max_flips + 1):
        level = F.flatten(F.transform(level, _one_more_flip(d, all_positions)))
        levels.append(level)
    partial = [F.transform(F.filter(x, lambda s: s["flips"] < n),
                           lambda s: F.struct(s["flips"].alias("flips"), s["code"].alias("code"))) for x in levels]
    full = F.array(F.struct(n.alias("flips"), mirror(code).alias("code")))
    full = F.filter(full, lambda s: s["flips"] > 0)
    parts = ([full] if with_mirror else []) + partial
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def with_single_flips(code: Column) -> Column:
    """The code itself and every code that differs from it in one position."""
    n = F.length(code)
    return F.when(n > 0, F.concat(F.array(code), F.transform(F.sequence(F.lit(1), n), lambda p: _flip(code, p)))).otherwise(F.array(code))


def code_distance(a: Column, b: Column) -> Column:
    """Number of positions in which two codes of one length differ."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))),
                           lambda p: F.substring(a, p, F.lit(1)) != F.substring(b, p, F.lit(1))))


def code_chunk(code: Column, i: Column, chunks: int) -> Column:
    """The ``i``-th of ``chunks`` runs of positions of about equal length, from 0."""
    n = F.length(code)
    start = F.floor(i * n / chunks).cast("int")
    return F.substring(code, start + 1, F.floor((i + 1) * n / chunks).cast("int") - start)


def packed_code(code: Column) -> Column:
    """A code of at most 62 labels R and S as a number: bit 0 is its last label, set for R."""
    return F.conv(F.translate(code, "SR", "01"), 2, 10).cast("long")


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def chunk_mask(n: Column, i: int, chunks: int) -> Column:
    """The bits of ``packed_code`` that ``code_chunk`` takes from a code of ``n`` labels."""
    return _bit(n - F.floor(F.lit(i) * n / chunks)) - _bit(n - F.floor(F.lit(i + 1) * n / chunks))


def with_single_bit_flips(part: Column, mask: Column, n: Column) -> Column:
    """The number itself and every number that differs from it in one bit of ``mask``, of ``n`` bits."""
    inside = F.filter(F.transform(F.sequence(F.lit(0), n - 1), _bit), lambda b: mask.bitwiseAND(b) != 0)
    return F.concat(F.array(part), F.transform(inside, lambda b: part.bitwiseXOR(b)))


def common_differences(labels_a: Column, labels_b: Column) -> tuple[Column, Column]:
    """(number of shared positions, number of them with different labels)."""
    a, b = F.map_from_entries(labels_a), F.map_from_entries(labels_b)
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.size(shared), F.size(F.filter(shared, lambda p: a[p] != b[p]))


def relationship(labels_a: Column, labels_b: Column, n_a: Column, n_b: Column) -> Column:
    """``enantiomer`` if all shared labels differ, ``diastereomer`` if some do, else null."""
    shared, differing = common_differences(labels_a, labels_b)
    return (
        F.when((n_a != n_b) | (shared == 0) | (differing == 0), F.lit(None).cast("string"))
        .when(differing == shared, F.lit("enantiomer"))
        .otherwise(F.lit("diastereomer"))
    )


def label_sign(labels: Column) -> Column:
    """1, -1 or 0 as R outnumbers S, S outnumbers R, or neither."""
    r = F.size(F.filter(labels, lambda x: x["label"] == "R"))
    s = F.size(F.filter(labels, lambda x: x["label"] == "S"))
    return F.signum((r - s).cast("double"))


def balanced_labels(labels: Column, symmetry: Column) -> Column:
    """True when the R sites and the S sites fall in the same symmetry classes.

    ``symmetry`` maps a position to its class: ``MAP<INT, INT>``.
    """
    def classes(which: str) -> Column:
        return F.array_sort(F.transform(
            F.filter(labels, lambda x: x["label"] == which), lambda x: symmetry[x["pos"]]
        ))

    return (F.size(classes("R")) > 0) & (classes("R") == classes("S"))


def label_assignment(labels: Column, number: Column) -> Column:
    """Label map whose i-th position is R where bit i of ``number`` is set, else S."""
    return F.transform(F.array_sort(labels), lambda x, i: F.struct(
        x["pos"].alias("pos"),
        F.when(F.floor(number / F.pow(F.lit(2.0), i)) % 2 == 1, "R").otherwise("S").alias("label")))


def label_configurations(labels: Column, max_sites: int = 20) -> Column:
    """Every assignment of R and S to the labelled positions, as an array of label maps.

    More than ``max_sites`` positions are an error: the array would not fit a row. ``label_variants``
    gives them as rows.
    """
    top = F.pow(F.lit(2.0), F.size(labels)).cast("long") - 1
    numbers = F.when(F.size(labels) > max_sites, F.raise_error(F.lit(f"more than {max_sites} labelled positions"))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.least(top, F.lit(2**max_sites - 1))))
    return F.transform(numbers, lambda c: label_assignment(labels, c))


def transition_text(labels_a: Column, labels_b: Column) -> Column:
    """Changes at the differing positions, such as ``C1: R->S``."""
    a, b = F.map_from_entries(labels_a), F.map_from_entries(labels_b)
    places = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    changed = F.filter(places, lambda p: ~a[p].eqNullSafe(b[p]))
    return F.array_join(
        F.transform(changed, lambda p: F.concat(
            F.lit("C"), p.cast("string"), F.lit(": "),
            F.coalesce(a[p], F.lit("?")), F.lit("->"), F.coalesce(b[p], F.lit("?")),
        )),
        ", ",
    )
