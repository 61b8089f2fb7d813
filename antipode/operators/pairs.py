"""Pair discovery: entities of one class whose label maps oppose each other.

Unless all pairs of a class are asked for, they are not found by comparing its members.
Each form looks up the label codes it can be paired with, or chunks of long codes, so the
work follows the number of result rows and the join key is as fine as (class, sites, code).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antipode.functions import labels as L
from antipode.scale import first_per_group, materialize


def with_defined_labels(entities: DataFrame, labels: str = "labels") -> DataFrame:
    """Entities with at least one label."""
    return entities.where(F.size(labels) > 0)


def distinct_forms(entities: DataFrame) -> DataFrame:
    """First entity per (class_key, canonical), by id, with its site key and label code."""
    firsts = first_per_group(
        entities.select("class_key", "canonical", "id", "n_centers", "labels"), ["class_key", "canonical"], ["id"]
    )
    return firsts.withColumn("sites", L.site_key(F.col("labels"))).withColumn("code", L.label_code(F.col("labels")))


def class_sizes(entities: DataFrame, min_size: int = 2) -> DataFrame:
    """Members and distinct forms per class, with the number of unordered form pairs."""
    per_form = entities.groupBy("class_key", "canonical").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_form.groupBy("class_key")
        .agg(F.sum("n").alias("n_members"), F.count(F.lit(1)).alias("n_forms"))
        .withColumn("n_form_pairs", F.floor(F.col("n_forms") * (F.col("n_forms") - 1) / 2))
        .where(F.col("n_members") >= min_size)
    )


def _uneven_sites(forms: DataFrame) -> DataFrame:
    """Unordered pairs of different site sets of a class that share a position.

    Works on the distinct site sets only. Classes whose members label the same
    positions (the usual case) give no row.
    """
    sets = forms.where(F.col("sites") != "").groupBy("class_key", "n_centers", "sites").agg(
        F.first(L.site_list(F.col("labels"))).alias("positions")
    )
    spread = sets.withColumn("pos", F.explode("positions"))
    other = spread.select("class_key", "n_centers", "pos", F.col("sites").alias("sites_b"),
                          F.col("positions").alias("positions_b"))
    return (
        spread.join(other, ["class_key", "n_centers", "pos"])
        .where(F.col("sites") < F.col("sites_b"))
        .select("class_key", "n_centers", F.col("sites").alias("sites_a"), "sites_b",
                F.array_intersect("positions", "positions_b").alias("common"))
        .distinct()
    )


def _uneven_forms(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms of both sides of each uneven site pair, coded on the shared positions."""
    uneven = _uneven_sites(forms)

    def side(name: str) -> DataFrame:
        return forms.join(
            uneven.withColumnRenamed(f"sites_{name}", "sites"), ["class_key", "n_centers", "sites"]
        ).select(
            "class_key", "n_centers", F.col("sites").alias(f"sites_{name}"),
            f"sites_{'b' if name == 'a' else 'a'}",
            "id", L.code_at(F.col("labels"), F.col("common")).alias("code"),
        )

    return side("a"), side("b")


#: Most codes a form may look up one by one; longer codes are looked up by chunks.
MAX_LOOKUPS = 256
#: Longest code held as the bits of one long.
PACKED_SITES = 60


def _longest_looked_up(max_flips: int) -> int:
    """Longest code with at most ``MAX_LOOKUPS`` codes in 1..max_flips flips."""
    n = 0
    while sum(math.comb(n + 1, i) for i in range(1, min(max_flips, n + 1) + 1)) <= MAX_LOOKUPS:
        n += 1
        if n > MAX_LOOKUPS:
            break
    return n


def _by_codes(left: DataFrame, right: DataFrame, keys: list[str], max_flips: int) -> DataFrame:
    """Each form asks for the codes it can be paired with: its mirror code, and one per set of flipped positions."""
    wanted = L.flipped_codes(F.col("code"), max_flips)
    asked = left.select(*keys, F.col("id").alias("x_id"), F.length("code").alias("n_shared"),
                        F.explode(wanted).alias("w")).select(
        *keys, "x_id", "n_shared", F.col("w.flips").alias("n_flips"), F.col("w.code").alias("code"))
    return asked.join(right.select(*keys, "code", F.col("id").alias("y_id")), [*keys, "code"])


def _by_chunks(left: DataFrame, right: DataFrame, keys: list[str], max_flips: int) -> DataFrame:
    """Partially inverted pairs of long codes.

    Of (max_flips + 2) // 2 chunks, two codes with at most ``max_flips`` differences have one with at most one
    difference. A form asks for each chunk and its single flips: some n rows instead of one per set of flips.
    A pair that meets in several chunks counts in the first.
    """
    chunks = (max_flips + 2) // 2
    numbered = lambda df, name: df.select(*keys, F.col("id").alias(f"{name}_id"), F.col("code").alias(f"{name}_code"),
                                          F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    asked = numbered(left, "x").withColumn("part", F.explode(L.with_single_flips(L.code_chunk(F.col("x_code"), F.col("chunk"), chunks))))
    stored = numbered(right, "y").withColumn("part", L.code_chunk(F.col("y_code"), F.col("chunk"), chunks))
    met = asked.join(stored, [*keys, "chunk", "part"])
    near = lambda i: L.code_distance(L.code_chunk(F.col("x_code"), i, chunks), L.code_chunk(F.col("y_code"), i, chunks)) <= 1
    earlier = F.filter(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda i: (i < F.col("chunk")) & near(i))
    flips = met.where(F.size(earlier) == 0).withColumn("n_shared", F.length("x_code")).withColumn(
        "n_flips", L.code_distance(F.col("x_code"), F.col("y_code")))
    return flips.where(F.col("n_flips").between(1, max_flips) & (F.col("n_flips") < F.col("n_shared"))).drop("chunk", "part", "x_code", "y_code")


def _by_packed_chunks(left: DataFrame, right: DataFrame, keys: list[str], max_flips: int) -> DataFrame:
    """``_by_chunks`` for codes of at most ``PACKED_SITES`` labels R and S: a code is a long, and a pair that meets costs a few bit operations."""
    chunks = (max_flips + 2) // 2
    masks = [f"m{i}" for i in range(chunks)]
    packed = lambda df, name: df.select(*keys, F.col("id").alias(f"{name}_id"), L.packed_code(F.col("code")).alias(f"{name}_bits"),
                                        F.length("code").alias("n"), *[L.chunk_mask(F.length("code"), i, chunks).alias(m) for i, m in enumerate(masks)])
    mask = F.when(F.lit(False), F.lit(None).cast("long"))
    for i, m in enumerate(masks):
        mask = mask.when(F.col("chunk") == i, F.col(m))
    numbered = lambda df, name: packed(df, name).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn(
        "part", F.col(f"{name}_bits").bitwiseAND(mask))
    asked = numbered(left, "x").withColumn("part", F.explode(L.with_single_bit_flips(F.col("part"), mask, F.col("n"))))
    stored = numbered(right, "y").drop("n", *masks)
    on = [*keys, "chunk", "part"]
    named = stored.select(*[F.col(c).alias(f"_y_{c}") for c in on], "y_id", "y_bits")
    differ = F.col("x_bits").bitwiseXOR(F.col("y_bits"))
    met = F.lit(True)
    for c in on:
        met = met & (F.col(c) == F.col(f"_y_{c}"))
    met = met & F.bit_count(differ).between(1, max_flips) & (F.bit_count(differ) < F.col("n"))
    for i, m in enumerate(masks[:-1]):  # not met in an earlier chunk
        met = met & ((F.col("chunk") <= i) | (F.bit_count(differ.bitwiseAND(F.col(m))) > 1))
    return asked.join(named, met).select(*keys, "x_id", "y_id", F.col("n").alias("n_shared"), F.bit_count(differ).alias("n_flips"))


def _all_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of different codes: all that share the keys belong to the result, so the join is as large as it is."""
    met = left.select(*keys, F.col("id").alias("x_id"), F.col("code").alias("x_code")).join(
        right.select(*keys, F.col("id").alias("y_id"), F.col("code").alias("y_code")), keys).where(
        (F.col("x_code") != F.col("y_code")) & (F.length("x_code") > 0))
    return met.withColumn("n_shared", F.length("x_code")).withColumn("n_flips", L.code_distance(F.col("x_code"), F.col("y_code")))


def related_pairs(entities: DataFrame, max_flips: int | None = None, uneven_sites: bool = True) -> DataFrame:
    """Pairs of distinct forms in one class, with their relationship.

    All pairs are found, for whatever number of sites the data has. A number for ``max_flips``
    asks for less: mirror pairs (all shared labels differ) and the pairs that differ in
    1..max_flips of their shared positions. These are looked up by code or, where that would be many
    codes, by chunks of the code, so no other pair is formed in number.
    Output: class_key, a_id, b_id (a first), relationship, n_flips.
    """
    forms = distinct_forms(with_defined_labels(entities))
    cols = ["class_key", "x_id", "y_id", "n_shared", "n_flips"]
    limit = 0 if max_flips is None else _longest_looked_up(max_flips)
    # the forms are written once: both sides of the look-up and the longest code read them
    any_long, by_chunks = False, _by_chunks
    if max_flips is not None:
        forms = materialize(forms, "forms")
        longest, plain = forms.agg(F.max(F.length("code")), F.bool_and(F.col("code").rlike("^[RS]*$"))).first()
        any_long = (longest or 0) > limit
        if plain and longest <= PACKED_SITES:
            by_chunks = _by_packed_chunks

    def look_up(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        if max_flips is None:
            return _all_of(left, right, keys).select(*cols)
        if not any_long:
            return _by_codes(left, right, keys, max_flips).select(*cols)
        short = F.length("code") <= limit
        return _by_codes(left.where(short), right.where(short), keys, max_flips).select(*cols).unionByName(
            _by_codes(left.where(~short), right.where(~short), keys, 0).select(*cols)).unionByName(
            by_chunks(left.where(~short), right.where(~short), keys, max_flips).select(*cols))

    found = look_up(forms, forms, ["class_key", "n_centers", "sites"]).where(F.col("x_id") < F.col("y_id"))
    if uneven_sites:
        left, right = _uneven_forms(forms)
        found = found.unionByName(look_up(left, right, ["class_key", "n_centers", "sites_a", "sites_b"]))
    return found.select(
        "class_key",
        F.least("x_id", "y_id").alias("a_id"),
        F.greatest("x_id", "y_id").alias("b_id"),
        F.when(F.col("n_flips") == F.col("n_shared"), "enantiomer").otherwise("diastereomer").alias("relationship"),
        F.col("n_flips").cast("int").alias("n_flips"),
    )


def pair_filter(pairs: DataFrame, include_partial: bool = True) -> DataFrame:
    """Drop pairs without a relationship and, if asked, the partially inverted ones."""
    kept = pairs.where(F.col("relationship").isNotNull())
    return kept if include_partial else kept.where(F.col("relationship") == "enantiomer")


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Relationship of given pairs, from the label maps of both sides."""
    return pairs.withColumn(
        "relationship",
        L.relationship(F.col("a_labels"), F.col("b_labels"), F.col("a_n_centers"), F.col("b_n_centers")),
    )


def relationship_counts(entities: DataFrame) -> DataFrame:
    """Exact number of pairs per class and relationship, for classes that have any, without forming pairs.

    From the number of forms per code: all pairs, minus those with equal codes,
    minus the mirror pairs, leaves the partially inverted ones.
    """
    forms = distinct_forms(with_defined_labels(entities))
    keys = ["class_key", "n_centers", "sites"]
    codes = forms.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("m"))
    partner = codes.select(*keys, L.mirror(F.col("code")).alias("code"), F.col("m").alias("m_mirror"))
    even = (
        codes.join(partner, [*keys, "code"], "left")
        .groupBy(*keys)
        .agg(
            F.sum("m").alias("n"),
            (F.sum(F.col("m") * (F.col("m") - 1)) / 2).alias("same"),
            (F.sum(F.col("m") * F.coalesce("m_mirror", F.lit(0))) / 2).alias("mirrored"),
        )
        .select("class_key", "mirrored",
                (F.col("n") * (F.col("n") - 1) / 2 - F.col("same") - F.col("mirrored")).alias("partial"))
    )
    left, right = _uneven_forms(forms)
    ukeys = ["class_key", "n_centers", "sites_a", "sites_b"]
    a = left.groupBy(*ukeys, "code").agg(F.count(F.lit(1)).alias("m_a"))
    b = right.groupBy(*ukeys, "code").agg(F.count(F.lit(1)).alias("m_b"))
    back = b.select(*ukeys, L.mirror(F.col("code")).alias("code"), F.col("m_b").alias("m_mirror"))
    per_code = a.join(b, [*ukeys, "code"], "left").join(back, [*ukeys, "code"], "left").groupBy(*ukeys).agg(
        F.sum("m_a").alias("n_a"),
        F.sum(F.col("m_a") * F.coalesce("m_b", F.lit(0))).alias("same"),
        F.sum(F.col("m_a") * F.coalesce("m_mirror", F.lit(0))).alias("mirrored"),
    )
    n_b = b.groupBy(*ukeys).agg(F.sum("m_b").alias("n_b"))
    uneven = per_code.join(n_b, ukeys).select(
        "class_key", "mirrored",
        (F.col("n_a") * F.col("n_b") - F.col("same") - F.col("mirrored")).alias("partial"),
    )
    return even.unionByName(uneven).groupBy("class_key").agg(
        F.sum("mirrored").cast("long").alias("n_enantiomer"), F.sum("partial").cast("long").alias("n_diastereomer")
    ).where(F.col("n_enantiomer") + F.col("n_diastereomer") > 0)


def single_flip_pairs(entities: DataFrame) -> DataFrame:
    """Ordered pairs (from, to) of one class whose label maps differ at exactly one site."""
    forms = distinct_forms(with_defined_labels(entities))
    keys = ["class_key", "sites"]
    flips = F.transform(
        F.sequence(F.lit(1), F.length("code")),
        lambda p: F.concat(
            F.substring(F.col("code"), F.lit(1), p - 1),
            L.mirror(F.substring(F.col("code"), p, F.lit(1))),
            F.substring(F.col("code"), p + 1, F.length("code")),
        ),
    )
    asked = forms.select(*keys, F.col("id").alias("from_id"), F.posexplode(flips).alias("site_no", "code"))
    return asked.join(forms.select(*keys, "code", F.col("id").alias("to_id")), [*keys, "code"]).select(
        "class_key", "from_id", "to_id", "site_no"
    )


def label_variants(entities: DataFrame) -> DataFrame:
    """One row per possible label map of each entity, marking its own; 2 to the number of sites, as rows."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.size("labels")).cast("long") - 1))
    numbered = entities.select("id", "class_key", "labels", number.alias("_v"))
    return numbered.select("id", "class_key", "labels", L.label_assignment(F.col("labels"), F.col("_v")).alias("variant")).select(
        "id", "class_key", L.label_code(F.col("variant")).alias("variant_code"),
        (L.label_code(F.col("variant")) == L.label_code(F.col("labels"))).alias("is_original"),
    )
