"""Rule tables: tags, property classes, risk levels, scores and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords per pathway, tried in this order.
PATHWAY_KEYWORDS = {
    "Wnt": ("wnt", "frizzled", "beta-catenin", "beta catenin", "dishevelled", "gsk-3", "gsk3", "axin"),
    "Notch": ("notch", "gamma-secretase", "gamma secretase", "presenilin", "nicastrin"),
    "Hedgehog": ("hedgehog", "smoothened", "patched", " shh ", "gli1", "gli2"),
    "BMP_TGF": ("bone morphogenetic", "bmp receptor", "smad", "tgf-beta", "tgf beta",
                "transforming growth factor", "tgfbr", "alk5", "alk-5"),
    "FGF": ("fibroblast growth factor", "fgfr", "fgf receptor"),
    "VEGF": ("vascular endothelial growth factor", "vegfr", "vegf receptor", "kdr"),
    "EGFR": ("epidermal growth factor", "egfr", "erbb", "her2", "her-2"),
    "Bcl2": ("bcl-2", "bcl2", "bcl-xl", "bclxl", "mcl-1", "mcl1"),
    "mitophagy": ("pink1", "parkin", "mitophagy", "mitochondrial"),
    "autophagy": ("autophagy", "lc3", "beclin", " atg ", "ulk1"),
    "PARP": (" parp", "poly(adp", "poly-adp"),
    "telomerase": ("telomerase", " tert "),
    "stem_cell": ("stem cell", "oct4", "sox2", "nanog", "klf4"),
    "DNA_repair": ("dna repair", "base excision", "nucleotide excision", "brca"),
}

# Fixed values: (property, measurement kinds, target keywords, keyword also needed), tried in this order.
PROPERTY_RULES = (
    ("metabolic_stability", ("CLint", "T1/2"),
     ("microsomal", "metabolic stability", "clearance", "liver microsome"), False),
    ("cyp_inhibition", ("IC50",), ("cyp", "cytochrome", "p450"), True),
    ("herg", ("IC50", "EC50"), ("herg", "kcnh2", "potassium channel"), True),
    ("plasma_protein_binding", ("fu", "Plasma protein binding"),
     ("plasma protein", "serum albumin", "protein binding"), False),
    ("solubility", ("Solubility",), ("solubility", "aqueous"), False),
)

# Fixed values: (property, high-risk threshold, moderate-risk threshold, lower values are worse).
RISK_THRESHOLDS = (
    ("metabolic_stability", 100.0, 30.0, False),
    ("cyp_inhibition", 1.0, 10.0, True),
    ("herg", 10.0, 30.0, True),
    ("plasma_protein_binding", 1.0, 5.0, True),
    ("solubility", 1.0, 10.0, True),
)

# Reaction patterns in lower text, tried in this order.
REACTION_PATTERNS = (
    ("hydrogenation", ("[h][h]", "[h]")),
    ("oxidation", ("o=o", "[o]")),
    ("transformation", (">>",)),
)

# Weights and defaults of the combined score.
SCORE_WEIGHTS = {"target": 0.4, "admet": 0.3, "novelty": 0.3}
SCORE_DEFAULTS = {"target": 0.0, "admet": 1.0, "novelty": 0.5}

# Group numbers that suggest a perovskite.
PEROVSKITE_GROUPS = (99, 107, 143, 144, 145, 146, 150, 152, 154, 168, 169)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def first_keyword_tag(text: Column, keywords: Mapping[str, Sequence[str]] = PATHWAY_KEYWORDS,
                      default: str | None = None) -> Column:
    """First tag with a keyword in the lower-case text, else ``default``."""
    low = F.lower(text)
    out = None
    for tag, words in keywords.items():
        out = F.when(contains_any(low, words), tag) if out is None else out.when(contains_any(low, words), tag)
    return out.otherwise(F.lit(default).cast("string"))


def pattern_type(text: Column) -> Column:
    """Type of a reaction text: the first pattern found, else ``other``."""
    return first_keyword_tag(F.coalesce(text, F.lit("")), dict(REACTION_PATTERNS), "other")


def property_class(kind: Column, assay: Column, target_name: Column, rules=PROPERTY_RULES) -> Column:
    """Property of a measurement: by kind (some also need a target keyword), or by keyword in an 'A' assay."""
    name = F.lower(F.coalesce(target_name, F.lit("")))
    out = None
    for prop, kinds, words, both in rules:
        of_kind, worded = F.coalesce(kind, F.lit("")).isin(*kinds), contains_any(name, words)
        by_kind = of_kind & worded if both else of_kind
        # a kind that needs its keyword and lacks it is not tried by assay either
        by_assay = (assay == "A") & worded
        hit = by_kind | (~of_kind & by_assay)
        out = F.when(hit, prop) if out is None else out.when(hit, prop)
    return out


def risk_level(prop: Column, value: Column, thresholds=RISK_THRESHOLDS) -> Column:
    """``high_risk``, ``moderate_risk`` or ``low_risk`` by strict thresholds; unknown property is low."""
    out = None
    for name, high, moderate, lower_is_worse in thresholds:
        beyond = (lambda cut: value < cut) if lower_is_worse else (lambda cut: value > cut)
        level = F.when(beyond(high), "high_risk").when(beyond(moderate), "moderate_risk").otherwise("low_risk")
        out = F.when(prop == name, level) if out is None else out.when(prop == name, level)
    return out.otherwise("low_risk")


def rule_violations(weight: Column, logp: Column, acceptors: Column, donors: Column) -> Column:
    """How many of the four limits (500, 5, 10, 5) are exceeded."""
    limits = ((weight, 500), (logp, 5), (acceptors, 10), (donors, 5))
    return sum((F.coalesce(c > cut, F.lit(False)).cast("int") for c, cut in limits), F.lit(0))


def strong_flag(divergence: Column, fold: Column) -> Column:
    return (divergence > 0.7) & (fold > 10)


def selected_flag(divergence: Column, fold: Column, violations: Column, qed: Column) -> Column:
    """Strong pairs that also look like a drug."""
    return strong_flag(divergence, fold) & (violations <= 1) & (qed > 0.3)


def sensitivity(prediction: Column, threshold: float = 3.0) -> tuple[Column, Column, Column]:
    """(fold change floored at 1, confidence, sensitive flag)."""
    fold = F.greatest(prediction, F.lit(1.0))
    return fold, F.least(fold / (2 * threshold), F.lit(1.0)), fold >= threshold


def clamp_outcome(prediction: Column) -> tuple[Column, Column, Column]:
    """(size clamped to [0, 100], side from the sign, confidence)."""
    size = F.least(F.abs(prediction), F.lit(100.0))
    return size, F.when(prediction >= 0, "R").otherwise("S"), F.least(size / 100.0, F.lit(1.0))


def combined_score(target: Column, admet: Column, novelty: Column) -> Column:
    """Weighted score; missing parts take their neutral defaults."""
    parts = {"target": target, "admet": admet, "novelty": novelty}
    return sum((F.coalesce(c, F.lit(SCORE_DEFAULTS[n])) * SCORE_WEIGHTS[n] for n, c in parts.items()), F.lit(0.0))


def label_from_note(note: Column) -> Column:
    """Activities of the R and the S form as told by a note: ``ARRAY<STRUCT<side, activity>>``."""
    def both(r: float, s: float) -> Column:
        return F.array(F.struct(F.lit("R").alias("side"), F.lit(r).alias("activity")),
                       F.struct(F.lit("S").alias("side"), F.lit(s).alias("activity")))

    return (
        F.when(contains_any(note, ("R=active", "R-active")), both(1.0, 0.2))
        .when(contains_any(note, ("S=active", "S-active")), both(0.2, 1.0))
        .otherwise(both(0.7, 0.5))
    )
