"""Text patterns read into columns."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a target line, a formula token and a key-value number.
ENTRY_PATTERN = r"(?m)^\s+(.+?)\s+\((CHEMBL\d+)\):\s+([\d.eE+]+)x\s+differential"
TOKEN_PATTERN = r"([A-Z][a-z]?)(\d*)"
CELL_KEYS = (
    ("a", r"_cell_length_a\s+([\d.]+)", 1.0), ("b", r"_cell_length_b\s+([\d.]+)", 1.0),
    ("c", r"_cell_length_c\s+([\d.]+)", 1.0), ("alpha", r"_cell_angle_alpha\s+([\d.]+)", 90.0),
    ("beta", r"_cell_angle_beta\s+([\d.]+)", 90.0), ("gamma", r"_cell_angle_gamma\s+([\d.]+)", 90.0),
)


def _groups(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parse_entries(text: Column, pattern: str = ENTRY_PATTERN) -> Column:
    """All target lines of a description: ``ARRAY<STRUCT<name, id, fold_change>>``, unreadable numbers dropped."""
    rows = F.arrays_zip(
        _groups(text, pattern, 1).alias("name"), _groups(text, pattern, 2).alias("id"),
        F.transform(_groups(text, pattern, 3), lambda x: x.try_cast("double")).alias("fold_change"),
    )
    return F.filter(rows, lambda r: r["fold_change"].isNotNull())


def formula_tokens(text: Column) -> Column:
    """Formula to an array of elements, each repeated by its count (1 when missing)."""
    clean = F.trim(F.regexp_replace(F.trim(text), r"^-+|-+$", ""))
    names, counts = _groups(clean, TOKEN_PATTERN, 1), _groups(clean, TOKEN_PATTERN, 2)
    return F.flatten(F.zip_with(
        names, counts, lambda e, n: F.array_repeat(e, F.coalesce(F.nullif(n, F.lit("")).try_cast("int"), F.lit(1)))
    ))


def number_after(text: Column, pattern: str, default: float | None) -> Column:
    """First number the pattern captures (an uncertainty suffix such as ``(5)`` is not part of it)."""
    found = F.regexp_extract(text, pattern, 1).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def cell_parameters(text: Column) -> list[Column]:
    """Cell lengths and angles with their defaults."""
    return [number_after(text, pattern, default).alias(name) for name, pattern, default in CELL_KEYS]


def strip_uncertainty(text: Column) -> Column:
    """``1.23(5)`` to ``1.23``."""
    return F.regexp_replace(text, r"\(.*", "")


def _fixed(x: float | None, digits: int) -> str:
    """Java's ``%.<digits>f``: the shortest decimal of a number is rounded half up."""
    if x is None or not np.isfinite(x):
        return "null" if x is None else "NaN" if np.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    return f"{Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}" if abs(x) < 1e15 else f"{Decimal(repr(x)):.{digits}f}"


def joined_numbers(numbers: Column | str, digits: int) -> Column:
    """The numbers of an array with so many decimals, as ``format_string`` prints them, with commas between."""

    @F.arrow_udf("string")
    def text(col: pa.Array) -> pa.Array:
        flat = col.flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        plain = x.tolist() if not flat.null_count else flat.to_pylist()
        with np.errstate(invalid="ignore", over="ignore"):
            part = np.modf(np.abs(x) * 10.0**digits)[0]
            odd = ~(np.abs(x) < 1e8) | (np.abs(part - 0.5) < 1e-4)  # C rounds the binary number, which matters next to a half only
        whole = {i: _fixed(plain[i], digits) for i in np.flatnonzero(odd).tolist()}
        out, at, one = [], 0, f"%.{digits}f"
        odd_before = np.concatenate([[0], np.cumsum(odd)]).tolist()
        for n in col.value_lengths().to_pylist():
            if n is None:
                out.append(None)
                continue
            end = at + n
            if odd_before[end] == odd_before[at]:
                out.append(",".join([one] * n) % tuple(plain[at:end]))
            else:
                out.append(",".join(whole[i] if i in whole else one % plain[i] for i in range(at, end)))
            at = end
        return pa.array(out, pa.string())

    return text(numbers)
