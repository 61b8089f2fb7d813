"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed byte trigrams, counted over the labelled
documents. A document is explained as a mixture of languages: expectation-maximisation
estimates the proportions, and the set of languages is chosen by penalised likelihood,
adding the next language of the full mixture as long as it pays for its parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from antipode.llm.common import map_rows

BUCKETS = 1 << 16
ROUNDS, TOLERANCE = 30, 1e-4
#: Overlapping trigrams are not independent: a language has to pay this often log(n) / 2.
PENALTY = 12.0
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")
# ASCII that is not a letter counts as one kind of separator
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased text; ASCII other than letters is blank, runs of blanks drop out."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    blank = raw == 32
    raw = raw[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, np.uint32)
    code = raw[:-2] | (raw[1:-1] << 8) | (raw[2:] << 16)
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint32)


@dataclass
class LanguageModel:
    """Log-probabilities of buckets per language; ``table`` has one row per bucket."""

    languages: list[str]
    table: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(language, score, proportions of the chosen languages)."""
        if text is None or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, {}
        grams, counts = np.unique(trigrams(text), return_counts=True)
        n = float(counts.sum())
        logs = self.table[grams]
        single = counts @ logs
        best = int(np.argmax(single))
        if len(self.languages) == 1 or not n:
            return self.languages[best], 1.0, {self.languages[best]: 1.0}
        # likelihoods relative to the best language of each trigram: no underflow, same proportions
        like = np.exp(logs - logs.max(1, keepdims=True))
        base = float(counts @ logs.max(1))
        share, full = _mixture(like, counts, n)
        order = np.argsort(-share, kind="stable")
        cost = PENALTY * 0.5 * np.log(n + 1)
        chosen, value, weights = [best], float(single[best]), np.ones(1)
        if base + full - value > cost:  # even the full mixture would not pay otherwise
            for k in range(2, len(order) + 1):
                trial = sorted(order[:k].tolist())
                w, ll = _mixture(like[:, trial], counts, n)
                if base + ll - cost <= value:
                    break
                chosen, value, weights = trial, base + ll - cost, w
        top = int(np.argmax(weights))
        posterior = np.exp(np.clip(single - single[chosen[top]], -700, 0))
        score = float(weights[top]) if len(chosen) > 1 else float(1.0 / posterior.sum())
        return self.languages[chosen[top]], min(1.0, max(0.0, score)), {
            self.languages[c]: float(w) for c, w in zip(chosen, weights, strict=True)}


def _mixture(like: np.ndarray, counts: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation and their log-likelihood."""
    share = np.full(like.shape[1], 1.0 / like.shape[1])
    for _ in range(ROUNDS):
        part = like @ share
        new = share * ((counts / part) @ like) / n
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(counts @ np.log(np.maximum(like @ share, 1e-300)))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams per language over all rows with text and language.

    Tasks send counts, at most languages x 65,536 numbers. Null texts and languages are left out.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        totals: dict[str, np.ndarray] = {}
        for cols in batches:
            for lang, text in zip(cols["lang"].to_pylist(), cols["text"].to_pylist(), strict=True):
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                grams = trigrams(text)
                if len(grams) > BUCKETS // 8:
                    totals[lang] += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(totals[lang], grams, 1)
        for lang, t in totals.items():
            hit = np.flatnonzero(t)
            yield {"lang": [lang] * len(hit), "bucket": hit.astype(np.int64), "n": t[hit]}

    counts = map_rows(labelled, "lang string, bucket long, n long", work).groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    # bounded by languages x BUCKETS
    rows = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy(
        "lang").collect()
    table = np.zeros((BUCKETS, len(rows)), np.float64)
    for j, r in enumerate(rows):
        table[np.array(r.b), j] = r.n
    table += 0.05
    table = np.log(table / table.sum(0)) if len(rows) else table
    return LanguageModel([r.lang for r in rows], table.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text",
             keep: list[str] | None = None) -> DataFrame:
    """(id, ``keep`` columns, lang_pred, score, shares) per row, from the text alone.

    ``und`` with score 0 if the text is null or has no letter. ``shares`` are the proportions of the
    chosen languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 65,536 numbers
    keep = keep or []
    # types, not text: a carried struct may have fields of any name
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in [id_col, *keep]]).add(
        "lang_pred", "string").add("score", "double").add("shares", T.MapType(T.StringType(), T.DoubleType()))

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for cols in batches:
            found = [m.predict(t) for t in cols["_text"].to_pylist()]
            yield {id_col: cols[id_col], **{c: cols[c] for c in keep}, "lang_pred": [f[0] for f in found],
                   "score": [f[1] for f in found], "shares": [list(f[2].items()) for f in found]}

    return map_rows(docs.select(id_col, *keep, F.col(text_col).alias("_text")), schema, work)


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """True for the documents whose id falls into the fold kept from training; null ids never do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
