"""Multilingual mixture inference: the languages of a text and their proportions.

Every language is a distribution over character trigrams (hashed to a fixed
number of cells), learned from labelled texts. A document is a mixture of
them; expectation-maximisation over its trigrams estimates the proportions.
Languages are then removed, the smallest proportion first, while the
penalised likelihood (half a logarithm of the number of trigrams, times
``PENALTY``, for each language) doesn't fall. The language with the largest
proportion is the predicted one, and its proportion the score.

The distributions are fitted on a bounded sample of labelled rows for each
language (``SAMPLE``, spread by a hash of the id); inference reads all trigrams
of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import mapped

CELLS = 1 << 16
SAMPLE = 4_000
PENALTY = 10.0
SMOOTHING = 0.5
STEPS = 12
NONE = "und"


def cells(text: str) -> np.ndarray:
    """The cell of each trigram of letters and word gaps; empty without a letter.

    Lower-cased; every run of other characters counts as one gap, so marks and digits say nothing.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate([[32], points[keep], [32]]).astype(np.uint64)
    hashed = (points[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (points[2:] * np.uint64(0x165667B19E3779F9))
    hashed ^= hashed >> np.uint64(29)
    return ((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


_LETTERS: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS[points]


def trigram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, counts): one row per language; tasks add up their own texts first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                own = sums.setdefault(lang, np.zeros(CELLS, dtype=np.int64))
                own += np.bincount(cells(text), minlength=CELLS)
        for lang, own in sums.items():
            at = own.nonzero()[0]
            yield pd.DataFrame({"lang": lang, "cell": at, "n": own[at]})

    parts = labelled.select("lang", "text").mapInPandas(run, "lang string, cell int, n long")
    return parts.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Languages:
    """Names, and the probability of each cell in each language."""

    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, table

    def mixture(self, text: str | None) -> tuple[str, float]:
        """(language, proportion); NONE and 0 without a letter."""
        at = cells(text or "")
        if not len(at):
            return NONE, 0.0
        if not self.names:
            return NONE, 0.0
        seen = self.table[at]
        chosen = np.arange(len(self.names))
        share, fit = _proportions(seen, np.full(len(chosen), 1 / len(chosen)))
        price = PENALTY * 0.5 * np.log(len(at))
        while len(chosen) > 1:
            rest = np.delete(np.arange(len(chosen)), share.argmin())
            start = share[rest] + 1e-6
            less, fit_less = _proportions(seen[:, chosen[rest]], start / start.sum())
            if fit_less + price < fit:
                break
            chosen, share, fit = chosen[rest], less, fit_less
        best = share.argmax()
        return self.names[chosen[best]], float(share[best])


def _proportions(seen: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions; (proportions, log likelihood)."""
    if seen.shape[1] == 1:
        return np.ones(1), float(np.log(seen[:, 0]).sum())
    for _ in range(STEPS):
        mixed = seen @ share
        new = share * ((1 / mixed) @ seen) / len(seen)
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(np.log(seen @ share).sum())


def fit(labelled: DataFrame) -> Languages:
    """``labelled``: lang, text. The table is languages x CELLS numbers, independent of the corpus."""
    counts = trigram_counts(labelled).toArrow()
    names, lang = np.unique(np.array(counts["lang"].to_pylist(), dtype=str), return_inverse=True)
    table = np.full((CELLS, len(names)), SMOOTHING)
    table[counts["cell"].to_numpy(), lang] += counts["n"].to_numpy()
    names = names.tolist()
    return Languages(names, table / table.sum(axis=0))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, out: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text of at most about SAMPLE rows of each language that aren't held out.

    Ids are ranked by a hash within a language after a cut by the count, so no language meets in one task.
    """
    rows = docs.where(~out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, F.lit(7)).alias("mix"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    limit = F.lit(0.0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(limit)
    below = F.pmod(F.col("mix"), F.lit(1_000_000)) < limit * 1_000_000
    return rows.where(below).select("lang", "text")


def identified(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))

    def make():
        own = Languages(*shared.value)
        return lambda pdf: pd.DataFrame([own.mixture(t) for t in pdf["_text"]], columns=["lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text"))
    return mapped(rows, [id_col], make, "lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if there was nothing to learn from. A row without an id is not held
    out; rows with equal ids are judged by their own texts.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(training_rows(docs, out, id_col, text_col, lang_col))
    return identified(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a language that has the proportion ``least``, with their columns as they are."""
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(training_rows(docs, out, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast((model.names, model.table))

    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Languages(*shared.value)
        for texts in batches:
            found = [own.mixture(t) for t in texts]
            yield pd.Series([name != NONE and share >= least for name, share in found], dtype=bool)

    return docs.where(F.pandas_udf(known, "boolean")(F.col(f"`{text_col}`")))
