"""Bradley-Terry quality ranking: scores learned from preference pairs, cut at a score quantile.

A document's strength is a linear function of features of its whole text.
Pairs of a good and a bad labelled document are preferences; the logistic loss
on their feature differences is minimised by Newton steps. Each step is one
Spark job: tasks return the gradient and the curvature of their pairs, which
are as large as the number of features squared, and the next weights are
solved from their sums.

Differences leave the origin of strengths open. It is set by a quantile: the
strength below which lies the share of bad documents among the labelled ones
becomes the score 0.3, so rejecting scores below 0.3 rejects that share.

The fit uses a bounded sample of labelled rows (``SAMPLE``, spread by a hash
of the id) and meets each good document with ``RIVALS`` bad ones; scores are
given to all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wovengraph.llm.common import mapped, settle

SAMPLE = 20_000
RIVALS = 8
CUT = 0.3
RIDGE = 1e-3
STEPS = 25

_LETTERS = re.compile(r"[^\W\d_]+")
_ENDS = re.compile(r"[.!?]")
NAMES = (
    "log_words",
    "word_chars",
    "letter_share",
    "digit_share",
    "mark_share",
    "upper_share",
    "end_rate",
    "distinct_share",
    "repeat_next",
    "line_repeat",
    "top_word_share",
    "bare_word_share",
    "short_line_share",
    "log_line_words",
    "marked_word_share",
    "pair_repeat",
)


def features(text: str) -> list[float]:
    """Shares and rates of the whole text; an empty text has zeros only."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = _LETTERS.findall(text)
    alpha = sum(map(len, letters))
    digits = sum(map(text.count, "0123456789"))
    spaces = chars - sum(map(len, words))
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    bare = sum(c for w, c in counts.items() if not any(ch.isalpha() for ch in w))
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')»”’")
    per_line = n / len(lines)
    return [
        np.log1p(n),
        (chars - spaces) / n,
        alpha / chars,
        digits / chars,
        (chars - spaces - alpha - digits) / chars,
        sum(1 for w in letters if w[0].isupper()) / n,
        len(_ENDS.findall(text)) / n,
        len(counts) / n,
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / n,
        1 - len(set(lines)) / len(lines),
        max(counts.values()) / n,
        bare / n,
        sum(1 for x in lines if len(x) < 30) / len(lines),
        np.log1p(per_line),
        marked / n,
        1 - len(pairs) / max(1, n - 1),
    ]


def expand(base: np.ndarray) -> np.ndarray:
    """Each feature, its square root and its square (the logarithms are small enough for all three)."""
    return np.hstack([base, np.sqrt(np.abs(base)), base**2])


def featured(docs: DataFrame, key: str, text_col: str, *more: str) -> DataFrame:
    """key, more, x: the features of each text."""
    keep = [key, *more]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features(t or "") for t in pdf[text_col]]
            yield pdf[keep].assign(x=x)

    return docs.select(*keep, text_col).mapInPandas(run, f"{schema}, x array<double>")


def preferences(labelled: DataFrame) -> DataFrame:
    """(better, worse) feature lists; ``labelled`` has id, good and x. Both sides are bounded by the sample."""
    good, bad = labelled.where("good = 1"), labelled.where("good = 0")
    slots = max(1, bad.count())
    bad = bad.withColumn("slot", F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1)
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(RIVALS - 1)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(slots)).cast("int")))
    good = good.withColumn("slot", meets)
    return good.join(bad.select("slot", F.col("x").alias("worse")), "slot").select(F.col("x").alias("better"), "worse")


def _sums(weights: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(weights)
        gradient, curve, pairs = np.zeros(size), np.zeros((size, size)), 0
        for pdf in batches:
            if len(pdf):
                better = (expand(np.stack(pdf["better"].to_numpy())) - mean) / scale
                d = better - (expand(np.stack(pdf["worse"].to_numpy())) - mean) / scale
                p = 1 / (1 + np.exp(np.clip(d @ weights, -50, 50)))
                gradient, pairs = gradient + d.T @ p, pairs + len(d)
                curve += (d * (p * (1 - p))[:, None]).T @ d
        yield pd.DataFrame({"pairs": [pairs], "gradient": [gradient], "curve": [curve.ravel()]})

    return run


class Ranking:
    """Strengths and scores of feature lists."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, origin: float = 0.0):
        self.weights, self.mean, self.scale, self.origin = weights, mean, scale, origin

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((expand(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        above = self.strength(x) - self.origin + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(above, -500, 500)))


def fit(labelled: DataFrame) -> Ranking:
    """``labelled``: id, good (0 or 1), x; at most about SAMPLE rows. With one kind of label only, every score is equal."""
    size = len(NAMES) * 3
    sample = labelled.select("good", "x").collect()
    if not sample or len({r["good"] for r in sample}) < 2:
        flat = Ranking(np.zeros(size), np.zeros(size), np.ones(size))
        flat.origin = 1.0 if sample and sample[0]["good"] == 0 else 0.0
        return flat
    base = np.array([r["x"] for r in sample])
    good = np.array([r["good"] for r in sample])
    wide = expand(base)
    model = Ranking(np.zeros(size), wide.mean(axis=0), wide.std(axis=0) + 1e-9)
    pairs = settle(preferences(labelled))
    for _ in range(STEPS):
        parts = pairs.mapInPandas(_sums(model.weights, model.mean, model.scale), "pairs long, gradient array<double>, curve array<double>").collect()
        n = max(1, sum(p["pairs"] for p in parts))
        gradient = sum(np.array(p["gradient"]) for p in parts) / n - RIDGE * model.weights
        curve = sum(np.array(p["curve"]).reshape(size, size) for p in parts) / n + RIDGE * np.eye(size)
        step = np.linalg.solve(curve, gradient)
        model.weights = model.weights + step * min(1.0, 10 / np.abs(step).max())
        if np.abs(step).max() < 1e-3:
            break
    strengths = np.sort(model.strength(base))
    bad = int((good == 0).sum())
    model.origin = float((strengths[bad - 1] + strengths[bad]) / 2)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    """id, good, x of at most SAMPLE labelled rows that aren't held out; one row per id."""
    ids = labels.where(F.col("quality").isin(0, 1)).groupBy(id_col).agg(F.max("quality").alias("good"))
    ids = ids.where(~held_out).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE)
    ids = settle(ids)
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(ids, F.col("_doc") == F.col(id_col))
    return settle(featured(rows.select(F.col("_doc").alias("id"), "good", "_text"), "id", "_text", "good"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def scored(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """id, more, score, predicted of every row; null text counts as empty."""
    keep = [id_col, *more]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array([features(t or "") for t in pdf["_text"]]).reshape(len(pdf), len(NAMES))
        score = model.score(x)
        return pd.DataFrame({"score": score, "predicted": (score >= CUT).astype("int32")})

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("_text"))
    return mapped(rows, keep, lambda: one, "score double, predicted int")


def rank_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A row without an id is not held out. Rows with equal ids are scored by
    their own texts; in training each labelled text counts. Null and empty
    texts have the features of an empty text.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(training_rows(docs, labels, out, id_col, text_col))
    return scored(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, with their columns as they are."""
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(training_rows(docs, labels, out, id_col, text_col))

    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t or "") for t in texts]).reshape(len(texts), len(NAMES))
            yield pd.Series(model.score(x) >= CUT)

    return docs.where(F.pandas_udf(good, "boolean")(F.col(f"`{text_col}`")))
