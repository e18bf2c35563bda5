"""Best-fit packing into sequences of several permitted lengths.

Rows are packed by length only, so the histogram of lengths, which has at most
as many entries as the longest sequence has tokens, is all the planner needs:
best-fit decreasing runs on counts, moving whole classes of equal bins at
once. A class is used at most log2(longest) times, as filling it leaves less
than half of its room, so the plan is bounded by the permitted lengths and not
by the data, and is sent to the tasks. Rows find their bins by their position
among the rows of the same length.

Opening a bin takes the permitted length with the least cost for each token
placed. Since the cheapest single choice isn't always best for the whole, the
plan is made once for each longest length allowed to be opened, and the
cheapest of these plans after downsizing counts. Finally each bin shrinks to
the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import mapped, numbered

SIZES = (512, 1024, 2048, 4096, 8192)
SEQUENCE_COST = 32


def cost(size: int) -> int:
    """Tokens of a sequence, and what each sequence costs besides."""
    return size + SEQUENCE_COST


@dataclass
class Segment:
    """Rows of ``length`` with ranks from ``rank`` on: ``each`` a bin, from ``bin`` on, at ``offset``."""

    length: int
    rank: int
    bin: int
    each: int
    offset: int


def pack(counts: dict[int, int], sizes: tuple[int, ...], price: Callable[[int], int] = cost):
    """(segments, [first bins], [their sizes], total cost) of the cheapest plan; see the module."""
    most = max(counts, default=0)
    plans = [_pack(counts, sizes[: k + 1], sizes, price) for k, s in enumerate(sizes) if s >= most]
    return min(plans, key=lambda p: p[3])


def _pack(counts, allowed, sizes, price):
    segments: list[Segment] = []
    opened: list[tuple[int, int, int, int]] = []  # (room, first bin, bins, size), sorted
    bins = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(opened, (length,))
            if at < len(opened):
                room, first, n, size = opened.pop(at)
            else:
                fitting = [s for s in allowed if s >= length]
                size = min(fitting, key=lambda s: (price(s) / (min(s // length, left) * length), s))
                room, first, n = size, bins, -(-left // (size // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            if full:
                segments.append(Segment(length, rank, first, each, size - room))
                insort(opened, (room - each * length, first, full, size))
            if part:
                segments.append(Segment(length, rank + full * each, first + full, part, size - room))
                insort(opened, (room - part * length, first + full, 1, size))
            rest = n - full - (part > 0)
            if rest:
                insort(opened, (room, first + n - rest, rest, size))
            rank, left = rank + full * each + part, left - full * each - part
    opened.sort(key=lambda c: c[1])
    last = [sizes[bisect_left(sizes, size - room)] for room, _, _, size in opened]
    total = sum(price(s) * c[2] for s, c in zip(last, opened, strict=True))
    return segments, [c[1] for c in opened], last, total


def word_length(text: Column) -> Column:
    """Words between ASCII white space, and one for the end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def place(segments: list[Segment], firsts: list[int], sizes: list[int]):
    """A function of batches: bin_id, bin_offset and bin_size by length and rank."""
    order = sorted(segments, key=lambda s: (s.length, s.rank))
    table = np.array([(s.length, s.rank, s.bin, s.each, s.offset) for s in order], dtype=np.int64).reshape(-1, 5)
    starts, shrunk = np.array(firsts, dtype=np.int64), np.array(sizes, dtype=np.int64)
    lengths = np.unique(table[:, 0])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        length, rank = pdf["_length"].to_numpy(), pdf["_rank"].to_numpy()
        row = np.empty(len(pdf), dtype=np.int64)
        for n in np.intersect1d(lengths, length):
            lo, hi = np.searchsorted(table[:, 0], [n, n + 1])
            own = length == n
            row[own] = lo + np.searchsorted(table[lo:hi, 1], rank[own], side="right") - 1
        _, first, start, each, offset = table[row].T
        past = rank - first
        which = start + past // each
        size = shrunk[np.searchsorted(starts, which, side="right") - 1]
        return pd.DataFrame({"bin_id": which, "bin_offset": offset + past % each * length, "bin_size": size})

    return one


def best_fit(
    docs: DataFrame,
    sizes: tuple[int, ...] = SIZES,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, bin_offset, bin_size.

    ``length`` counts tokens of a row (default: words and an end mark; null and
    empty texts have the end mark only). A row longer than the longest
    permitted sequence is cut into pieces of that length and a rest, each with
    its start; nothing is dropped. Rows with equal or null ids are packed
    separately. No rows in, no rows out.
    """
    sizes = tuple(sorted(sizes))
    longest = sizes[-1]
    tokens = word_length(F.col(f"`{text_col}`")) if length is None else length.cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), tokens.alias("tokens")).where("tokens > 0")
    last = ((F.col("tokens") - 1) / longest).cast("long")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece") * longest
    pieces = pieces.select("id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("tokens") - start).alias("length"))
    ranked = numbered(pieces, ["length"], [])
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, firsts, shrunk, _ = pack(counts, sizes)
    own = place(segments, firsts, shrunk)
    keep = ["id", "piece", "start", "length"]
    placed = ranked.select(*keep, F.col("length").alias("_length"), F.col("rank").alias("_rank"))
    placed = mapped(placed, keep, lambda: own, "bin_id long, bin_offset long, bin_size long")
    return placed.withColumnRenamed("id", id_col)
