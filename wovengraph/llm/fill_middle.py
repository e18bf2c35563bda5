"""Fill-in-middle documents: a text cut at two line ends, its middle moved to the back.

The line ends of a text are a boundary set in the style of roaring bitmaps
(``Boundaries``): the text is read in slices of 2 ** 16 code points, and each
slice that holds line ends becomes one container, whichever is smallest of a
sorted array of 16-bit offsets, a bitmap, or runs of neighbouring offsets.
Cumulative cardinalities say which container holds the k-th line end; a local
select in that container gives its offset. Only one slice is spread out at a
time, so memory beyond the text itself stays within a few bits a line.

Which lines are cut is drawn from a hash of seed and id, so a retried task
makes the same cuts. The way back (``restored``) is a column expression that
sees only the output and its form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1 << 16
ARRAY, BITMAP, RUNS = 0, 1, 2
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


class Container:
    """Sorted distinct 16-bit offsets, held in the smallest of three forms."""

    def __init__(self, offsets: np.ndarray):
        first = np.flatnonzero(np.diff(offsets.astype(np.int32), prepend=-2) != 1)
        size = {ARRAY: 2 * len(offsets), BITMAP: SLICE // 8, RUNS: 4 * len(first)}
        self.kind = min(size, key=lambda k: (size[k], k))
        if self.kind == ARRAY:
            self.offsets = offsets.astype(np.uint16)
        elif self.kind == BITMAP:
            bits = np.zeros(SLICE, dtype=bool)
            bits[offsets] = True
            self.bytes = np.packbits(bits, bitorder="little")
        else:
            self.starts = offsets[first].astype(np.uint16)
            self.before = first.astype(np.uint16)

    def select(self, k: int) -> int:
        """The k-th offset, counted from 0."""
        if self.kind == ARRAY:
            return int(self.offsets[k])
        if self.kind == RUNS:
            run = int(np.searchsorted(self.before, k, side="right")) - 1
            return int(self.starts[run]) + k - int(self.before[run])
        upto = np.cumsum(_POPCOUNT[self.bytes], dtype=np.int64)
        at = int(np.searchsorted(upto, k, side="right"))
        left = k - (int(upto[at - 1]) if at else 0)
        bits = np.flatnonzero(np.unpackbits(self.bytes[at : at + 1], bitorder="little"))
        return at * 8 + int(bits[left])


class Boundaries:
    """The last code point of every line of a text; a line is ``[^\\n]*\\n`` or what is left at the end."""

    def __init__(self, text: str):
        self.keys: list[int] = []
        self.containers: list[Container] = []
        counts = [0]
        for key in range(-(-len(text) // SLICE)):
            part = text[key * SLICE : (key + 1) * SLICE]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            ends = np.flatnonzero(points == 10)
            if key * SLICE + len(part) == len(text) and part[-1] != "\n":
                ends = np.append(ends, len(part) - 1)
            if len(ends):
                self.keys.append(key)
                self.containers.append(Container(ends))
                counts.append(counts[-1] + len(ends))
        self.counts = np.array(counts, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.counts[-1])

    def offset(self, lines: int) -> int:
        """Code points in the first ``lines`` lines."""
        if not lines:
            return 0
        at = int(np.searchsorted(self.counts, lines - 1, side="right")) - 1
        return self.keys[at] * SLICE + self.containers[at].select(lines - 1 - int(self.counts[at])) + 1


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels are found again for certain if their first character stands nowhere else in them."""
    if not all(sentinels) or len(set(sentinels)) < 3:
        raise ValueError("three different sentinels, none empty")
    if any(s[0] in "".join(t[1:] for t in sentinels) for s in sentinels) or any(s != t and s.startswith(t) for s in sentinels for t in sentinels):
        raise ValueError("a sentinel's first character may not stand inside a sentinel, and none may begin with another")
    return sentinels


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """One row per input row: id, n (lines), form, prefix_chars, middle_chars, output.

    form: ``plain`` (output is the text) for empty and null texts, for texts
    that hold a sentinel and for the share beyond ``percent``; else ``spm``
    for ``spm_percent`` of 100, else ``psm``. psm: prefix, suffix and middle, each
    behind its sentinel; spm: suffix, prefix, middle. prefix_chars and
    middle_chars count code points and are null for plain. Rows are
    independent: repeated rows give equal rows, rows with a null id share one draw,
    other columns are not carried along and may have any name. Empty tables give none.
    """
    p, s, m = _checked(sentinels)
    kind = docs.schema[id_col].dataType
    out = T.StructType(
        [T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
        + [T.StructField("output", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [batch.column(f"h{k}").to_numpy() for k in range(1, 5)]
            made: dict[str, list] = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
            for at, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                ends = Boundaries(text)
                h1, h2, h3, h4 = (int(h[at]) for h in hashes)
                form, first, second, output = "plain", None, None, text
                if text and h3 % 100 < percent and not any(x in text for x in sentinels):
                    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
                    first, second = ends.offset(low), ends.offset(high)
                    prefix, middle, suffix = text[:first], text[first:second], text[second:]
                    form = "spm" if h4 % 100 < spm_percent else "psm"
                    output = f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"
                    second -= first
                for c, x in zip(made, (len(ends), form, first, second, output), strict=True):
                    made[c].append(x)
            kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
            columns = {"id": batch.column("id")} | {c: pa.array(v, kinds[c]) for c, v in made.items()}
            yield pa.RecordBatch.from_pydict(columns)

    own, hashes = F.col(f"`{id_col}`"), [h.alias(f"h{k}") for k, h in enumerate(draws(F.col(f"`{id_col}`"), seed), 1)]
    return docs.select(own.alias("id"), F.col(f"`{text_col}`").alias("text"), *hashes).mapInArrow(run, out)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``fill_in_middle`` was given, from its output and form alone."""
    p, s, m = _checked(sentinels)

    def between(start: str, end: str | None) -> Column:
        begin = F.instr(output, start) + len(start)
        return F.substr(output, begin, F.instr(output, end) - begin if end else F.char_length(output))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
