"""Collocations: frequent phrases of two to five words, level by level with double-array tries.

1. Words are counted for each language; only words with ``least`` occurrences can
   stand in a frequent phrase. They get numbers, and every text becomes a list of
   numbers in which everything else (rare words, ends of pieces) is one -1.
2. Candidates of k + 1 words are frequent phrases of k words with a frequent word
   behind them, whose last k words are frequent as well. Only those that stand in the texts
   are considered: a shard (``SHARD`` text positions of one task) names what it holds and how
   often, and names that cannot add up to ``least`` go no further.
3. Candidates go into double-array tries of at most ``BLOCK`` phrases. A trie is
   broadcast, and numpy moves the states of all text positions of a shard one word
   further at a time; accepting states are counted and the shards' counts summed.
   The same pass names the candidates of the next level. More candidates mean
   more tries and passes, never a larger trie.
4. Scores, containment and ranks are joins and grouped maxima over frequent phrases.

Nothing is sampled, and no group of a language meets in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import discard, numbered, settle, settled

BLOCK = 1 << 18  # phrases in one trie
WORDS = 1 << 20  # words in one broadcast dictionary
SHARD = 1 << 21  # text positions counted together
HELD = 1 << 17  # distinct words a task holds before it passes their counts on
STRIDE = 1 << 17  # text positions walked at once
CHUNK = 1 << 20  # bytes of a text cut at once
BATCH = 1 << 16  # rows handed on at once
DIGIT = 10  # bits of a trie's symbol; a word's number takes two or three

_END = b","
_FOLDED = bytearray(range(256))
for _c in range(65, 91):
    _FOLDED[_c] = _c + 32
_FOLDED[0x09] = 0x20
for _c in b".,;:!?\n\x0b\x0c\r":
    _FOLDED[_c] = _END[0]
_FOLDED = bytes(_FOLDED)


def words(raw: bytes, chunk: int = CHUNK) -> Iterator[list[bytes]]:
    """The words of a text in order, A-Z as a-z, in lists; ``,`` (in no word) ends a piece."""
    start = 0
    while start < len(raw):
        end = start + chunk
        if end < len(raw):
            cut = max(raw.rfind(b" ", start, end), raw.rfind(b"\n", start, end), raw.rfind(b".", start, end))
            while cut < start and end < len(raw):  # a word longer than a chunk
                end += chunk
                cut = max(raw.rfind(b" ", start, end), raw.rfind(b"\n", start, end), raw.rfind(b".", start, end))
            end = cut + 1 if end < len(raw) else len(raw)
        yield raw[start:end].translate(_FOLDED).replace(_END, b" , ").split()
        start = end


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n from lang and raw text; a row without word holds the number of all words."""

    def rows(lang: str, own: Counter) -> Iterator[pa.RecordBatch]:
        found, n = [None, *own], [sum(own.values()), *own.values()]
        for at in range(0, len(n), BATCH):
            word, some = pa.array(found[at : at + BATCH], pa.binary()), pa.array(n[at : at + BATCH], pa.int64())
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "word": word, "n": some})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for given in batches:
            for lang, raw in zip(given.column("lang").to_pylist(), given.column("raw"), strict=True):
                own = counts.setdefault(lang, Counter())
                for part in words(raw.as_py()):
                    own.update(part)
                del own[_END]
                if sum(map(len, counts.values())) > HELD:
                    most = max(counts, key=lambda x: len(counts[x]))
                    yield from rows(most, counts.pop(most))
        for lang, own in counts.items():
            yield from rows(lang, own)

    found = texts.mapInArrow(run, "lang string, word binary, n long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _flat(lists: pa.ListArray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """All values with ``gap`` times -1 behind each list, and the length of each list."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.full(len(values) + gap * len(sizes), -1, dtype=np.int32)
    out[np.arange(len(values)) + np.repeat(np.arange(len(sizes)) * gap, sizes)] = values
    return out, sizes


def encoded(texts: DataFrame, vocabulary: DataFrame, size: int) -> str:
    """Path of a written table: ids (array<int>) of each text that holds two known words side by side, runs of -1 as one."""
    spark = texts.sparkSession
    now, path = texts, ""
    for start in range(0, max(size, 1), WORDS):
        last, again = start + WORDS >= size, start > 0
        known: dict[str, dict[bytes, int]] = {}
        part = vocabulary.where((F.col("id") >= start) & (F.col("id") < start + WORDS)).select("lang", F.col("word").cast("binary"), "id").toArrow()
        for lang, word, number in zip(*(part[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
            known.setdefault(lang, {})[word] = number
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, again=again) -> Iterator[pa.RecordBatch]:
            for given in batches:
                found, keep = [], []
                for at, (lang, raw) in enumerate(zip(given.column("lang").to_pylist(), given.column("raw"), strict=True)):
                    get = shared.value.get(lang, {}).get
                    ids = [np.fromiter(map(get, part, repeat(-1)), dtype=np.int32, count=len(part)) for part in words(raw.as_py())]
                    ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                    if again:
                        ids = np.maximum(ids, np.array(given.column("ids")[at].values, dtype=np.int32))
                    if last:
                        out = ids < 0
                        ids = ids[~(out & np.concatenate([[True], out[:-1]]))]
                    if not last or bool(((ids[1:] >= 0) & (ids[:-1] >= 0)).any()):
                        found.append(ids)
                        keep.append(at)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(found) if found else np.zeros(0, dtype=np.int32))
                columns = {"ids": lists} if last else {"lang": given.column("lang").take(keep), "raw": given.column("raw").take(keep), "ids": lists}
                yield pa.RecordBatch.from_pydict(columns)

        before, path = path, settled(now.mapInArrow(run, "ids array<int>" if last else "lang string, raw binary, ids array<int>"))
        now = spark.read.parquet(path)
        if before:
            discard(spark, before)
    return path


class DoubleArray:
    """A trie of rows of numbers: the child of slot s by symbol c is slot base[s] + c, if check there is s.

    Symbols are digits of ``DIGIT`` bits, so the children of a node lie close together and
    the array is hardly longer than the number of nodes.
    """

    def __init__(self, rows: np.ndarray):
        """rows: distinct, all of one length."""
        self.mask, self.top = (1 << DIGIT) - 1, int(rows.max(initial=0))
        self.shifts = list(range(0, max(1, self.top.bit_length()), DIGIT))[::-1]
        rows = np.stack([rows[:, k] >> shift & self.mask for k in range(rows.shape[1]) for shift in self.shifts], axis=1)
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        parent, symbol, nodes = [], [], 1
        above = np.zeros(len(rows), dtype=np.int64)
        new = np.zeros(len(rows), dtype=bool)
        for depth in range(rows.shape[1]):
            column = rows[:, depth]
            new = new | np.concatenate([[True], column[1:] != column[:-1]])[: len(rows)]
            own = nodes + np.cumsum(new) - 1
            parent.append(above[new])
            symbol.append(column[new])
            nodes += int(new.sum())
            above = own
        parents = np.concatenate(parent) if parent else np.zeros(0, dtype=np.int64)
        symbols = np.concatenate(symbol).astype(np.int64) if symbol else parents
        first = np.flatnonzero(np.diff(parents, prepend=-1) != 0)
        sizes = np.diff(np.append(first, len(parents)))
        base = np.zeros(nodes, dtype=np.int64)
        taken = np.zeros(max(1024, 2 * nodes), dtype=bool)
        taken[0] = True
        extent, start, wide = 1, 1, 0
        for at in np.argsort(-sizes, kind="stable"):
            if sizes[at] == 1:
                break
            if wide != int(sizes[at]).bit_length():  # smaller nodes look at all gaps again
                start, wide = 1, int(sizes[at]).bit_length()
            own = symbols[first[at] : first[at] + sizes[at]]
            rel = own - own[0]
            if len(taken) < extent + 2 * int(rel[-1]) + 8192:
                taken = np.concatenate([taken, np.zeros(len(taken) + 2 * int(rel[-1]) + 8192, dtype=bool)])
            place = extent
            for _ in range(8):
                free = start + np.flatnonzero(~taken[start : start + 4096])[:64]
                free = free[free < extent]
                if not len(free):
                    break
                fits = ~taken[free[:, None] + rel[None, :]].any(axis=1)
                if fits.any():
                    place = int(free[np.argmax(fits)])
                    break
                start = int(free[len(free) // 2]) + 1
            taken[place + rel] = True
            extent = max(extent, place + int(rel[-1]) + 1)
            base[parents[first[at]]] = place - own[0]
        alone = first[sizes == 1]
        free = np.flatnonzero(~taken[:extent])[: len(alone)]
        free = np.concatenate([free, extent + np.arange(len(alone) - len(free))])
        base[parents[alone]] = free - symbols[alone]
        slots = np.zeros(nodes, dtype=np.int64)
        slots[1:] = base[parents] + symbols
        size = int(slots.max(initial=0)) + 1
        self.base, self.check, self.row = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.base[slots] = base
        self.check[slots[1:]] = slots[parents]
        if len(rows):
            self.row[slots[above]] = order

    def walk(self, flat: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``flat`` where a row begins, and which one. ``flat`` ends with ``depth`` times -1.

        ``STRIDE`` positions are walked at a time, so what a walk holds beside its result doesn't grow with ``flat``.
        """
        known = np.flatnonzero(flat >= 0).astype(np.int32)
        parts = [self._walk(flat, known[at : at + STRIDE].astype(np.int64), depth) for at in range(0, max(1, len(known)), STRIDE)]
        return np.concatenate([at for at, _ in parts]), np.concatenate([row for _, row in parts])

    def _walk(self, flat: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        state = np.zeros(len(at), dtype=np.int64)
        for step in range(depth):
            good = (flat[at + step] >= 0) & (flat[at + step] <= self.top)
            at, state = at[good], state[good]
            for shift in self.shifts:
                to = self.base[state] + (flat[at + step] >> shift & self.mask)
                good = (to >= 0) & (to < len(self.check))
                at, state, to = at[good], state[good], to[good]
                good = self.check[to] == state
                at, state = at[good], to[good]
        return at.astype(np.int32), self.row[state]


def _pass(corpus: DataFrame, trie: DoubleArray | None, size: int, depth: int, grow: bool, only: bool) -> str:
    """Path of (number, word, n): how often the trie's rows stand in the texts (no word), and the rows with a word behind them.

    Without a trie every word is a row of its own. If the trie is the ``only`` one of its
    depth, what it doesn't hold from the second word on isn't named.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        counts = np.zeros(size if trie else 0, dtype=np.int64)

        def rows(number: np.ndarray, word: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(n), BATCH):
                end = min(at + BATCH, len(n))
                words = pa.nulls(end - at, pa.int32()) if word is None else pa.array(word[at:end], pa.int32())
                yield pa.RecordBatch.from_pydict({"number": pa.array(number[at:end], pa.int64()), "word": words, "n": pa.array(n[at:end], pa.int64())})

        def shard(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            flat = np.concatenate([*parts, np.full(depth + 1, -1, dtype=np.int32)])
            parts.clear()
            if trie:
                at, row = trie.walk(flat, depth)
                counts[:] += np.bincount(row, minlength=size)
            else:
                at = np.flatnonzero(flat >= 0).astype(np.int32)
                row = flat[at]
            if grow:
                word = flat[at + depth]
                good = word >= 0
                if trie and only:
                    held = np.zeros(len(flat), dtype=bool)
                    held[at] = True
                    good &= held[at + 1]
                keys = row[good].astype(np.int64)
                keys <<= 32
                keys |= word[good]
                del flat, at, row, word, good
                # Sorted where they stand: counting holds no second copy of what isn't distinct.
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
                n, keys = np.diff(np.append(first, len(keys))), keys[first]
                yield from rows(keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32), n)

        parts, held = [], 0
        for given in batches:
            flat, _ = _flat(given.column("ids"), 1)
            parts.append(flat)
            held += len(flat)
            if held >= SHARD:
                yield from shard(parts)
                parts, held = [], 0
        if parts:
            yield from shard(parts)
        seen = np.flatnonzero(counts)
        yield from rows(seen, None, counts[seen])

    path = settled(corpus.mapInArrow(run, "number long, word int, n long"))
    shared.unpersist()
    return path


def _candidates(found: DataFrame, named: DataFrame, vocabulary: DataFrame, depth: int, least: int) -> DataFrame:
    """lang, words, phrase, size, number of the named phrases of ``depth`` words that can be frequent."""
    likely = named.groupBy("number", "word").agg(F.sum("n").alias("most")).where(F.col("most") >= least)
    behind = vocabulary.select(F.col("id").alias("word"), F.col("word").alias("text"))
    longer = F.concat("words", F.array("word")).alias("words")
    grown = likely.join(found.select("number", "lang", "words", "phrase"), "number").join(behind, "word")
    grown = grown.select("lang", longer, F.concat_ws(" ", "phrase", "text").alias("phrase"), F.lit(depth).alias("size"))
    if depth > 2:
        tails = found.select(F.col("words").alias("tail"))
        grown = grown.join(tails, F.slice("words", 2, depth - 1) == F.col("tail"), "left_semi")
    return settle(numbered(grown, [], ["lang", "phrase"], "number"))


def _counted(corpus: DataFrame, candidates: DataFrame, depth: int, least: int, grow: bool) -> tuple[DataFrame, DataFrame]:
    """The frequent ones of the candidates with f, and the rows that name longer ones."""
    spark, size = corpus.sparkSession, candidates.count()
    counts = spark.createDataFrame([], "number long, word int, n long")
    for start in range(0, size, BLOCK):
        part = candidates.where((F.col("number") >= start) & (F.col("number") < start + BLOCK)).select("number", "words").toArrow().sort_by("number")
        rows = np.array(part["words"].combine_chunks().flatten()).reshape(len(part), depth)
        own = spark.read.schema(counts.schema).parquet(_pass(corpus, DoubleArray(rows), len(part), depth, grow, size <= BLOCK))
        counts = counts.unionByName(own.withColumn("number", F.col("number") + start))
    sums = counts.where("word IS NULL").groupBy("number").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return settle(candidates.join(sums, "number")), counts.where("word IS NOT NULL")


def frequent_phrases(docs: DataFrame, least: int, most_words: int, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, size, f) of every phrase of 1 to ``most_words`` words with f >= least, and (lang, n) of all words."""
    spark = docs.sparkSession
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    texts = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("raw"))
    counted = settle(word_counts(texts).where((F.col("n") >= least) | F.col("word").isNull()))
    ordered = counted.where("word IS NOT NULL").withColumn("less", -F.col("n"))
    vocabulary = settle(numbered(ordered, [], ["lang", "less", "word"], "id").select("lang", "word", "n", F.col("id").cast("int")))
    path = encoded(texts, vocabulary, vocabulary.count())
    corpus = spark.read.schema("ids array<int>").parquet(path)
    columns = ["lang", "words", "phrase", "size", "number", "f"]
    single = vocabulary.withColumns({"words": F.array("id"), "phrase": F.col("word"), "size": F.lit(1), "number": F.col("id").cast("long"), "f": F.col("n")})
    levels = [single.select(*columns)]
    if most_words > 1:
        named = spark.read.schema("number long, word int, n long").parquet(_pass(corpus, None, 0, 1, True, True)).where("word IS NOT NULL")
    for depth in range(2, most_words + 1):
        candidates = _candidates(levels[-1], named, vocabulary, depth, least)
        found, named = _counted(corpus, candidates, depth, least, depth < most_words)
        levels.append(found.select(*columns))
    discard(spark, path)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.drop("number"), counted.where("word IS NULL").select("lang", "n")


def collocations(
    docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, contained_percent: int = 100, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Words lie between blanks and tabs in pieces between ``.,;:!?`` and line ends,
    A-Z as a-z; a phrase stays in its piece. n counts all words of the language, a the
    phrase, l and r the parts of its lowest-scoring cut (of equal ones the first);
    score is floor(1000 * a * n / (l * r)), exact while 1000 * a * n has 38 digits. A phrase inside
    a longer one that has ``contained_percent`` of its occurrences is left out. Ranks
    go by score and a, falling, then by the phrase's bytes, so there are no ties. Null
    texts count as empty, null languages as ``und``; repeated rows count each time; other
    columns are not read. Empty tables, and those without a frequent phrase, give no rows.
    """
    every, totals = frequent_phrases(docs, least, most_words, text_col, lang_col)
    phrases = every.where("size > 1")
    cuts = phrases.select("lang", "words", "phrase", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))})
    part = lambda words, f: every.select(F.col("words").alias(words), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right").join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", score).groupBy("words").agg(
        F.min(F.struct("score", "k", "lang", "phrase", "f", "l", "r", "n")).alias("best")
    )
    scored = lowest.select("words", "best.*")

    long = phrases.where("size > 2")
    sizes = F.filter(F.sequence(F.lit(2), F.lit(max(2, most_words - 1))), lambda x: x < F.col("size"))
    inner = long.select("words", "f", "size", F.explode(sizes).alias("wide"))
    inner = inner.select("f", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("wide") + 1), lambda at: F.slice("words", at, F.col("wide")))).alias("words"))
    around = inner.groupBy("words").agg(F.max("f").alias("around"))
    alone = scored.join(around, "words", "left").where(F.col("around").isNull() | (100 * F.col("around") < contained_percent * F.col("f")))
    ordered = alone.withColumns({"lower": -F.col("score"), "rarer": -F.col("f")})
    ranked = numbered(ordered, ["lang"], ["lower", "rarer", "phrase"], "rank").where(F.col("rank") < top)
    return ranked.select("lang", (F.col("rank") + 1).alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
