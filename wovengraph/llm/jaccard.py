"""Exact Jaccard join of shingle sets in metric regions, and its components.

Jaccard distance is a metric, but the sets of unrelated texts all lie at
distance 1 from each other, so documents as the only pivots would leave nearly
everything on a border. Regions are therefore made in two levels:

1. Single shingles are the first pivots: a document's nearest ones are those it
   holds, and ties go to the rarer, then to the smaller hash. A document also
   joins the regions of all pivots that could be the nearest common one of a
   linked pair: since linked sets share ``need`` elements at least, these are its
   first ``n - need + 1`` pivots. That window is exact. Shingles met in many
   windows are put last in a second pass, so common passages open no regions.
   The order is free: it decides the cost, never the result.
2. A region with more than ``LARGE`` documents is divided by document pivots (the
   smallest hashes). Documents within the threshold of a pivot are linked, so
   each pivot's ball becomes one set of the component; only documents outside
   the largest set of their region are then compared with the others.

A pair is taken up where its first common pivot stands early enough in both sets
for the threshold, which also bounds sizes by the triangle inequality. Regions it
shares later are passed over if the few pivots just before are common already, so
rows carry a bounded list and never their whole window. Texts may be
alike without being linked, so the parities of sets in ``8 * 64`` bins are compared first,
in the regions of level 2 before a pair becomes a row: sets differ in at least as many
elements as bins, and linked ones in few. That bound loses no link. What remains is compared with whole sets. Identical sets are one class from the start. Sets are compared by
64-bit hashes of their shingles.

Most shingles open a region for one document only, and most texts are in no pair.
Bit tables of fixed size (``BITS``) over the shingles of shared regions and over the
ids in pairs keep the others from being shuffled; what they let through by chance
is dropped by the exact join after them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import Tables, components, mapped, settle, shuffles_dropped
from wovengraph.llm.shingles import mixed, shingle_sets

LARGE = 8
PIVOTS = 8
COMMON = 16
ORDERED = 200_000
BITS = 27
BEFORE = 3
WORDS = 8  # 64-bit words of a sketch
SHIFT = 64 - (64 * WORDS - 1).bit_length()


def window(size: int, percent: int) -> int:
    """Pivots of a set that may be the first it shares with a linked set."""
    return size - -(-percent * size // 100) + 1 if size else 0


def windows(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """id, mark (hash of the text), n, d1, d2 (digest of the set), keys: the window of each set, shingles in ``common`` last; sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make():
        last, often = np.ascontiguousarray(shared.value["key"]), np.ascontiguousarray(shared.value["n"])

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for chunk in shingle_sets(pdf["text"], width):
                every = np.concatenate(chunk)
                ends = np.cumsum([0, *map(len, chunk)])
                d1, d2 = (_sums(mixed(every ^ np.uint64(x)), ends) for x in (0, 0x5555))
                marks = sketches(every, ends)
                held = np.zeros(len(every), dtype=np.int64)
                if len(last):
                    at = np.minimum(np.searchsorted(last, every), len(last) - 1)
                    held = np.where(last[at] == every, often[at], 0)
                late = _sums(held.astype(np.uint64), ends) > 0
                for k, own in enumerate(chunk):
                    keep = window(len(own), percent)
                    keys = own[np.argsort(held[ends[k] : ends[k + 1]], kind="stable")[:keep]] if late[k] else own[:keep].copy()
                    rows.append((len(own), d1[k], d2[k], keys.view(np.int64), marks[k]))
            return pd.DataFrame(rows, columns=["n", "d1", "d2", "keys", "sketch"])

        return one

    return mapped(docs.select("id", _mark().alias("mark"), "text"), ["id", "mark"], make, "n long, d1 long, d2 long, keys array<long>, sketch array<long>")


def _mark() -> Column:
    """Tells rows with equal ids and different texts apart."""
    return F.xxhash64("text")


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 between neighbouring ends, as signed numbers."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values)])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def sketches(every: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set between neighbouring ends, ``WORDS`` words of bits: whether a bin holds an odd number of its elements."""
    at = (mixed(every ^ np.uint64(0x3C3C)) >> np.uint64(SHIFT)).astype(np.int64)
    own = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    out = np.zeros(WORDS * (len(ends) - 1), dtype=np.uint64)
    np.bitwise_xor.at(out, own * WORDS + (at >> 6), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
    return out.view(np.int64).reshape(-1, WORDS)


def common_keys(found: DataFrame) -> np.ndarray:
    """The shingles in the most windows (a list of fixed size: it only sets the order), sorted by key."""
    counts = found.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    with shuffles_dropped(found.sparkSession):
        top = counts.where(F.col("n") > COMMON).orderBy(F.desc("n"), "key").limit(ORDERED).toArrow()
    out = np.zeros(len(top), dtype=[("key", np.uint64), ("n", np.int64)])
    out["key"], out["n"] = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    return np.sort(out, order="key")


def sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """id (a class number), elements: the whole sets of the classes in ``pairs`` (and of a few others)."""
    kind = docs.schema["id"].dataType.simpleString()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    firsts = classes.join(ids, "id").select("first.id", "first.mark", F.col("id").alias("class"))
    firsts = settle(firsts)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(firsts.select(F.xxhash64("id", "mark").alias("key"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[_set(shared.value, _places(pdf["key"]))]
            if len(pdf):
                found = [own.view(np.int64) for chunk in shingle_sets(pdf["text"], width) for own in chunk]
                yield pdf[["id", "mark"]].assign(elements=found)

    known = docs.where("id IS NOT NULL").select("id", _mark().alias("mark"), "text").withColumn("key", F.xxhash64("id", "mark"))
    found = known.mapInPandas(run, f"id {kind}, mark long, elements array<long>")
    return found.join(firsts, ["id", "mark"]).select(F.col("class").alias("id"), "elements").dropDuplicates(["id"])


def _places(keys: pd.Series) -> np.ndarray:
    """The place of each key in the bit table."""
    return (mixed(np.asarray(keys).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def _set(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def bit_table(crowds: DataFrame) -> np.ndarray:
    """2 ** BITS bits as 64-bit words: those of the ``key`` column of ``crowds`` are set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _places(pdf["key"])
            yield pd.DataFrame({"word": at >> 6, "bits": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    words = crowds.select("key").mapInPandas(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    with shuffles_dropped(crowds.sparkSession):
        words = words.toArrow()
    table = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def members(own: DataFrame, table: np.ndarray) -> DataFrame:
    """id, n, key, at (the key's position in its window), before (the few keys ahead of it) of keys set in the table."""
    kind = own.schema["id"].dataType.simpleString()
    shared = own.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for pdf in batches:
            keys = [np.asarray(k) for k in pdf["keys"]]
            at = [np.flatnonzero(_set(bits, _places(k))) for k in keys]
            rows = pdf[["id", "n"]].loc[pdf.index.repeat([len(x) for x in at])].reset_index(drop=True)
            if len(rows):
                before = [k[max(0, i - BEFORE) : i] for k, own_at in zip(keys, at, strict=True) for i in own_at]
                yield rows.assign(key=np.concatenate([k[x] for k, x in zip(keys, at, strict=True)]), at=np.concatenate(at), before=before)

    return own.select("id", "n", "keys").mapInPandas(run, f"id {kind}, n long, key long, at long, before array<long>")


def _meeting(a: str, b: str, percent: int) -> Column:
    """Two rows of one region allow the threshold if this is the first common key, and the keys just before don't deny that.

    No more than what follows the first common key can be common. Linked pairs pass at their first common key at least.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    fresh = ~F.arrays_overlap(f"{a}.before", f"{b}.before")
    return (F.col(f"{a}.key") == F.col(f"{b}.key")) & ((100 + percent) * most >= percent * (na + nb)) & fresh


def _alike(a: str, b: str, percent: int) -> Column:
    """No more bins differ than elements may.

    With s elements in both sets together, linked ones share percent * s / (100 + percent) at least, so
    (100 - percent) * s / (100 + percent) at most are in one of them only, and only those can make bins differ.
    """
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(WORDS)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _thinned(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches are alike."""
    side = lambda name: marks.select(F.col("id").alias(name), F.struct("n", "sketch").alias(f"_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("_a", "_b", percent)).select("a", "b")


def _linked(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    left = whole.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = whole.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    union = F.size("ea") + F.size("eb") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, mark, n, first of each row of (id, text); first: (id, mark) of the smallest row reachable by links."""
    tables = Tables()
    settle = tables.settle
    common = common_keys(windows(docs, width, percent, np.zeros(0, dtype=[("key", np.uint64), ("n", np.int64)])))
    found = settle(windows(docs, width, percent, common))

    alike = ["n", "d1", "d2"]
    classes = found.where("id IS NOT NULL AND n > 0").groupBy(*alike).agg(F.min(F.struct("id", "mark")).alias("first"))
    # Classes are numbered once and written: an id may stand for several texts, and so for several classes.
    classes = settle(classes.withColumn("id", F.monotonically_increasing_id()))
    own = found.join(classes.select(F.col("id").alias("class"), "first.id", "first.mark"), ["id", "mark"])
    own = settle(own.select(F.col("class").alias("id"), "n", "keys", "sketch").dropDuplicates(["id"]))
    rows = settle(found.select("id", "mark", *alike))
    tables.drop(found)

    crowds = own.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    crowds = settle(crowds)
    held = settle(members(own, bit_table(crowds)).join(crowds, "key"))
    small, large = held.where(F.col("m") <= LARGE).drop("m"), held.where(F.col("m") > LARGE).drop("m")
    marks = settle(own.select("id", "n", "sketch"))
    large = settle(large.join(marks.select("id", "sketch"), "id"))
    tables.drop(own, crowds)

    reach = _meeting("x", "y", percent)
    near = _pairs(small.alias("x").join(small.alias("y"), reach & (F.col("x.id") < F.col("y.id"))), "x.id", "y.id")

    part = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    chosen = large.groupBy("key", part.alias("part")).agg(F.min(F.struct(F.xxhash64("id", F.lit(1)), "id"))["id"].alias("id"))
    pivots = settle(large.join(chosen.select("key", "id"), ["key", "id"], "left_semi"))
    like = reach & _alike("x", "y", percent)
    balls = _pairs(large.alias("x").join(pivots.alias("y"), like & (F.col("x.id") != F.col("y.id"))), "x.id", "y.id")
    # Few rows of small regions are in a pair, so their sketches come after.
    pairs = settle(_thinned(near.distinct(), marks, percent).unionByName(balls).distinct())
    tables.drop(held, pivots, marks)

    links = _checked(tables, docs, classes, pairs, width, percent)
    parts = components(links, "a", "b").withColumnRenamed("node", "id")
    bare, large = large, settle(large.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")))
    tables.drop(bare)
    counts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    most = settle(counts.groupBy("key").agg(F.max(F.struct("m", "component"))["component"].alias("most")))
    outside = large.join(most, "key").where("component != most")
    once = (F.col("y.component") == F.col("x.most")) | (F.col("x.id") < F.col("y.id"))
    late = like & (F.col("x.component") != F.col("y.component")) & once
    late = settle(_pairs(outside.alias("x").join(large.alias("y"), late), "x.id", "y.id").distinct())
    tables.drop(large, most)
    if not late.isEmpty():
        links = links.unionByName(_checked(tables, docs, classes, late, width, percent))

    parts = components(links, "a", "b").withColumnRenamed("node", "id")
    of = settle(classes.join(parts, "id", "left").select(*alike, "first", F.coalesce("component", "id").alias("component")))
    tables.drop(classes)
    least = of.groupBy("component").agg(F.min("first").alias("least"))
    of = settle(of.join(least, "component").select(*alike, "least"))
    rows = rows.join(of, alike, "left")
    itself = F.struct("id", "mark")
    return rows.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.coalesce("least", itself)).alias("first"))


def _checked(tables: Tables, docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs``, which are dropped with their sets."""
    whole = tables.settle(sets(docs, classes, pairs, width))
    links = tables.settle(_linked(pairs, whole, percent))
    tables.drop(pairs, whole)
    return links


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def jaccard_components(
    docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words: between ASCII white space, A-Z as a-z; a text with fewer than ``width``
    words is one shingle, one without words (or null) is empty and linked with
    nothing. component_id: the smallest id reachable by links, itself included.
    Rows with equal ids and different texts are separate: an id joins no texts.
    A row with a null id has a null component and links nothing. Other columns
    are not read. No rows in, no rows out.
    """
    found = _grouped(_columns(docs, id_col, text_col), width, percent)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One text of ``docs`` for each component, with its columns as they are: that of the smallest id.

    Rows without an id stay, and so do rows that repeat the id and the text of
    the one that stays. Columns may have any names.
    """
    found = _grouped(_columns(docs, id_col, text_col), width, percent)
    gone = settle(found.where(F.struct("id", "mark") != F.col("first")).select("id", "mark").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("mark"))
    return rows.join(gone, ["id", "mark"], "left_anti").select("row.*")
