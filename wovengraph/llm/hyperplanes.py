"""Near duplicates of embeddings: random-hyperplane signs in several tables, exact cosine, components.

Vectors are compared only within their label. The cosine of two unit vectors
with angle a makes each random hyperplane separate them with probability
a / pi, so a table of b signs lets a pair at the threshold meet with
probability (1 - a / pi) ** b. The number of signs follows the number of rows
(chance meetings stay below one a row and table), the number of tables follows
from the wanted chance ``recall`` that a pair exactly at the threshold is
found; both are formulas, the same at every size. Every pair that meets in a
table is compared in double precision.

Equal vectors of a label are one class before anything is compared, so a
vector held by a third of all rows is one row with a count. Bucket members
are compared in blocks of bounded size: a bucket with more rows than a block
becomes several block pairs, which are tasks of their own. No pairs are
written: a block gives each row its number of links and the smallest row of
its linked set within the block, and components joins these.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.llm.common import components, settle

BLOCK = 1024
SEED = 20240901


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs a table, tables) for so many rows."""
    meet = 1 - math.acos(threshold) / math.pi
    signs = min(62, max(8, math.ceil(math.log2(max(rows, 2)))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet**signs))
    return signs, tables


def usable(vector: Column) -> Column:
    """Not null, not zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def signatures(signs: int, tables: int):
    """mapInPandas function: (cls, label, vec) to one row per table: cls, label, tab, sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vec"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, signs * tables))
                side = unit(np.stack(part["vec"].to_numpy()).astype(np.float64)) @ planes[dim] >= 0
                sig = side.reshape(len(part), tables, signs) @ weights
                yield pd.DataFrame({"cls": part["cls"].to_numpy(), "label": part["label"].to_numpy(), "sigs": list(sig)})

    return run


def _links(x: np.ndarray, y: np.ndarray, sx: np.ndarray, sy: np.ndarray, tab: int, threshold: float) -> np.ndarray:
    """Linked pairs of two blocks that meet in this table first."""
    link = x @ y.T >= threshold
    for t in range(tab):
        if not link.any():
            break
        link &= sx[:, t][:, None] != sy[:, t][None, :]
    return link


def _join_sets(parent: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest position reachable within a square block; labels spread until none changes."""
    link = link | link.T
    np.fill_diagonal(link, True)
    while True:
        least = np.where(link, parent[None, :], len(parent)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == parent).all():
            return parent
        parent = least


def compare(threshold: float):
    """mapInPandas function over rows sorted by block pair: link counts and local sets.

    A block pair has at most 2 * BLOCK rows; the last, unfinished one of a batch waits for the next.
    """
    keys = ["label", "dim", "tab", "sig", "lo", "hi"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tab, lo, hi = part["tab"].iloc[0], part["lo"].iloc[0], part["hi"].iloc[0]
        part = part.sort_values("cls")
        cls, weight, chunk = part["cls"].to_numpy(), part["weight"].to_numpy(), part["chunk"].to_numpy()
        vec, sig = unit(np.stack(part["vec"].to_numpy()).astype(np.float64)), np.stack(part["sigs"].to_numpy())
        link = _links(vec, vec, sig, sig, tab, threshold)
        np.fill_diagonal(link, False)
        if lo != hi:
            link &= chunk[:, None] != chunk[None, :]
        some = link.any(axis=1)
        root = cls[_join_sets(np.arange(len(cls)), link)]
        found = pd.DataFrame({"cls": cls, "links": link @ weight, "root": root})
        return found[some]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
            done = [one(pdf.iloc[a:b]) for a, b in zip(change[:-1], change[1:])]
            rest = pdf.iloc[change[-1] :] if len(change) else pdf
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest is not None and len(rest):
            yield one(rest)

    return run


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    recall: float = 0.9999,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows with a null label, and vectors that are null, zero or hold null or
    non-finite components, link with nothing and are their own component.
    Vectors of different length have no cosine and do not link. Equal ids
    are separate rows, linked only as their vectors are. A null id links like
    any other but names no component unless all ids of it are null; it is kept
    if its component has no id. Other columns are not read. No rows in, no rows out.
    """
    read = lambda c: F.col(f"`{c}`")
    rows = vectors.select(read(id_col).alias("id"), read(label_col).alias("label"), read(vector_col).cast("array<double>").alias("vec"))
    good = F.col("label").isNotNull() & usable(F.col("vec"))
    rows = rows.select("id", F.when(good, F.col("label")).alias("label"), F.when(good, F.col("vec")).alias("vec"))
    key = F.xxhash64("vec")
    classes = rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    # Classes are numbered once and written: an id may be held by several vectors.
    classes = settle(classes.withColumn("cls", F.monotonically_increasing_id()))
    signs, tables = plan(classes.count(), threshold, recall)
    kind = classes.schema["label"].dataType.simpleString()
    sigs = classes.select("cls", "label", "vec").mapInPandas(signatures(signs, tables), f"cls long, label {kind}, sigs array<long>")
    sigs = settle(sigs)
    met = sigs.join(classes.select("cls", "label", F.size("vec").alias("dim")), ["cls", "label"])
    met = met.select("cls", "label", "dim", F.posexplode("sigs").alias("tab", "sig"))
    bucket = ["label", "dim", "tab", "sig"]
    sizes = met.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = settle(sizes)
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = met.join(sizes, bucket).withColumn("chunks", chunks)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = placed.withColumn("other", other).select(
        "cls", *bucket, "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi")
    )
    full = placed.join(classes, ["cls", "label"]).join(sigs, ["cls", "label"])
    block = [*bucket, "lo", "hi"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = full.repartition(parts, *block).sortWithinPartitions(*block)
    full = full.select(*block, "cls", "chunk", "weight", "vec", "sigs")
    found = settle(full.mapInPandas(compare(threshold), "cls long, links long, root long"))
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    sets = components(found.where("cls != root"), "cls", "root").withColumnRenamed("node", "cls")
    of = classes.join(linked, "cls", "left").join(sets, "cls", "left").select(
        "label",
        key.alias("key"),
        F.col("vec").alias("class_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "cls").alias("component"),
        "first",
    )
    of = settle(of)
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    of = of.join(least, "component")
    rows = rows.withColumn("key", key)
    same = (rows["label"] == of["label"]) & (rows["key"] == of["key"]) & (rows["vec"] == of["class_vec"])
    joined = rows.join(of, same, "left")
    component = F.when(of["component"].isNull(), rows["id"]).otherwise(of["component_id"])
    return joined.select(
        rows["id"].alias(id_col),
        F.coalesce(of["n_links"], F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        rows["id"].eqNullSafe(component).alias("kept"),
    )
