"""Written intermediates, gapless numbering and connected components.

Intermediates are Parquet tables in the folder named by ``spark.checkpoint.dir``,
which all executors share, so a lost executor costs one re-read. A session
without the setting (a test) gets a folder of its own, set openly in its
configuration.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder for one operator's tables, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="wovengraph-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wovengraph-llm/{uuid.uuid4().hex}"


# Spark's own setting: a query's shuffle files go when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries within shuffle is dropped as soon as each ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settled(df: DataFrame) -> str:
    """Write the rows to a new folder below the shared one; its path. What the write shuffled is dropped."""
    path = shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table."""
    return df.sparkSession.read.schema(df.schema).parquet(settled(df))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Tables:
    """The written tables of one operator, deleted when nothing reads them any more."""

    def __init__(self) -> None:
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def settle(self, df: DataFrame) -> DataFrame:
        path = settled(df)
        read = df.sparkSession.read.schema(df.schema).parquet(path)
        self._paths[id(read)] = read, path
        return read

    def drop(self, *tables: DataFrame) -> None:
        """Delete these; all that is derived from them must be written."""
        for own in tables:
            df, path = self._paths.pop(id(own))
            discard(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Lower-case A-Z only, null as empty; every other character stays."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    capital = lambda p: (p >= F.lit("A")) & (p < F.lit("["))
    return F.array_join(F.transform(pieces, lambda p: F.when(capital(p), F.lower(p)).otherwise(p)), "")


# Arrow types of the columns that ``mapped`` makes.
ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def mapped(df: DataFrame, keep: list[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """The columns ``keep`` as they are, and for each row what a function of the other columns gives.

    ``make`` is called once a task; its function gets one batch after another
    and returns as many rows in the same order. The kept columns stay in Arrow:
    pandas would turn whole numbers into floats where one of a batch is null.
    """
    new = [c.rsplit(" ", 1) for c in schema.split(", ")]
    kinds = pa.schema([(name, ARROW[kind]) for name, kind in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            found = one(batch.select([c for c in batch.schema.names if c not in keep]).to_pandas())
            found = pa.RecordBatch.from_pandas(found[kinds.names], schema=kinds, preserve_index=False)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), *found.columns], names=[*keep, *kinds.names])

    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.mapInArrow(run, f"{kept}, {schema}")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 0-based position of each row within its keys along ``order``.

    No group meets in one task: rows are cut into ranges of (keys, order) over
    all partitions and written once, the rows of each (keys, range) are
    counted, and a running sum of these counts is what precedes a range.
    Without ``order`` any gapless numbering does, and rows stay where they are.
    """
    cut = df
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cut = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    cut = settle(cut.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    names = [f"_key{i}" for i in range(len(keys))]
    offsets = sizes.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col("_range").alias("_own"), before.alias("_before"))
    on = [F.col("_range") == F.col("_own"), *(F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True))]
    joined = cut.join(offsets, on).drop("_own", *names)
    local = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_at")) - 1
    return joined.withColumn(name, (F.col("_before") + local).cast("long")).drop("_range", "_before", "_at")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest id reachable from each node that has an edge.

    Alternating large-star and small-star rounds; every round is two grouped
    minima and is written before the next, until the edges no longer change.
    """
    pair = lambda df: df.where("u > v").distinct()
    tables = Tables()
    now = tables.settle(pair(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pair(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = tables.settle(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, tables.settle(pair(small.unionByName(least.select("u", F.col("m").alias("v")))))
        tables.drop(old, large)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int | None]:
    with shuffles_dropped(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]
