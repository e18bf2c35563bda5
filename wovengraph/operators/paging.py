"""Ordering, pages, caps and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.session import settle

PAGE_SIZE = 25
NEAR = 10_000


class Ranked:
    """Rows in ranges of an order, written once, with a table of how many rows each range holds.

    Any slice is found by these counts: only the ranges it lies in are read, however many
    rows stand before it. The counts are one number for each range, not for each row.
    """

    def __init__(self, df: DataFrame, order: list[Column], parts: int | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.columns = df.columns
        cut = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        self.rows = settle(cut.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
        sizes = self.rows.groupBy("_range").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("_range")
        self.ranges, self.total = [], 0
        for r in sizes.collect():
            self.ranges.append((r["first"], self.total, self.total + r["n"]))
            self.total += r["n"]

    def slice(self, start: int, count: int) -> DataFrame:
        """Rows ``start`` to ``start + count``, counted from 0, in order."""
        wanted = F.lit(False)
        for first, low, high in self.ranges:
            if low < start + count and high > start:
                lo, hi = first + max(0, start - low), first + min(high, start + count) - low
                wanted = wanted | ((F.col("_at") >= lo) & (F.col("_at") < hi))
        return self.rows.where(wanted).orderBy("_at").select(*[F.col(f"`{c}`") for c in self.columns])


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_SIZE, near: int = NEAR) -> DataFrame:
    """A page by number. The order must end in a unique column, so that pages are stable."""
    return slice_sorted(df, order, number * size, size, near)


def sorted_by_value(matches: DataFrame, key: str, value: str, descending: bool = False) -> list[Column]:
    """Sort columns: the value, then the main resource."""
    return [F.col(value).desc() if descending else F.col(value).asc(), F.col(key).asc()]


def one_sort_value(matches: DataFrame, key: str, value: str, descending: bool = False) -> DataFrame:
    """One row per resource when the sorted property has several values."""
    pick = F.max(value) if descending else F.min(value)
    return matches.groupBy(key).agg(pick.alias(value))


def page_table(df: DataFrame, rows_per_page: int, current: int) -> DataFrame:
    """Every page with its first row, its number of rows and whether it is current."""
    total = df.count()
    pages = -(-total // rows_per_page)
    return df.sparkSession.range(pages).select(
        F.col("id").alias("page"),
        F.lit(pages).cast("long").alias("pages"),
        (F.col("id") * rows_per_page).alias("start_row"),
        F.least(F.lit(rows_per_page), F.lit(total) - F.col("id") * rows_per_page).cast("long").alias("rows_shown"),
        (F.col("id") == current).alias("is_current"),
    )


def slice_sorted(df: DataFrame, order: list[Column], start: int, count: int, near: int = NEAR) -> DataFrame:
    """Rows ``start`` to ``start + count`` of the order.

    Up to row ``near`` each task keeps its first rows and nothing is sorted as a whole;
    a slice farther on is found by rank (``Ranked``).
    """
    if start + count <= near:
        return df.orderBy(*order).offset(start).limit(count)
    return Ranked(df, order).slice(start, count)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that are not in b, each once."""
    return a.join(b, a.columns, "left_anti").distinct()


def covers(found: Column, expected: Column) -> Column:
    """True when every expected element was found."""
    return F.size(F.array_except(expected, found)) == 0


def union_distinct(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()
