"""Positions, predecessors and bounded lists within groups of any size.

A window sorts each group in one task. Groups above ``hot_rows`` are therefore
cut into ranges of (keys, order) over all partitions and written once, sorted
(``ranged``). Rows of a group that lie in one range stand next to each other, so their
position is their distance from the first of them plus what the ranges before hold
(a small table). Every group is cut by its own rows, whatever the others hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wovengraph.session import settle

HOT_ROWS = 2_000_000
PART_ROWS = 10_000
# Slots in which groups are counted before any of them is counted by its keys.
SLOTS = 1 << 18
# Rows of a few statements each that one task puts together in memory.
MEETING_ROWS = 250_000
# Bits that tell keys apart in ``marked``: 8 MB, whatever number of keys they stand for.
SIEVE_BITS = 1 << 26


def _order_columns(order: list[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _names(order: list[str]) -> list[str]:
    return [o.lstrip("-") for o in order]


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys)


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """The rows in ``parts`` ranges of (keys, order), written; ``_range`` and ``_at`` grow along both."""
    by = [*(F.col(k) for k in keys), *_order_columns(order)]
    cut = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return settle(cut.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def range_sizes(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _range, _first, _n, _before): the first ``_at`` and the rows of a group in a range, and its rows in those before."""
    sizes = cut.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _slots(df: DataFrame, keys: list[str]) -> DataFrame:
    """(_slot, _n), written: rows by a hash of their keys. Slots and counts are all that moves; the keys stay where they are."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    return settle(df.select(slot.alias("_slot")).groupBy("_slot").agg(F.count(F.lit(1)).alias("_n")))


def _crowded(df: DataFrame, keys: list[str], slots: DataFrame, hot_rows: int) -> DataFrame:
    """Keys of the rows that lie in slots with more than ``hot_rows`` rows; each hot group is among them."""
    full = slots.where(F.col("_n") > hot_rows).select("_slot")
    if full.isEmpty():
        return df.limit(0).select(*keys)
    held = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("_slot"))
    return held.join(full, "_slot").select(*keys)


def parts_for(spark: SparkSession, total: int) -> int:
    """Partitions for rows that meet by a key and are taken apart there: as many as keep a task's share in its memory.

    Spark's own sizes count bytes as they are moved, packed.
    """
    return max(spark.sparkContext.defaultParallelism, -(-total // MEETING_ROWS))


def _split(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(rows of ordinary groups, rows of hot groups or None, how many these are)."""
    if not keys:
        total = df.count()
        return (None, df, total) if total > hot_rows else (df, None, 0)
    return _split_by(df, keys, hot_rows, _slots(df, keys))


def _split_by(df: DataFrame, keys: list[str], hot_rows: int, slots: DataFrame) -> tuple[DataFrame | None, DataFrame | None, int]:
    hot = settle(_crowded(df, keys, slots, hot_rows).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows))
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return df, None, 0
    cond = _same_keys(df, hot, keys)
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi"), total


def split(df: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of groups of at most ``hot_rows`` rows, those of the others if there are any, and how many rows there are in all."""
    slots = _slots(df, keys)
    cold, hot, _ = _split_by(df, keys, hot_rows, slots)
    return cold, hot, slots.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def _parts(df: DataFrame, total: int, hot_rows: int, ranges: int | None) -> int:
    """Ranges of about ``hot_rows`` rows, as many as there are shuffle partitions at least."""
    return ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // hot_rows))


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str = "pos", hot_rows: int = HOT_ROWS, ranges: int | None = None
) -> DataFrame:
    """1-based position of every row in its group; ``-col`` orders descending.

    The order must be total within a group, and its columns not null.
    """
    cold, hot, total = _split(df, keys, hot_rows)
    out = []
    if cold is not None:
        window = Window.partitionBy(*keys).orderBy(*_order_columns(order))
        out.append(cold.withColumn(name, F.row_number().over(window).cast("long")))
    if hot is not None:
        hot = ranged(hot, keys, order, _parts(df, total, hot_rows, ranges))
        joined = hot.alias("l").join(range_sizes(hot, keys).alias("z"), _same_keys_alias("l", "z", [*keys, "_range"]))
        position = F.col("l._at") - F.col("z._first") + F.col("z._before") + 1
        out.append(joined.select(*[F.col(f"l.`{c}`") for c in df.columns], position.cast("long").alias(name)))
    return reduce(DataFrame.unionByName, out)


def _same_keys_alias(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """The ``value`` of the row before, in ascending order within the group."""
    cold, hot, total = _split(df, keys, hot_rows)
    out = []
    if cold is not None:
        out.append(cold.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))))
    if hot is not None:
        hot = ranged(hot, keys, order, _parts(df, total, hot_rows, ranges))
        group = [*keys, "_range"]
        last = hot.groupBy(*group).agg(F.max_by(value, "_at").alias("_last"))
        last = last.select(*group, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")).alias("_carry"))
        window = Window.partitionBy(*group).orderBy("_at")
        local = hot.withColumn("_lag", F.lag(value).over(window)).withColumn("_first", F.row_number().over(window) == 1)
        joined = local.alias("l").join(last.alias("z"), _same_keys_alias("l", "z", group))
        previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))
        out.append(joined.select(*[F.col(f"l.`{c}`") for c in df.columns], previous.alias(name)))
    return reduce(DataFrame.unionByName, out)


def listed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column | None,
    name: str,
    part_rows: int = PART_ROWS,
    hot_rows: int = HOT_ROWS,
    distinct: bool = False,
) -> DataFrame:
    """One ordered list per group, cut into parts of at most ``part_rows`` items.

    Rows are (keys, part, list); nothing is left out and no list is unbounded.
    Without ``item`` the order's columns are listed, with ``distinct`` each row of keys and these once.
    A group that fills one part at most is sorted as a list; only the rows of others are numbered.
    """
    columns = F.struct(*_names(order))
    if distinct and item is not None:
        raise ValueError("distinct lists hold the order's columns")
    if not keys or any(o.startswith("-") for o in order):
        cold, hot = None, df
    else:
        cold, hot, _ = _split(df, keys, part_rows)
    out = []
    if cold is not None:
        held = columns if item is None else F.struct(columns.alias("_at"), item.alias("_item"))
        items = F.array_sort((F.collect_set if distinct else F.collect_list)(held))
        grouped = cold.groupBy(*keys).agg(items.alias("_items"))
        out.append(grouped.select(*keys, F.lit(0).cast("long").alias("part"), F.col("_items" if item is None else "_items._item").alias(name)))
    if hot is not None:
        rows = numbered(settle(hot.select(*keys, *_names(order)).distinct()) if distinct else hot, keys, order, "_pos", hot_rows)
        part = F.floor((F.col("_pos") - 1) / part_rows).cast("long").alias("part")
        rows = rows.select(*keys, part, "_pos", (columns if item is None else item).alias("_item"))
        grouped = rows.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_items"))
        out.append(grouped.select(*keys, "part", F.col("_items._item").alias(name)))
    return reduce(DataFrame.unionByName, out)


def marked(rows: DataFrame, others: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows with a column that is true wherever ``others`` may hold their keys: for all that it holds, and for some by chance.

    The keys of ``others`` stand as bits in a table of bounded size, which every task gets; neither side moves. Null keys count as equal.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(SIEVE_BITS))
    bit = F.expr("shiftleft(1L, cast(_at & 63 AS int))")
    bits = others.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(settle(bits)), "_word", "left")
    return held.select(*rows.columns, F.coalesce(F.getbit("_bits", F.col("_at").bitwiseAND(63)) == 1, F.lit(False)).alias(name))


def sifted(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without most of those whose keys ``others`` does not hold: for a join with it, which then moves fewer."""
    return marked(rows, others, keys, "_may").where("_may").select(*rows.columns)


def having(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys ``others`` holds.

    Spark pushes a semi join into every part of a union, and each part then sorts all of ``others`` again. This one is done once.
    """
    return rows.join(others.select(*keys).distinct(), keys).select(*rows.columns)


def lacking(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys ``others`` does not hold; as ``having``, without an anti join in every part of a union."""
    marks = others.select(*keys).distinct().withColumn("_met", F.lit(True))
    return rows.join(marks, keys, "left").where("_met IS NULL").select(*rows.columns)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every group, by partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*df.columns)


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per group in a total order.

    Up to 1000 rows, Spark limits each group before the shuffle, so a hot group
    costs n rows per map task. Longer lists are numbered.
    """
    if n > 1000:
        return numbered(df, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")
    window = Window.partitionBy(*keys).orderBy(*_order_columns(order))
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
