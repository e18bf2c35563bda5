"""Aggregations over pattern results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators.ordering import listed
from wovengraph.session import settle


def count_values(df: DataFrame, keys: list[str], var: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(var).alias("n"), F.count_distinct(var).alias("n_distinct"))


def concat_group(df: DataFrame, keys: list[str], var: str, separator: str = ",", part_rows: int = 10_000) -> DataFrame:
    """The distinct values of a group as sorted text, in parts of bounded length."""
    distinct = settle(df.select(*keys, var).where(F.col(var).isNotNull()).distinct())
    parts = listed(distinct, keys, [var], F.col(var), "_items", part_rows)
    return parts.select(*keys, "part", F.array_join("_items", separator).alias("items"))


def split_group(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """The text of ``concat_group`` back to one row per member of the set."""
    return df.withColumn(column, F.explode(F.array_distinct(F.split(column, separator))))


def next_order(values: DataFrame, requests: DataFrame) -> DataFrame:
    """The next position in every requested (resource, prop), counting live values only."""
    live = values.where(~F.col("is_deleted")).groupBy("resource", "prop").agg(F.max("vorder").alias("_max"))
    return requests.join(live, ["resource", "prop"], "left").select(
        *requests.columns, F.coalesce(F.col("_max") + 1, F.lit(0)).cast("long").alias("next_order")
    )


def distinct_sorted(df: DataFrame, column: Column, name: str) -> DataFrame:
    """All members of an array column, each once, in order."""
    return df.select(F.explode(column).alias(name)).distinct().orderBy(name)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


