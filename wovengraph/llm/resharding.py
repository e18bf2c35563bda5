"""Minimum-cost-flow resharding: equal row counts with the fewest bytes moved.

A layout is a folder of Parquet files below ``shard=N``; each file row holds
the input row (column ``row``) and its ``size``. The law is ``rows``: after
resharding the counts of the new shards differ by one at most. The flow
network has one node per old and new shard, so it is solved where the job is
planned, whatever the data's size: keeping a row costs nothing, moving the
m-th smallest row of a shard costs its bytes, and the shards that get one row
more than others are chosen by the flow as well.

Moved rows of a shard are its smallest ones, cut into one block per target.
A block is a range of (size, id, place), so rewriting needs no join and no
shuffle of texts: rows are compared with a few bounds as they are read. Only
shards that give rows away are rewritten; the files of shards that stay or
only receive are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wovengraph.llm.common import numbered, settle, shared_folder


@dataclass(frozen=True)
class Block:
    """Ranks [start, end) of an old shard, in order of size, go to a new shard."""

    old: int
    new: int
    start: int
    end: int


def cheapest_flow(arcs: list[list[int]], source: int, sink: int, nodes: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) arc of a maximum flow of least cost.

    Successive cheapest augmenting paths; costs are not negative.
    """
    flow = [0] * len(arcs)
    while True:
        cost, via = [float("inf")] * nodes, [None] * nodes
        cost[source] = 0
        changed = True
        while changed:
            changed = False
            for i, (a, b, room, price) in enumerate(arcs):
                for frm, to, left, pay, way in ((a, b, room - flow[i], price, 1), (b, a, flow[i], -price, -1)):
                    if left > 0 and cost[frm] + pay < cost[to]:
                        cost[to], via[to], changed = cost[frm] + pay, (i, way, frm, left), True
        if cost[sink] == float("inf"):
            return flow
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = via[at][2]
        step = min(left for _, _, _, left in path)
        for i, way, _, _ in path:
            flow[i] += way * step


def solve(counts: dict[int, int], new_shards: int, marginal: dict[int, int]) -> list[Block]:
    """Blocks that leave every new shard with floor or ceil of the mean count.

    ``marginal``: for each old shard above the mean, the bytes of the row that
    moves only if the shard isn't given the extra row (rank count - ceil).
    Shards numbered ``new_shards`` or higher are closed and give all rows.
    """
    total = sum(counts.values())
    floor, extra = divmod(total, new_shards)
    olds, news = sorted(counts), range(new_shards)
    node = {("old", i): 4 + k for k, i in enumerate(olds)} | {("new", j): 4 + len(olds) + j for j in news}
    source, sink, pool, spare = 0, 1, 2, 3
    arcs: list[list[int]] = []
    where: dict[tuple[str, int], list[int]] = {}

    def arc(name, key, a, b, room, price):
        where.setdefault((name, key), []).append(len(arcs))
        arcs.append([a, b, room, price])

    for i in olds:
        arc("in", i, source, node["old", i], counts[i], 0)
        if i in news:
            arc("keep", i, node["old", i], node["new", i], counts[i], 0)
        forced = max(0, counts[i] - (floor + (extra > 0))) if i in news else counts[i]
        arc("move", i, node["old", i], pool, forced, 0)
        if i in marginal:
            arc("move", i, node["old", i], pool, 1, marginal[i])
    for j in news:
        arc("get", j, pool, node["new", j], total, 0)
        arc("out", j, node["new", j], sink, floor, 0)
        arc("more", j, node["new", j], spare, 1, 0)
    arc("spare", 0, spare, sink, extra, 0)
    flow = cheapest_flow(arcs, source, sink, 4 + len(olds) + new_shards)
    through = lambda name, key: sum(flow[a] for a in where.get((name, key), []))
    need = [[j, through("get", j)] for j in news]
    blocks = []
    for i in olds:
        start, left = 0, through("move", i)
        while left:
            while not need[0][1]:
                need.pop(0)
            n = min(left, need[0][1])
            blocks.append(Block(i, need[0][0], start, start + n))
            start, left, need[0][1] = start + n, left - n, need[0][1] - n
        if i in news and start < counts[i]:
            blocks.append(Block(i, i, start, counts[i]))
    return blocks


class Layout:
    """Shards in one folder or several, each with the shards that are valid in it."""

    def __init__(self, spark: SparkSession, schema: T.StructType, parts: list[tuple[str, list[int] | None]]):
        self.spark, self.schema, self.parts = spark, schema, parts

    def rows(self) -> DataFrame:
        """row, size, shard, and the place of each row: part, file, at."""
        out = None
        for k, (path, shards) in enumerate(self.parts):
            df = self.spark.read.schema(self.schema).parquet(path)
            df = df if shards is None else df.where(F.col("shard").isin(shards))
            df = df.select("row", "size", "shard", F.lit(k).alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
            out = df if out is None else out.unionByName(df)
        return out


def lay_out(docs: DataFrame, shard: Column, text_col: str = "text") -> Layout:
    """Write rows as shard files; size: UTF-8 bytes of the text (null: none) plus 1."""
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession)
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), size.alias("size"), shard.cast("int").alias("shard"))
    rows.write.partitionBy("shard").parquet(path)
    return Layout(spark, rows.schema, [(path, None)])


def plan(layout: Layout, new_shards: int, id_col: str = "doc_id") -> tuple[list[Block], DataFrame]:
    """(blocks, ranks): ranks has shard, size, id, file, at, rank of each row that could move."""
    rows = layout.rows().select("shard", "size", F.col(f"row.`{id_col}`").alias("id"), "part", "file", "at")
    counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
    floor, extra = divmod(sum(counts.values()), new_shards)
    ceil = floor + (extra > 0)
    above = [i for i, n in counts.items() if n > floor or i >= new_shards]
    order = ["size", "id", "part", "file", "at"]
    ranks = settle(numbered(rows.where(F.col("shard").isin(above)), ["shard"], order))
    edge = {i: counts[i] - ceil for i in above if i < new_shards and counts[i] >= ceil and extra}
    marginal = {r["shard"]: r["size"] for r in _at_ranks(ranks, list(edge.items())).select("shard", "size").collect()}
    return solve(counts, new_shards, marginal), ranks


def _at_ranks(ranks: DataFrame, at: list[tuple[int, int]]) -> DataFrame:
    chosen = F.lit(False)
    for shard, rank in at:
        chosen = chosen | ((F.col("shard") == shard) & (F.col("rank") == rank))
    return ranks.where(chosen)


def reshard(layout: Layout, new_shards: int, id_col: str = "doc_id") -> Layout:
    """The layout after rewriting the shards that give rows away."""
    blocks, ranks = plan(layout, new_shards, id_col)
    givers = sorted({b.old for b in blocks if b.old != b.new})
    if not givers:
        return layout
    blocks = [b for b in blocks if b.old in givers]
    bounds = {(r["shard"], r["rank"]): r for r in _at_ranks(ranks, [(b.old, b.start) for b in blocks]).collect()}
    rows = layout.rows()
    names = ["size", "id", "part", "file", "at"]
    kinds = {f.name: f.dataType for f in ranks.schema.fields}
    key = F.struct("size", F.col(f"row.`{id_col}`").alias("id"), "part", "file", "at")
    target = None
    for b in sorted(blocks, key=lambda b: (b.old, -b.start)):
        low = bounds[b.old, b.start]
        bound = F.struct(*(F.lit(low[n]).cast(kinds[n]).alias(n) for n in names))
        test = (F.col("shard") == b.old) & (key >= bound)
        target = F.when(test, b.new) if target is None else target.when(test, b.new)
    path = shared_folder(layout.spark)
    moved = rows.where(F.col("shard").isin(givers)).select("row", "size", target.cast("int").alias("shard"))
    moved.write.partitionBy("shard").parquet(path)
    shards = range(max(new_shards, *givers) + 1)
    stay = [(p, [s for s in (shards if valid is None else valid) if s not in givers]) for p, valid in layout.parts]
    return Layout(layout.spark, layout.schema, [*stay, (path, None)])


def slots(layout: Layout, *columns: Column) -> DataFrame:
    """``columns`` of each row, shard and slot: gapless from 0 in each shard, in the order of files and of rows in them.

    The columns (of ``row`` and ``size``) are computed as files are read; texts they don't return aren't shuffled.
    """
    rows = layout.rows().select("shard", "part", "file", "at", *columns)
    files = rows.groupBy("shard", "part", "file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part", "file")) - F.col("n")
    files = files.withColumn("before", before).drop("n")
    return rows.join(files, ["shard", "part", "file"]).withColumn("slot", F.col("before") + F.col("at"))
