"""Walks over links: neighbourhoods, references, parts, version chains.

Links: (link_value, src, prop, dst, is_deleted, creator, project, permissions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.operators import access
from wovengraph.operators.ordering import first_n
from wovengraph.session import settle


def link_kind(links: DataFrame, prop_closure: DataFrame, base: str, but_not: str | None = None) -> DataFrame:
    """Links whose property is the base or below it, without those below ``but_not``."""
    below = prop_closure.where(F.col("ancestor") == base).select(F.col("node").alias("prop"))
    rows = links.join(below, "prop", "left_semi")
    if but_not:
        excluded = prop_closure.where(F.col("ancestor") == but_not).select(F.col("node").alias("prop"))
        rows = rows.join(excluded, "prop", "left_anti")
    return rows


def visible_edges(links: DataFrame, resources: DataFrame, profiles: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame]:
    """Live nodes and links that the user may see; a link needs itself and both ends visible."""
    nodes = settle(access.visible(resources.where(~F.col("is_deleted")), profiles, user_id))
    shown = access.visible(links.where(~F.col("is_deleted")), profiles, user_id)
    ends = nodes.select("iri")
    edges = shown.join(ends.withColumnRenamed("iri", "src"), "src", "left_semi").join(
        ends.withColumnRenamed("iri", "dst"), "dst", "left_semi"
    )
    return nodes, edges.select("link_value", "src", "prop", "dst")


def neighbourhood(
    edges: DataFrame, starts: DataFrame, depth: int, outbound: bool = True, per_node: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from every start (column ``node``) along one direction.

    Gives nodes (start, node, depth) and edges (start, link_value, src, prop,
    dst). ``per_node`` keeps that many edges of a node in a fixed order; by
    default all are kept. A round shuffles the newest nodes and joins them to
    the edges; a hub is split by the engine's skew join.
    """
    here, there = ("src", "dst") if outbound else ("dst", "src")
    usable = settle(first_n(edges, [here], [there, "prop", "link_value"], per_node) if per_node else edges)
    front = settle(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("depth", F.lit(0)))
    seen, walked = front, []
    for step in range(1, depth + 1):
        out = settle(front.select("start", F.col("node").alias(here)).join(usable, here))
        walked.append(out.select("start", "link_value", "src", "prop", "dst"))
        reached = out.select("start", F.col(there).alias("node")).distinct()
        front = settle(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(front)
    return seen, reduce(DataFrame.union, walked).distinct()


def both_directions(edges: DataFrame, starts: DataFrame, depth: int, per_node: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The outbound and the inbound neighbourhood together."""
    edges = settle(edges)
    out_nodes, out_edges = neighbourhood(edges, starts, depth, True, per_node)
    in_nodes, in_edges = neighbourhood(edges, starts, depth, False, per_node)
    nodes = out_nodes.union(in_nodes).groupBy("start", "node").agg(F.min("depth").alias("depth"))
    return nodes, out_edges.union(in_edges).distinct()


def prune_isolated(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes touching an edge, and the starts."""
    touched = edges.select("start", F.explode(F.array("src", "dst")).alias("node"))
    kept = touched.union(starts.select(F.col("node").alias("start"), "node"))
    return nodes.join(kept, ["start", "node"], "left_semi")


def incoming_references(links: DataFrame, resources: DataFrame, prop_closure: DataFrame, base: str, but_not: str) -> DataFrame:
    """Live links to each resource with facts of the referring one: (target, referrer, prop, link_value, label, cls)."""
    rows = link_kind(links.where(~F.col("is_deleted")), prop_closure, base, but_not)
    facts = resources.where(~F.col("is_deleted")).select(F.col("iri").alias("src"), "label", "cls")
    return rows.join(facts, "src").select(
        F.col("dst").alias("target"), F.col("src").alias("referrer"), "prop", "link_value", "label", "cls"
    )


def containers(links: DataFrame, resources: DataFrame, prop_closure: DataFrame, part_of: str) -> DataFrame:
    """The live resource each resource is part of: (iri, container)."""
    rows = link_kind(links.where(~F.col("is_deleted")), prop_closure, part_of)
    live = resources.where(~F.col("is_deleted")).select(F.col("iri").alias("dst"))
    return rows.join(live, "dst", "left_semi").select(F.col("src").alias("iri"), F.col("dst").alias("container"))


def parts_in_order(part_links: DataFrame, sequence: DataFrame, files: DataFrame) -> DataFrame:
    """Parts with their sequence number and images: one row per part.

    part_links: (iri, container); sequence: (iri, seqnum); files: (iri,
    is_preview, file). Sort by (container, seqnum, iri) to list them.
    """
    images = files.groupBy("iri").agg(
        F.min(F.when(F.col("is_preview"), F.col("file"))).alias("preview"),
        F.min(F.when(~F.col("is_preview"), F.col("file"))).alias("full_image"),
    )
    return part_links.join(sequence, "iri", "left").join(images, "iri", "left").select(
        "container", "seqnum", "iri", "preview", "full_image"
    )


def regions(links: DataFrame, resources: DataFrame, class_closure: DataFrame, region_class: str, prop: str) -> DataFrame:
    """Live resources of the region class that point at a resource: (resource, region, label)."""
    below = class_closure.where(F.col("ancestor") == region_class).select(F.col("node").alias("cls"))
    shapes = resources.where(~F.col("is_deleted")).join(below, "cls", "left_semi")
    rows = links.where((F.col("prop") == prop) & ~F.col("is_deleted"))
    return rows.join(shapes.select(F.col("iri").alias("src"), "label"), "src").select(
        F.col("dst").alias("resource"), F.col("src").alias("region"), "label"
    )


def chain_heads(versions: DataFrame, max_rounds: int = 64) -> DataFrame:
    """For every version the newest one of its chain and the steps to it: (value, head, age).

    Pointers are doubled each round, so a chain of length n takes log2(n)
    rounds. A pointer that has reached its head leaves the loop, so no join key
    is ever shared by many rows.
    """
    later = versions.where("prev_value IS NOT NULL").select(F.col("prev_value").alias("value"), F.col("value").alias("to"))
    linked = versions.select("value").join(later, "value", "left")
    heads = linked.where("to IS NULL").select("value", F.col("value").alias("head"), F.lit(0).cast("long").alias("age"))
    ends = linked.where("to IS NULL").select(F.col("value").alias("to"), F.lit(True).alias("is_end"))
    open_ = settle(
        linked.where("to IS NOT NULL").join(ends, "to", "left").select("value", "to", F.lit(1).cast("long").alias("age"), "is_end")
    )
    finished = [heads]
    for _ in range(max_rounds):
        finished.append(open_.where("is_end").select("value", F.col("to").alias("head"), "age"))
        walking = open_.where("is_end IS NULL")
        if walking.isEmpty():
            return settle(reduce(DataFrame.union, finished))
        ahead = open_.select(F.col("value").alias("to"), F.col("to").alias("_to"), F.col("age").alias("_age"), F.col("is_end").alias("_end"))
        # A target that finished in an earlier round is looked up among the finished ones.
        done = reduce(DataFrame.union, finished[1:-1]) if len(finished) > 2 else None
        if done is not None:
            ahead = ahead.union(done.select("value", "head", "age", F.lit(True)))
        open_ = settle(
            walking.select("value", "to", "age")
            .join(ahead, "to")
            .select("value", F.col("_to").alias("to"), (F.col("age") + F.col("_age")).alias("age"), F.col("_end").alias("is_end"))
        )
    raise ValueError("a version chain does not end")


def version_history(versions: DataFrame, heads: DataFrame, profiles: DataFrame, user_id: str) -> DataFrame:
    """Visible versions of every live current value, newest first by ``age``.

    Older versions are shown whether deleted or not; a pointer to a version the
    user may not see is blanked.
    """
    live = versions.where(~F.col("is_deleted")).select(F.col("value").alias("head"))
    current = heads.join(live, "head", "left_semi")
    shown = access.visible(versions.select("value", "prev_value", "creator", "project", "permissions"), profiles, user_id)
    shown = shown.select("value", "prev_value").join(current, "value")
    seen = shown.select(F.col("value").alias("prev_value"), F.lit(True).alias("_seen"))
    return shown.join(seen, "prev_value", "left").select(
        F.col("head").alias("current"), "age", "value", F.when(F.col("_seen"), F.col("prev_value")).alias("prev_value")
    )


def is_version_of(requests: DataFrame, heads: DataFrame) -> DataFrame:
    """Answer (current, value): is the value among the versions of the current one?"""
    hits = heads.select(F.col("head").alias("current"), "value", F.lit(True).alias("found"))
    return requests.join(hits, ["current", "value"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def holders(requests: DataFrame, values: DataFrame, links: DataFrame) -> DataFrame:
    """Resource and property of values and link values: (value, resource, prop)."""
    held = values.select(F.col("iri").alias("value"), "resource", "prop").union(
        links.select("link_value", "src", F.concat("prop", F.lit("Value")))
    )
    return requests.join(held, "value")


def link_values(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Link values for (src, prop, dst), with whether the direct link exists; unknown links give nulls."""
    known = links.select("src", "prop", "dst", "link_value", "ref_count", (~F.col("is_deleted")).alias("direct_exists"))
    return requests.join(known, ["src", "prop", "dst"], "left").withColumn(
        "direct_exists", F.coalesce("direct_exists", F.lit(False))
    )


def link_values_by_iri(requests: DataFrame, links: DataFrame) -> DataFrame:
    known = links.select("link_value", "src", "prop", "dst", "ref_count", (~F.col("is_deleted")).alias("direct_exists"))
    return requests.join(known, "link_value")


def assemble(mains: DataFrame, links: DataFrame, resources: DataFrame, depth: int) -> DataFrame:
    """Resources embedded in main resources by links, level by level.

    Rows are (main, level, link_value, prop, incoming, source, target,
    target_label). On each level the links leading on from the newest
    resources are followed; incoming links count for the main resource only. A
    resource embedded once in a main resource is not opened again.
    """
    live = links.where(~F.col("is_deleted"))
    facts = resources.where(~F.col("is_deleted")).select(F.col("iri").alias("target"), F.col("label").alias("target_label"))
    out = live.select("link_value", "prop", F.lit(False).alias("incoming"), F.col("src").alias("source"), F.col("dst").alias("target"))
    back = live.select("link_value", "prop", F.lit(True).alias("incoming"), F.col("dst").alias("source"), F.col("src").alias("target"))
    front = settle(mains.select(F.col("iri").alias("main"), F.col("iri").alias("source")).distinct())
    seen, levels = front, []
    for level in range(1, depth + 1):
        steps = out.union(back) if level == 1 else out
        rows = settle(front.join(steps, "source").join(facts, "target").withColumn("level", F.lit(level)))
        levels.append(rows.select("main", "level", "link_value", "prop", "incoming", "source", "target", "target_label"))
        reached = rows.select("main", F.col("target").alias("source")).distinct()
        front = settle(reached.join(seen, ["main", "source"], "left_anti"))
        seen = seen.unionByName(front)
    return reduce(DataFrame.union, levels)


