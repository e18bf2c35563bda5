"""Class, property and list hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators.ordering import numbered
from wovengraph.session import settle


class CycleError(ValueError):
    pass


def ancestors(edges: DataFrame, reflexive: bool = True) -> DataFrame:
    """All (node, ancestor, depth) of a hierarchy given as (child, parent); least depth.

    Walks double: a round joins those of exactly ``reach`` steps with all that
    are no longer, so a hierarchy of n levels takes log2(n) rounds. A cycle is
    an error, found as soon as a node is its own ancestor.
    """
    edges = settle(edges.select("child", "parent").distinct())
    newest = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    rounds, reach = [], 1
    while not newest.isEmpty():
        if not newest.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise CycleError("the hierarchy contains a cycle")
        rounds.append(newest)
        known = reduce(DataFrame.union, rounds).toDF("_via", "_up", "_more")
        farthest = newest.where(F.col("depth") == reach)
        further = farthest.join(known, farthest["ancestor"] == known["_via"])
        newest = settle(further.select("node", F.col("_up").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth")).distinct())
        reach *= 2
    if reflexive:
        nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
        rounds.append(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")))
    if not rounds:
        return newest
    return reduce(DataFrame.union, rounds).groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def descendants_of(closure: DataFrame, top: str) -> DataFrame:
    return closure.where(F.col("ancestor") == top).select("node", "depth")


def is_below(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """Answer (child, parent) pairs: is the first the second or below it?"""
    hits = closure.select(F.col("node").alias("child"), F.col("ancestor").alias("parent"), F.lit(True).alias("below"))
    return pairs.join(hits, ["child", "parent"], "left").withColumn("below", F.coalesce("below", F.lit(False)))


# Strictest first.
STRICTNESS = ["1", "0-1", "1-n", "0-n"]


def strictness(card: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in STRICTNESS]), card)


def inherited_cardinalities(class_edges: DataFrame, prop_closure: DataFrame, cardinalities: DataFrame) -> DataFrame:
    """Cardinalities of every class, own and inherited: (cls, prop, card, gui_order, origin).

    From the top down, one level per round: what a class gets from its base
    classes is dropped where one of its own properties is the same property or
    lies below it. Several inherited rows for a property: the strictest counts.
    """
    edges = settle(class_edges.select("child", "parent").distinct())
    nodes = edges.select(F.col("child").alias("cls")).union(edges.select("parent")).distinct()
    nodes = settle(nodes.union(cardinalities.select("cls")).distinct())
    depth = ancestors(edges, reflexive=True).groupBy("node").agg(F.max("depth").alias("level"))
    levels = settle(nodes.join(depth, nodes["cls"] == depth["node"], "left").select("cls", F.coalesce("level", F.lit(0)).alias("level")))
    deepest = levels.agg(F.max("level")).first()[0] or 0
    own = settle(cardinalities.select("cls", "prop", "card", "gui_order", F.col("cls").alias("origin")))
    overridden = settle(
        own.join(prop_closure, own["prop"] == prop_closure["node"], "left")
        .select("cls", F.explode(F.array_distinct(F.array("prop", F.coalesce("ancestor", "prop")))).alias("prop"))
        .distinct()
    )
    done = settle(own.join(levels.where("level = 0").select("cls"), "cls", "left_semi"))
    for level in range(1, deepest + 1):
        here = levels.where(F.col("level") == level).select("cls")
        up = edges.join(here.withColumnRenamed("cls", "child"), "child", "left_semi")
        gained = (
            up.join(done.withColumnRenamed("cls", "parent"), "parent")
            .select(F.col("child").alias("cls"), "prop", "card", "gui_order", "origin")
            .join(overridden, ["cls", "prop"], "left_anti")
        )
        best = F.min_by(F.struct("card", "gui_order", "origin"), F.struct(strictness(F.col("card")), "gui_order", "origin"))
        gained = gained.groupBy("cls", "prop").agg(best.alias("b")).select("cls", "prop", "b.*")
        done = settle(done.unionByName(own.join(here, "cls", "left_semi")).unionByName(gained))
    return done


def _climbed(nodes: DataFrame, key: Column) -> DataFrame:
    """row (the node's columns), root, level, path and problem of every node.

    A state covers a node's chain up to ``root`` and points to what is ``up``
    from there; joining it with the state of ``up`` doubles the chain, so n
    levels take log2(n) rounds. No chain is longer than there are nodes:
    pointers left open after that lead into a cycle.
    """
    nodes = settle(nodes)
    total = nodes.count()
    known = nodes.select(F.col("node").alias("_known")).distinct()
    state = nodes.select(F.struct(*nodes.columns).alias("row"), "node", F.col("parent").alias("up"), key.alias("path"))
    state = state.join(known, F.col("up") == F.col("_known"), "left")
    absent = F.col("up").isNotNull() & F.col("_known").isNull()
    state = state.select("row", "node", F.col("_known").alias("up"), F.col("node").alias("root"), F.lit(0).alias("level"), "path", F.when(absent, "absent_parent").alias("problem"))
    state, length = settle(state), 1
    while length <= total and not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("node").alias("up"), *(F.col(c).alias(f"_{c}") for c in ("up", "root", "level", "path", "problem")))
        open_ = state.where("up IS NOT NULL").join(above, "up")
        level = (F.col("level") + F.col("_level") + 1).alias("level")
        path = F.concat("_path", F.lit("/"), "path").alias("path")
        open_ = open_.select("row", "node", F.col("_up").alias("up"), F.col("_root").alias("root"), level, path, F.col("_problem").alias("problem"))
        state, length = settle(state.where("up IS NULL").unionByName(open_)), 2 * length
    return state.withColumn("problem", F.when(F.col("up").isNotNull(), "cycle").otherwise(F.col("problem")))


def tree_labels(nodes: DataFrame) -> DataFrame:
    """The nodes with root, level, pre, last and problem: what lies below a node has its root and a ``pre`` from its own to its ``last``.

    nodes: (node, parent, position, ...). Children go by position (missing ones last),
    then by node; ``pre`` counts from 0 within each root. Nodes that have children form
    a tour that enters and leaves each of them; an event's weight is the node itself and
    the childless siblings passed on the way. Pointers along the tour double, so a
    tour of n events takes log2(n) rounds whatever the depth. Childless nodes never
    enter it: their place follows from the sibling before. ``problem`` is as in ``unplaced``:
    a node whose parent is absent is a root of its own, and nodes in cycles or below
    them have no labels. Of rows with one node, the least by (parent, position) counts.
    """
    rest = [x for x in nodes.columns if x != "node"]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce("parent", F.lit("")), F.coalesce("position", F.lit(0)))).alias("_row")
    nodes = settle(nodes.groupBy("node").agg(best).select("node", "_row.*"))
    inner = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    flagged = nodes.join(inner.withColumn("_inner", F.lit(True)), "node", "left").select("node", "parent", "position", F.coalesce("_inner", F.lit(False)).alias("inner"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    flagged = flagged.join(known, "parent", "left").withColumn("absent", F.col("parent").isNotNull() & F.col("_known").isNull())
    children = flagged.where("parent IS NOT NULL AND NOT absent").select(
        "parent", "node", "inner", F.col("position").isNull().alias("_last"), F.coalesce("position", F.lit(0)).alias("_at")
    )
    children = settle(numbered(children, ["parent"], ["_last", "_at", "node"], "pos").select("parent", "node", "inner", "pos"))
    turns = settle(numbered(children.where("inner").select("parent", "node", "pos"), ["parent"], ["pos"], "turn"))
    sizes = children.groupBy("parent").agg(F.count(F.lit(1)).alias("children"), F.max(F.when(F.col("inner"), F.col("pos"))).alias("end"))

    # Events: (node, True) enters a node with children, (node, False) leaves it. A next event of null ends a tour.
    following = turns.select("parent", (F.col("turn") - 1).alias("turn"), F.col("node").alias("after"), F.col("pos").alias("after_pos"))
    linked = turns.join(following, ["parent", "turn"], "left")
    leave = linked.select(
        "node", F.lit(False).alias("enters"), F.coalesce("after", "parent").alias("next"), F.col("after").isNotNull().alias("next_enters"),
    )
    firsts = turns.where("turn = 1").select(F.col("parent").alias("node"), F.col("node").alias("first"))
    tops = flagged.where("inner AND (parent IS NULL OR absent)").select("node", F.lit(False).alias("enters"), F.lit(None).cast("string").alias("next"), F.lit(False).alias("next_enters"))
    enter = sizes.select(F.col("parent").alias("node")).join(firsts, "node", "left").select(
        "node", F.lit(True).alias("enters"), F.coalesce("first", "node").alias("next"), F.col("first").isNotNull().alias("next_enters")
    )
    before = turns.select("parent", (F.col("turn") + 1).alias("turn"), F.col("pos").alias("before_pos"))
    passed = turns.join(before, ["parent", "turn"], "left").select("node", F.lit(True).alias("enters"), (F.col("pos") - F.coalesce("before_pos", F.lit(0)) - 1).alias("passed"))
    behind = sizes.select(F.col("parent").alias("node"), F.lit(False).alias("enters"), (F.col("children") - F.coalesce("end", F.lit(0))).alias("passed"))
    events = enter.unionByName(leave).unionByName(tops).join(passed.unionByName(behind), ["node", "enters"], "left")
    one = F.when(F.col("enters"), 1).otherwise(0)
    state = settle(
        events.select(
            "node", "enters", "next", "next_enters", F.col("node").alias("end"),
            (F.coalesce("passed", F.lit(0)) + one).cast("long").alias("weight"), F.when(F.col("enters"), 1).otherwise(-1).cast("long").alias("steps"),
        )
    )
    total, length = state.count(), 1
    while length <= total and not state.where("next IS NOT NULL").isEmpty():
        ahead = state.select(F.col("node").alias("next"), F.col("enters").alias("next_enters"), *(F.col(x).alias(f"_{x}") for x in ("next", "next_enters", "end", "weight", "steps")))
        moved = state.where("next IS NOT NULL").join(ahead, ["next", "next_enters"])
        moved = moved.select(
            "node", "enters", F.col("_next").alias("next"), F.col("_next_enters").alias("next_enters"), F.col("_end").alias("end"),
            (F.col("weight") + F.col("_weight")).alias("weight"), (F.col("steps") + F.col("_steps")).alias("steps"),
        )
        state, length = settle(state.where("next IS NULL").unionByName(moved)), 2 * length

    # What an event has before it: the tour's whole weight, which its first event has, less its own from here on.
    done = state.where("next IS NULL")
    whole = done.where("enters AND node = end").select("end", F.col("weight").alias("whole"))
    enters = done.where("enters").select("node", "end", F.col("weight").alias("w_in"), F.col("steps").alias("s_in"))
    leaves = done.where("NOT enters").select("node", F.col("weight").alias("w_out"))
    own = behind.select("node", F.col("passed").alias("tail"))
    lead = passed.select("node", F.col("passed").alias("lead"))
    spans = enters.join(leaves, "node").join(own, "node").join(lead, "node", "left").join(whole, "end")
    pre = F.col("whole") - F.col("w_in") + F.coalesce("lead", F.lit(0))
    # Entering steps up once and leaving down once, so what is left to the end is -level.
    spans = settle(
        spans.select(
            "node", F.col("end").alias("root"), (-F.col("s_in")).alias("level"), pre.alias("pre"),
            (F.col("whole") - F.col("w_out") + F.col("tail") - 1).alias("last"),
        )
    )
    leaf = children.where("NOT inner")
    leaf = settle(numbered(leaf.select("parent", "node", "pos"), ["parent"], ["pos"], "rank").withColumn("turn", F.col("pos") - F.col("rank")))
    around = spans.select(F.col("node").alias("parent"), "root", F.col("level").alias("_level"), F.col("pre").alias("_pre"))
    beside = turns.join(spans.select("node", F.col("last").alias("_end")), "node").select("parent", "turn", F.col("pos").alias("_pos"), "_end")
    place = F.coalesce(F.col("_end") + F.col("pos") - F.col("_pos"), F.col("_pre") + F.col("pos"))
    leaves = leaf.join(around, "parent").join(beside, ["parent", "turn"], "left").select("node", "root", (F.col("_level") + 1).alias("level"), place.alias("pre"), place.alias("last"))
    alone = flagged.where("NOT inner AND (parent IS NULL OR absent)").select("node", F.col("node").alias("root"), *(F.lit(0).cast("long").alias(x) for x in ("level", "pre", "last")))
    labels = spans.unionByName(leaves).unionByName(alone)
    lost = flagged.where("absent").select(F.col("node").alias("root"), F.lit("absent_parent").alias("problem"))
    labels = labels.join(lost, "root", "left")
    out = nodes.join(labels, "node", "left").withColumn("problem", F.when(F.col("root").isNull(), "cycle").otherwise(F.col("problem")))
    return settle(out.select("node", *rest, "root", "level", "pre", "last", "problem"))


def _labelled(nodes: DataFrame) -> DataFrame:
    return nodes if "pre" in nodes.columns else tree_labels(nodes)


def subtree(nodes: DataFrame, top: str) -> DataFrame:
    """A node and everything below it: a range of one root, level counted from the node. Best given ``tree_labels``."""
    labels = _labelled(nodes)
    at = labels.where(F.col("node") == top).select(F.col("root").alias("_root"), F.col("level").alias("_level"), F.col("pre").alias("_pre"), F.col("last").alias("_end"))
    at = at.first()
    if at is None or at["_root"] is None:
        return labels.limit(0).drop("root", "pre", "last", "problem")
    inside = (F.col("root") == at["_root"]) & F.col("pre").between(at["_pre"], at["_end"])
    return labels.where(inside).withColumn("level", F.col("level") - at["_level"]).drop("root", "pre", "last", "problem")


def under(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(child, parent) pairs with ``below``: whether the first is the second or below it; no closure is needed."""
    ends = lambda side: labels.where("root IS NOT NULL").select(F.col("node").alias(side), *(F.col(x).alias(f"_{side}_{x}") for x in ("root", "pre", "last")))
    both = pairs.join(ends("child"), "child", "left").join(ends("parent"), "parent", "left")
    inside = (F.col("_child_root") == F.col("_parent_root")) & F.col("_child_pre").between(F.col("_parent_pre"), F.col("_parent_last"))
    return both.select(*pairs.columns, F.coalesce(inside, F.lit(False)).alias("below"))


def nested_list(nodes: DataFrame) -> DataFrame:
    """Every node with its root, level and sort path, so that sorting by the path
    walks the tree: siblings by position, missing positions last, then by name.

    Nodes that hang on no root are in ``unplaced``.
    """
    key = F.concat(
        F.when(F.col("position").isNull(), F.lit("~")).otherwise(F.lpad(F.col("position").cast("string"), 10, "0")),
        F.lit(":"),
        F.col("node"),
    )
    return _climbed(nodes, key).where("problem IS NULL").select("row.*", "root", "level", F.col("path").alias("sort_path"))


def unplaced(nodes: DataFrame) -> DataFrame:
    """(node, parent, problem) of the nodes in no tree: 'absent_parent' (its own or of a node above) or 'cycle' (in or below one)."""
    return _labelled(nodes).where("problem IS NOT NULL").select("node", "parent", "problem")


def node_paths(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """The way from each start to just below the root: (start, steps up, node).

    Every node gets pointers 1, 2, 4, 8 ... steps up. A start is spread into one row for
    each step of its path, and the set bits of a step say which pointers lead there,
    so the longest path of n levels takes log2(n) joins. A start in a cycle is an error.
    """
    labels = _labelled(nodes)
    asked = starts.select("node").distinct().join(labels.select("node", "level", "problem"), "node")
    if not asked.where("problem = 'cycle'").isEmpty():
        raise CycleError("the hierarchy contains a cycle")
    deepest = asked.agg(F.max("level")).first()[0] or 0
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("level") - 1))
    ways = settle(asked.where("level > 0").select(F.col("node").alias("start"), "node", steps.alias("left")))
    jump, bit = settle(labels.where("level > 0").select("node", F.col("parent").alias("to"))), 0
    while 1 << bit < deepest:
        take = F.col("left").bitwiseAND(F.lit(1 << bit)) != 0
        moved = ways.where(take).join(jump, "node").select("start", F.col("to").alias("node"), "left")
        ways = settle(ways.where(~take).unionByName(moved))
        jump = settle(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("_up")), "to").select("node", F.col("_up").alias("to")))
        bit += 1
    return ways.select("start", F.col("left").cast("int").alias("up"), "node")
