"""Typed filters over value objects.

Values: (iri, resource, prop, vtype, is_deleted, one column per literal kind).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators.closure import subtree

# The literal column of each value type and its legal operators.
LITERAL = {
    "IntValue": "as_int",
    "DecimalValue": "as_decimal",
    "BooleanValue": "as_boolean",
    "TextValue": "as_string",
    "UriValue": "as_uri",
    "ListValue": "as_node",
    "ColorValue": "as_string",
    "GeomValue": "as_string",
    "DateValue": "start_jdn",
}
ORDERED = {"=", "!=", "<", "<=", ">", ">=", "exists"}
LEGAL = {
    "IntValue": ORDERED,
    "DecimalValue": ORDERED,
    "DateValue": ORDERED,
    "BooleanValue": {"=", "!=", "exists"},
    "TextValue": {"=", "!=", "like", "not_like", "match", "match_boolean", "exists"},
    "UriValue": {"=", "!=", "exists"},
    "ListValue": {"=", "exists"},
    "ColorValue": {"=", "exists"},
    "GeomValue": {"exists"},
    "Link": {"=", "exists"},
}


class IllegalOperator(ValueError):
    pass


def check_operator(value_type: str, op: str) -> None:
    if op not in LEGAL.get(value_type, ()):
        raise IllegalOperator(f"{op} is not defined for {value_type}")


def date_compare(op: str, start: int, end: int) -> Column:
    """Compare a stored period with the period (start, end): equal means any overlap."""
    v_start, v_end = F.col("start_jdn"), F.col("end_jdn")
    return {
        "=": (v_end >= start) & (v_start <= end),
        "!=": (v_end < start) | (v_start > end),
        "<": v_end < start,
        "<=": v_start <= end,
        ">": v_start > end,
        ">=": v_end >= start,
    }[op]


def compare(literal: Column, op: str, operand) -> Column:
    other = operand if isinstance(operand, Column) else F.lit(operand)
    return {
        "=": literal == other,
        "!=": literal != other,
        "<": literal < other,
        "<=": literal <= other,
        ">": literal > other,
        ">=": literal >= other,
    }[op]


def regex(text: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(text, F.lit(f"(?{flags}){pattern}" if flags else pattern))


def condition(value_type: str, op: str, operand=None) -> Column:
    """The test on one value row. ``!=`` and ``not_like`` hold if some value differs, not if none is equal."""
    check_operator(value_type, op)
    literal = F.col(LITERAL[value_type])
    if op == "exists":
        return literal.isNotNull()
    if value_type == "DateValue":
        return date_compare(op, *operand)
    if op == "like":
        return regex(literal, operand, "i")
    if op == "not_like":
        return ~regex(literal, operand, "i")
    if value_type == "DecimalValue":
        literal = literal.cast("decimal(38,18)")
        operand = F.lit(str(operand)).cast("decimal(38,18)")
    return compare(literal, op, operand)


def value_filter(values: DataFrame, prop: str, op: str, operand=None, value_type: str = "TextValue") -> DataFrame:
    """Live values of the property that pass: (resource, value, literal)."""
    rows = values.where((F.col("prop") == prop) & ~F.col("is_deleted") & condition(value_type, op, operand))
    return rows.select("resource", F.col("iri").alias("value"), F.col(LITERAL[value_type]).alias("literal"))


def list_filter(values: DataFrame, prop: str, node: str, labels: DataFrame) -> DataFrame:
    """Values naming the node or any node below it; labels: those of the lists (``closure.tree_labels``)."""
    below = subtree(labels, node).select(F.col("node").alias("literal"))
    return value_filter(values, prop, "exists", value_type="ListValue").join(below, "literal", "left_semi")


def link_filter(links: DataFrame, resources: DataFrame, prop: str, target: str | None = None) -> DataFrame:
    """Live links to live targets, with what is needed to show and protect the target."""
    rows = links.where((F.col("prop") == prop) & ~F.col("is_deleted"))
    if target is not None:
        rows = rows.where(F.col("dst") == target)
    targets = resources.where(~F.col("is_deleted")).select(
        F.col("iri").alias("dst"),
        F.col("label").alias("target_label"),
        F.col("creator").alias("target_creator"),
        F.col("project").alias("target_project"),
        F.col("permissions").alias("target_permissions"),
    )
    found = rows.select(F.col("src").alias("resource"), "link_value", "dst").join(targets, "dst")
    return found.select("resource", "link_value", "dst", *[c for c in targets.columns if c != "dst"])


def all_criteria(values: DataFrame, criteria: list[tuple[str, str, object, str]]) -> DataFrame:
    """Resources for which every criterion (prop, op, operand, type) holds for some live value.

    One pass over the values and one aggregation, however many criteria.
    """
    tests = [(F.col("prop") == p) & condition(t, op, operand) for p, op, operand, t in criteria]
    rows = values.where(~F.col("is_deleted") & reduce(lambda a, b: a | b, tests))
    met = [F.max(F.coalesce(t, F.lit(False))).alias(f"_m{i}") for i, t in enumerate(tests)]
    grouped = rows.groupBy("resource").agg(*met)
    return grouped.where(reduce(lambda a, b: a & b, [F.col(f"_m{i}") for i in range(len(tests))])).select("resource")


def scope(
    resources: DataFrame, project: str | None = None, cls: str | None = None, creator: str | None = None, class_closure: DataFrame | None = None
) -> DataFrame:
    rows = resources
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if creator is not None:
        rows = rows.where(F.col("creator") == creator)
    if cls is not None:
        below = class_closure.where(F.col("ancestor") == cls).select(F.col("node").alias("cls"))
        rows = rows.join(below, "cls", "left_semi")
    return rows


def period_overlap_join(left: DataFrame, right: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Pairs whose periods overlap (and whose keys agree); periods are start_jdn, end_jdn.

    A period of n days belongs to the level of the next power of two and lies in one or
    two slots of that width, however long it is. Two periods meet at the higher of their
    levels, where the shorter one lies in one or two slots as well: it is
    repeated for the levels that the other side has (at most 32). A pair is kept
    in the first slot both share, so it appears once. Periods without start or end, and
    those that end before they start, overlap nothing. Left columns are prefixed l_, right ones r_.
    """

    def levelled(df: DataFrame, side: str) -> DataFrame:
        named = df.select(*keys, *[F.col(f"`{c}`").alias(f"{side}_{c}") for c in df.columns if c not in keys])
        days = F.col(f"{side}_end_jdn").cast("long") - F.col(f"{side}_start_jdn")
        return named.where(days >= 0).withColumn("_own", F.char_length(F.bin(days)) * (days > 0).cast("int"))

    def slots(df: DataFrame, side: str, levels: Column) -> DataFrame:
        """A row for each of the levels and each slot of that width that the period touches."""
        rows = df.withColumn("_level", F.explode(levels))
        width = F.expr("shiftleft(1L, _level)")
        slot = lambda name: F.floor(F.col(f"{side}_{name}") / width)
        return rows.withColumn("_slot", F.explode(F.array_distinct(F.array(slot("start_jdn"), slot("end_jdn"))))).drop("_own")

    def levels_of(df: DataFrame) -> Column:
        """The levels that occur, a number each and 33 at most."""
        found = sorted(r["_own"] for r in df.select("_own").distinct().collect())
        return F.array(*map(F.lit, found)) if found else F.array().cast("array<int>")

    l, r = levelled(left, "l"), levelled(right, "r")
    own, lifted = F.array("_own"), lambda other, strict: F.filter(levels_of(other), lambda x: (x > F.col("_own")) if strict else (x >= F.col("_own")))
    on = [*keys, "_level", "_slot"]
    pairs = slots(l, "l", lifted(r, False)).join(slots(r, "r", own), on)
    longer = slots(l, "l", own).join(slots(r, "r", lifted(l, True)), on)
    both = pairs.unionByName(longer)
    first_shared = F.floor(F.greatest("l_start_jdn", "r_start_jdn") / F.expr("shiftleft(1L, _level)"))
    overlap = (F.col("l_start_jdn") <= F.col("r_end_jdn")) & (F.col("l_end_jdn") >= F.col("r_start_jdn"))
    return both.where(overlap & (F.col("_slot") == first_shared)).drop("_slot", "_level")
