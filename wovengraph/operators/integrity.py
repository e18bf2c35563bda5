"""Integrity checks. Each gives violations (rule, subject, property, detail).

Holdings are the statements to check: (s, prop, o, is_deleted). Ontology tables
are the closures, prop_constraints and inherited cardinalities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators import aggregates
from wovengraph.operators.ordering import lacking
from wovengraph.session import settle

COLUMNS = ["rule", "subject", "property", "detail"]


def _report(df: DataFrame, rule: str, subject: str, prop: str | Column, detail: str | Column) -> DataFrame:
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(
        F.lit(rule).alias("rule"),
        F.col(subject).alias("subject"),
        as_col(prop).cast("string").alias("property"),
        as_col(detail).cast("string").alias("detail"),
    )


def holdings(values: DataFrame, links: DataFrame) -> DataFrame:
    return values.select(F.col("resource").alias("s"), "prop", F.col("iri").alias("o"), "is_deleted").union(
        links.select("src", "prop", "dst", "is_deleted")
    )


def empty_strings(values: DataFrame, column: str = "as_string") -> DataFrame:
    return _report(values.where(F.col(column) == ""), "empty_string", "iri", "prop", F.lit(column))


def unconstrained_properties(prop_closure: DataFrame, prop_constraints: DataFrame, base: str) -> DataFrame:
    """Properties below the base without an object class."""
    below = prop_closure.where((F.col("ancestor") == base) & (F.col("node") != base)).select(F.col("node").alias("prop"))
    known = prop_constraints.where("object_class IS NOT NULL").select("prop")
    return _report(below.join(known, "prop", "left_anti"), "no_object_class", "prop", "prop", F.lit(base))


def _outside(df: DataFrame, class_closure: DataFrame, cls: str, wanted: str) -> DataFrame:
    """Rows whose class is not the wanted one or below it.

    Few (class, property) pairs occur, so those are checked, not every row.
    """
    pairs = df.select(cls, wanted).distinct()
    good = class_closure.select(F.col("node").alias(cls), F.col("ancestor").alias(wanted))
    bad = pairs.join(good, [cls, wanted], "left_anti").where(F.col(cls) != F.col(wanted))
    return df.join(bad, [cls, wanted], "left_semi")


def wrong_subject_class(held: DataFrame, types: DataFrame, class_closure: DataFrame, prop_constraints: DataFrame) -> DataFrame:
    """types: (iri, cls)."""
    rows = held.join(prop_constraints.select("prop", "subject_class"), "prop").join(types.toDF("s", "cls"), "s")
    return _report(_outside(rows, class_closure, "cls", "subject_class"), "subject_class", "s", "prop", "cls")


def wrong_object_class(held: DataFrame, types: DataFrame, class_closure: DataFrame, prop_constraints: DataFrame) -> DataFrame:
    """An object without a known class is wrong as well."""
    rows = held.join(prop_constraints.select("prop", "object_class"), "prop").join(types.toDF("o", "cls"), "o", "left")
    rows = rows.withColumn("cls", F.coalesce("cls", F.lit("(none)")))
    return _report(_outside(rows, class_closure, "cls", "object_class"), "object_class", "s", "prop", F.concat_ws(" ", "o", "cls"))


def _cards(cards: DataFrame, *kinds: str) -> DataFrame:
    """(s, prop) pairs with the given cardinalities, from the cardinality table."""
    return cards.where(F.col("card").isin(*kinds)).select("s", "prop")


def missing(cards: DataFrame, held: DataFrame, card: str) -> DataFrame:
    """Required properties without any object (a deleted one will do); card is '1' or '1-n'."""
    rows = _cards(cards, card).join(held.select("s", "prop"), ["s", "prop"], "left_anti")
    return _report(rows, "missing_" + card, "s", "prop", F.lit(None))


def several_labels(cards: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: (s, label)."""
    need = _cards(cards, "1").where("prop = 'label'").select("s")
    many = labels.groupBy("s").agg(F.count_distinct("label").alias("n")).where("n > 1")
    return _report(many.join(need, "s", "left_semi"), "several_labels", "s", F.lit("label"), "n")


def too_many(cards: DataFrame, held: DataFrame, deletable: bool) -> DataFrame:
    """More than one object where at most one may be; with ``deletable`` only live ones count.

    Objects are counted per subject and property first; only those with several
    are joined.
    """
    rows = held.where(~F.col("is_deleted")) if deletable else held
    many = rows.groupBy("s", "prop").agg(F.count_distinct("o").alias("n")).where("n > 1")
    found = many.join(_cards(cards, "1", "0-1"), ["s", "prop"], "left_semi")
    return _report(found, "several_live" if deletable else "several", "s", "prop", "n")


def no_cardinality(held: DataFrame, types: DataFrame, inherited: DataFrame) -> DataFrame:
    """Properties used on an instance whose class has no cardinality for them."""
    rows = held.select("s", "prop").distinct().join(types.toDF("s", "cls"), "s")
    bad = rows.select("cls", "prop").distinct().join(inherited.select("cls", "prop"), ["cls", "prop"], "left_anti")
    return _report(rows.join(bad, ["cls", "prop"], "left_semi"), "no_cardinality", "s", "prop", "cls")


def wrong_markup_parent(tags: DataFrame, parent_classes: DataFrame) -> DataFrame:
    """Tags whose parent is of another class than their own class asks for.

    tags: (tag, cls, parent); parent_classes: (cls, parent_class). A class
    without an entry may not have a parent.
    """
    parents = tags.select(F.col("tag").alias("parent"), F.col("cls").alias("_parent_cls"))
    rows = tags.where("parent IS NOT NULL").join(parents, "parent").join(parent_classes, "cls", "left")
    bad = rows.where(F.col("parent_class").isNull() | (F.col("parent_class") != F.col("_parent_cls")))
    return _report(bad, "markup_parent", "tag", "cls", "_parent_cls")


def ingest_problems(
    resources: DataFrame, values: DataFrame, links: DataFrame, inherited: DataFrame, prop_constraints: DataFrame, class_closure: DataFrame
) -> DataFrame:
    """Everything wrong with a batch before it is written.

    resources: (client_id, cls); values: (client_id, prop, vtype); links:
    (client_id, prop, target_id), where the target is in the batch.
    """
    of = resources.select("client_id", "cls")
    wanted = prop_constraints.select("prop", "object_class")
    typed = values.join(wanted, "prop")
    wrong_type = _report(_outside(typed, class_closure, "vtype", "object_class"), "value_type", "client_id", "prop", "vtype")
    targets = links.join(of.select(F.col("client_id").alias("target_id"), F.col("cls").alias("target_cls")), "target_id", "left")
    unknown = _report(targets.where("target_cls IS NULL"), "unknown_target", "client_id", "prop", "target_id")
    aimed = targets.where("target_cls IS NOT NULL").join(wanted, "prop")
    wrong_target = _report(_outside(aimed, class_closure, "target_cls", "object_class"), "target_class", "client_id", "prop", "target_cls")
    submitted = values.select("client_id", "prop").union(links.select("client_id", "prop"))
    # Three rules look at the counts, which are far fewer than the rows.
    counted = settle(submitted.groupBy("client_id", "prop").agg(F.count(F.lit(1)).alias("n")).join(of, "client_id"))
    cards = inherited.select("cls", "prop", "card")
    placed = counted.join(cards, ["cls", "prop"], "left")
    no_card = _report(placed.where("card IS NULL"), "no_cardinality", "client_id", "prop", "cls")
    many = _report(placed.where(F.col("card").isin("1", "0-1") & (F.col("n") > 1)), "too_many", "client_id", "prop", "n")
    required = lacking(of.join(cards.where(F.col("card").isin("1", "1-n")), "cls"), counted, ["client_id", "prop"])
    absent = _report(required, "missing", "client_id", "prop", "card")
    return reduce(DataFrame.union, [wrong_type, unknown, wrong_target, no_card, many, absent])


def _bounds(card: Column) -> tuple[Column, Column]:
    """Least and most values that a cardinality allows; most is null if it has no limit."""
    return F.left(card, F.lit(1)).cast("int"), F.when(~F.endswith(card, F.lit("n")), F.right(card, F.lit(1)).cast("int"))


def compatible(direct: Column, base: Column) -> Column:
    """Every number of values that the class itself allows must be allowed by its base."""
    (least, most), (base_least, base_most) = _bounds(direct), _bounds(base)
    return (least >= base_least) & (base_most.isNull() | F.coalesce(most <= base_most, F.lit(False)))


def incompatible_overrides(cardinalities: DataFrame, class_edges: DataFrame, inherited: DataFrame, prop_closure: DataFrame) -> DataFrame:
    own = cardinalities.select("cls", "prop", "card")
    base = class_edges.select(F.col("child").alias("cls"), F.col("parent").alias("_base")).join(
        inherited.select(F.col("cls").alias("_base"), F.col("prop").alias("base_prop"), F.col("card").alias("base_card")), "_base"
    )
    up = prop_closure.select(F.col("node").alias("prop"), F.col("ancestor").alias("base_prop"))
    pairs = own.join(up, "prop").union(own.select("prop", "cls", "card", F.col("prop").alias("base_prop"))).distinct()
    bad = pairs.join(base, ["cls", "base_prop"]).where(~compatible(F.col("card"), F.col("base_card")))
    return _report(bad, "incompatible_cardinality", "cls", "prop", F.concat_ws(" ", "card", "base_prop", "base_card"))


def constraint_not_narrower(prop_constraints: DataFrame, prop_closure: DataFrame, class_closure: DataFrame, column: str) -> DataFrame:
    """A property's constraint class must lie below that of every base property."""
    own = prop_constraints.select("prop", F.col(column).alias("own"))
    base = prop_constraints.select(F.col("prop").alias("base"), F.col(column).alias("wanted"))
    up = prop_closure.where("node <> ancestor").select(F.col("node").alias("prop"), F.col("ancestor").alias("base"))
    rows = own.join(up, "prop").join(base, "base")
    return _report(_outside(rows, class_closure, "own", "wanted"), column, "prop", "base", F.concat_ws(" ", "own", "wanted"))


def class_outside_constraint(cardinalities: DataFrame, prop_constraints: DataFrame, class_closure: DataFrame) -> DataFrame:
    """Classes with a cardinality for a property whose subject class they are not below."""
    rows = cardinalities.select("cls", "prop").join(prop_constraints.select("prop", "subject_class"), "prop")
    return _report(_outside(rows, class_closure, "cls", "subject_class"), "class_not_in_constraint", "cls", "prop", "subject_class")


def duplicate_values(values: DataFrame, literal: Column) -> DataFrame:
    """Equal live values of one resource and property."""
    rows = values.where(~F.col("is_deleted")).withColumn("literal", literal)
    return _report(aggregates.duplicates(rows, ["resource", "prop", "literal"]), "duplicate_value", "resource", "prop", "literal")


def redundant_versions(edits: DataFrame, current: DataFrame) -> DataFrame:
    """New versions equal to the current one; both (value, literal)."""
    now = current.select("value", F.col("literal").alias("_now"))
    rows = edits.join(now, "value").where(F.col("literal").eqNullSafe(F.col("_now")))
    return _report(rows, "redundant_version", "value", F.lit(None), "literal")


def markup_attribute_problems(tags: DataFrame, attributes: DataFrame, required: DataFrame) -> DataFrame:
    """Attributes of tags against the rules of their class.

    tags: (tag, cls); attributes: (tag, name); required: (cls, name, card).
    """
    counted = attributes.groupBy("tag", "name").agg(F.count(F.lit(1)).alias("n")).join(tags.select("tag", "cls"), "tag")
    rules = required.select("cls", "name", "card")
    judged = counted.join(rules, ["cls", "name"], "left")
    unsupported = _report(judged.where("card IS NULL"), "unsupported_attribute", "tag", "name", "cls")
    many = _report(judged.where(F.col("card").isin("1", "0-1") & (F.col("n") > 1)), "repeated_attribute", "tag", "name", "n")
    needed = tags.select("tag", "cls").join(rules.where(F.col("card").isin("1", "1-n")), "cls")
    lacking = _report(needed.join(counted, ["tag", "name"], "left_anti"), "missing_attribute", "tag", "name", "cls")
    return unsupported.union(many).union(lacking)


def text_reference_problems(declared: DataFrame, found: DataFrame, targets: DataFrame) -> DataFrame:
    """References a text declares must be those in its mark-up, and must exist.

    declared and found: (text, target); targets: (target).
    """
    undeclared = found.join(declared, ["text", "target"], "left_anti").distinct()
    unused = declared.join(found, ["text", "target"], "left_anti").distinct()
    unknown = declared.join(targets, "target", "left_anti").select("text", "target").distinct()
    rules = {"undeclared_reference": undeclared, "unused_reference": unused, "unknown_target": unknown}
    return reduce(DataFrame.union, [_report(df, rule, "text", F.lit(None), "target") for rule, df in rules.items()])


