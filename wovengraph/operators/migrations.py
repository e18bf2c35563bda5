"""Whole-repository transforms over statements (s, p, o).

Each is a function from statements to statements. Property names follow the layout of the statement tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.functions import dates
from wovengraph.operators import access
from wovengraph.operators.ordering import lacking
from wovengraph.session import settle

Step = Callable[[DataFrame], DataFrame]


def _facts(triples: DataFrame, **names: str) -> DataFrame:
    """One row per subject with the smallest object of the named properties."""
    columns = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in names.items()]
    return triples.where(F.col("p").isin(list(names.values()))).groupBy("s").agg(*columns)


def _add(triples: DataFrame, subjects: DataFrame, p: str, o: Column) -> DataFrame:
    return triples.unionByName(subjects.select("s", F.lit(p).alias("p"), o.cast("string").alias("o")))


def add_missing_deletion_flag(triples: DataFrame, without: list[str]) -> DataFrame:
    """Resources and values without the flag get 'false'; classes in ``without`` and mark-up nodes do not."""
    facts = _facts(triples, cls="type", flag="isDeleted", start="standoffStart")
    need = facts.where(F.col("cls").isNotNull() & F.col("flag").isNull() & F.col("start").isNull() & ~F.col("cls").isin(without))
    return _add(triples, need, "isDeleted", F.lit("false"))


def merge_permissions(triples: DataFrame, old: dict[str, str]) -> DataFrame:
    """One permission string per subject from statements of the old properties (property -> abbreviation)."""
    names = F.create_map(*[F.lit(x) for pair in old.items() for x in pair])
    held = triples.where(F.col("p").isin(list(old))).select("s", names[F.col("p")].alias("permission"), F.col("o").alias("grp"))
    parsed = held.withColumn("code", access.permission_code(F.col("permission")))
    # A group may hold several of the old permissions, and keeps them all.
    per_code = parsed.groupBy("s", "permission", "code").agg(F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("g"))
    text = F.concat_ws(" ", "permission", "g")
    merged = per_code.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("code", text.alias("t")))).alias("parts"))
    return _add(triples.where(~F.col("p").isin(list(old))), merged, "permissions", F.array_join("parts.t", "|"))


# The literal property of each value class.
VALUE_LITERALS = {
    "IntValue": "asInt",
    "BooleanValue": "asBoolean",
    "UriValue": "asUri",
    "DecimalValue": "asDecimal",
    "ColorValue": "asColor",
    "GeomValue": "asGeometry",
    "ListValue": "asNode",
    "GeonameValue": "asGeoname",
    "StillImageFileValue": "originalFilename",
    "LinkValue": "object",
}


def fill_string_form(triples: DataFrame) -> DataFrame:
    """Values without a text form get one from their typed literal."""
    names = {
        "cls": "type",
        "text": "asString",
        "start": "startJDN",
        "end": "endJDN",
        "calendar": "calendar",
        "from_time": "intervalStart",
        "to_time": "intervalEnd",
    }
    facts = _facts(triples, **names, **{f"lit_{p}": p for p in VALUE_LITERALS.values()})
    form = F.lit(None).cast("string")
    for cls, p in VALUE_LITERALS.items():
        form = F.when(F.col("cls") == cls, F.col(f"lit_{p}")).otherwise(form)
    period = dates.period_text(F.col("start").cast("int"), F.col("end").cast("int"), F.col("calendar") == "JULIAN")
    form = F.when(F.col("cls") == "DateValue", period).when(
        F.col("cls") == "IntervalValue", dates.interval_text(F.col("from_time"), F.col("to_time"))
    ).otherwise(form)
    need = facts.where(F.col("cls").endswith("Value") & F.col("text").isNull()).withColumn("_form", form)
    return _add(triples, need.where("_form IS NOT NULL"), "asString", F.col("_form"))


def rename_properties(triples: DataFrame, names: dict[str, str]) -> DataFrame:
    mapped = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return triples.withColumn("p", F.coalesce(mapped[F.col("p")], "p"))


# Day-number properties by their old and new names.
DAY_NUMBER_NAMES = {"startJDC": "startJDN", "endJDC": "endJDN"}


def drop_value_projects(triples: DataFrame) -> DataFrame:
    """Values do not name a project: their resource does."""
    values = triples.where((F.col("p") == "type") & F.col("o").endswith("Value")).select("s")
    kept = lacking(triples.where("p = 'project'"), values, ["s"])
    return triples.where("p <> 'project'").unionByName(kept)


def owner_to_creator(triples: DataFrame) -> DataFrame:
    """The group Owner is called Creator in permission strings."""
    renamed = F.regexp_replace("o", r"(?<![\w/])Owner(?!\w)", "Creator")
    return triples.withColumn("o", F.when(F.col("p") == "permissions", renamed).otherwise(F.col("o")))


def grant_creator(triples: DataFrame) -> DataFrame:
    """Every subject gets full rights for its creator, in place of the creator's other rights; not mark-up nodes."""
    nodes = triples.where(F.col("p") == "hasStandoff").select(F.col("o").alias("s"))
    subjects = triples.select("s").distinct().join(nodes, "s", "left_anti")
    old = triples.where(F.col("p") == "permissions").join(nodes, "s", "left_anti").select("s", F.col("o").alias("permissions"))
    parsed = access.parse_permissions(old).where("grp <> 'Creator'").select("s", "permission", "grp", "code")
    full = subjects.select("s", F.lit("CR").alias("permission"), F.lit("Creator").alias("grp"), F.lit(access.HIGHEST).alias("code"))
    text = access.format_permissions(parsed.union(full), ["s"], descending=True)
    # Statements of mark-up nodes stay as they are.
    kept = triples.where(F.col("p") != "permissions").unionByName(
        triples.where(F.col("p") == "permissions").join(nodes, "s", "left_semi").select("s", "p", "o")
    )
    return _add(kept, text, "permissions", F.col("permissions"))


def label_regions(triples: DataFrame, region_class: str = "Region") -> DataFrame:
    """Regions without a proper label get the text of their comment."""
    facts = _facts(triples, cls="type", label="label", comment="hasComment")
    need = facts.where((F.col("cls") == region_class) & (F.col("label").isNull() | F.col("label").contains("test")))
    texts = triples.where(F.col("p") == "asString").select(F.col("s").alias("comment"), F.col("o").alias("_text"))
    found = need.join(texts, "comment").select("s", "_text")
    kept = triples.join(found.select("s", F.lit("label").alias("p")), ["s", "p"], "left_anti")
    return _add(kept, found, "label", F.col("_text"))


# Mark-up classes that moved to another vocabulary under the same name.
MARKUP_CLASSES = [
    "StandoffRootTag",
    "StandoffParagraphTag",
    "StandoffItalicTag",
    "StandoffBoldTag",
    "StandoffUnderlineTag",
    "StandoffStrikethroughTag",
    "StandoffHeader1Tag",
    "StandoffHeader2Tag",
    "StandoffHeader3Tag",
    "StandoffHeader4Tag",
    "StandoffHeader5Tag",
    "StandoffHeader6Tag",
    "StandoffSuperscriptTag",
    "StandoffSubscriptTag",
    "StandoffOrderedListTag",
    "StandoffUnorderedListTag",
    "StandoffListElementTag",
]
# The one that got a new name, and that name.
STYLE_CLASS, NEW_STYLE_CLASS = "StandoffStyleTag", "StandoffStyleElementTag"


def rename_markup_classes(triples: DataFrame, old_base: str, new_base: str) -> DataFrame:
    """Mark-up classes under their new names; the old style tag has a longer name now."""
    name = F.substr("o", F.lit(len(old_base) + 1))
    known = [*MARKUP_CLASSES, STYLE_CLASS]
    moved = (F.col("p") == "type") & F.startswith("o", F.lit(old_base)) & name.isin(known)
    name = F.when(name == STYLE_CLASS, NEW_STYLE_CLASS).otherwise(name)
    return triples.withColumn("o", F.when(moved, F.concat(F.lit(new_base), name)).otherwise(F.col("o")))


def move_gui_order(triples: DataFrame) -> DataFrame:
    """The order of properties in a form is stated with each restriction, not with the property."""
    kinds = triples.where(F.col("p") == "type")
    props = kinds.where("o = 'ObjectProperty'").select("s")
    orders = triples.where(F.col("p") == "guiOrder").join(props, "s", "left_semi").select(F.col("s").alias("prop"), F.col("o").alias("_order"))
    restrictions = triples.where(F.col("p") == "onProperty").select("s", F.col("o").alias("prop"))
    restrictions = restrictions.join(kinds.where("o = 'Restriction'").select("s"), "s", "left_semi").join(orders, "prop")
    kept = triples.join(orders.select(F.col("prop").alias("s"), F.lit("guiOrder").alias("p")), ["s", "p"], "left_anti")
    return _add(kept, restrictions, "guiOrder", F.col("_order"))


def run(triples: DataFrame, steps: list[Step]) -> DataFrame:
    """Several transforms in order.

    A step may read its input more than once, so what the step before gave is
    written to the shared folder and read back, not computed again.
    """
    for i, step in enumerate(steps):
        triples = step(settle(triples) if i else triples)
    return triples.select("s", "p", "o")
