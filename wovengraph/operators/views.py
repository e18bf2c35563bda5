"""Views of resources, ontologies and records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators import access


def resource_info(resources: DataFrame, file_values: DataFrame) -> DataFrame:
    """Facts about resources that are not values, and their file values: (iri, p, o)."""
    facts = F.array(
        *[F.struct(F.lit(p).alias("p"), F.col(p).cast("string").alias("o")) for p in ("cls", "label", "creator", "project", "permissions", "is_deleted")]
    )
    own = resources.select("iri", F.inline(facts))
    files = file_values.select(F.col("resource").alias("iri"), F.lit("file").alias("p"), F.col("file").alias("o"))
    return own.union(files)


def properties_and_values(values: DataFrame, links: DataFrame, file_props: list[str], prop_closure: DataFrame) -> DataFrame:
    """Value, link and link-value rows of resources with flags: (resource, prop, value, is_link, is_link_value)."""
    link_props = prop_closure.where("ancestor = 'hasLinkTo'").select(F.col("node").alias("prop"))
    held = values.where(~F.col("is_deleted") & ~F.col("prop").isin(file_props))
    live = links.where(~F.col("is_deleted")).join(link_props, "prop", "left_semi")

    def rows(df: DataFrame, resource: str, prop: Column, value: str, link: bool, link_value: bool) -> DataFrame:
        return df.select(
            F.col(resource).alias("resource"), prop.alias("prop"), F.col(value).alias("value"),
            F.lit(link).alias("is_link"), F.lit(link_value).alias("is_link_value"),
        )

    return (
        rows(held, "resource", F.col("prop"), "iri", False, False)
        .union(rows(live, "src", F.col("prop"), "dst", True, False))
        .union(rows(live, "src", F.concat("prop", F.lit("Value")), "link_value", False, True))
    )


def split_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """Ordinary, link-value and link rows."""
    return {
        "value": rows.where(~F.col("is_link") & ~F.col("is_link_value")),
        "link_value": rows.where("is_link_value"),
        "link": rows.where("is_link"),
    }


def with_empty_properties(resources: DataFrame, rows: DataFrame, inherited: DataFrame) -> DataFrame:
    """Add the properties the class allows and the resource lacks: (resource, prop, value)."""
    possible = resources.select(F.col("iri").alias("resource"), "cls").join(inherited.select("cls", "prop"), "cls")
    empty = possible.join(rows.select("resource", "prop"), ["resource", "prop"], "left_anti")
    return rows.select("resource", "prop", "value").union(empty.select("resource", "prop", F.lit(None).cast("string")))


def value_order(df: DataFrame) -> list[Column]:
    """Sort columns for values: by position, a missing one counting as 0."""
    return [F.coalesce("vorder", F.lit(0)), F.col("iri")]


def with_part(statements: DataFrame, mains: DataFrame) -> DataFrame:
    """Statements (s, p, o) about resources and values, with ``kind``: main, dependent or value.

    mains: (s). Main are statements of main resources, dependent those of others;
    a value's subject is typed with a value class. Statements of a subject without
    a type are left out, and each type of a subject counts.
    """
    types = statements.where("p = 'type'").select("s", F.col("o").endswith("Value").alias("_is_value"))
    asked = mains.select("s", F.lit(True).alias("_main")).distinct()
    # Each subject is judged on its own before its statements come to it.
    judged = types.join(asked, "s", "left")
    kind = F.when(F.col("_is_value"), "value").when(F.col("_main"), "main").otherwise("dependent")
    return statements.join(judged.select("s", kind.alias("kind")), "s").select("s", "p", "o", "kind")


def split_result(statements: DataFrame, mains: DataFrame) -> dict[str, DataFrame]:
    """Divide statements (s, p, o) about resources and values into those of main resources, of dependent ones and of values.

    See ``with_part``. Each of the three reads the statements; who needs all at once takes them from there.
    """
    rows = with_part(statements, mains)
    return {x: rows.where(F.col("kind") == x).select("s", "p", "o") for x in ("main", "dependent", "value")}


def class_shape(inherited: DataFrame, prop_constraints: DataFrame) -> DataFrame:
    """Properties of every class with occurrence, value type and place in the form."""
    return inherited.join(prop_constraints.select("prop", F.col("object_class").alias("value_type")), "prop", "left").select(
        "cls", "prop", F.col("card").alias("occurrence"), "value_type", "gui_order"
    )


def entities_of(definitions: DataFrame, ontology: str | None = None, kind: str | None = None) -> DataFrame:
    """Classes or properties (entity, ontology, kind) of an ontology."""
    rows = definitions.where(F.col("ontology") == ontology) if ontology else definitions
    return rows.where(F.col("kind") == kind) if kind else rows


def image_resolutions(images: DataFrame) -> DataFrame:
    """Six sizes of each JPEG 2000 image, smallest first; other files as they are. Columns dim_x, dim_y, mime."""
    powers = F.when(F.col("mime") == "image/jp2", F.sequence(F.lit(5), F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
    rows = images.withColumn("power", F.explode(powers))
    scaled = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), "power") + 0.5).cast("int")
    return rows.withColumns({"dim_x": scaled("dim_x"), "dim_y": scaled("dim_y")})


def resources_of(resources: DataFrame, project: str, cls: str) -> DataFrame:
    return resources.where((F.col("project") == project) & (F.col("cls") == cls))


def file_values(resources: DataFrame, files: DataFrame) -> DataFrame:
    """files: (resource, quality, file, is_deleted)."""
    live = files.where(~F.col("is_deleted"))
    return live.join(resources.select(F.col("iri").alias("resource")), "resource", "left_semi").select("resource", "quality", "file")


def records(statements: DataFrame, cls: str, properties: list[str], where: dict[str, str] | None = None) -> DataFrame:
    """Typed records from statements: one row per subject of the class, one column per property.

    ``where`` looks records up by property values. Only the named properties are
    read, and each column holds the smallest object.
    """
    rows = statements.where(F.col("p").isin(["type", *properties]))
    columns = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(p) for p in properties]
    is_kind = F.max(((F.col("p") == "type") & (F.col("o") == cls)).cast("int")).alias("_kind")
    out = rows.groupBy("s").agg(is_kind, *columns).where("_kind = 1").drop("_kind")
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), (where or {}).items(), out)


def value_with_markup(values: DataFrame, tags: DataFrame, resources: DataFrame, text_of_tag: str) -> DataFrame:
    """Literal, mark-up and project of values as statements: (value, p, o)."""
    literal = values.where("as_string IS NOT NULL").select(F.col("iri").alias("value"), F.lit("asString").alias("p"), F.col("as_string").alias("o"))
    markup = tags.join(values.select(F.col("iri").alias(text_of_tag)), text_of_tag, "left_semi").select(
        F.col(text_of_tag).alias("value"), F.lit("standoff"), "tag"
    )
    project = values.select("resource", "iri").join(resources.select(F.col("iri").alias("resource"), "project"), "resource")
    return literal.union(markup).union(project.select("iri", F.lit("project"), "project"))


def requested_resources(requests: DataFrame, resources: DataFrame, profiles: DataFrame, user_id: str) -> DataFrame:
    """Asked-for resources with how it went: (iri, label, status found | hidden | missing)."""
    live = access.with_code(resources.where(~F.col("is_deleted")), profiles, user_id).select("iri", "label", "code", F.lit(True).alias("_known"))
    rows = requests.select("iri").distinct().join(live, "iri", "left")
    shown = F.col("code").isNotNull()
    status = F.when(F.col("_known").isNull(), "missing").when(shown, "found").otherwise("hidden")
    return rows.select("iri", F.when(shown, F.col("label")).alias("label"), status.alias("status"))
