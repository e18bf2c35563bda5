"""Validation, escaping and IRI functions; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of names and codes.
NAME = r"[\p{L}_][\p{L}0-9_.-]*"
COLOR = r"^#(?:[0-9a-fA-F]{3}){1,2}$"
PROJECT_CODE = r"^\p{XDigit}{4}$"
DATE_TIME = "yyyy-MM-dd'T'HH:mm:ss"
CLIENT_REFERENCE = rf"^ref:({NAME})$"
# Characters and their escaped form.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("'", "\\'"), ("\t", "\\t"), ("\n", "\\n")]


def valid_int(text: Column) -> Column:
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))


def valid_decimal(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("decimal(38,18)"))


def valid_boolean(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def valid_date_time(text: Column) -> Column:
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$")
    return F.when(shaped & F.try_to_timestamp(text, F.lit(DATE_TIME)).isNotNull(), text)


def valid_iri(text: Column) -> Column:
    return F.when(text.rlike(r'^[A-Za-z][A-Za-z0-9+.-]*://[^\s<>"{}|\\^`/]+(/[^\s<>"{}|\\^`]*)?$'), text)


def valid_color(text: Column) -> Column:
    return F.when(text.rlike(COLOR), text)


def valid_geometry(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def valid_name(text: Column) -> Column:
    return F.when(text.rlike(f"^{NAME}$"), text)


def valid_map_path(text: Column) -> Column:
    return F.when(text.rlike(f"^{NAME}(/{NAME})*$"), text)


def valid_project_code(text: Column) -> Column:
    return F.when(text.rlike(PROJECT_CODE), F.upper(text))


def escape(text: Column) -> Column:
    """Escaped text; null for an empty text or one with a carriage return."""
    out = text
    for plain, escaped in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return F.when((text != "") & ~F.contains(text, F.lit("\r")), out)


def unescape(text: Column) -> Column:
    """Undo ``escape``: an escaped backslash is set aside, so that what follows it is not taken for its own escape."""
    hold = "\u0000"
    out = F.replace(text, F.lit("\\\\"), F.lit(hold))
    for plain, escaped in ESCAPES[1:]:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit(hold), F.lit("\\"))


def iri_parts(iri: Column) -> Column:
    """struct(ontology, entity, project_code, prefix) of ``.../ontology/[code/]name#entity``."""
    ontology = F.substring_index(iri, "#", 1)
    entity = F.nullif(F.regexp_extract(iri, "#(.*)$", 1), F.lit(""))
    name = F.element_at(F.split(ontology, "/"), -1)
    code = F.nullif(F.regexp_extract(ontology, r"/ontology/(\p{XDigit}{4})/", 1), F.lit(""))
    prefix = F.when(code.isNotNull(), F.concat(F.lit("p"), code, F.lit("-"), name)).otherwise(name)
    return F.struct(ontology.alias("ontology"), entity.alias("entity"), code.alias("project_code"), prefix.alias("prefix"))


def to_schema(iri: Column, source: str, target: str) -> Column:
    """The same entity under another schema's start; other IRIs stay."""
    return F.when(F.startswith(iri, F.lit(source)), F.concat(F.lit(target), F.substr(iri, F.lit(len(source) + 1)))).otherwise(iri)


def uuid_to_base64(uuid: Column) -> Column:
    """The 22-character form of a UUID: URL-safe, no padding."""
    raw = F.base64(F.unhex(F.replace(uuid, F.lit("-"), F.lit(""))))
    return F.rtrim(F.translate(raw, "+/=", "-_ "))


def base64_to_uuid(text: Column) -> Column:
    digits = F.lower(F.hex(F.unbase64(F.concat(F.translate(text, "-_", "+/"), F.lit("==")))))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts])


def stable_uuid(*parts: Column) -> Column:
    """A UUID that follows from its parts, so that a retried task mints the same one."""
    digits = F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts])


def resource_iri(base: str, project_code: Column, project_name: Column, uuid: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.nullif(project_code, F.lit("")), project_name, uuid_to_base64(uuid))


def value_iri(resource: Column, uuid: Column) -> Column:
    return F.concat_ws("/values/", resource, uuid_to_base64(uuid))


def project_graph(base: str, project_code: Column, project_name: Column) -> Column:
    return F.concat_ws("/", F.lit(base), F.nullif(project_code, F.lit("")), project_name)


def property_iri(name: Column, base: str) -> Column:
    """``prefix__local`` as a property IRI; null for another shape."""
    pattern = f"^({NAME}?)__({NAME})$"
    prefix, local = F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)
    return F.when(name.rlike(pattern), F.concat(F.lit(base), prefix, F.lit("#"), local))


def resolve_client_references(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Replace ``ref:ID`` targets by the IRIs of (client_id, iri); others stay.

    A reference without an IRI becomes null.
    """
    ref = F.nullif(F.regexp_extract(column, CLIENT_REFERENCE, 1), F.lit(""))
    found = ids.select(F.col("client_id").alias("_ref"), F.col("iri").alias("_iri"))
    joined = df.withColumn("_ref", ref).join(found, "_ref", "left")
    return joined.withColumn(column, F.when(F.col("_ref").isNull(), F.col(column)).otherwise(F.col("_iri"))).select(*df.columns)
