"""N-Triples and N-Quads lines as statements, and the stored graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# One line: subject, predicate, object (IRI, blank node or literal with type or language), optional graph.
# The literal is taken greedily and then checked, as a pattern for its inside would not do for long texts.
_IRI, _BLANK = r"<([^\x00-\x1F>]*)>", r"_:([^\s\x00-\x1F]+)"
LINE = (
    rf"(?s)^\s*(?:{_IRI}|{_BLANK})\s*{_IRI}\s*(?=([<_\"]))(?:{_IRI}|{_BLANK}|"
    rf'"(.*)"(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*(?:{_IRI}|(_:[^\s\x00-\x1F]+))?\s*\.\s*(?:#.*)?\z'
)
# The fields of a line, the literal last, since it alone may hold the sign between them.
_START, _BETWEEN = "\x02", "\x1f"
_FIELDS = ("s_iri", "s_blank", "p", "opens", "o_iri", "o_blank", "dt", "lang", "g_iri", "g_blank", "literal")
_ORDER = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 7)
# Escapes of one code point: two halves of a pair, four digits, eight digits.
_HEX = "[0-9A-Fa-f]"
UNICODE = (
    rf"\\u[Dd][89ABab]{_HEX}{{2}}\\u[Dd][C-Fc-f]{_HEX}{{2}}|\\u(?![Dd][89A-Fa-f]){_HEX}{{4}}"
    rf"|\\U(?!0000[Dd][89A-Fa-f])(?:0010|000{_HEX}){_HEX}{{4}}"
)
# The other escapes of a literal.
SIGNS = {'\\"': '"', "\\'": "'", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\b": "\b", "\\f": "\f"}


def _unicode(text: Column) -> Column:
    """``\\u`` and ``\\U`` escapes as their characters; other text stays."""
    digits = lambda e: F.regexp_replace(e, r"\\[uU]", "")

    def sign(e: Column) -> Column:
        wide = F.decode(F.unhex(digits(e)), "UTF-32")
        return F.when(F.startswith(e, F.lit("\\U")), wide).otherwise(F.decode(F.unhex(digits(e)), "UTF-16BE"))

    between, escapes = F.split(text, UNICODE, -1), F.regexp_extract_all(text, F.lit(UNICODE), F.lit(0))
    joined = F.array_join(F.zip_with(between, escapes, lambda t, e: F.concat(t, F.coalesce(sign(e), F.lit("")))), "")
    return F.when(F.lower(text).contains("\\u"), joined).otherwise(text)


def _unquote(literal: Column) -> Column:
    """The text of a literal: escaped backslashes are set aside, so that each one left begins an escape."""

    def plain(part: Column) -> Column:
        out = _unicode(part)
        for escaped, sign in SIGNS.items():
            out = F.replace(out, F.lit(escaped), F.lit(sign))
        return out

    parts = F.transform(F.split(literal, r"\\\\", -1), plain)
    return F.when(literal.contains("\\"), F.array_join(parts, "\\")).otherwise(literal)


def parse_lines(lines: DataFrame, graph: str) -> DataFrame:
    """Statements from a column ``value`` of lines; null, empty and comment lines are skipped.

    A graph that is a blank node keeps its ``_:``. A line that is no statement,
    one with a bad escape included, gives a row without a subject, with the line
    as its object.
    """
    v = F.col("value")
    rows = lines.where(~v.rlike(r"^\s*(#.*)?$"))
    cut = F.regexp_replace(v, LINE, _START + _BETWEEN.join(f"${i}" for i in _ORDER))
    # No statement begins with the sign that a cut line begins with.
    rows = rows.select(v, F.split(cut, _BETWEEN, len(_FIELDS)).alias("_f"))
    found = F.startswith(F.col("_f")[0], F.lit(_START)) & ~F.startswith(v, F.lit(_START))
    fields = [F.when(F.col("_found"), F.col("_f")[i]).alias(name) for i, name in enumerate(_FIELDS)]
    rows = rows.select("value", "_f", found.alias("_found")).select("value", *fields)
    bare = F.regexp_replace("literal", r"""\\[\\"'nrtbf]|""" + UNICODE, "")
    sound = F.col("literal").isNotNull() & ~(F.col("literal").rlike(r'[\\"]') & bare.rlike(r'[\\"]'))
    node = lambda name: F.nullif(F.col(name), F.lit(""))
    iri = lambda name: _unicode(F.col(name))
    s_iri = F.substring("s_iri", 2, 1 << 30)
    kind = F.when(F.col("opens") == '"', "literal").when(F.col("opens") == "<", "iri").otherwise("blank")
    obj = F.when(F.col("opens") == '"', _unquote(F.col("literal"))).when(F.col("opens") == "<", iri("o_iri")).otherwise(F.col("o_blank"))
    ok = lambda c: F.when(F.col("_sound"), c)
    return rows.withColumn("_sound", sound).select(
        F.coalesce(ok(F.coalesce(F.nullif(iri("g_iri"), F.lit("")), node("g_blank"))), F.lit(graph)).alias("graph"),
        ok(F.when(F.col("s_blank") == "", _unicode(s_iri)).otherwise(F.col("s_blank"))).alias("s"),
        ok(iri("p")).alias("p"),
        F.coalesce(ok(obj), v).alias("o"),
        ok(kind).alias("o_kind"),
        ok(F.nullif(iri("dt"), F.lit(""))).alias("o_dt"),
        ok(node("lang")).alias("o_lang"),
        ok(F.when(F.col("s_blank") == "", "iri").otherwise("blank")).alias("s_kind"),
    )


def load_graph(spark: SparkSession, path: str, graph: str) -> DataFrame:
    return parse_lines(spark.read.text(path), graph)


def format_lines(statements: DataFrame) -> DataFrame:
    """Statements as N-Quads lines (column ``value``); a graph that begins with ``_:`` is a blank node."""
    node = lambda c, kind: F.when(kind == "blank", F.concat(F.lit("_:"), c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(
        F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))
    )
    literal = F.concat(F.lit('"'), quoted, F.lit('"'), F.coalesce(suffix, F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"), F.col("o_kind")))
    graph = F.when(F.startswith("graph", F.lit("_:")), F.col("graph")).otherwise(node(F.col("graph"), F.lit("iri")))
    line = F.concat_ws(" ", node(F.col("s"), F.coalesce("s_kind", F.lit("iri"))), node(F.col("p"), F.lit("iri")), obj, graph, F.lit("."))
    return statements.select(line.alias("value"))


def save_graphs(statements: DataFrame, path: str, replace: bool = True, files_per_graph: int = 16) -> None:
    """Store statements by graph; the graphs present are replaced, or added to.

    Other graphs in the store stay as they are. A big graph is written by
    several tasks, in files sorted by property so that scans can skip.
    """
    spread = F.pmod(F.xxhash64("s"), F.lit(files_per_graph))
    rows = statements.repartition("graph", spread).sortWithinPartitions("graph", "p", "s")
    writer = rows.write.partitionBy("graph")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def reset(statements: DataFrame, path: str, files_per_graph: int = 16) -> None:
    """Drop the whole store and load these statements."""
    spread = F.pmod(F.xxhash64("s"), F.lit(files_per_graph))
    rows = statements.repartition("graph", spread).sortWithinPartitions("graph", "p", "s")
    rows.write.partitionBy("graph").mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
