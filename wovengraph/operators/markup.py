"""Text mark-up as ranges over plain text.

Parsing and writing XML, and comparing two texts, work on one document at a
time in Arrow batches; everything about the resulting rows is done in Spark.
Positions count characters.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.session import settle

# The word break put in after some tags, and the attributes of milestones.
SEPARATOR = "\u001e"
START_ID, END_ID = "sID", "eID"
# No XML document holds this sign, so no namespace does.
BETWEEN_NAMES = "\u001f"
# HTML elements without content, and those whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = frozenset(("script", "style"))

RANGES = (
    "doc string, text string, tag string, start_pos int, end_pos int, tag_index int, parent int, "
    "attributes map<string,string>, error string"
)
RANGES_ARROW = pa.schema(
    [
        *((name, pa.string()) for name in ("doc", "text", "tag")),
        *((name, pa.int32()) for name in ("start_pos", "end_pos", "tag_index", "parent")),
        ("attributes", pa.map_(pa.string(), pa.string())),
        ("error", pa.string()),
    ]
)
# What a task holds before it hands rows on.
HELD_ROWS, HELD_CHARS = 1 << 14, 1 << 22


def _held(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows in batches of bounded weight, whatever number of them a document gives."""
    held, chars = [], 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= HELD_ROWS or chars >= HELD_CHARS:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


class _Ranges:
    """Collects ranges from the events of a parser."""

    def __init__(self, separated: frozenset[str]):
        self.parts, self.pos, self.tags, self.open, self.separated = [], 0, [], [], separated

    def start(self, tag: str, attributes: dict) -> None:
        parent = self.open[-1] if self.open else None
        self.open.append(len(self.tags))
        self.tags.append([tag, self.pos, None, parent, attributes])

    def text(self, data: str) -> None:
        self.parts.append(data)
        self.pos += len(data)

    def end(self, tag: str) -> None:
        if not any(self.tags[i][0] == tag for i in self.open):
            return  # an end tag without a start, which only HTML lets through
        while self.open:
            name = self.close()
            if name == tag:
                break

    def close(self) -> str:
        item = self.tags[self.open.pop()]
        item[2] = self.pos
        if item[0] in self.separated:
            self.text(SEPARATOR)
        return item[0]


class _Html(HTMLParser):
    def __init__(self, ranges: _Ranges):
        super().__init__(convert_charrefs=True)
        self.ranges, self.silent = ranges, 0

    def handle_starttag(self, tag, attrs):
        self.ranges.start(tag, {k: v or "" for k, v in attrs})
        if tag in VOID:
            self.ranges.close()
        elif tag in NO_TEXT:
            self.silent += 1

    def handle_endtag(self, tag):
        if tag in NO_TEXT:
            self.silent = max(0, self.silent - 1)
        if tag not in VOID:
            self.ranges.end(tag)

    def handle_data(self, data):
        if not self.silent:
            self.ranges.text(data)


def _full_name(name: str) -> str:
    """``{namespace}local`` from the parser's form of a name."""
    namespace, _, local = name.rpartition(BETWEEN_NAMES)
    return f"{{{namespace}}}{local}" if namespace else local


def _parse(source: str, html: bool, separated: frozenset[str], namespaces: bool = False) -> _Ranges:
    ranges = _Ranges(separated)
    if html:
        parser = _Html(ranges)
        parser.feed(source)
        parser.close()
        while ranges.open:
            ranges.close()
    else:
        reader = expat.ParserCreate(namespace_separator=BETWEEN_NAMES if namespaces else None)
        reader.StartElementHandler, reader.EndElementHandler = ranges.start, ranges.end
        if namespaces:
            reader.StartElementHandler = lambda tag, found: ranges.start(_full_name(tag), {_full_name(k): v for k, v in found.items()})
            reader.EndElementHandler = lambda tag: ranges.end(_full_name(tag))
        reader.CharacterDataHandler = ranges.text
        reader.Parse(source, True)
    return ranges


def to_ranges(
    docs: DataFrame, doc: str, source: str, html: bool = False, separated: list[str] = (), namespaces: bool = False
) -> DataFrame:
    """One row per tag; the row of tag 0 also has the plain text. A bad document gives one row with an error.

    XML must be well-formed; HTML is read leniently. ``separated`` names tags
    after which a word break is put into the text. With ``namespaces`` (XML only)
    a column ``namespace`` has what the nearest declaration around a tag gives its
    prefix (empty without one), ``tag`` is the local name, attributes with a
    prefix and ``separated`` are ``{namespace}name``, and declarations are no
    attributes; a prefix without a declaration is an error.
    """
    if html and namespaces:
        raise ValueError("HTML has no namespaces")
    chosen = frozenset(separated)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, markup in zip(batch["doc"], batch["source"], strict=True):
                key = key.as_py()
                try:
                    ranges = _parse(markup.as_py() or "", html, chosen, namespaces)
                except expat.ExpatError as e:
                    yield key, None, None, None, None, None, None, None, str(e)
                    continue
                text = "".join(ranges.parts)
                if not ranges.tags:
                    yield key, text, None, None, None, None, None, None, "no tags"
                for i, (tag, start, end, parent, attributes) in enumerate(ranges.tags):
                    yield key, None if i else text, tag, start, end, i, parent, list(attributes.items()), None

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _held(found(batches), RANGES_ARROW)

    ranges = docs.select(F.col(doc).cast("string").alias("doc"), F.col(source).alias("source")).mapInArrow(convert, RANGES)
    if not namespaces:
        return ranges
    split = r"^(?:\{(.*)\})?([^}]*)$"
    return ranges.withColumns({"namespace": F.regexp_extract("tag", split, 1), "tag": F.regexp_extract("tag", split, 2)})


def pair_milestones(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlapping ranges from pairs of empty start and end tags, and the tags that do not pair.

    Pairs have their own start and end parents: (doc, id, tag, start_pos,
    end_pos, tag_index, end_index, parent, end_parent). Problems: (doc, id,
    problem).
    """
    empty = ranges.where("error IS NULL AND start_pos = end_pos")
    is_start = F.map_contains_key("attributes", START_ID)
    marks = empty.where(is_start | F.map_contains_key("attributes", END_ID)).select(
        "doc",
        F.coalesce(F.col("attributes")[START_ID], F.col("attributes")[END_ID]).alias("id"),
        is_start.alias("is_start"),
        F.struct("tag_index", "tag", "start_pos", "parent").alias("mark"),
    )
    paired = marks.groupBy("doc", "id").agg(
        F.min(F.when(F.col("is_start"), F.col("mark"))).alias("a"),
        F.min(F.when(~F.col("is_start"), F.col("mark"))).alias("b"),
    )
    problem = (
        F.when(F.col("b").isNull(), "not closed")
        .when(F.col("a").isNull() | (F.col("a.tag_index") > F.col("b.tag_index")), "no start")
        .when(F.col("a.tag") != F.col("b.tag"), "tags differ")
    )
    judged = paired.withColumn("problem", problem)
    pairs = judged.where("problem IS NULL").select(
        "doc",
        "id",
        "a.tag",
        F.col("a.start_pos").alias("start_pos"),
        F.col("b.start_pos").alias("end_pos"),
        F.col("a.tag_index").alias("tag_index"),
        F.col("b.tag_index").alias("end_index"),
        F.col("a.parent").alias("parent"),
        F.col("b.parent").alias("end_parent"),
    )
    return pairs, judged.where("problem IS NOT NULL").select("doc", "id", "problem")


def as_milestones(pairs: DataFrame) -> DataFrame:
    """Overlapping ranges as pairs of empty tags again."""
    start = F.struct(
        F.col("start_pos").alias("at"), F.col("tag_index").alias("i"), F.col("parent").alias("up"), F.lit(START_ID).alias("name")
    )
    end = F.struct(
        F.col("end_pos").alias("at"), F.col("end_index").alias("i"), F.col("end_parent").alias("up"), F.lit(END_ID).alias("name")
    )
    rows = pairs.select("doc", "tag", "id", F.explode(F.array(start, end)).alias("m"))
    return rows.select(
        "doc",
        "tag",
        F.col("m.at").alias("start_pos"),
        F.col("m.at").alias("end_pos"),
        F.col("m.i").alias("tag_index"),
        F.col("m.up").alias("parent"),
        F.create_map("m.name", "id").alias("attributes"),
    )


def _write(text: str, tags: list) -> str:
    children: dict = {}
    for t in sorted(tags, key=lambda t: t["tag_index"]):
        children.setdefault(t["parent"], []).append(t)
    roots = children.get(None, [])
    if len(roots) != 1:
        raise ValueError("one root tag is needed" if roots else "no root tag")
    out, at = [], 0
    stack = [("open", roots[0])]
    while stack:
        step, t = stack.pop()
        place = t["start_pos"] if step == "open" else t["end_pos"]
        out.append(escape(text[at:place]))
        at = max(at, place)
        if step == "close":
            out.append(f"</{t['tag']}>")
            continue
        attributes = "".join(f" {k}={quoteattr(v)}" for k, v in sorted(dict(t["attributes"] or {}).items()))
        inner = children.get(t["tag_index"], [])
        if t["end_pos"] == t["start_pos"] and not inner:
            out.append(f"<{t['tag']}{attributes}/>")
            continue
        out.append(f"<{t['tag']}{attributes}>")
        stack.append(("close", t))
        stack.extend(("open", child) for child in reversed(inner))
    return "".join(out).replace(SEPARATOR, "")


def to_xml(ranges: DataFrame) -> DataFrame:
    """(doc, xml, error) from the ranges of each document; one root is required.

    A document's tags come together in one row, as its text does.
    """
    tag = F.struct("tag", "start_pos", "end_pos", "tag_index", "parent", "attributes")
    docs = ranges.where("tag IS NOT NULL").groupBy("doc").agg(F.max("text").alias("text"), F.collect_list(tag).alias("tags"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(batch["doc"], batch["text"], batch["tags"], strict=True):
                key, text, tags = (x.as_py() for x in row)
                try:
                    yield key, _write(text or "", tags), None
                except ValueError as e:
                    yield key, None, str(e)

    schema = pa.schema([(name, pa.string()) for name in ("doc", "xml", "error")])
    return docs.mapInArrow(lambda batches: _held(written(batches), schema), "doc string, xml string, error string")


def changed_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tags a version adds and removes, by UUID: (uuid, change)."""
    added = new.select("uuid").distinct().join(old, "uuid", "left_anti").select("uuid", F.lit("added").alias("change"))
    removed = old.select("uuid").distinct().join(new, "uuid", "left_anti").select("uuid", F.lit("removed").alias("change"))
    return added.union(removed)


DIFFS = "pair string, seq int, op string, base_start int, base_end int, derived_start int, derived_end int"
_TOKEN = re.compile(r"\s+|\w+|[^\w\s]")


def _diff(base: str, derived: str) -> list[tuple]:
    a, b = _TOKEN.findall(base), _TOKEN.findall(derived)
    starts = []
    for tokens in (a, b):
        at = [0]
        for t in tokens:
            at.append(at[-1] + len(t))
        starts.append(at)
    rows = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        x1, x2, y1, y2 = starts[0][i1], starts[0][i2], starts[1][j1], starts[1][j2]
        if op == "equal":
            rows.append(("equal", x1, x2, y1, y2))
        if op in ("delete", "replace"):
            rows.append(("delete", x1, x2, y1, y1))
        if op in ("insert", "replace"):
            rows.append(("insert", x2, x2, y1, y2))
    return rows


def text_diffs(pairs: DataFrame) -> DataFrame:
    """Equal, deleted and inserted ranges between two texts, word by word: pairs (pair, base, derived)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["pair", "seq", "op", "base_start", "base_end", "derived_start", "derived_end"]
        for batch in batches:
            rows = [
                (key, i, *row)
                for key, base, derived in zip(batch["pair"], batch["base"], batch["derived"])
                for i, row in enumerate(_diff(base or "", derived or ""))
            ]
            yield pd.DataFrame(rows, columns=columns)

    # Comparing costs far more than its input weighs, so rows are spread by number, not by size.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select(F.col("pair").cast("string").alias("pair"), "base", "derived").repartition(tasks)
    return rows.mapInPandas(compare, DIFFS)


def xml_escape(text: Column) -> Column:
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def inline_diffs(pairs: DataFrame, diffs: DataFrame) -> DataFrame:
    """(pair, marked): the texts as one, with <ins> and <del>.

    The ranges of a pair are together no longer than its texts, which come in one row.
    """
    ranges = diffs.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "base_start", "base_end", "derived_start", "derived_end"))).alias("r"))
    rows = pairs.select(F.col("pair").cast("string").alias("pair"), "base", "derived").join(ranges, "pair", "left")

    def piece(r: Column) -> Column:
        old = xml_escape(F.substr("base", r["base_start"] + 1, r["base_end"] - r["base_start"]))
        new = xml_escape(F.substr("derived", r["derived_start"] + 1, r["derived_end"] - r["derived_start"]))
        return (
            F.when(r["op"] == "equal", old)
            .when(r["op"] == "delete", F.concat(F.lit("<del>"), old, F.lit("</del>")))
            .otherwise(F.concat(F.lit("<ins>"), new, F.lit("</ins>")))
        )

    return rows.select("pair", F.array_join(F.transform(F.coalesce("r", F.array()), piece), "").alias("marked"))


def link_targets(tags: DataFrame, text: str, target: str) -> DataFrame:
    return tags.where(F.col(target).isNotNull()).select(text, target).distinct()


def map_tags(tags: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags with their mapped class, and those the mapping lacks; mapping: (namespace, tag, css_class, cls)."""
    # Both results read the tags, which may come from a parser: it runs once.
    tags = settle(tags)
    keys = ["namespace", "tag", "css_class"]
    rules = mapping.select(*keys, "cls")
    return tags.join(rules, keys), tags.join(rules, keys, "left_anti")


def invert_mapping(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """class -> tag, and classes that several tags map to."""
    counted = mapping.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("namespace", "tag", "css_class")).alias("_t")
    )
    return counted.where("n = 1").select("cls", "_t.*"), counted.where("n > 1").select("cls", "n")


def typed_tags(tags: DataFrame, attributes: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Tags with typed columns from their attributes; kinds: column -> (attribute, Spark type).

    attributes: (tag, name, value). A value that is not of its type is null.
    """
    columns = [
        F.max(F.when(F.col("name") == name, F.col("value").try_cast(dtype))).alias(column) for column, (name, dtype) in kinds.items()
    ]
    wanted = attributes.where(F.col("name").isin([name for name, _ in kinds.values()]))
    return tags.join(wanted.groupBy("tag").agg(*columns), "tag", "left")
