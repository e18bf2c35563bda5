"""Relational rows to triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE_COLUMNS = ["graph", "s", "p", "o", "o_kind"]


def _text(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def tables_to_triples(df: DataFrame, subject: Column, mapping: dict[str, tuple[Column, str]], graph: Column) -> DataFrame:
    """All statements of each row in one pass; null objects give no statement.

    ``mapping`` is property -> (object, 'iri' | 'literal'). Reads the table
    once, whatever the number of properties: the form for full exports.
    """
    statements = F.array(
        *[F.struct(F.lit(p).alias("p"), _text(o).alias("o"), F.lit(kind).alias("o_kind")) for p, (o, kind) in mapping.items()]
    )
    rows = df.select(graph.alias("graph"), subject.alias("s"), F.inline(statements))
    return rows.where(F.col("o").isNotNull()).select(*TRIPLE_COLUMNS)


class StatementTables:
    """Resources, value objects and reified links, read as one statement table.

    A pattern with a known property reads just the table and columns that hold
    it. Without one, every table is read once and gives all its statements.
    """

    def __init__(self, resources: DataFrame, values: DataFrame, links: DataFrame):
        c = F.col
        self.resources, self.values, self.links = resources, values, links
        self._facts = {
            "label": (resources, "iri", c("label"), "literal"),
            "creator": (resources, "iri", c("creator"), "iri"),
            "isDeleted": (resources, "iri", c("is_deleted"), "literal"),
            "valueOrder": (values, "iri", c("vorder"), "literal"),
            "asString": (values, "iri", c("as_string"), "literal"),
            "asInt": (values, "iri", c("as_int"), "literal"),
            "asDecimal": (values, "iri", c("as_decimal"), "literal"),
            "asNode": (values, "iri", c("as_node"), "iri"),
            "subject": (links, "link_value", c("src"), "iri"),
            "predicate": (links, "link_value", c("prop"), "iri"),
            "object": (links, "link_value", c("dst"), "iri"),
        }
        self._types = [(resources, "iri", c("cls")), (values, "iri", c("vtype")), (links, "link_value", F.lit("LinkValue"))]

    def of(self, prop: str | None = None) -> DataFrame:
        if prop is None:
            return self._everything()
        if prop == "type":
            return reduce(DataFrame.union, [self._column(t, s, "type", o, "iri") for t, s, o in self._types])
        if prop in self._facts:
            table, subject, obj, kind = self._facts[prop]
            return self._column(table, subject, prop, obj, kind).where(F.col("o").isNotNull())
        iri = F.lit("iri").alias("o_kind")
        held = self.values.where(F.col("prop") == prop).select(
            F.col("project").alias("graph"), F.col("resource").alias("s"), F.lit(prop).alias("p"), F.col("iri").alias("o"), iri
        )
        direct = self.links.where((F.col("prop") == prop) & ~F.col("is_deleted"))
        parts = [held, self._column(direct, "src", prop, F.col("dst"), "iri")]
        if prop.endswith("Value"):
            reified = self.links.where(F.col("prop") == prop.removesuffix("Value"))
            parts.append(self._column(reified, "src", prop, F.col("link_value"), "iri"))
        return reduce(DataFrame.union, parts)

    @staticmethod
    def _column(table: DataFrame, subject: str, prop: str, obj: Column, kind: str) -> DataFrame:
        return table.select(
            F.col("project").alias("graph"), F.col(subject).alias("s"), F.lit(prop).alias("p"), _text(obj).alias("o"), F.lit(kind).alias("o_kind")
        )

    def _said(self) -> dict[str, list[tuple[str, Column, Column, str]]]:
        """Of each table: (subject, property, object, kind) of every statement a row makes."""
        c = F.col

        def facts(table: DataFrame, subject: str, types: Column) -> list[tuple[str, Column, Column, str]]:
            own = [(subject, F.lit(p), _text(o), k) for p, (t, _, o, k) in self._facts.items() if t is table]
            return [(subject, F.lit("type"), _text(types), "iri"), *own]

        (_, _, cls), (_, _, vtype), (_, _, link_type) = self._types
        return {
            "resources": facts(self.resources, "iri", cls),
            "values": [*facts(self.values, "iri", vtype), ("resource", c("prop"), c("iri"), "iri")],
            "links": [
                *facts(self.links, "link_value", link_type),
                ("src", F.concat("prop", F.lit("Value")), c("link_value"), "iri"),
                ("src", c("prop"), F.when(~c("is_deleted"), c("dst")), "iri"),
            ],
        }

    def _everything(self) -> DataFrame:
        c = F.col
        statement = lambda s, p, o, kind: F.struct(c(s).alias("s"), p.alias("p"), _text(o).alias("o"), F.lit(kind).alias("o_kind"))
        parts = [
            getattr(self, name).select(c("project").alias("graph"), F.inline(F.array(*[statement(*x) for x in said])))
            for name, said in self._said().items()
        ]
        return reduce(DataFrame.union, parts).where(c("o").isNotNull()).select(*TRIPLE_COLUMNS)

    def by_subject(self) -> DataFrame:
        """The same statements as (s, p, o, o_kind) with arrays side by side: one row for what a table's row says of a subject.

        Null objects are no statements. For what brings subjects together: fewer and shorter rows move.
        """

        def row(subject: str, said: list[tuple[str, Column, Column, str]]) -> Column:
            _, props, objects, kinds = zip(*[x for x in said if x[0] == subject], strict=True)
            lists = (F.array(*props).alias("p"), F.array(*objects).alias("o"), F.array(*map(F.lit, kinds)).alias("o_kind"))
            return F.struct(F.col(subject).alias("s"), *lists)

        parts = [
            getattr(self, name).select(F.inline(F.array(*[row(subject, said) for subject in dict.fromkeys(x[0] for x in said)])))
            for name, said in self._said().items()
        ]
        return reduce(DataFrame.union, parts)


def flat(rows: DataFrame) -> DataFrame:
    """Statements (s, p, o, o_kind) of rows with arrays of them, as ``by_subject`` gives; other rows as they are."""
    if not dict(rows.dtypes)["p"].startswith("array"):
        return rows
    return rows.select("s", F.inline(F.arrays_zip("p", "o", "o_kind"))).where(F.col("o").isNotNull())
