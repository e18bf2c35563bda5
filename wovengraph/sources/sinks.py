"""Exports of nested data. Lists come in parts of bounded length, so that no row is unbounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wovengraph.operators.ordering import PART_ROWS, first_n, listed, parts_for, split
from wovengraph.sources.relational import flat


def subject_view(statements: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """All statements of each subject in order: (s, part, statements).

    statements: (s, p, o), or arrays of p and o as ``StatementTables.by_subject`` gives. Such rows move as they are; each
    subject's are put together where they meet, and cut into parts there. Subjects of very many rows are listed by statement.
    """
    if not dict(statements.dtypes)["p"].startswith("array"):
        return listed(statements, ["s"], ["p", "o"], None, "statements", part_rows, distinct=True)
    cold, hot, total = split(statements.select("s", "p", "o", "o_kind"), ["s"], part_rows)
    said = F.filter(F.flatten(F.collect_list(F.arrays_zip("p", "o"))), lambda x: x["o"].isNotNull())
    items = cold.repartition(parts_for(cold.sparkSession, total), "s").groupBy("s").agg(F.array_sort(F.array_distinct(said)).alias("_items"))
    last = F.floor((F.size("_items") - 1) / part_rows).cast("long")
    parts = items.where(F.size("_items") > 0).select("s", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"), "_items")
    out = parts.select("s", "part", F.slice("_items", (F.col("part") * part_rows + 1).cast("int"), part_rows).alias("statements"))
    return out if hot is None else out.unionByName(listed(flat(hot), ["s"], ["p", "o"], None, "statements", part_rows, distinct=True))


def catalogue(projects: DataFrame, datasets: DataFrame, files: DataFrame, limit: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Datasets of each project with their files: (project, longname, dataset, title, part, files).

    projects: (project, longname); datasets: (project, dataset, title); files:
    (dataset, seqnum, file). ``limit`` is the number of datasets per project
    that was asked for, by dataset key.
    """
    chosen = first_n(datasets, ["project"], ["dataset"], limit) if limit else datasets
    held = files.join(chosen.select("dataset"), "dataset", "left_semi")
    lists = listed(held, ["dataset"], ["seqnum", "file"], F.struct("seqnum", "file"), "files", part_rows)
    rows = chosen.join(projects, "project").join(lists, "dataset", "left")
    return rows.select("project", "longname", "dataset", "title", F.coalesce("part", F.lit(0)).alias("part"), "files")


def resources_jsonld(resources: DataFrame, values: DataFrame, labels: DataFrame | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """One JSON-LD object per resource (and part): (iri, part, json).

    values: (resource, prop, value, literal). The values of a property form an
    array. labels: (iri, lang, label), given as language-tagged entries.
    """
    order = ["prop", "value"]
    item = F.struct("prop", "value", "literal")
    rows = values.select("resource", "prop", "value", "literal")
    parts = listed(rows, ["resource"], order, item, "held", part_rows).withColumnRenamed("resource", "iri")
    props = F.array_distinct(F.transform("held", lambda h: h["prop"]))
    by_prop = F.map_from_arrays(
        props,
        F.transform(
            props,
            lambda p: F.transform(
                F.filter("held", lambda h: h["prop"] == p),
                lambda h: F.struct(h["value"].alias("@id"), h["literal"].alias("@value")),
            ),
        ),
    )
    out = resources.select("iri", "cls", "label").join(parts, "iri", "left")
    fields = [F.col("iri").alias("@id"), F.col("cls").alias("@type"), F.col("label").alias("label"), by_prop.alias("values")]
    if labels is not None:
        # A resource has one label per language, and languages are few.
        tagged = labels.groupBy("iri").agg(
            F.array_sort(F.collect_set(F.struct(F.col("lang").alias("@language"), F.col("label").alias("@value")))).alias("labels")
        )
        out = out.join(tagged, "iri", "left")
        fields.append(F.col("labels"))
    return out.select("iri", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct(*fields)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
