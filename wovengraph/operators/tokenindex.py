"""A stored inverted index over labels and text values.

The index is a folder. Every write adds one part: the first holds all entries,
later ones what was added or removed since. A part is cut into ranges of
(token, resource, value) and sorted, so a common token spreads over as many files as it fills.
A small table beside the parts says which tokens each file begins and ends with;
a search opens only files that can hold its terms, and the filter on the sorted
token column skips row groups within them. Parts are merged on reading: of
an entry's rows the one in the newest part counts. ``compact`` writes one part again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.operators.fulltext import terms_of, tokens
from wovengraph.operators.ordering import having, marked

ENTRY = ["token", "resource", "value"]
_FILES = "version int, file string, low string, high string, entries long"
_ROWS = "token string, resource string, value string, removed boolean, version int"
_LAST = "\U0010ffff"  # no text goes behind it


def entries(resources: DataFrame, values: DataFrame) -> DataFrame:
    """(token, resource, value) of live labels (value is empty) and live texts of live resources, each token of a text once."""
    live = resources.where(~F.col("is_deleted"))
    labels = live.select(F.col("iri").alias("resource"), F.lit("").alias("value"), F.col("label").alias("text"))
    texts = values.where((F.col("vtype") == "TextValue") & ~F.col("is_deleted")).select("resource", F.col("iri").alias("value"), F.col("as_string").alias("text"))
    texts = having(texts, live.select(F.col("iri").alias("resource")), ["resource"])
    return labels.unionByName(texts).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), "resource", "value")


class TokenIndex:
    """An index in a folder that all executors reach. One writer at a time.

    ``parts``: ranges of a part; without it Spark sizes them by its own settings.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def files(self) -> DataFrame:
        """version, file, low, high, entries: one row for each written file."""
        return self.spark.read.schema(_FILES).parquet(f"{self.path}/files/*")

    def _add(self, rows: DataFrame, version: int) -> None:
        part = f"{self.path}/rows/{version}"
        rows = rows.select(*ENTRY, "removed", F.lit(version).alias("version"))
        cut = rows.repartitionByRange(self.parts, *ENTRY) if self.parts else rows.repartitionByRange(*ENTRY)
        # Equal entries lie in one range, so they are found without moving them.
        cut.dropDuplicates(ENTRY).sortWithinPartitions(*ENTRY).write.parquet(part)
        held = self.spark.read.schema(_ROWS).parquet(part).select("token", "version", F.col("_metadata.file_path").alias("file"))
        spans = held.groupBy("version", "file").agg(F.min("token").alias("low"), F.max("token").alias("high"), F.count(F.lit(1)).alias("entries"))
        spans.select("version", "file", "low", "high", "entries").coalesce(1).write.parquet(f"{self.path}/files/{version}")
        self._marked(version)

    def _marked(self, version: int) -> None:
        self.spark.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{self.path}/newest")

    def newest(self) -> int:
        return self.spark.read.schema("version int").parquet(f"{self.path}/newest").first()[0]

    def build(self, found: DataFrame) -> TokenIndex:
        """The first part: all entries, each once."""
        self._add(found.withColumn("removed", F.lit(False)), 0)
        return self

    def change(self, before: DataFrame, after: DataFrame) -> TokenIndex:
        """A part with what differs between the entries of some texts before and after an edit."""
        both = before.select(*ENTRY, F.lit(-1).alias("_by")).union(after.select(*ENTRY, F.lit(1)))
        differ = both.groupBy(*ENTRY).agg(F.sum("_by").alias("_by")).where("_by <> 0")
        self._add(differ.select(*ENTRY, (F.col("_by") < 0).alias("removed")), self.newest() + 1)
        return self

    def _current(self, rows: DataFrame) -> DataFrame:
        """Entries as the newest part has them; rows of a text stay where they are for what follows."""
        last = rows.repartition("resource", "value").groupBy("resource", "value", "token").agg(F.max_by("removed", "version").alias("_gone"))
        return last.where(~F.col("_gone")).select(*ENTRY)

    def rows(self) -> DataFrame:
        """All current entries, each once. A single part has nothing to merge and is read as it lies.

        Of the first part only the texts that a later one may name are merged; the others stay where they are.
        """
        read, newest = self.spark.read.schema(_ROWS).parquet, self.newest()
        if not newest:
            return read(f"{self.path}/rows/*").select(*ENTRY)
        later = read(*[f"{self.path}/rows/{version}" for version in range(1, newest + 1)])
        first = marked(read(f"{self.path}/rows/0"), later, ["resource", "value"], "_later")
        return first.where("NOT _later").select(*ENTRY).union(self._current(first.where("_later").drop("_later").union(later)))

    def scan(self, spans: list[tuple[str, str]]) -> DataFrame:
        """Stored rows with a token in one of the ranges (both ends included), from the files that can hold them."""
        meets = reduce(lambda a, b: a | b, [(F.col("low") <= high) & (F.col("high") >= low) for low, high in spans])
        wanted = [r["file"] for r in self.files().where(meets).select("file").collect()]
        if not wanted:
            return self.spark.createDataFrame([], _ROWS)
        tests = [F.col("token") == low if low == high else F.col("token").between(low, high) for low, high in spans]
        return self.spark.read.schema(_ROWS).parquet(*wanted).where(reduce(lambda a, b: a | b, tests))

    def search(self, search: str, mode: str = "and", typing: bool = False) -> DataFrame:
        """(resource, value) of the texts that hold all terms (or any, with mode 'or'); with ``typing`` the last term may go on.

        Terms are cut like the texts; signs alone find nothing. The value is empty for a label.
        """
        terms = list(dict.fromkeys(terms_of(search)[:-1])) + terms_of(search)[-1:]
        if not terms:
            return self.spark.createDataFrame([], "resource string, value string")
        spans = [(t, t + _LAST if typing and k == len(terms) - 1 else t) for k, t in enumerate(terms)]
        # A single part has nothing to merge; what follows names each text once.
        held = self._current(self.scan(spans)) if self.newest() else self.scan(spans)
        if mode == "or":
            return held.select("resource", "value").distinct()
        tests = [F.col("token") == low if low == high else F.col("token").startswith(low) for low, high in spans]
        met = held.groupBy("resource", "value").agg(*[F.max(t).alias(f"_m{k}") for k, t in enumerate(tests)])
        return met.where(reduce(lambda a, b: a & b, [F.col(f"_m{k}") for k in range(len(tests))])).select("resource", "value")

    def phrase(self, search: str, texts: DataFrame, verified: Column) -> DataFrame:
        """Typed text in sequence: the index names the candidates, ``verified`` tests their text; texts: (resource, value, text)."""
        return self.search(search, typing=True).join(texts, ["resource", "value"]).where(verified).select("resource", "value")

    def compact(self, path: str) -> TokenIndex:
        """The current entries as one part in another folder."""
        return TokenIndex(self.spark, path, self.parts).build(self.rows())
