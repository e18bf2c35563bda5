"""Full-text search: token expressions, a token table, and search results.

A single search is a test on the text column (one scan, no shuffle). The token
table pays off when many searches run over the same texts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.operators.access import visible, with_code
from wovengraph.operators.ordering import listed
from wovengraph.session import settle

# Fixed value: what separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"
SLOTS = 128
# Fixed value: width and height of a class icon.
ICON = 32


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def terms_of(search: str) -> list[str]:
    """The tokens of typed text, cut like those of the texts."""
    return [t for t in re.split(r"[\W_]+", search.lower()) if t]


def has_terms(text: Column, terms: list[str], mode: str = "and") -> Column:
    """All terms (or any, with mode 'or') occur as tokens. No terms are found nowhere."""
    terms = [t for term in terms for t in terms_of(term)]
    if not terms:
        return F.lit(False)
    wanted = F.array(*map(F.lit, terms))
    if mode == "or":
        return F.arrays_overlap(tokens(text), wanted)
    return F.size(F.array_except(wanted, tokens(text))) == 0


def has_terms_typing(text: Column, search: str) -> Column:
    """As-you-type: all but the last term are tokens, the last begins one. Signs alone find nothing."""
    if not terms_of(search):
        return F.lit(False)
    *whole, last = terms_of(search)
    begins = F.exists(tokens(text), lambda t: t.startswith(last))
    return begins & has_terms(text, whole) if whole else begins


def has_phrase_typing(text: Column, search: str) -> Column:
    """As-you-type in sequence: the typed text occurs as it stands."""
    phrase = " ".join(search.split())
    return has_terms_typing(text, search) & F.rlike(text, F.lit("(?i)" + re.escape(phrase)))


def boolean_terms(search: str) -> tuple[list[str], list[str], list[str]]:
    """(required, excluded, optional) terms of ``+a -b c``."""
    found = [(w[0] if w[0] in "+-" else "", w) for w in search.split()]
    return tuple([t for sign, w in found if sign == s for t in terms_of(w)] for s in ("+", "-", ""))


def has_boolean(text: Column, search: str, negatives: str = "all") -> Column:
    """Required terms all occur (an unsigned term counts as required).

    Excluded terms drop a text that has them all, or any with negatives='any'.
    """
    required, excluded, plain = boolean_terms(search)
    wanted = required + plain
    if not wanted and not excluded:
        return F.lit(False)
    test = has_terms(text, wanted) if wanted else F.lit(True)
    if excluded:
        test = test & ~has_terms(text, excluded, "and" if negatives == "all" else "or")
    return test


def text_index(df: DataFrame, subject: str, text: str) -> DataFrame:
    """(token, subject); each token once per row of the input."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"), F.col(subject).alias("subject"))


def _slot(token: Column) -> Column:
    return F.pmod(F.ascii(token), F.lit(SLOTS))


def write_index(index: DataFrame, path: str) -> None:
    """Store the token table by the first character, so that searches read only their slots.

    Rows of a slot are spread over tasks by subject: a common first letter does
    not end up in one task.
    """
    spread = F.pmod(F.xxhash64("subject"), F.lit(16))
    rows = index.withColumn("slot", _slot(F.col("token")))
    rows.repartition("slot", spread).sortWithinPartitions("slot", "token").write.mode("overwrite").partitionBy("slot").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(index: DataFrame, terms: list[str], mode: str = "and", prefix_last: bool = False) -> DataFrame:
    """Subjects with the terms, from the token table (a slot column is used for pruning)."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    tests = [
        F.col("token").startswith(t) if prefix_last and i == len(terms) - 1 else F.col("token") == t for i, t in enumerate(terms)
    ]
    rows = index
    if "slot" in index.columns:
        rows = rows.where(F.col("slot").isin(sorted({ord(t[0]) % SLOTS for t in terms})))
    rows = rows.where(reduce(lambda a, b: a | b, tests))
    if mode == "or":
        return rows.select("subject").distinct()
    met = rows.groupBy("subject").agg(*[F.max(t).alias(f"_m{i}") for i, t in enumerate(tests)])
    return met.where(reduce(lambda a, b: a & b, [F.col(f"_m{i}") for i in range(len(tests))])).select("subject")


def hits(resources: DataFrame, values: DataFrame, test) -> DataFrame:
    """(resource, value) of live labels and live texts that pass; the value is null for a label.

    ``test`` maps a text column to a boolean column. Reified links are not
    values here, so they give no hits.
    """
    live = resources.where(~F.col("is_deleted"))
    by_label = live.where(test(F.col("label"))).select(F.col("iri").alias("resource"), F.lit(None).cast("string").alias("value"))
    texts = values.where((F.col("vtype") == "TextValue") & ~F.col("is_deleted") & test(F.col("as_string")))
    by_value = texts.select("resource", F.col("iri").alias("value")).join(live.select(F.col("iri").alias("resource")), "resource", "left_semi")
    return by_label.union(by_value)


def grouped_hits(found: DataFrame) -> DataFrame:
    """One row per resource with its matching values (in parts, should they be very many)."""
    rows = settle(found.select("resource", F.coalesce("value", F.lit("")).alias("value")).distinct())
    parts = listed(rows, ["resource"], ["value"], F.col("value"), "_all")
    return parts.select("resource", "part", F.array_remove("_all", "").alias("matches"))


def count_hits(found: DataFrame) -> DataFrame:
    return found.agg(F.count_distinct("resource").alias("n"))


def visible_hits(found: DataFrame, resources: DataFrame, values: DataFrame, profiles: DataFrame, user_id: str) -> DataFrame:
    """Hits whose resource the user may see, and whose value too unless the label was hit, with the ``rights`` on the resource."""
    codes = with_code(resources, profiles, user_id).where("code IS NOT NULL").select(F.col("iri").alias("resource"), F.col("code").alias("rights"))
    seen = visible(values, profiles, user_id).select(F.col("iri").alias("value"), F.lit(True).alias("_seen"))
    rows = found.join(codes, "resource").join(seen, "value", "left")
    return rows.where(F.col("value").isNull() | F.col("_seen")).select("resource", "value", "rights")


def count_before_and_after(found: DataFrame, shown: DataFrame) -> DataFrame:
    """Resources found, and those left after permissions."""
    before = found.select("resource", F.lit(False).alias("_shown"))
    rows = before.unionByName(shown.select("resource", F.lit(True).alias("_shown"))).groupBy("resource").agg(F.max("_shown").alias("_shown"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("_shown").alias("n_visible"))


def label_search(resources: DataFrame, search: str) -> DataFrame:
    live = resources.where(~F.col("is_deleted"))
    return live.where(has_terms_typing(F.col("label"), search))


def result_rows(found: DataFrame, resources: DataFrame, values: DataFrame) -> DataFrame:
    """Hits with label, then matched values by property and IRI: (resource, label, part, matches)."""
    texts = values.select(F.col("iri").alias("value"), "prop", F.col("as_string").alias("literal"))
    rows = found.join(texts, "value", "left").select(
        "resource", F.coalesce("prop", F.lit("")).alias("prop"), F.coalesce("value", F.lit("")).alias("value"), "literal"
    )
    parts = listed(settle(rows), ["resource"], ["prop", "value"], F.struct("prop", "value", "literal"), "_all")
    matches = F.filter("_all", lambda m: m["value"] != "").alias("matches")
    labelled = parts.join(resources.select(F.col("iri").alias("resource"), "label"), "resource")
    return labelled.select("resource", "label", "part", matches)


def rows_for_user(
    found: DataFrame, resources: DataFrame, values: DataFrame, previews: DataFrame, profiles: DataFrame, user_id: str, icon: int = ICON
) -> DataFrame:
    """The rows of ``result_rows`` that a user may see, with their rights on the resource and its preview.

    previews: (resource, preview, preview_x, preview_y); a resource without one has the icon's size.
    """
    shown = settle(visible_hits(found, resources, values, profiles, user_id))
    rights = shown.select("resource", "rights").distinct()
    rows = result_rows(shown.select("resource", "value"), resources, values).join(rights, "resource").join(previews, "resource", "left")
    size = lambda name: F.coalesce(name, F.lit(icon)).alias(name)
    return rows.select("resource", "label", "part", "rights", "preview", size("preview_x"), size("preview_y"), "matches")


def suggestions(found: DataFrame, values: DataFrame, gui_orders: DataFrame) -> DataFrame:
    """For matching resources: their texts by order of the property in the form, then of the value."""
    texts = values.where((F.col("vtype") == "TextValue") & ~F.col("is_deleted"))
    texts = texts.join(found.select("resource").distinct(), "resource", "left_semi").join(gui_orders, "prop", "left")
    rows = texts.select("resource", F.coalesce("gui_order", F.lit(0)).alias("gui_order"), "vorder", "iri", "as_string")
    return listed(settle(rows), ["resource"], ["gui_order", "vorder", "iri"], F.col("as_string"), "texts")
