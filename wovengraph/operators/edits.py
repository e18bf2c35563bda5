"""Versioned edits as table transforms: current tables and a batch of edits in, next tables out.

Every function is set-based: a batch may hold any number of edits. Those that
cannot be applied come back in a second table with the reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wovengraph.operators.access import CODES, with_code
from wovengraph.operators.ordering import numbered, sifted
from wovengraph.session import settle


def _anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def create_values(values: DataFrame, new: DataFrame) -> DataFrame:
    """Append values (resource, prop, iri, ...) at the next positions of their resource and property.

    Several new values of one property get consecutive positions, by IRI.
    """
    live = values.where(~F.col("is_deleted")).groupBy("resource", "prop").agg((F.max("vorder") + 1).alias("_next"))
    placed = numbered(new, ["resource", "prop"], ["iri"], "_n").join(live, ["resource", "prop"], "left")
    placed = placed.withColumn("vorder", (F.coalesce("_next", F.lit(0)) + F.col("_n") - 1).cast("int")).withColumn("is_deleted", F.lit(False))
    return values.unionByName(placed.drop("_n", "_next").select(*[c for c in values.columns if c in placed.columns]), allowMissingColumns=True)


def split_new(new: DataFrame, taken: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch whose key is free, the first of each key by ``order``; the others with a ``reason``.

    What is equal in all of ``order`` and the other columns is one row said twice; one of it is kept.
    """
    by = [*order, *[x for x in new.columns if x not in {*keys, *order}]]
    counted = new.groupBy(*new.columns).agg(F.count(F.lit(1)).alias("_copies"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(*by)).alias("_first"))
    held = taken.select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_taken")).distinct()
    same = lambda a, b: [F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in keys]
    firsts = first.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first")
    rows = counted.join(firsts, same("", "_")).drop(*[f"_{k}" for k in keys]).join(held, same("", "_"), "left").drop(*[f"_{k}" for k in keys])
    leads = F.struct(*by).eqNullSafe(F.col("_first"))
    rows = settle(rows.select(*new.columns, "_copies", F.coalesce("_taken", F.lit(False)).alias("_taken"), leads.alias("_leads")))
    lost = rows.withColumn("reason", F.when(F.col("_taken"), "exists").otherwise("repeated in the batch"))
    again = F.col("_copies") - F.when(F.col("_leads") & ~F.col("_taken"), 1).otherwise(0)
    lost = lost.withColumn("_each", F.explode(F.when(again > 0, F.sequence(F.lit(1).cast("long"), again)).otherwise(F.array().cast("array<bigint>"))))
    return rows.where("_leads AND NOT _taken").select(*new.columns), lost.select(*new.columns, "reason")


# What a value of each type says, as text.
def value_text() -> Column:
    numbers = [F.col(x).cast("string") for x in ("as_int", "as_decimal", "as_boolean")]
    days = F.when(F.col("start_jdn").isNotNull(), F.concat_ws(":", F.col("start_jdn"), F.col("end_jdn"), F.col("prec")))
    return F.coalesce("as_string", *numbers, "as_uri", "as_node", days)


def replay_values(
    values: DataFrame, resources: DataFrame, new: DataFrame, types: DataFrame, cardinalities: DataFrame, profiles: DataFrame, user_id: str
) -> tuple[DataFrame, DataFrame]:
    """Create values (seq, resource, prop, vtype, iri, literals) as if one after the other by ``seq``: (values, rejected).

    types: (prop, vtype); cardinalities: (cls, prop, card), inherited ones included. The
    first of these that holds is the reason a request is rejected for: unknown resource,
    deleted resource, unknown property, wrong type, no right (less than M on the resource),
    IRI exists, same value (a live one, or one accepted before in the batch), no more
    values allowed. Those of a resource and property are folded in order: the first
    request for each literal takes a place as long as there is one, and later ones
    see what was accepted. ``seq`` is unique. Accepted values get the next positions.
    """
    key = ["resource", "prop"]
    own = with_code(resources, profiles, user_id).select(F.col("iri").alias("resource"), "cls", F.col("is_deleted").alias("_gone"), F.col("code").alias("_code"))
    cards = cardinalities.select("cls", "prop", F.lit(True).alias("_known"), F.col("card").isin("1", "0-1").alias("_one"))
    rows = new.where("iri IS NOT NULL").withColumn("_text", value_text()).join(own, "resource", "left").join(cards, ["cls", "prop"], "left")
    rows = rows.join(types.select("prop", F.col("vtype").alias("_vtype")), "prop", "left")
    told = (
        F.when(F.col("_gone").isNull(), "unknown resource")
        .when(F.col("_gone"), "deleted resource")
        .when(F.col("_known").isNull(), "unknown property")
        .when(~F.col("vtype").eqNullSafe(F.col("_vtype")), "wrong type")
        .when(F.coalesce(F.col("_code") < CODES["M"], F.lit(True)), "no right")
    )
    # Only requests that their resource admits are held against values, and only against those that one of them may name.
    rows = settle(rows.select(*new.columns, "_text", "_one", told.alias("reason")))
    firsts = rows.groupBy("iri").agg(F.min("seq").alias("_seq"))
    admitted = rows.where("reason IS NULL").drop("reason")
    live = sifted(values.where(~F.col("is_deleted")), admitted, key)
    held = live.groupBy(*key).agg(F.count(F.lit(1)).alias("_live"), (F.max("vorder") + 1).alias("_next"))
    same = live.select(*key, value_text().alias("_text"), F.lit(True).alias("_same")).distinct()
    names = sifted(values.select("iri"), admitted, ["iri"]).select("iri", F.lit(True).alias("_named")).distinct()
    tried = admitted.join(names, "iri", "left").join(firsts, "iri").join(held, key, "left").join(same, [*key, "_text"], "left")
    known = F.when(F.col("_named").isNotNull() | (F.col("seq") != F.col("_seq")), "IRI exists").when(F.col("_same").isNotNull(), "same value")
    tried = settle(tried.select(*admitted.columns, "_live", "_next", known.alias("reason")))
    open_ = tried.where("reason IS NULL")
    # In order, a literal's first request decides: those after it are the same value, or as late as it was.
    leads = open_.groupBy(*key, "_text").agg(F.min("seq").alias("seq"), F.first("_one").alias("_one"), F.first("_live").alias("_live"))
    room = F.when(F.col("_one"), F.greatest(F.lit(0), 1 - F.coalesce("_live", F.lit(0))))
    placed = settle(numbered(leads, key, ["seq"], "_n").withColumn("_in", F.coalesce(F.col("_n") <= room, F.lit(True))))
    judged = open_.drop("reason").join(placed.select(*key, "_text", F.col("seq").alias("_lead"), "_in", "_n"), [*key, "_text"])
    late = F.when(~F.col("_in"), "no more values allowed").when(F.col("seq") != F.col("_lead"), "same value")
    judged = settle(judged.withColumn("reason", late))
    vorder = (F.coalesce("_next", F.lit(0)) + F.col("_n") - 1).cast("int")
    good = judged.where("reason IS NULL").withColumns({"vorder": vorder, "is_deleted": F.lit(False)})
    fresh = good.select(*[x for x in values.columns if x in good.columns])
    rejected = reduce(DataFrame.union, [x.where("reason IS NOT NULL").select("seq", "iri", "reason") for x in (rows, tried, judged)])
    return values.unionByName(fresh, allowMissingColumns=True), rejected


def new_versions(values: DataFrame, edits: DataFrame, literal: str) -> tuple[DataFrame, DataFrame]:
    """Replace current values by new versions.

    values: current values with a ``prev_value`` column and ``is_current``;
    edits: (iri, new_iri, <literal>). A new version takes over everything else.
    Edits of unknown, deleted or outdated values, edits that change nothing and
    all but the first (by new IRI) of several edits of one value are rejected:
    (iri, new_iri, reason).
    """
    first = edits.groupBy("iri").agg(F.min("new_iri").alias("_first"))
    edits = edits.join(first, "iri")
    incoming = edits.select("iri", "new_iri", "_first", F.col(literal).alias("_new"))
    known = values.select("iri", "is_current", "is_deleted", F.col(literal).alias("_now"))
    judged = incoming.join(known, "iri", "left").withColumn(
        "reason",
        F.when(F.col("is_current").isNull(), "unknown value")
        .when(~F.col("is_current"), "not the current version")
        .when(F.col("is_deleted"), "deleted")
        .when(F.col("_new").eqNullSafe(F.col("_now")), "no change")
        .when(F.col("new_iri") != F.col("_first"), "edited twice"),
    )
    good = judged.where("reason IS NULL").select("iri", "new_iri", "_new")
    joined = values.join(good, "iri", "left")
    old = joined.withColumn("is_current", F.col("is_current") & F.col("new_iri").isNull()).select(*values.columns)
    fresh = joined.where("new_iri IS NOT NULL")
    fresh = fresh.withColumns({"prev_value": F.col("iri"), "iri": F.col("new_iri"), literal: F.col("_new")}).select(*values.columns)
    return old.unionByName(fresh), judged.where("reason IS NOT NULL").select("iri", "new_iri", "reason")


def soft_delete(rows: DataFrame, deletions: DataFrame, key: str = "iri") -> DataFrame:
    """Mark rows deleted, with date and comment: deletions (key, delete_date, delete_comment).

    A key given several times takes the earliest date. Rows that were deleted
    before keep their date and comment, so the result can be fed on.
    """
    added = [c for c in ("delete_date", "delete_comment") if c not in rows.columns]
    mark = F.min(F.struct(F.col("delete_date").alias("_date"), F.col("delete_comment").alias("_comment")))
    marks = deletions.groupBy(key).agg(mark.alias("_mark"))
    rows_then = rows.withColumns({c: F.lit(None).cast(deletions.schema[c].dataType) for c in added}) if added else rows
    hit = F.col("_mark").isNotNull() & ~F.col("is_deleted")
    return rows_then.join(marks, key, "left").withColumns(
        {
            "delete_date": F.when(hit, F.col("_mark._date")).otherwise(F.col("delete_date")),
            "delete_comment": F.when(hit, F.col("_mark._comment")).otherwise(F.col("delete_comment")),
            "is_deleted": F.col("is_deleted") | F.col("_mark").isNotNull(),
        }
    ).select(*rows.columns, *added)


def create_links(links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add links (link_value, src, prop, dst, ...) with count 1; links that exist or are repeated are rejected with a reason."""
    fresh, rejected = split_new(new, links.where(~F.col("is_deleted")), ["src", "prop", "dst"], ["link_value"])
    fresh = fresh.withColumns({"ref_count": F.lit(1).cast("long"), "is_deleted": F.lit(False)})
    return links.unionByName(fresh, allowMissingColumns=True), rejected


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """The link value stays, with count 0, marked deleted; gone: (link_value)."""
    hit = F.coalesce("_hit", F.lit(False))
    joined = links.join(gone.select("link_value", F.lit(True).alias("_hit")).distinct(), "link_value", "left")
    return joined.withColumns(
        {"ref_count": F.when(hit, F.lit(0)).otherwise(F.col("ref_count")).cast("long"), "is_deleted": F.col("is_deleted") | hit}
    ).select(*links.columns)


def change_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Point links at new targets: the old one is closed, a new one opened with count 1.

    changes: (link_value, new_link_value, new_dst).
    """
    changes = changes.groupBy("link_value").agg(F.min(F.struct("new_link_value", "new_dst")).alias("_new")).select("link_value", "_new.*")
    moved = links.where(~F.col("is_deleted")).join(changes, "link_value")
    fresh = moved.withColumns(
        {"link_value": F.col("new_link_value"), "dst": F.col("new_dst"), "ref_count": F.lit(1).cast("long")}
    ).select(*links.columns)
    return delete_links(links, changes.select("link_value")).unionByName(fresh)


def reference_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Targets a text gains (+1) and loses (-1) by an edit; both (src, dst)."""
    gained = after.distinct().join(before, ["src", "dst"], "left_anti").select("src", "dst", F.lit(1).alias("delta"))
    lost = before.distinct().join(after, ["src", "dst"], "left_anti").select("src", "dst", F.lit(-1).alias("delta"))
    return gained.union(lost)


def apply_reference_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """New counts per (src, dst): (ref_count, change). 'insert' at first use, 'remove' at zero.

    Deltas are added up before they meet the table.
    """
    sums = deltas.groupBy("src", "dst").agg(F.sum("delta").alias("_delta"))
    joined = counts.select("src", "dst", "ref_count").join(sums, ["src", "dst"], "full")
    old, new = F.coalesce("ref_count", F.lit(0)), F.coalesce("ref_count", F.lit(0)) + F.coalesce("_delta", F.lit(0))
    change = F.when((old == 0) & (new > 0), "insert").when((old > 0) & (new <= 0), "remove").otherwise("keep")
    return joined.select("src", "dst", F.greatest(new, F.lit(0)).cast("long").alias("ref_count"), change.alias("change"))


def change_labels(resources: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (iri, label, modified); of several for a resource the last counts."""
    last = F.max(F.struct(F.col("modified").alias("_modified"), F.col("label").alias("_label")))
    new = edits.groupBy("iri").agg(last.alias("_new")).select("iri", "_new.*")
    joined = resources.join(new, "iri", "left")
    return joined.withColumns(
        {"label": F.coalesce("_label", "label"), "modified": F.coalesce("_modified", "modified")}
    ).select(*resources.columns)


def check_unchanged(edits: DataFrame, state: DataFrame, key: str = "iri") -> tuple[DataFrame, DataFrame]:
    """Split edits by whether the state still has the modification date they expect (``expected``)."""
    now = state.select(key, F.col("modified").alias("_modified"), F.lit(True).alias("_known"))
    judged = edits.join(now, key, "left")
    good = F.coalesce(F.col("_known") & F.col("expected").eqNullSafe(F.col("_modified")), F.lit(False))
    return judged.where(good).select(*edits.columns), judged.where(~good).select(*edits.columns)


def delete_unused(entities: DataFrame, deletions: DataFrame, uses: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Delete entities no statement refers to; uses: (key). The others are rejected."""
    unused = _anti(deletions.select(key), uses, [key])
    return _anti(entities, unused, [key]), deletions.select(key).join(uses.select(key), key, "left_semi")


def create_absent(entities: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Add entities whose key is free, each once; the others are rejected with a reason. Of several the least row counts."""
    fresh, rejected = split_new(new, entities, [key], [])
    return entities.unionByName(fresh), rejected


def add_cardinalities(cardinalities: DataFrame, new: DataFrame) -> DataFrame:
    """Cardinalities of classes that have none for the property; of several for one the least row counts."""
    return cardinalities.unionByName(split_new(new, cardinalities, ["cls", "prop"], [])[0])


def replace_cardinalities(cardinalities: DataFrame, new: DataFrame) -> DataFrame:
    """All cardinalities of the classes in ``new`` are replaced."""
    return _anti(cardinalities, new, ["cls"]).unionByName(new)


def upsert_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Map entries (map, key, value): new ones win. The batch's last write (``seq``) counts."""
    last = new.groupBy("map", "key").agg(F.max_by("value", "seq").alias("_value"))
    joined = entries.join(last, ["map", "key"], "full")
    return joined.select("map", "key", F.coalesce("_value", "value").alias("value"))


def delete_entries(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """gone: (map, key), or (map) for whole maps."""
    return entries.join(gone, gone.columns, "left_anti")


def replace_qualities(files: DataFrame, edits: DataFrame) -> DataFrame:
    """New versions of a resource's files, matched by quality; files: (resource, quality, iri, file, is_current, prev_value).

    Of several edits of one quality the first by IRI counts.
    """
    new = edits.groupBy("resource", "quality").agg(F.min(F.struct(F.col("iri").alias("_iri"), F.col("file").alias("_file"))).alias("_new"))
    new = new.select("resource", "quality", "_new.*")
    joined = files.join(new, ["resource", "quality"], "left")
    superseded = F.col("_iri").isNotNull() & F.col("is_current")
    old = joined.withColumn("is_current", F.col("is_current") & ~superseded).select(*files.columns)
    fresh = joined.where(superseded).withColumns({"prev_value": F.col("iri"), "iri": F.col("_iri"), "file": F.col("_file")})
    return old.unionByName(fresh.select(*files.columns))


def replace_texts(texts: DataFrame, new: DataFrame) -> DataFrame:
    """Labels or comments by language: (entity, pred, lang, text). What is given replaces all languages of its entity and predicate."""
    return _anti(texts, new, ["entity", "pred"]).unionByName(new)


def with_link_value_properties(props: DataFrame, link_props: DataFrame, value_base: str, value_class: str) -> DataFrame:
    """Add the link-value property of every link property; props: (prop, base, object_class)."""
    derived = props.join(link_props, "prop", "left_semi").select(
        F.concat("prop", F.lit("Value")).alias("prop"), F.lit(value_base).alias("base"), F.lit(value_class).alias("object_class")
    )
    return props.unionByName(derived)


def mapping_rows(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nested mark-up mappings, and elements defined twice.

    mappings: (mapping, elements array<struct<namespace, tag, css_class, cls, attributes array<struct<name, prop>>>>).
    """
    element = mappings.select("mapping", F.inline("elements"))
    rows = element.select(
        "mapping", "namespace", "tag", "css_class", "cls", F.inline_outer("attributes").alias("name", "prop")
    )
    twice = element.groupBy("mapping", "namespace", "tag", "css_class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows, twice


def not_written(edits: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Edits whose rows are not in the new state."""
    return edits.join(state.select(*keys), keys, "left_anti")


