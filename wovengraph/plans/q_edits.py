"""Edit queries: batches derived from the keys of the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import access, edits
from wovengraph.plans import fixture
from wovengraph.plans.q_hierarchy import INHERITED_SQL, _inherited
from wovengraph.plans.registry import query
from wovengraph.session import settle

c = F.col
FIX = fixture.FIXTURES
FIX["inherited"] = INHERITED_SQL
FIX["part_names"] = (
    "SELECT 'n/' || CAST(p_partkey AS STRING) AS iri, 'part/' || CAST(p_partkey AS STRING) AS resource, p_partkey AS k, p_name AS body, "
    "CAST(NULL AS STRING) AS prev_value, p_partkey % 11 <> 0 AS is_current, p_partkey % 13 = 0 AS is_deleted, '' AS comment FROM part"
)
FIX["entries"] = (
    "SELECT map, key, arg_max(value, event_id) AS value FROM map_entries WHERE event_id % 2 = 0 GROUP BY map, key"
)


def _text(kind, key):
    return F.concat(F.lit(kind), key.cast("string"))


def _entries(g):
    rows = g.map_entries.where("event_id % 2 = 0")
    return rows.groupBy("map", "key").agg(F.max_by("value", "event_id").alias("value"))


@query(
    "e01_create_values",
    """SELECT resource, prop, iri, vorder FROM vals UNION ALL SELECT q.resource, q.prop, q.iri, CAST(coalesce(m.top + 1, 0) + q.n - 1 AS INT) FROM
    (SELECT resource, 'hasName' AS prop, resource || '/new/' || CAST(i AS STRING) AS iri, row_number() OVER (PARTITION BY resource ORDER BY i) AS n FROM
    (SELECT 'part/' || CAST(p_partkey AS STRING) AS resource, unnest(range(p_partkey % 3)) AS i FROM part)) q
    LEFT JOIN (SELECT resource, prop, max(vorder) AS top FROM vals WHERE NOT is_deleted GROUP BY resource, prop) m ON m.resource = q.resource AND m.prop = q.prop""",
)
def _(g):
    part = _text("part/", c("p_partkey"))
    count = F.when(c("p_partkey") % 3 > 0, F.sequence(F.lit(0).cast("long"), c("p_partkey") % 3 - 1))
    new = g.part.select(part.alias("resource"), F.explode(count).alias("i"))
    new = new.select("resource", F.lit("hasName").alias("prop"), F.concat_ws("/new/", "resource", c("i").cast("string")).alias("iri"))
    return edits.create_values(g.vals, new).select("resource", "prop", "iri", "vorder")


# Requests by a project member: new names, brands and sizes of parts and orders, some of them wrong in one way or another.
FIX["value_requests"] = """SELECT CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS seq, CASE WHEN l_orderkey % 19 = 0 THEN 'part/none' WHEN l_orderkey % 17 = 0 THEN 'order/' || CAST(l_orderkey AS STRING)
    ELSE 'part/' || CAST(l_partkey AS STRING) END AS resource, CASE WHEN l_orderkey % 17 = 0 THEN 'isFulfilled' WHEN l_linenumber % 3 = 0 THEN 'hasBrand' WHEN l_linenumber = 7 THEN 'hasDate' WHEN l_linenumber % 3 = 1 THEN 'hasName' ELSE 'hasSize' END AS prop,
    CASE WHEN l_orderkey % 17 = 0 THEN 'BooleanValue' WHEN l_orderkey % 13 = 0 THEN 'UriValue' WHEN l_linenumber % 3 = 2 THEN 'IntValue' ELSE 'TextValue' END AS vtype,
    'w/' || CAST(CASE WHEN l_orderkey % 11 = 0 THEN l_orderkey ELSE l_orderkey * 100 + l_linenumber END AS STRING) AS iri,
    CASE WHEN l_orderkey % 17 <> 0 AND (l_linenumber % 3 <> 2) THEN 'Brand#' || CAST(l_suppkey % 5 AS STRING) END AS as_string,
    CAST(CASE WHEN l_orderkey % 17 <> 0 AND l_linenumber % 3 = 2 THEN l_suppkey % 5 END AS INT) AS as_int, CASE WHEN l_orderkey % 17 = 0 THEN l_linenumber % 2 = 0 END AS as_boolean
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""
# Parts lose their size first, so that there is room for one.
FIX["vals_before"] = "SELECT iri, resource, prop, vtype, vorder, as_string, as_int, as_decimal, as_boolean, as_uri, as_node, start_jdn, end_jdn, prec, is_deleted OR (prop = 'hasSize' AND vorder <> 1) AS is_deleted FROM vals"
_VALUE_TEXT = "coalesce({t}.as_string, CAST({t}.as_int AS STRING), CAST({t}.as_boolean AS STRING))"


def _replay_sql(requests, before):
    return f"""judged AS (SELECT q.*, {_VALUE_TEXT.format(t='q')} AS txt, i.card IN ('1', '0-1') AS one, coalesce(h.live, 0) AS live, coalesce(h.top + 1, 0) AS nxt,
    CASE WHEN r.iri IS NULL THEN 'unknown resource' WHEN r.is_deleted THEN 'deleted resource' WHEN i.cls IS NULL THEN 'unknown property'
    WHEN d.object_class IS NULL OR d.object_class <> q.vtype THEN 'wrong type' WHEN s.code IS NULL OR s.code < 6 THEN 'no right'
    WHEN EXISTS (SELECT 1 FROM {before} v WHERE v.iri = q.iri) OR q.seq <> min(q.seq) OVER (PARTITION BY q.iri) THEN 'IRI exists'
    WHEN EXISTS (SELECT 1 FROM {before} v WHERE v.resource = q.resource AND v.prop = q.prop AND NOT v.is_deleted AND {_VALUE_TEXT.format(t='v')} = {_VALUE_TEXT.format(t='q')}) THEN 'same value' END AS why
    FROM {requests} q LEFT JOIN resources r ON r.iri = q.resource LEFT JOIN inherited i ON i.cls = r.cls AND i.prop = q.prop LEFT JOIN prop_constraints d ON d.prop = q.prop
    LEFT JOIN subject_codes s ON s.iri = q.resource AND s.user_id = 'user/4'
    LEFT JOIN (SELECT resource, prop, count(*) AS live, max(vorder) AS top FROM {before} WHERE NOT is_deleted GROUP BY resource, prop) h ON h.resource = q.resource AND h.prop = q.prop),
    ledd AS (SELECT *, min(seq) OVER (PARTITION BY resource, prop, txt) AS lead FROM judged WHERE why IS NULL),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY resource, prop ORDER BY lead) AS n FROM ledd),
    folded AS (SELECT *, CASE WHEN one AND n > greatest(0, 1 - live) THEN 'no more values allowed' WHEN seq <> lead THEN 'same value' END AS late FROM ranked)"""


def _replayed(g, batches):
    profiles = access.user_profiles(g.users, g.memberships, g.admin_rights)
    types, cards, state = g.prop_constraints.select("prop", c("object_class").alias("vtype")), settle(_inherited(g)), g.vals_before
    extra = {x: F.lit(None).cast(t) for x, t in (("as_decimal", "decimal(18,2)"), ("as_uri", "string"), ("as_node", "string"), ("start_jdn", "int"), ("end_jdn", "int"), ("prec", "string"))}
    for test in batches:
        # What a batch adds is written; the values before it are read where they lie.
        state, rejected = edits.replay_values(state, g.resources, g.value_requests.where(test).withColumns(extra), types, cards, profiles, "user/4")
    return state, rejected


@query("e01_rejected_values", f"WITH {_replay_sql('value_requests', 'vals_before')} SELECT seq, iri, why AS reason FROM judged WHERE why IS NOT NULL UNION ALL SELECT seq, iri, late FROM folded WHERE late IS NOT NULL")
def _(g):
    return _replayed(g, ["true"])[1]


_FIRST = _replay_sql("(SELECT * FROM value_requests WHERE seq % 2 = 0)", "vals_before")
_SECOND = _replay_sql("(SELECT * FROM value_requests WHERE seq % 2 = 1)", "after_one").replace("judged", "judged2").replace("ledd", "ledd2").replace("ranked", "ranked2").replace("folded", "folded2")


@query(
    "e01_two_batches",
    f"""WITH {_FIRST}, after_one AS (SELECT iri, resource, prop, vorder, as_string, as_int, as_boolean, is_deleted FROM vals_before UNION ALL
    SELECT iri, resource, prop, CAST(nxt + n - 1 AS INT), as_string, as_int, as_boolean, FALSE FROM folded WHERE late IS NULL), {_SECOND}
    SELECT iri, resource, prop, vorder FROM after_one WHERE iri LIKE 'w/%' UNION ALL SELECT iri, resource, prop, CAST(nxt + n - 1 AS INT) FROM folded2 WHERE late IS NULL""",
)
def _(g):
    state, _ = _replayed(g, ["seq % 2 = 0", "seq % 2 = 1"])
    return state.where("iri LIKE 'w/%'").select("iri", "resource", "prop", "vorder")


_AGAIN = "(SELECT l_partkey AS id, CAST(l_quantity AS INT) AS name FROM lineitem UNION ALL SELECT -l_orderkey, l_linenumber FROM lineitem)"


@query(
    "e12_rejected_repeats",
    f"""SELECT id, name, CASE WHEN p.p_partkey IS NOT NULL THEN 'exists' ELSE 'repeated in the batch' END AS reason FROM
    (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name) AS rn FROM {_AGAIN} a) q LEFT JOIN part p ON p.p_partkey = q.id WHERE p.p_partkey IS NOT NULL OR rn > 1""",
)
def _(g):
    state = g.part.select(c("p_partkey").alias("id"), c("p_size").cast("int").alias("name"))
    new = g.lineitem.select(c("l_partkey").alias("id"), c("l_quantity").cast("int").alias("name")).union(g.lineitem.select(-c("l_orderkey"), "l_linenumber"))
    return edits.create_absent(state, new, "id")[1]


_NAME_EDITS = """(SELECT 'n/' || CAST(p_partkey AS STRING) AS iri, 'n2/' || CAST(p_partkey AS STRING) AS new_iri,
    CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE upper(p_name) END AS body FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'n/x' || CAST(p_partkey AS STRING), 'n2/x', 'y' FROM part WHERE p_partkey % 100 = 1)"""


def _name_edits(g):
    body = F.when(c("p_partkey") % 5 == 0, c("p_name")).otherwise(F.upper("p_name"))
    real = g.part.where("p_partkey % 2 = 0").select(_text("n/", c("p_partkey")).alias("iri"), _text("n2/", c("p_partkey")).alias("new_iri"), body.alias("body"))
    return real.union(g.part.where("p_partkey % 100 = 1").select(_text("n/x", c("p_partkey")), F.lit("n2/x"), F.lit("y")))


@query(
    "e02_new_versions",
    f"""WITH e AS (SELECT e.*, v.k FROM {_NAME_EDITS} e JOIN part_names v ON v.iri = e.iri WHERE v.is_current AND NOT v.is_deleted AND v.body <> e.body)
    SELECT v.iri, v.body, v.prev_value, v.is_current AND e.iri IS NULL AS is_current FROM part_names v LEFT JOIN e ON e.iri = v.iri
    UNION ALL SELECT e.new_iri, e.body, e.iri, TRUE FROM e""",
)
def _(g):
    state, _ = edits.new_versions(g.part_names, _name_edits(g), "body")
    return state.select("iri", "body", "prev_value", "is_current")


@query(
    "e02_rejected_versions",
    f"""SELECT e.iri, e.new_iri, CASE WHEN v.iri IS NULL THEN 'unknown value' WHEN NOT v.is_current THEN 'not the current version' WHEN v.is_deleted THEN 'deleted' ELSE 'no change' END AS reason
    FROM {_NAME_EDITS} e LEFT JOIN part_names v ON v.iri = e.iri WHERE v.iri IS NULL OR NOT v.is_current OR v.is_deleted OR v.body = e.body""",
)
def _(g):
    return edits.new_versions(g.part_names, _name_edits(g), "body")[1]


@query(
    "e03_delete_values",
    """SELECT iri, is_deleted OR (prop = 'hasSize' AND vorder = 1) AS is_deleted, CASE WHEN prop = 'hasSize' AND vorder = 1 THEN '2020-01-01' END AS delete_date,
    CASE WHEN prop = 'hasSize' AND vorder = 1 THEN 'wrong' END AS delete_comment FROM vals""",
)
def _(g):
    gone = g.vals.where("prop = 'hasSize' AND vorder = 1").select("iri", F.lit("2020-01-01").alias("delete_date"), F.lit("wrong").alias("delete_comment"))
    return edits.soft_delete(g.vals, gone).select("iri", "is_deleted", "delete_date", "delete_comment")


@query(
    "e04_delete_resources",
    "SELECT iri, is_deleted OR cls LIKE 'Text/%' AS is_deleted, CASE WHEN cls LIKE 'Text/%' THEN '2020-01-02' END AS delete_date FROM resources",
)
def _(g):
    gone = g.resources.where(c("cls").startswith("Text/")).select("iri", F.lit("2020-01-02").alias("delete_date"), F.lit("").alias("delete_comment"))
    return edits.soft_delete(g.resources, gone).select("iri", "is_deleted", "delete_date")


_NEW_LINKS = "(SELECT 'new/' || link_value AS link_value, src, prop, CASE WHEN ref_count = 1 THEN dst ELSE dst || 'x' END AS dst FROM links WHERE prop = 'cites')"


@query(
    "e05_create_links",
    f"""SELECT link_value, src, dst, ref_count, is_deleted FROM links UNION ALL SELECT n.link_value, n.src, n.dst, 1, FALSE FROM {_NEW_LINKS} n
    WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.src = n.src AND l.prop = n.prop AND l.dst = n.dst AND NOT l.is_deleted)""",
)
def _(g):
    dst = F.when(c("ref_count") == 1, c("dst")).otherwise(F.concat("dst", F.lit("x")))
    new = g.links.where("prop = 'cites'").select(F.concat(F.lit("new/"), "link_value").alias("link_value"), "src", "prop", dst.alias("dst"))
    return edits.create_links(g.links, new)[0].select("link_value", "src", "dst", "ref_count", "is_deleted")


@query(
    "e05_delete_links",
    """SELECT link_value, CASE WHEN prop = 'cites' AND ref_count = 2 THEN 0 ELSE ref_count END AS ref_count, is_deleted OR (prop = 'cites' AND ref_count = 2) AS is_deleted FROM links""",
)
def _(g):
    return edits.delete_links(g.links, g.links.where("prop = 'cites' AND ref_count = 2").select("link_value")).select("link_value", "ref_count", "is_deleted")


@query(
    "e05_change_links",
    """SELECT link_value, dst, CASE WHEN prop = 'placedBy' THEN 0 ELSE ref_count END AS ref_count, is_deleted OR prop = 'placedBy' AS is_deleted FROM links
    UNION ALL SELECT link_value || '/2', 'customer/0', 1, FALSE FROM links WHERE prop = 'placedBy' AND NOT is_deleted""",
)
def _(g):
    changes = g.links.where("prop = 'placedBy'").select("link_value", F.concat("link_value", F.lit("/2")).alias("new_link_value"), F.lit("customer/0").alias("new_dst"))
    return edits.change_links(g.links, changes).select("link_value", "dst", "ref_count", "is_deleted")


# A text's references before and after an edit: shipped parts of an order, by flag.
_BEFORE = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R')"
_AFTER = "(SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'A')"
_DELTAS = f"(SELECT src, dst, 1 AS delta FROM (SELECT * FROM {_AFTER} EXCEPT SELECT * FROM {_BEFORE}) UNION ALL SELECT src, dst, -1 FROM (SELECT * FROM {_BEFORE} EXCEPT SELECT * FROM {_AFTER}))"


def _deltas(g):
    pairs = lambda flag: g.lineitem.where(c("l_returnflag") != flag).select(c("l_orderkey").alias("src"), c("l_partkey").alias("dst"))
    return edits.reference_deltas(pairs("R"), pairs("A"))


@query("e07_reference_deltas", f"SELECT * FROM {_DELTAS}")
def _(g):
    return _deltas(g)


@query(
    "e06_reference_counts",
    f"""SELECT src, dst, greatest(n + d, 0) AS ref_count, CASE WHEN n = 0 AND n + d > 0 THEN 'insert' WHEN n > 0 AND n + d <= 0 THEN 'remove' ELSE 'keep' END AS change FROM
    (SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.n, 0) AS n, coalesce(b.d, 0) AS d FROM
    (SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2) a
    FULL JOIN (SELECT src, dst, CAST(sum(delta) AS BIGINT) AS d FROM {_DELTAS} GROUP BY src, dst) b ON a.src = b.src AND a.dst = b.dst)""",
)
def _(g):
    counts = g.lineitem.where("l_returnflag <> 'R'").groupBy(c("l_orderkey").alias("src"), c("l_partkey").alias("dst")).agg(F.count(F.lit(1)).alias("ref_count"))
    return edits.apply_reference_counts(counts, _deltas(g))


@query(
    "e08_change_comments",
    """SELECT iri, comment, is_current AND (is_deleted OR k % 3 <> 0) AS is_current FROM part_names
    UNION ALL SELECT 'c2/' || CAST(k AS STRING), 'seen', TRUE FROM part_names WHERE k % 3 = 0 AND is_current AND NOT is_deleted""",
)
def _(g):
    new = g.part_names.where("k % 3 = 0").select("iri", _text("c2/", c("k")).alias("new_iri"), F.lit("seen").alias("comment"))
    return edits.new_versions(g.part_names, new, "comment")[0].select("iri", "comment", "is_current")


@query(
    "e09_change_labels",
    """SELECT iri, CASE WHEN cls = 'Supplier' THEN 'S ' || label ELSE label END AS label, CASE WHEN cls = 'Supplier' THEN '2020-02-02' ELSE '2019-01-01' END AS modified FROM resources""",
)
def _(g):
    state = g.resources.withColumn("modified", F.lit("2019-01-01"))
    new = g.resources.where("cls = 'Supplier'").select("iri", F.concat(F.lit("S "), "label").alias("label"), F.lit("2020-02-02").alias("modified"))
    return edits.change_labels(state, new).select("iri", "label", "modified")


@query("e10_unchanged_only", "SELECT iri, TRUE AS applied FROM (SELECT o_orderkey AS iri FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P') UNION ALL "
       "SELECT o_orderkey, FALSE FROM orders WHERE o_orderkey % 2 <> 0 OR o_orderstatus = 'P'")
def _(g):
    batch = g.orders.select(c("o_orderkey").alias("iri"), F.when(c("o_orderkey") % 2 == 0, "a").otherwise("b").alias("expected"))
    state = g.orders.where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("iri"), F.lit("a").alias("modified"))
    good, stale = edits.check_unchanged(batch, state)
    return good.select("iri", F.lit(True).alias("applied")).union(stale.select("iri", F.lit(False)))


@query("e11_delete_unused", "SELECT p_partkey, p_name FROM part WHERE p_size < 40 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(g):
    entities = g.part.select("p_partkey", "p_name")
    uses = g.lineitem.where("l_quantity > 45").select(c("l_partkey").alias("p_partkey"))
    return edits.delete_unused(entities, g.part.where("p_size >= 40"), uses, "p_partkey")[0]


@query("e12_create_absent", "SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)")
def _(g):
    state = g.part.select(c("p_partkey").alias("id"), c("p_name").alias("name"))
    return edits.create_absent(state, g.orders.select(c("o_orderkey").alias("id"), F.lit("order").alias("name")), "id")[0]


_CLASS_CARDS = "(SELECT DISTINCT cls, prop, '0-n' AS card, 9 AS gui_order FROM (SELECT r.cls, v.prop FROM resources r JOIN vals v ON v.resource = r.iri) q)"


def _class_cards(g):
    held = g.vals.select(c("resource").alias("iri"), "prop").join(g.resources.select("iri", "cls"), "iri")
    return held.select("cls", "prop").distinct().withColumns({"card": F.lit("0-n"), "gui_order": F.lit(9)})


@query(
    "e13_add_cardinalities",
    f"SELECT cls, prop, card FROM cardinalities UNION ALL SELECT cls, prop, card FROM {_CLASS_CARDS} n WHERE NOT EXISTS (SELECT 1 FROM cardinalities c WHERE c.cls = n.cls AND c.prop = n.prop)",
)
def _(g):
    return edits.add_cardinalities(g.cardinalities, _class_cards(g)).select("cls", "prop", "card")


@query(
    "e13_replace_cardinalities",
    f"SELECT cls, prop, card FROM cardinalities WHERE cls NOT IN (SELECT cls FROM {_CLASS_CARDS} m) UNION ALL SELECT cls, prop, card FROM {_CLASS_CARDS} n",
)
def _(g):
    return edits.replace_cardinalities(g.cardinalities, _class_cards(g)).select("cls", "prop", "card")


@query(
    "e14_upsert_entries",
    """SELECT coalesce(n.map, e.map) AS map, coalesce(n.key, e.key) AS key, coalesce(n.value, e.value) AS value FROM
    (SELECT map, key, arg_max(value, event_id) AS value FROM map_entries WHERE event_id % 2 = 0 GROUP BY map, key) e
    FULL JOIN (SELECT map, key, arg_max(value, event_id) AS value FROM map_entries WHERE event_id % 2 = 1 GROUP BY map, key) n ON n.map = e.map AND n.key = e.key""",
)
def _(g):
    new = g.map_entries.where("event_id % 2 = 1").select("map", "key", "value", c("event_id").alias("seq"))
    return edits.upsert_entries(_entries(g), new)


@query("e14_delete_entries", "SELECT map, key, value FROM entries e WHERE NOT EXISTS (SELECT 1 FROM map_entries m WHERE m.map = e.map AND m.key = e.key AND m.event_id % 2 = 1)")
def _(g):
    return edits.delete_entries(_entries(g), g.map_entries.where("event_id % 2 = 1").select("map", "key"))


@query("e14_delete_maps", "SELECT map, key, value FROM entries WHERE map NOT IN (SELECT map FROM map_entries WHERE event_id % 100 = 1)")
def _(g):
    return edits.delete_entries(_entries(g), g.map_entries.where("event_id % 100 = 1").select("map"))


@query("e14_read_map", "SELECT key, value FROM entries WHERE map = 'user/7'")
def _(g):
    return _entries(g).where("map = 'user/7'").select("key", "value")


@query(
    "e15_replace_qualities",
    """WITH f AS (SELECT page_id, q, 'f/' || CAST(page_id AS STRING) || '/' || q AS iri FROM pages, (VALUES ('full'), ('thumb')) AS z(q))
    SELECT iri, q || '.jp2' AS file, NOT (q = 'thumb' AND page_id % 2 = 0) AS is_current, NULL AS prev_value FROM f UNION ALL
    SELECT iri || '/2', 'new.jp2', TRUE, iri FROM f WHERE q = 'thumb' AND page_id % 2 = 0""",
)
def _(g):
    page = c("page_id").cast("string")
    rows = g.pages.select(page.alias("resource"), F.explode(F.array(F.lit("full"), F.lit("thumb"))).alias("quality"))
    iri = F.concat_ws("/", F.lit("f"), "resource", "quality")
    files = rows.select("resource", "quality", iri.alias("iri"), F.concat("quality", F.lit(".jp2")).alias("file"), F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("prev_value"))
    new = g.pages.where("page_id % 2 = 0").select(page.alias("resource"), F.lit("thumb").alias("quality"), F.concat(F.lit("f/"), page, F.lit("/thumb/2")).alias("iri"), F.lit("new.jp2").alias("file"))
    return edits.replace_qualities(files, new).select("iri", "file", "is_current", "prev_value")


@query(
    "e16_replace_texts",
    """SELECT node, lang, label FROM labels_by_lang WHERE node NOT IN (SELECT node FROM labels_by_lang WHERE label LIKE '%red%')
    UNION ALL SELECT DISTINCT node, 'it', 'it' FROM labels_by_lang WHERE label LIKE '%red%'""",
)
def _(g):
    texts = g.labels_by_lang.select(c("node").alias("entity"), F.lit("label").alias("pred"), "lang", c("label").alias("text"))
    new = texts.where(c("text").contains("red")).select("entity", "pred", F.lit("it").alias("lang"), F.lit("it").alias("text")).distinct()
    return edits.replace_texts(texts, new).select(c("entity").alias("node"), "lang", c("text").alias("label"))


@query("e17_not_written", "SELECT iri FROM vals WHERE prop = 'hasSize' AND is_deleted = FALSE AND vorder = 2")
def _(g):
    batch = g.vals.where("prop = 'hasSize'").select("iri")
    state = g.vals.where("prop = 'hasSize' AND vorder <> 2")
    return edits.not_written(batch, state, ["iri"])


@query(
    "e19_link_value_properties",
    """SELECT prop, 'hasLinkTo' AS base, 'Resource' AS object_class, n FROM (SELECT prop, count(*) AS n FROM links GROUP BY prop) UNION ALL
    SELECT prop || 'Value', 'hasLinkToValue', 'LinkValue', n FROM (SELECT prop, count(*) AS n FROM links GROUP BY prop)""",
)
def _(g):
    used = g.links.groupBy("prop").agg(F.count(F.lit(1)).alias("n"))
    props = used.select("prop", F.lit("hasLinkTo").alias("base"), F.lit("Resource").alias("object_class"))
    rows = edits.with_link_value_properties(props, used.select("prop"), "hasLinkToValue", "LinkValue")
    counts = used.select(c("prop").alias("_of"), "n")
    return rows.withColumn("_of", F.regexp_replace("prop", "Value$", "")).join(counts, "_of").drop("_of")


def _mappings(g):
    attributes = F.array(F.struct(F.lit("id").alias("name"), F.lit("hasId").alias("prop")))
    tag = F.element_at(F.split("p_name", " "), -1)
    element = F.struct(F.lit("").alias("namespace"), tag.alias("tag"), c("p_type").alias("css_class"), c("p_brand").alias("cls"), attributes.alias("attributes"))
    return g.part.select(_text("m", c("p_partkey") % 100).alias("mapping"), F.array(element).alias("elements"))


@query("e20_mapping_rows", "SELECT 'm' || CAST(p_partkey % 100 AS STRING) AS mapping, split_part(p_name, ' ', 2) AS tag, p_brand AS cls, 'id' AS name, 'hasId' AS prop FROM part")
def _(g):
    return edits.mapping_rows(_mappings(g))[0].select("mapping", "tag", "cls", "name", "prop")


@query(
    "e20_duplicate_elements",
    "SELECT 'm' || CAST(p_partkey % 100 AS STRING) AS mapping, split_part(p_name, ' ', 2) AS tag, p_type AS css_class, count(*) AS n FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def _(g):
    return edits.mapping_rows(_mappings(g))[1].select("mapping", "tag", "css_class", "n")
