"""Hierarchies, walks and version chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import access, closure, ordering, pattern, walks
from wovengraph.plans.registry import query

c = F.col


def _profiles(g):
    return access.user_profiles(g.users, g.memberships, g.admin_rights)


@query("g02_property_closure", "SELECT l.src, k.ancestor AS prop FROM links l JOIN prop_closure k ON k.node = l.prop")
def _(g):
    closed = closure.ancestors(g.prop_edges).select(c("node").alias("prop"), "ancestor")
    return g.links.join(closed, "prop").select("src", c("ancestor").alias("prop"))


@query(
    "g03_subclasses",
    """SELECT ancestor, CAST((rn - 1) // 10000 AS BIGINT) AS part, string_agg(node, ',' ORDER BY node) AS subclasses FROM
    (SELECT ancestor, node, row_number() OVER (PARTITION BY ancestor ORDER BY node) AS rn FROM class_closure) GROUP BY 1, 2""",
)
def _(g):
    parts = ordering.listed(g.class_closure, ["ancestor"], ["node"], c("node"), "subclasses")
    return parts.withColumn("subclasses", F.array_join("subclasses", ","))


@query(
    "g04_is_below",
    """SELECT r.iri AS iri, EXISTS (SELECT 1 FROM class_closure k WHERE k.node = r.cls AND k.ancestor = 'Doc') AS below FROM resources r""",
)
def _(g):
    pairs = g.resources.select("iri", c("cls").alias("child"), F.lit("Doc").alias("parent"))
    return closure.is_below(pairs, g.class_closure).select("iri", "below")


@query(
    "g05_properties_under",
    "SELECT v.prop, count(*) AS n FROM vals v JOIN prop_closure k ON k.node = v.prop AND k.ancestor = 'hasText' GROUP BY v.prop",
)
def _(g):
    under = closure.descendants_of(g.prop_closure, "hasText").select(c("node").alias("prop"))
    return g.vals.join(under, "prop", "left_semi").groupBy("prop").agg(F.count(F.lit(1)).alias("n"))


def _inherited(g):
    return g._once("inherited", lambda: closure.inherited_cardinalities(g.class_edges, g.prop_closure, g.cardinalities))


# Own rows of a class hide base rows on the same property or on a base property of an own one. The test
# classes form a tree, so a row of class b reaches class k if no class on the way from k up to below b hides it.
INHERITED_SQL = """SELECT k.node AS cls, c.prop, c.card, c.gui_order, c.cls AS origin FROM class_closure k JOIN cardinalities c ON c.cls = k.ancestor
    WHERE NOT EXISTS (SELECT 1 FROM class_closure a JOIN class_closure b ON b.node = a.ancestor AND b.ancestor = c.cls AND b.depth > 0
    JOIN cardinalities o ON o.cls = a.ancestor LEFT JOIN prop_closure q ON q.node = o.prop
    WHERE a.node = k.node AND (o.prop = c.prop OR q.ancestor = c.prop))"""


@query("g06_inherited_cardinalities", INHERITED_SQL)
def _(g):
    return _inherited(g)


@query(
    "g07_value_classes",
    """SELECT node, ancestor FROM class_closure WHERE node <> ancestor AND ancestor NOT IN ('Resource') AND node NOT LIKE 'Page/%'""",
)
def _(g):
    skipped = closure.descendants_of(g.class_closure, "Page").where("node <> 'Page'")
    rows = g.class_closure.where("node <> ancestor AND ancestor <> 'Resource'")
    return rows.join(skipped.select("node"), "node", "left_anti").select("node", "ancestor")


@query(
    "g08_list_subtree",
    """SELECT n.node, n.name, CAST(k.depth AS BIGINT) AS level FROM list_closure k JOIN list_nodes n ON n.node = k.node WHERE k.ancestor = 'region/1'""",
)
def _(g):
    return closure.subtree(g.list_labels, "region/1").select("node", "name", c("level").cast("long").alias("level"))


@query(
    "g08_tree_labels",
    """WITH sized AS (SELECT ancestor AS node, count(*) AS n, any_value(x.parent) AS parent, any_value(x.position) AS position FROM list_closure k
    JOIN list_nodes x ON x.node = k.ancestor GROUP BY ancestor),
    placed AS (SELECT node, n, parent, coalesce(sum(n) OVER (PARTITION BY parent ORDER BY position IS NULL, position, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS skip FROM sized)
    SELECT p.node, 'world' AS root, CAST((SELECT max(depth) FROM list_closure k WHERE k.node = p.node) AS BIGINT) AS level,
    CAST(coalesce((SELECT sum(q.skip) FROM list_closure k JOIN placed q ON q.node = k.ancestor WHERE k.node = p.node AND q.parent IS NOT NULL), 0) AS BIGINT) AS pre,
    CAST(coalesce((SELECT sum(q.skip) FROM list_closure k JOIN placed q ON q.node = k.ancestor WHERE k.node = p.node AND q.parent IS NOT NULL), 0) + p.n - 1 AS BIGINT) AS last
    FROM placed p""",
)
def _(g):
    return g.list_labels.select("node", "root", "level", "pre", "last")


@query(
    "g08_under",
    """SELECT a.node AS child, b.node AS parent, EXISTS (SELECT 1 FROM list_closure k WHERE k.node = a.node AND k.ancestor = b.node) AS below
    FROM list_nodes a JOIN list_nodes b ON b.node IN ('world', 'region/0', 'nation/3', 'customer/7')""",
)
def _(g):
    pairs = g.list_nodes.select(c("node").alias("child"), F.explode(F.array(*map(F.lit, ("world", "region/0", "nation/3", "customer/7")))).alias("parent"))
    return closure.under(pairs, g.list_labels)


_SORT_KEY = "CASE WHEN {p}.position IS NULL THEN '~' ELSE lpad(CAST({p}.position AS STRING), 10, '0') END || ':' || {p}.node"


@query(
    "g09_nested_list",
    f"""WITH RECURSIVE tree AS (SELECT n.node, n.parent, n.node AS root, CAST(0 AS BIGINT) AS level, {_SORT_KEY.format(p='n')} AS sort_path
    FROM list_nodes n WHERE n.parent IS NULL UNION ALL SELECT n.node, n.parent, t.root, t.level + 1, t.sort_path || '/' || {_SORT_KEY.format(p='n')}
    FROM tree t JOIN list_nodes n ON n.parent = t.node) SELECT * FROM tree""",
)
def _(g):
    rows = closure.nested_list(g.list_nodes)
    return rows.select("node", "parent", "root", c("level").cast("long").alias("level"), "sort_path")


@query(
    "g10_node_paths",
    """SELECT k.node AS start, CAST(k.depth AS BIGINT) AS up, k.ancestor AS node FROM list_closure k
    WHERE k.node LIKE 'customer/%' AND k.ancestor <> 'world'""",
)
def _(g):
    starts = g.list_nodes.where(c("node").startswith("customer/"))
    return closure.node_paths(g.list_labels, starts).withColumn("up", c("up").cast("long"))


_EDGES = """edges AS (SELECT l.link_value, l.src, l.prop, l.dst FROM links l JOIN prop_closure k ON k.node = l.prop AND k.ancestor = 'hasLinkTo'
    JOIN subject_codes sc ON sc.iri = l.link_value AND sc.user_id = 'user/2' AND sc.code >= 1
    JOIN resources a ON a.iri = l.src AND NOT a.is_deleted JOIN subject_codes ac ON ac.iri = a.iri AND ac.user_id = 'user/2' AND ac.code >= 1
    JOIN resources b ON b.iri = l.dst AND NOT b.is_deleted JOIN subject_codes bc ON bc.iri = b.iri AND bc.user_id = 'user/2' AND bc.code >= 1
    WHERE NOT l.is_deleted AND l.prop NOT IN (SELECT node FROM prop_closure WHERE ancestor = 'isPartOf'))"""
_WALK = f"""WITH RECURSIVE {_EDGES}, starts AS (SELECT r.iri AS node FROM resources r JOIN subject_codes x ON x.iri = r.iri AND x.user_id = 'user/2' AND x.code >= 1
    WHERE r.cls LIKE 'Text/%' AND NOT r.is_deleted),
    walk_out AS (SELECT node AS start, node, 0 AS depth FROM starts UNION SELECT w.start, e.dst, w.depth + 1 FROM walk_out w JOIN edges e ON e.src = w.node WHERE w.depth < 2),
    walk_in AS (SELECT node AS start, node, 0 AS depth FROM starts UNION SELECT w.start, e.src, w.depth + 1 FROM walk_in w JOIN edges e ON e.dst = w.node WHERE w.depth < 2)"""


def _walk(g):
    links = walks.link_kind(g.links, g.prop_closure, "hasLinkTo", "isPartOf")
    nodes, edges = walks.visible_edges(links, g.resources, _profiles(g), "user/2")
    starts = nodes.where(c("cls").startswith("Text/")).select(c("iri").alias("node"))
    return starts, *walks.both_directions(edges, starts, 2)


@query(
    "g11_neighbourhood_nodes",
    f"""{_WALK} SELECT start, node, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT * FROM walk_out UNION ALL SELECT * FROM walk_in) GROUP BY start, node""",
)
def _(g):
    _, nodes, _ = _walk(g)
    return nodes.withColumn("depth", c("depth").cast("long"))


@query(
    "g11_neighbourhood_edges",
    f"""{_WALK} SELECT w.start, e.link_value, e.src, e.prop, e.dst FROM walk_out w JOIN edges e ON e.src = w.node WHERE w.depth < 2
    UNION SELECT w.start, e.link_value, e.src, e.prop, e.dst FROM walk_in w JOIN edges e ON e.dst = w.node WHERE w.depth < 2""",
)
def _(g):
    _, _, edges = _walk(g)
    return edges


@query(
    "g12_pruned_nodes",
    """WITH shown AS (SELECT src, dst FROM links WHERE prop = 'cites' AND NOT is_deleted)
    SELECT r.iri AS node FROM resources r WHERE EXISTS (SELECT 1 FROM shown s WHERE s.src = r.iri OR s.dst = r.iri) OR r.iri = 'order/0'""",
)
def _(g):
    anchor = F.lit("order/0").alias("start")
    nodes = g.resources.select(anchor, c("iri").alias("node"))
    edges = g.links.where((c("prop") == "cites") & ~c("is_deleted")).select(anchor, "src", "dst")
    starts = g.resources.where(c("iri") == "order/0").select(c("iri").alias("node"))
    return walks.prune_isolated(nodes, edges, starts).select("node")


@query(
    "g13_incoming_references",
    """SELECT l.dst AS target, l.src AS referrer, l.prop, l.link_value, r.label, r.cls FROM links l JOIN resources r ON r.iri = l.src AND NOT r.is_deleted
    WHERE NOT l.is_deleted AND l.prop IN ('placedBy', 'hasPart', 'cites')""",
)
def _(g):
    return walks.incoming_references(g.links, g.resources, g.prop_closure, "hasLinkTo", "isPartOf")


@query(
    "g14_containers",
    """SELECT l.src AS iri, l.dst AS container FROM links l JOIN resources r ON r.iri = l.dst AND NOT r.is_deleted
    WHERE NOT l.is_deleted AND l.prop IN ('locatedIn', 'inRegion')""",
)
def _(g):
    return walks.containers(g.links, g.resources, g.prop_closure, "isPartOf")


@query(
    "g15_parts_in_order",
    """SELECT l.dst AS container, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS seqnum, l.src AS iri,
    'small/' || c_mktsegment AS preview, CASE WHEN c_custkey % 2 = 0 THEN 'large/' || c_mktsegment END AS full_image
    FROM links l JOIN customer ON l.src = 'customer/' || CAST(c_custkey AS STRING) WHERE l.prop = 'locatedIn' AND NOT l.is_deleted""",
)
def _(g):
    iri = F.concat(F.lit("customer/"), c("c_custkey").cast("string")).alias("iri")
    sequence = g.customer.where("c_custkey % 5 <> 0").select(iri, c("c_custkey").alias("seqnum"))
    small = g.customer.select(iri, F.lit(True).alias("is_preview"), F.concat(F.lit("small/"), "c_mktsegment").alias("file"))
    large = g.customer.where("c_custkey % 2 = 0").select(iri, F.lit(False).alias("is_preview"), F.concat(F.lit("large/"), "c_mktsegment").alias("file"))
    parts = walks.containers(g.links, g.resources, g.prop_closure, "isPartOf")
    customers = parts.where(c("iri").startswith("customer/"))
    return walks.parts_in_order(customers, sequence, small.union(large))


@query(
    "g16_regions",
    """SELECT l.dst AS resource, l.src AS region, r.label FROM links l JOIN resources r ON r.iri = l.src AND NOT r.is_deleted
    JOIN class_closure k ON k.node = r.cls AND k.ancestor = 'Text' WHERE l.prop = 'cites' AND NOT l.is_deleted""",
)
def _(g):
    return walks.regions(g.links, g.resources, g.class_closure, "Text", "cites")


_HEADS = """heads AS (SELECT v.value, first_value(v.value) OVER w AS head, row_number() OVER w - 1 AS age FROM versions v JOIN events e ON e.event_id = v.event_id
    WINDOW w AS (PARTITION BY v.user_id ORDER BY e.ts DESC, e.event_id DESC))"""


def _heads(g):
    return g._once("heads", lambda: walks.chain_heads(g.versions))


@query("g17_chain_heads", f"WITH {_HEADS} SELECT value, head, age FROM heads")
def _(g):
    return walks.chain_heads(g.versions)


@query(
    "g17_version_history",
    f"""WITH {_HEADS}, shown AS (SELECT v.value, v.prev_value, h.head, h.age FROM versions v JOIN heads h ON h.value = v.value
    JOIN versions cur ON cur.value = h.head AND NOT cur.is_deleted
    WHERE v.permissions LIKE '%KnownUser%' OR v.permissions LIKE '%UnknownUser%' OR (v.creator = 'user/5' AND v.permissions LIKE '%Creator%')
    OR (v.project = 'project/1' AND v.permissions LIKE '%ProjectMember%'))
    SELECT s.head AS current, s.age, s.value, p.value AS prev_value FROM shown s LEFT JOIN shown p ON p.value = s.prev_value""",
)
def _(g):
    return walks.version_history(g.versions, _heads(g), _profiles(g), "user/5")


@query(
    "g18_is_version_of",
    f"""WITH {_HEADS} SELECT v.value, 'v/' || CAST(v.event_id - v.event_id % 50 AS STRING) AS current,
    h.head = 'v/' || CAST(v.event_id - v.event_id % 50 AS STRING) AS found FROM versions v JOIN heads h ON h.value = v.value""",
)
def _(g):
    current = F.concat(F.lit("v/"), (c("event_id") - c("event_id") % 50).cast("string"))
    return walks.is_version_of(g.versions.select("value", current.alias("current")), _heads(g))


@query(
    "g19_holders",
    """SELECT iri AS value, resource, prop FROM vals UNION ALL SELECT link_value, src, prop || 'Value' FROM links""",
)
def _(g):
    requests = g.vals.select(c("iri").alias("value")).union(g.links.select("link_value"))
    return walks.holders(requests, g.vals, g.links)


@query(
    "g20_link_values",
    """SELECT q.src, q.prop, q.dst, l.link_value, l.ref_count, coalesce(NOT l.is_deleted, FALSE) AS direct_exists FROM
    (SELECT 'order/' || CAST(o_orderkey AS STRING) AS src, 'placedBy' AS prop, 'customer/' || CAST(o_custkey - o_orderkey % 2 AS STRING) AS dst FROM orders) q
    LEFT JOIN links l ON l.src = q.src AND l.prop = q.prop AND l.dst = q.dst""",
)
def _(g):
    text = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    requests = g.orders.select(
        text("order/", c("o_orderkey")).alias("src"),
        F.lit("placedBy").alias("prop"),
        text("customer/", c("o_custkey") - c("o_orderkey") % 2).alias("dst"),
    )
    return walks.link_values(requests, g.links)


@query(
    "g20_link_values_by_iri",
    "SELECT link_value, src, prop, dst, ref_count, NOT is_deleted AS direct_exists FROM links WHERE prop = 'cites'",
)
def _(g):
    requests = g.documents.where("doc_id > 0").select(
        F.concat(
            F.lit("text/"), c("doc_id").cast("string"), F.lit("/cites/text/"), F.floor(c("doc_id") / 2).cast("string")
        ).alias("link_value")
    )
    return walks.link_values_by_iri(requests, g.links)


@query(
    "g21_assembled",
    """WITH live AS (SELECT link_value, prop, src, dst FROM links WHERE NOT is_deleted),
    facts AS (SELECT iri, label FROM resources WHERE NOT is_deleted), mains AS (SELECT iri FROM resources WHERE cls LIKE 'Text/%'),
    first AS (SELECT m.iri AS main, 1 AS level, l.link_value, l.prop, FALSE AS incoming, l.src AS source, l.dst AS target FROM mains m JOIN live l ON l.src = m.iri
    UNION ALL SELECT m.iri, 1, l.link_value, l.prop, TRUE, l.dst, l.src FROM mains m JOIN live l ON l.dst = m.iri),
    reached AS (SELECT DISTINCT main, target FROM first JOIN facts ON iri = target WHERE target <> main),
    second AS (SELECT r.main, 2 AS level, l.link_value, l.prop, FALSE AS incoming, l.src AS source, l.dst AS target FROM reached r JOIN live l ON l.src = r.target)
    SELECT q.main, q.level, q.link_value, q.prop, q.incoming, q.source, q.target, f.label AS target_label
    FROM (SELECT * FROM first UNION ALL SELECT * FROM second) q JOIN facts f ON f.iri = q.target""",
)
def _(g):
    mains = pattern.instances_of(g.resources, "Text", g.class_closure)
    return walks.assemble(mains, g.links, g.resources, 2)
