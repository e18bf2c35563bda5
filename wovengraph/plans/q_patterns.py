"""Pattern, join, set, aggregation and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import access, aggregates, closure, ordering, paging, pattern
from wovengraph.plans.registry import query
from wovengraph.sources import relational

c = F.col


@query(
    "pattern_date_overlap_page",
    """SELECT v.resource, v.start_jdn FROM vals v JOIN resources r ON r.iri = v.resource
    JOIN class_closure k ON k.node = r.cls AND k.ancestor = 'Order'
    JOIN subject_codes s ON s.iri = r.iri AND s.user_id = 'user/2' AND s.code >= 1
    WHERE v.prop = 'hasDate' AND NOT v.is_deleted AND NOT r.is_deleted AND 2450509 <= v.end_jdn AND 2450539 >= v.start_jdn
    ORDER BY v.start_jdn, v.resource LIMIT 25""",
)
def _(g):
    profiles = access.user_profiles(g.users, g.memberships, g.admin_rights)
    orders = pattern.instances_of(g.resources.where(~c("is_deleted")), "Order", g.class_closure)
    mine = access.visible(orders, profiles, "user/2").select(c("iri").alias("resource"))
    dates = g.vals.where((c("prop") == "hasDate") & ~c("is_deleted") & (c("end_jdn") >= 2450509) & (c("start_jdn") <= 2450539))
    found = dates.join(mine, "resource").select("resource", "start_jdn")
    return paging.page(found, [c("start_jdn"), c("resource")], 0)


@query("p01_triple_scan", "SELECT s AS r, o AS v FROM triples WHERE p = 'hasDate'")
def _(g):
    return pattern.match(g.triples, "?r", "hasDate", "?v")


@query("p01_repeated_variable", "SELECT s AS n, p AS rel FROM triples WHERE s = o UNION ALL SELECT node, 'self' FROM list_nodes")
def _(g):
    loops = pattern.match(g.triples, "?n", "?rel", "?n")
    return loops.union(g.list_nodes.select("node", F.lit("self")))


@query(
    "p02_basic_graph_pattern",
    """SELECT a.s AS ord, a.o AS cust, b.o AS nation, d.o AS name FROM triples a JOIN triples b ON b.s = a.o AND b.p = 'locatedIn'
    JOIN triples d ON d.s = b.o AND d.p = 'label' WHERE a.p = 'placedBy'""",
)
def _(g):
    return pattern.pattern(
        g.triples, ("?ord", "placedBy", "?cust"), ("?cust", "locatedIn", "?nation"), ("?nation", "label", "?name")
    )


@query(
    "p03_asserted_and_inferred",
    """SELECT s AS r, FALSE AS inferred FROM triples WHERE p = 'hasAmount' UNION ALL
    SELECT DISTINCT t.s, TRUE FROM triples t JOIN prop_closure k ON k.node = t.p AND k.ancestor = 'hasAmount'""",
)
def _(g):
    asserted = pattern.match(g.triples, "?r", "hasAmount", "?v").select("r", F.lit(False).alias("inferred"))
    inferred = pattern.match_any_property(g.triples, "?r", "hasAmount", "?v", g.prop_closure)
    return asserted.union(inferred.select("r", F.lit(True)).distinct())


@query(
    "p04_sub_property",
    "SELECT t.s AS r, t.p AS p, t.o AS v FROM triples t JOIN prop_closure k ON k.node = t.p AND k.ancestor = 'isPartOf'",
)
def _(g):
    return pattern.match_any_property(g.triples, "?r", "isPartOf", "?v", g.prop_closure)


@query(
    "p05_sub_class",
    "SELECT r.iri, r.cls FROM resources r JOIN class_closure k ON k.node = r.cls AND k.ancestor = 'Agent'",
)
def _(g):
    return pattern.instances_of(g.resources, "Agent", g.class_closure).select("iri", "cls")


@query(
    "p06_property_variable",
    """SELECT a.s AS src, a.p AS prop, a.o AS dst, b.o AS lv FROM triples a JOIN triples b ON b.s = a.s AND b.p = 'locatedInValue'
    JOIN triples d ON d.s = b.o AND d.p = 'object' AND d.o = a.o WHERE a.p = 'locatedIn'""",
)
def _(g):
    direct = pattern.match(g.triples, "?src", "?prop", "?dst").where(c("prop") == "locatedIn")
    held = pattern.match(g.triples, "?src", "?lp", "?lv").where(c("lp") == "locatedInValue")
    objects = pattern.match(g.triples, "?lv", "object", "?dst")
    found = pattern.conjoin(pattern.conjoin(direct, held), objects)
    return found.where(c("lp") == pattern.link_value_property(c("prop"))).select("src", "prop", "dst", "lv")


@query(
    "p07_live_resources",
    "SELECT t.s AS r, t.o AS v FROM triples t JOIN resources r ON r.iri = t.s AND NOT r.is_deleted WHERE t.p = 'hasTotal'",
)
def _(g):
    live = g.resources.where(~c("is_deleted")).select(c("iri").alias("r"))
    return pattern.exists(pattern.match(g.triples, "?r", "hasTotal", "?v"), live)


@query(
    "p08_link_expansion",
    """SELECT l.src, l.prop, l.dst, l.link_value FROM links l JOIN resources r ON r.iri = l.dst AND NOT r.is_deleted
    WHERE NOT l.is_deleted AND l.prop = 'placedBy'""",
)
def _(g):
    held = pattern.expand_links(g.links.where(c("prop") == "placedBy"), g.resources)
    return held.select("src", "prop", "dst", "link_value")


@query(
    "p09_values",
    "SELECT s AS r, o AS dst FROM triples WHERE p = 'placedBy' AND o IN ('customer/1','customer/2','customer/7')",
)
def _(g):
    return pattern.values(pattern.match(g.triples, "?r", "placedBy", "?dst"), "dst", ["customer/1", "customer/2", "customer/7"])


@query(
    "p10_bind",
    "SELECT src, prop || 'Value' AS lp, 'http://data/' || dst AS target FROM links WHERE prop = 'inRegion' OR prop = 'locatedIn'",
)
def _(g):
    found = g.links.where(c("prop").isin("inRegion", "locatedIn"))
    return found.select(
        "src", pattern.link_value_property(c("prop")).alias("lp"), F.concat(F.lit("http://data/"), "dst").alias("target")
    )


@query(
    "p11_coalesce",
    """SELECT r.iri, coalesce(a.as_string, b.as_decimal_text, r.label) AS shown FROM resources r
    LEFT JOIN vals a ON a.resource = r.iri AND a.prop = 'hasBrand'
    LEFT JOIN (SELECT resource, CAST(as_decimal AS STRING) AS as_decimal_text FROM vals WHERE prop = 'hasTotal') b ON b.resource = r.iri""",
)
def _(g):
    brand = g.vals.where(c("prop") == "hasBrand").select(c("resource").alias("iri"), c("as_string").alias("a"))
    total = g.vals.where(c("prop") == "hasTotal").select(c("resource").alias("iri"), c("as_decimal").cast("string").alias("b"))
    found = pattern.optional(pattern.optional(g.resources.select("iri", "label"), brand), total)
    return found.select("iri", F.coalesce("a", "b", "label").alias("shown"))


@query(
    "p12_not_bound",
    "SELECT iri FROM resources r WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.resource = r.iri AND v.prop = 'hasSize') AND NOT is_deleted",
)
def _(g):
    size = g.vals.where(c("prop") == "hasSize").select(c("resource").alias("iri"), c("iri").alias("v"))
    live = g.resources.where(~c("is_deleted")).select("iri")
    return pattern.optional(live, size).where(c("v").isNull()).select("iri")


@query(
    "p13_if_bound",
    """SELECT r.iri, CASE WHEN v.m IS NOT NULL THEN v.m + 1 ELSE 0 END AS next_order FROM resources r
    LEFT JOIN (SELECT resource, max(vorder) AS m FROM vals WHERE prop = 'hasDate' GROUP BY resource) v ON v.resource = r.iri""",
)
def _(g):
    top = g.vals.where(c("prop") == "hasDate").groupBy(c("resource").alias("iri")).agg(F.max("vorder").alias("m"))
    found = pattern.optional(g.resources.select("iri"), top)
    return found.select("iri", F.when(c("m").isNotNull(), c("m") + 1).otherwise(0).alias("next_order"))


@query(
    "p14_is_blank",
    """SELECT s FROM (SELECT s, CASE WHEN s LIKE 'nation/%' THEN 'blank' ELSE 'iri' END AS s_kind FROM triples WHERE p = 'type')
    WHERE s_kind <> 'blank' AND s NOT LIKE 'order/%'""",
)
def _(g):
    kinds = pattern.match(g.triples, "?s", "type", "?t").withColumn(
        "s_kind", F.when(c("s").startswith("nation/"), "blank").otherwise("iri")
    )
    return kinds.where((c("s_kind") != "blank") & ~c("s").startswith("order/")).select("s")


@query(
    "p15_best_label",
    """SELECT node, coalesce(max(CASE WHEN lang = 'de' THEN label END), max(CASE WHEN lang = 'en' THEN label END), min(label)) AS label
    FROM labels_by_lang GROUP BY node""",
)
def _(g):
    return pattern.best_label(g.labels_by_lang, "de", "en")


@query(
    "p16_and_or",
    """SELECT resource, as_int FROM vals WHERE prop = 'hasSize' AND ((as_int > 40 AND as_int <> 45) OR as_int = 7)""",
)
def _(g):
    size = c("as_int")
    return g.vals.where((c("prop") == "hasSize") & (((size > 40) & (size != 45)) | (size == 7))).select("resource", "as_int")


@query("p17_distinct", "SELECT DISTINCT dst FROM links WHERE prop = 'hasPart'")
def _(g):
    return g.links.where(c("prop") == "hasPart").select("dst").distinct()


@query(
    "p18_ask",
    "SELECT iri, EXISTS (SELECT 1 FROM links l WHERE l.dst = r.iri) AS found FROM resources r",
)
def _(g):
    return pattern.ask(g.resources.select("iri"), g.links.select(c("dst").alias("iri")))


@query(
    "p19_construct",
    """SELECT DISTINCT s, p, o FROM (SELECT src AS s, 'inNation' AS p, v.as_node AS o FROM links l JOIN vals v ON v.resource = l.dst
    AND v.prop = 'hasPlace' WHERE l.prop = 'placedBy' UNION ALL SELECT v.as_node, 'hasOrder', l.src FROM links l JOIN vals v
    ON v.resource = l.dst AND v.prop = 'hasPlace' WHERE l.prop = 'placedBy')""",
)
def _(g):
    placed = g.links.where(c("prop") == "placedBy").select(c("src").alias("ord"), c("dst").alias("cust"))
    place = g.vals.where(c("prop") == "hasPlace").select(c("resource").alias("cust"), c("as_node").alias("nation"))
    return pattern.construct(pattern.conjoin(placed, place), [("?ord", "inNation", "?nation"), ("?nation", "hasOrder", "?ord")])


@query(
    "p20_subselect_limit",
    """SELECT q.dst, q.src, r.label FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM links
    WHERE prop = 'hasPart') q JOIN resources r ON r.iri = q.src WHERE q.rn <= 3""",
)
def _(g):
    capped = ordering.first_n(g.links.where(c("prop") == "hasPart").select("dst", "src"), ["dst"], ["src"], 3)
    return pattern.conjoin(capped, g.resources.select(c("iri").alias("src"), "label"))


@query("p21_graph_variable", "SELECT graph AS g, p, count(*) AS n FROM triples GROUP BY graph, p")
def _(g):
    found = pattern.match(g.triples, "?s", "?p", "?o", "?g")
    return found.groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p23_used_as_object",
    "SELECT iri AS entity FROM resources r WHERE EXISTS (SELECT 1 FROM triples t WHERE t.o = r.iri AND t.p <> 'object' AND t.p <> 'locatedIn')",
)
def _(g):
    return pattern.used_as_object(g.resources.select(c("iri").alias("entity")), g.triples, ["object", "locatedIn"])


@query("j01_inner", "SELECT l.src, r.label FROM links l JOIN resources r ON r.iri = l.dst WHERE l.prop = 'placedBy'")
def _(g):
    placed = g.links.where(c("prop") == "placedBy").select("src", "dst")
    return pattern.conjoin(placed, g.resources.select(c("iri").alias("dst"), "label")).select("src", "label")


@query(
    "j02_optional",
    """SELECT r.iri, v.as_string AS brand FROM resources r LEFT JOIN vals v ON v.resource = r.iri AND v.prop = 'hasBrand'
    WHERE r.is_deleted = FALSE""",
)
def _(g):
    brand = g.vals.where(c("prop") == "hasBrand").select(c("resource").alias("iri"), c("as_string").alias("brand"))
    return pattern.optional(g.resources.where(~c("is_deleted")).select("iri"), brand)


@query(
    "j03_nested_optional",
    """SELECT r.iri, l.dst AS cust, v.as_node AS place FROM resources r LEFT JOIN (links l LEFT JOIN vals v ON v.resource = l.dst
    AND v.prop = 'hasPlace' AND v.as_node LIKE 'nation/1%') ON l.src = r.iri AND l.prop = 'placedBy'""",
)
def _(g):
    place = g.vals.where((c("prop") == "hasPlace") & c("as_node").startswith("nation/1"))
    inner = pattern.optional(
        g.links.where(c("prop") == "placedBy").select(c("src").alias("iri"), c("dst").alias("cust")),
        place.select(c("resource").alias("cust"), c("as_node").alias("place")),
    )
    return pattern.optional(g.resources.select("iri"), inner).select("iri", "cust", "place")


@query(
    "j04_not_exists",
    """SELECT iri FROM resources r WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.resource = r.iri AND v.creator = r.creator
    AND v.vorder >= r.k % 2)""",
)
def _(g):
    held = g.vals.select(c("resource").alias("iri"), "creator", "vorder")
    kept = pattern.not_exists(g.resources.select("iri", "creator", "k"), held, c("r.vorder") >= c("l.k") % 2)
    return kept.select("iri")


@query("j05_minus", "SELECT iri FROM resources WHERE iri NOT IN (SELECT dst FROM links)")
def _(g):
    all_iris = g.resources.select("iri")
    unrelated = g.nation.select("n_name")
    return pattern.minus(pattern.minus(all_iris, g.links.select(c("dst").alias("iri"))), unrelated)


@query("j06_exists", "SELECT iri FROM resources WHERE iri IN (SELECT dst FROM links WHERE prop = 'hasPart')")
def _(g):
    return pattern.exists(g.resources.select("iri"), g.links.where(c("prop") == "hasPart").select(c("dst").alias("iri")))


@query(
    "j08_ontology_lookup",
    "SELECT r.iri, r.cls, e.parent FROM resources r JOIN class_edges e ON e.child = r.cls",
)
def _(g):
    return pattern.conjoin(g.resources.select("iri", "cls"), g.class_edges.select(c("child").alias("cls"), "parent"))


@query("a01_counts", "SELECT prop, count(dst) AS n, count(DISTINCT dst) AS n_distinct FROM links GROUP BY prop")
def _(g):
    return aggregates.count_values(g.links, ["prop"], "dst")


@query(
    "a02_group_concat",
    """SELECT src, part, string_agg(dst, ',' ORDER BY dst) AS items FROM (SELECT src, dst,
    CAST((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 10000 AS BIGINT) AS part
    FROM (SELECT DISTINCT src, dst FROM links WHERE prop = 'hasPart')) GROUP BY src, part""",
)
def _(g):
    return aggregates.concat_group(g.links.where(c("prop") == "hasPart"), ["src"], "dst")


@query(
    "a02_group_concat_split",
    "SELECT DISTINCT src, dst FROM links WHERE prop = 'hasPart'",
)
def _(g):
    joined = aggregates.concat_group(g.links.where(c("prop") == "hasPart"), ["src"], "dst")
    return aggregates.split_group(joined, "items").select("src", c("items").alias("dst"))


@query(
    "a03_group_by_sort_key",
    """SELECT l.src, d.start_jdn, count(DISTINCT l.dst) AS n FROM links l JOIN vals d ON d.resource = l.src AND d.prop = 'hasDate'
    WHERE l.prop = 'hasPart' GROUP BY l.src, d.start_jdn""",
)
def _(g):
    date = g.vals.where(c("prop") == "hasDate").select(c("resource").alias("src"), "start_jdn")
    found = pattern.conjoin(g.links.where(c("prop") == "hasPart").select("src", "dst"), date)
    return found.groupBy("src", "start_jdn").agg(F.count_distinct("dst").alias("n"))


@query(
    "a04_next_order",
    """SELECT r.iri AS resource, 'hasDate' AS prop, CAST(coalesce(max(v.vorder) + 1, 0) AS BIGINT) AS next_order FROM resources r
    LEFT JOIN vals v ON v.resource = r.iri AND v.prop = 'hasDate' AND NOT v.is_deleted GROUP BY r.iri""",
)
def _(g):
    requests = g.resources.select(c("iri").alias("resource"), F.lit("hasDate").alias("prop"))
    return aggregates.next_order(g.vals, requests)


@query("a05_max_dims", "SELECT lang, max(n_chars) AS width, max(length(text)) AS height FROM documents GROUP BY lang")
def _(g):
    return g.documents.groupBy("lang").agg(F.max("n_chars").alias("width"), F.max(F.length("text")).alias("height"))


@query(
    "a06_keywords",
    """SELECT DISTINCT unnest(string_split(p_name, ' ')) AS keyword FROM part""",
)
def _(g):
    return aggregates.distinct_sorted(g.part, F.split("p_name", " "), "keyword")


@query("a07_duplicates", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) > 1")
def _(g):
    return aggregates.duplicates(g.part, ["p_name", "p_brand"])


@query(
    "a08_nested_rows",
    """SELECT resource, CAST((row_number() OVER (PARTITION BY resource ORDER BY prop, iri) - 1) // 10000 AS BIGINT) AS part,
    prop AS first_prop, n FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY prop, iri) AS rn,
    count(*) OVER (PARTITION BY resource) AS n FROM vals) WHERE rn = 1""",
)
def _(g):
    nested = ordering.listed(g.vals, ["resource"], ["prop", "iri"], F.struct("prop", "iri"), "held")
    return nested.select("resource", "part", c("held")[0]["prop"].alias("first_prop"), F.size("held").cast("long").alias("n"))


@query(
    "o01_order_by_value",
    "SELECT resource, as_decimal FROM vals WHERE prop = 'hasTotal' ORDER BY as_decimal DESC, resource LIMIT 25",
)
def _(g):
    totals = g.vals.where(c("prop") == "hasTotal").select("resource", "as_decimal")
    return paging.page(totals, paging.sorted_by_value(totals, "resource", "as_decimal", True), 0)


@query(
    "o02_stable_ties",
    "SELECT resource, as_int FROM vals WHERE prop = 'hasSize' ORDER BY as_int, resource LIMIT 50",
)
def _(g):
    sizes = g.vals.where(c("prop") == "hasSize").select("resource", "as_int")
    return paging.page(sizes, paging.sorted_by_value(sizes, "resource", "as_int"), 0, 50)


@query(
    "o02_one_row_per_resource",
    """SELECT src, min(as_int) AS as_int FROM links l JOIN vals v ON v.resource = l.dst AND v.prop = 'hasSize' WHERE l.prop = 'hasPart'
    GROUP BY src ORDER BY min(as_int), src LIMIT 25""",
)
def _(g):
    sizes = g.vals.where(c("prop") == "hasSize").select(c("resource").alias("dst"), "as_int")
    found = paging.one_sort_value(pattern.conjoin(g.links.where(c("prop") == "hasPart").select("src", "dst"), sizes), "src", "as_int")
    return paging.page(found, paging.sorted_by_value(found, "src", "as_int"), 0)


@query(
    "o03_third_page",
    "SELECT resource, start_jdn FROM vals WHERE prop = 'hasDate' ORDER BY start_jdn, resource LIMIT 25 OFFSET 50",
)
def _(g):
    dates = g.vals.where(c("prop") == "hasDate").select("resource", "start_jdn")
    return paging.page(dates, [c("start_jdn"), c("resource")], 2)


@query(
    "o03_page_by_rank",
    """SELECT s, p, o FROM triples WHERE p = 'hasPart' ORDER BY s, o LIMIT 25 OFFSET
    (SELECT CAST(floor(count(*) / 50) AS BIGINT) * 25 FROM triples WHERE p = 'hasPart')""",
)
def _(g):
    parts = g.links.where("prop = 'hasPart' AND NOT is_deleted").select(c("src").alias("s"), c("prop").alias("p"), c("dst").alias("o"))
    ranked = paging.Ranked(parts, [c("s"), c("o")])
    return ranked.slice(ranked.total // 50 * 25, 25)


@query(
    "o04_page_table",
    """SELECT page, pages, page * 25 AS start_row, least(25, n - page * 25) AS rows_shown, page = 2 AS is_current FROM
    (SELECT n, CAST(ceil(n / 25.0) AS BIGINT) AS pages, unnest(range(CAST(ceil(n / 25.0) AS BIGINT))) AS page FROM
    (SELECT count(*) AS n FROM vals WHERE prop = 'hasSize'))""",
)
def _(g):
    return paging.page_table(g.vals.where(c("prop") == "hasSize"), 25, 2)


@query(
    "o06_capped_rows",
    """SELECT prop, resource, iri FROM (SELECT *, row_number() OVER (PARTITION BY prop ORDER BY resource, iri) AS rn FROM vals) WHERE rn <= 50""",
)
def _(g):
    return ordering.first_n(g.vals.select("prop", "resource", "iri"), ["prop"], ["resource", "iri"], 50)


@query(
    "o07_top_one",
    "SELECT dst, min(src) AS src FROM links WHERE prop = 'placedBy' GROUP BY dst",
)
def _(g):
    return ordering.first_by(g.links.where(c("prop") == "placedBy").select("dst", "src"), ["dst"], ["src"])


@query("o08_slice", "SELECT iri, label FROM resources ORDER BY label, iri LIMIT 40 OFFSET 15")
def _(g):
    return paging.slice_sorted(g.resources.select("iri", "label"), [c("label"), c("iri")], 15, 40)


@query(
    "o09_siblings",
    """SELECT parent, node, row_number() OVER (PARTITION BY parent ORDER BY position IS NULL, position, node) AS pos
    FROM list_nodes WHERE parent IS NOT NULL""",
)
def _(g):
    nodes = g.list_nodes.where("parent IS NOT NULL").select(
        "parent", "node", c("position").isNull().alias("last"), F.coalesce("position", F.lit(0)).alias("at")
    )
    return ordering.numbered(nodes, ["parent"], ["last", "at", "node"]).select("parent", "node", "pos")


@query(
    "o10_nulls_first",
    "SELECT node, position FROM list_nodes ORDER BY position NULLS FIRST, node",
)
def _(g):
    return g.list_nodes.select("node", "position").orderBy(c("position").asc_nulls_first(), "node")


@query(
    "u01_union",
    """SELECT iri, as_int AS size, NULL AS total FROM vals WHERE prop = 'hasSize' UNION ALL
    SELECT iri, NULL, CAST(as_decimal AS STRING) FROM vals WHERE prop = 'hasTotal'""",
)
def _(g):
    sizes = g.vals.where(c("prop") == "hasSize").select("iri", c("as_int").alias("size"))
    totals = g.vals.where(c("prop") == "hasTotal").select("iri", c("as_decimal").cast("string").alias("total"))
    return pattern.union(sizes, totals)


@query("u02_difference", "SELECT iri FROM resources EXCEPT SELECT src FROM links")
def _(g):
    return paging.difference(g.resources.select("iri"), g.links.select(c("src").alias("iri")))


@query(
    "u03_covers",
    """SELECT o_custkey, count(DISTINCT o_orderpriority) = 5 AS complete FROM orders GROUP BY o_custkey""",
)
def _(g):
    # At most five priorities exist, so the set is bounded.
    expected = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    found = g.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("found"))
    return found.select("o_custkey", paging.covers(c("found"), expected).alias("complete"))


@query(
    "u04_set_union",
    "SELECT src AS node FROM links UNION SELECT dst FROM links UNION SELECT iri FROM resources",
)
def _(g):
    return paging.union_distinct(
        g.links.select(c("src").alias("node")), g.links.select(c("dst").alias("node")), g.resources.select(c("iri").alias("node"))
    )


@query(
    "s02_tables_to_triples",
    """SELECT 'g' || CAST(p_partkey % 4 AS STRING) AS graph, s, p, o, o_kind FROM (SELECT p_partkey, 'part/' || CAST(p_partkey AS STRING) AS s,
    'label' AS p, p_name AS o, 'literal' AS o_kind FROM part UNION ALL SELECT p_partkey, 'part/' || CAST(p_partkey AS STRING), 'brand',
    'brand/' || p_brand, 'iri' FROM part UNION ALL SELECT p_partkey, 'part/' || CAST(p_partkey AS STRING), 'size', CAST(p_size AS STRING),
    'literal' FROM part WHERE p_size > 10)""",
)
def _(g):
    mapping = {
        "label": (c("p_name"), "literal"),
        "brand": (F.concat(F.lit("brand/"), "p_brand"), "iri"),
        "size": (F.when(c("p_size") > 10, c("p_size")), "literal"),
    }
    key = c("p_partkey").cast("string")
    graph = F.concat(F.lit("g"), (c("p_partkey") % 4).cast("string"))
    return relational.tables_to_triples(g.part, F.concat(F.lit("part/"), key), mapping, graph)


@query(
    "g01_class_closure",
    "SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM class_closure",
)
def _(g):
    return closure.ancestors(g.class_edges).withColumn("depth", c("depth").cast("long"))
