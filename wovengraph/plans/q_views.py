"""Views, mark-up, migrations, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wovengraph.operators import access, markup, migrations, ordering, views
from wovengraph.plans import fixture
from wovengraph.plans.q_hierarchy import _inherited
from wovengraph.plans.registry import query
from wovengraph.session import shared_dir
from wovengraph.sources import ingest, ntriples, sinks

c = F.col
FIX = fixture.FIXTURES
FIX["files"] = " UNION ALL ".join(
    f"SELECT 'page/' || CAST(page_id AS STRING) AS resource, '{q}' AS quality, 'f/' || CAST(page_id AS STRING) || '/{q}' AS file, "
    "page_id % 10 = 3 AS is_deleted FROM pages"
    for q in ("full", "thumb")
)


def _profiles(g):
    return access.user_profiles(g.users, g.memberships, g.admin_rights)


def _files(g):
    page = F.concat(F.lit("page/"), c("page_id").cast("string"))
    rows = g.pages.select(page.alias("resource"), "page_id", F.explode(F.array(F.lit("full"), F.lit("thumb"))).alias("quality"))
    file = F.concat_ws("/", F.lit("f"), c("page_id").cast("string"), "quality")
    return rows.select("resource", "quality", file.alias("file"), (c("page_id") % 10 == 3).alias("is_deleted"))


@query(
    "b01_resource_info",
    """SELECT iri, p, o FROM (SELECT iri, 'cls' AS p, cls AS o FROM resources UNION ALL SELECT iri, 'label', label FROM resources UNION ALL SELECT iri, 'creator', creator FROM resources
    UNION ALL SELECT iri, 'project', project FROM resources UNION ALL SELECT iri, 'permissions', permissions FROM resources UNION ALL SELECT iri, 'is_deleted', CAST(is_deleted AS STRING) FROM resources
    UNION ALL SELECT resource, 'file', file FROM files) z""",
)
def _(g):
    return views.resource_info(g.resources, _files(g))


_ROWS = """(SELECT resource, prop, iri AS value, FALSE AS is_link, FALSE AS is_link_value FROM vals WHERE NOT is_deleted AND prop <> 'hasUrl'
    UNION ALL SELECT src, prop, dst, TRUE, FALSE FROM links WHERE NOT is_deleted UNION ALL SELECT src, prop || 'Value', link_value, FALSE, TRUE FROM links WHERE NOT is_deleted)"""


def _rows(g):
    return views.properties_and_values(g.vals, g.links, ["hasUrl"], g.prop_closure)


@query("b02_properties_and_values", f"SELECT * FROM {_ROWS} z")
def _(g):
    return _rows(g)


@query("b03_split_rows", f"SELECT CASE WHEN is_link THEN 'link' WHEN is_link_value THEN 'link_value' ELSE 'value' END AS kind, prop, count(*) AS n FROM {_ROWS} z GROUP BY ALL")
def _(g):
    parts = [df.groupBy("prop").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(k)) for k, df in views.split_rows(_rows(g)).items()]
    return parts[0].union(parts[1]).union(parts[2]).select("kind", "prop", "n")


@query(
    "b04_with_empty_properties",
    """SELECT resource, prop, iri AS value FROM vals WHERE NOT is_deleted UNION ALL SELECT r.iri, i.prop, NULL FROM resources r JOIN inherited i ON i.cls = r.cls
    WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.resource = r.iri AND v.prop = i.prop AND NOT v.is_deleted)""",
)
def _(g):
    rows = g.vals.where(~c("is_deleted")).select("resource", "prop", c("iri").alias("value"))
    return views.with_empty_properties(g.resources, rows, _inherited(g))


@query(
    "b05_values_in_order",
    """SELECT resource, CAST(0 AS BIGINT) AS part, string_agg(iri, '|' ORDER BY CASE WHEN vorder = 2 THEN 0 ELSE vorder END, iri) AS ordered FROM vals GROUP BY resource""",
)
def _(g):
    spoiled = F.when(c("vorder") != 2, c("vorder"))
    rows = g.vals.select("resource", "iri", spoiled.alias("vorder")).withColumn("at", views.value_order(g.vals)[0])
    return ordering.listed(rows, ["resource"], ["at", "iri"], c("iri"), "ordered").withColumn("ordered", F.array_join("ordered", "|"))


@query(
    "b06_split_result",
    """SELECT CASE WHEN k.o LIKE '%Value' THEN 'value' WHEN k.o LIKE 'Part/%' THEN 'main' ELSE 'dependent' END AS kind, count(*) AS n FROM triples t
    JOIN (SELECT DISTINCT s, o FROM triples WHERE p = 'type') k ON k.s = t.s GROUP BY 1""",
)
def _(g):
    mains = g.resources.where(c("cls").startswith("Part/")).select(c("iri").alias("s"))
    rows = views.with_part(g.triples.of().select("s", "p", "o"), mains)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b07_class_shape",
    "SELECT i.cls, i.prop, i.card AS occurrence, p.object_class AS value_type, i.gui_order FROM inherited i LEFT JOIN prop_constraints p ON p.prop = i.prop WHERE i.cls IN (SELECT cls FROM resources)",
)
def _(g):
    return views.class_shape(_inherited(g), g.prop_constraints).join(g.resources.select("cls"), "cls", "left_semi")


@query(
    "b08_entities",
    """SELECT DISTINCT cls AS entity, project AS ontology, 'class' AS kind FROM resources WHERE project = 'project/1' UNION ALL SELECT DISTINCT prop, project, 'property' FROM vals WHERE project = 'project/1'""",
)
def _(g):
    classes = g.resources.select(c("cls").alias("entity"), c("project").alias("ontology"), F.lit("class").alias("kind")).distinct()
    props = g.vals.select(c("prop").alias("entity"), c("project").alias("ontology"), F.lit("property").alias("kind")).distinct()
    return views.entities_of(classes.union(props), "project/1")


@query(
    "b09_image_resolutions",
    """SELECT page_id, power, CAST(floor((1000 + page_id) / pow(2, power) + 0.5) AS INT) AS dim_x, CAST(floor((800 + page_id * 3) / pow(2, power) + 0.5) AS INT) AS dim_y FROM
    (SELECT page_id, unnest(CASE WHEN page_id % 4 <> 0 THEN [5, 4, 3, 2, 1, 0] ELSE [0] END) AS power FROM pages)""",
)
def _(g):
    mime = F.when(c("page_id") % 4 != 0, "image/jp2").otherwise("image/png")
    images = g.pages.select("page_id", (c("page_id") + 1000).alias("dim_x"), (c("page_id") * 3 + 800).alias("dim_y"), mime.alias("mime"))
    return views.image_resolutions(images).select("page_id", "power", "dim_x", "dim_y")


@query("b10_resources_of", "SELECT iri FROM resources WHERE project = 'project/2' AND cls = 'Text/en'")
def _(g):
    return views.resources_of(g.resources, "project/2", "Text/en").select("iri")


@query("b11_file_values", "SELECT f.resource, f.quality, f.file FROM files f JOIN resources r ON r.iri = f.resource WHERE NOT f.is_deleted")
def _(g):
    return views.file_values(g.resources, _files(g))


@query(
    "b12_records",
    """SELECT 'customer/' || CAST(c_custkey AS STRING) AS s, 'Customer' || CAST(c_custkey AS STRING) || '@x.org' AS email, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(g):
    iri = F.concat(F.lit("customer/"), c("c_custkey").cast("string"))
    email = F.concat(F.lit("Customer"), c("c_custkey").cast("string"), F.lit("@x.org"))
    facts = {"type": F.lit("User"), "email": email, "name": c("c_name"), "segment": c("c_mktsegment")}
    rows = g.customer.select(iri.alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts.items()])))
    return views.records(rows, "User", ["email", "name", "segment"], {"segment": "BUILDING"}).select("s", "email", "name")


@query(
    "b13_value_with_markup",
    """SELECT v.iri AS value, 'asString' AS p, v.as_string AS o FROM vals v WHERE v.prop = 'hasSource' UNION ALL SELECT v.iri, 'standoff', t.tag FROM tags t JOIN vals v ON v.prop = 'hasSource' AND v.iri = t.txt || '/hasSource'
    UNION ALL SELECT v.iri, 'project', r.project FROM vals v JOIN resources r ON r.iri = v.resource WHERE v.prop = 'hasSource'""",
)
def _(g):
    tags = g.tags.select(F.concat("txt", F.lit("/hasSource")).alias("txt"), "tag")
    return views.value_with_markup(g.vals.where("prop = 'hasSource'"), tags, g.resources, "txt")


@query(
    "b14_requested_resources",
    """SELECT q.iri, CASE WHEN r.iri IS NOT NULL AND s.code >= 1 THEN r.label END AS label, CASE WHEN r.iri IS NULL THEN 'missing' WHEN s.code >= 1 THEN 'found' ELSE 'hidden' END AS status FROM
    (SELECT DISTINCT dst AS iri FROM links UNION SELECT src || 'x' FROM links WHERE prop = 'locatedIn' UNION SELECT src FROM links WHERE prop = 'placedBy') q
    LEFT JOIN resources r ON r.iri = q.iri AND NOT r.is_deleted LEFT JOIN subject_codes s ON s.iri = q.iri AND s.user_id = 'user/3'""",
)
def _(g):
    asked = g.links.select(c("dst").alias("iri")).union(g.links.where("prop = 'locatedIn'").select(F.concat("src", F.lit("x"))))
    asked = asked.union(g.links.where("prop = 'placedBy'").select("src"))
    return views.requested_resources(asked, g.resources, _profiles(g), "user/3")


# Documents as XML: a root with one paragraph per line. Control characters are not allowed in XML.
_CONTROL = r"[\x00-\x09\x0b-\x1f]"
_CLEAN = r"regexp_replace(text, '[\x00-\x09\x0b-\x1f]', '', 'g')"


def _xml_documents(g):
    clean = F.regexp_replace("text", _CONTROL, "")
    lines = F.replace(markup.xml_escape(clean), F.lit("\n"), F.lit("</p><p>"))
    return g.documents.select("doc_id", F.concat(F.lit('<doc id="'), c("doc_id").cast("string"), F.lit('"><p>'), lines, F.lit("</p></doc>")).alias("xml"))


@query(
    "m01_xml_ranges",
    f"""SELECT CAST(doc_id AS STRING) AS doc, 'doc' AS tag, 0 AS start_pos, CAST(length(replace({_CLEAN}, chr(10), '')) AS INT) AS end_pos, 0 AS tag_index, NULL AS parent FROM documents UNION ALL
    SELECT CAST(doc_id AS STRING), 'p', CAST(coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT),
    CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS INT), CAST(i AS INT), 0 FROM
    (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS lines FROM documents))""",
)
def _(g):
    rows = markup.to_ranges(_xml_documents(g), "doc_id", "xml")
    return rows.select("doc", "tag", "start_pos", "end_pos", "tag_index", "parent")


@query("m01_plain_text", f"SELECT CAST(doc_id AS STRING) AS doc, replace({_CLEAN}, chr(10), '') AS text FROM documents")
def _(g):
    return markup.to_ranges(_xml_documents(g), "doc_id", "xml").where("tag_index = 0").select("doc", "text")


@query("m01_html_ranges")
def _(g):
    return markup.to_ranges(g.pages, "page_id", "html", html=True)


_NESTED = """SELECT p_partkey, p_type, p_size, 'http://one/' || CAST(p_size % 2 AS STRING) AS one FROM part"""


@query(
    "m01_namespaces_to_typed_tags",
    f"""WITH x AS ({_NESTED}), named AS (SELECT p_partkey, 0 AS tag_index, one AS namespace, 'doc' AS tag, NULL AS number FROM x
    UNION ALL SELECT p_partkey, 1, one, p_type, p_size FROM x UNION ALL SELECT p_partkey, 2, 'http://two', p_type, NULL FROM x
    UNION ALL SELECT p_partkey, 3, 'http://three', p_type, p_size + 1 FROM x UNION ALL SELECT p_partkey, 4, one, 'doc', NULL FROM x
    UNION ALL SELECT p_partkey, 5, '', p_type, NULL FROM x)
    SELECT CAST(p_partkey AS STRING) AS doc, CAST(tag_index AS INT) AS tag_index, namespace, tag, CAST(number AS INT) AS number,
    CASE WHEN tag = 'doc' THEN '(none)' WHEN namespace = 'http://one/0' THEN 'One' || tag WHEN namespace = 'http://three' THEN 'Three' || tag ELSE '(none)' END AS cls FROM named""",
)
def _(g):
    """Prefixes declared anew within, a default namespace and its end; mapped by namespace, with a number read from an attribute."""
    size, kind = c("p_size").cast("string"), c("p_type")
    xml = F.concat(
        F.lit('<t:doc xmlns:t="http://one/'), (c("p_size") % 2).cast("string"), F.lit('"><t:'), kind, F.lit(' n="'), size, F.lit('"/><'), kind,
        F.lit(' xmlns="http://two">a<t:'), kind, F.lit(' xmlns:t="http://three" n="'), (c("p_size") + 1).cast("string"),
        F.lit('"/><t:doc>b</t:doc></'), kind, F.lit("><"), kind, F.lit("/></t:doc>"),
    )
    ranges = markup.to_ranges(g.part.select("p_partkey", xml.alias("xml")), "p_partkey", "xml", namespaces=True)
    tags = ranges.select(F.struct("doc", "tag_index").alias("id"), "doc", "tag_index", "namespace", "tag", F.lit("").alias("css_class"), "attributes")
    names = g.part.select(c("p_type").alias("tag")).distinct()
    rule = lambda namespace, first: names.select(F.lit(namespace).alias("namespace"), "tag", F.lit("").alias("css_class"), F.concat(F.lit(first), "tag").alias("cls"))
    mapped, lacking = markup.map_tags(tags, rule("http://one/0", "One").union(rule("http://three", "Three")))
    columns = ["id", "doc", "tag_index", "namespace", c("tag").alias("name"), "attributes"]
    known = mapped.select(*columns, "cls").union(lacking.select(*columns, F.lit("(none)")))
    values = known.select(c("id").alias("tag"), F.explode("attributes").alias("name", "value"))
    typed = markup.typed_tags(known.select(c("id").alias("tag"), "doc", "tag_index", "namespace", "name", "cls"), values, {"number": ("n", "int")})
    return typed.select("doc", "tag_index", "namespace", c("name").alias("tag"), "number", "cls")


@query("m02_xml_round_trip", "SELECT CAST(doc_id AS STRING) AS doc, TRUE AS same FROM documents")
def _(g):
    docs = _xml_documents(g)
    back = markup.to_xml(markup.to_ranges(docs, "doc_id", "xml"))
    xml = F.replace("xml", F.lit("<p></p>"), F.lit("<p/>"))
    return back.join(docs.select(c("doc_id").cast("string").alias("doc"), xml.alias("_xml")), "doc").select("doc", (c("xml") == c("_xml")).alias("same"))


def _milestones(g):
    """One overlapping range per conversation turn, from the first word into the next paragraph; some are broken."""
    turn = c("conv_id").cast("string")
    end = F.when(c("turn") % 4 == 3, "").otherwise(F.concat(F.lit('<hi eID="a'), c("turn").cast("string"), F.lit('"/>')))
    start = F.concat(F.lit('<hi sID="a'), c("turn").cast("string"), F.lit('"/>'))
    role = c("role")
    xml = F.concat(F.lit("<doc><p>"), role, start, role, F.lit("</p><p>"), role, end, role, F.lit("</p></doc>"))
    return g.conversations.select(F.concat_ws(":", turn, c("turn").cast("string")).alias("doc"), xml.alias("xml"))


@query(
    "m03_milestone_pairs",
    """SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS doc, 'a' || CAST(turn AS STRING) AS id, 'hi' AS tag, CAST(length(role) AS INT) AS start_pos, CAST(length(role) * 3 AS INT) AS end_pos,
    2 AS tag_index, 4 AS end_index, 1 AS parent, 3 AS end_parent FROM conversations WHERE turn % 4 <> 3""",
)
def _(g):
    return markup.pair_milestones(markup.to_ranges(_milestones(g), "doc", "xml"))[0]


@query(
    "m03_unpaired_milestones",
    "SELECT CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS doc, 'a' || CAST(turn AS STRING) AS id, 'not closed' AS problem FROM conversations WHERE turn % 4 = 3",
)
def _(g):
    return markup.pair_milestones(markup.to_ranges(_milestones(g), "doc", "xml"))[1]


@query(
    "m04_changed_tags",
    """SELECT uuid, 'added' AS change FROM tags WHERE cls = 'click' AND start_index % 2 <> 0 UNION ALL SELECT uuid, 'removed' FROM tags WHERE cls <> 'click' AND start_index % 2 = 0""",
)
def _(g):
    return markup.changed_tags(g.tags.where("start_index % 2 = 0"), g.tags.where("cls = 'click'"))


def _turn_pairs(g):
    """Every turn of a conversation with the one two turns earlier, as versions of a text."""
    now = g.conversations.select("conv_id", "turn", c("text").alias("derived"))
    old = g.conversations.select("conv_id", (c("turn") + 2).alias("turn"), c("text").alias("base"))
    pair = F.concat_ws(":", c("conv_id").cast("string"), c("turn").cast("string"))
    return old.join(now, ["conv_id", "turn"]).select(pair.alias("pair"), "base", "derived")


@query(
    "m05_text_diffs",
    """SELECT CAST(a.conv_id AS STRING) || ':' || CAST(b.turn AS STRING) AS pair, TRUE AS base_whole, TRUE AS derived_whole FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 2""",
)
def _(g):
    pairs = _turn_pairs(g)
    diffs = markup.text_diffs(pairs).join(pairs, "pair")
    old = F.substr("base", c("base_start") + 1, c("base_end") - c("base_start"))
    new = F.substr("derived", c("derived_start") + 1, c("derived_end") - c("derived_start"))
    same = F.max((c("op") != "equal") | (old == new))
    pieces = lambda col, skip: F.array_join(F.array_sort(F.collect_list(F.when(c("op") != skip, F.struct("seq", col.alias("t"))))).getField("t"), "")
    rows = diffs.groupBy("pair").agg(pieces(old, "insert").alias("b"), pieces(new, "delete").alias("d"), F.first("base").alias("base"), F.first("derived").alias("derived"), same.alias("s"))
    return rows.select("pair", (c("s") & (c("b") == c("base"))).alias("base_whole"), (c("d") == c("derived")).alias("derived_whole"))


@query(
    "m06_inline_diffs",
    """SELECT CAST(p_partkey AS STRING) AS pair, split_part(p_name, ' ', 1) || ' <del>' || split_part(p_name, ' ', 2) || '</del><ins>&amp;' || '</ins>' AS marked FROM part""",
)
def _(g):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    pairs = g.part.select(c("p_partkey").cast("string").alias("pair"), c("p_name").alias("base"), F.concat(first, F.lit(" &")).alias("derived"))
    return markup.inline_diffs(pairs, markup.text_diffs(pairs))


_SIZES = "(SELECT CAST(p_partkey AS STRING) AS pair, CAST(length(split_part(p_name, ' ', 1)) AS INT) + 1 AS n, CAST(length(p_name) AS INT) AS whole FROM part)"


@query(
    "m05_diff_positions",
    f"""SELECT pair, 0 AS seq, 'equal' AS op, 0 AS base_start, n AS base_end, 0 AS derived_start, n AS derived_end FROM {_SIZES} x
    UNION ALL SELECT pair, 1, 'delete', n, whole, n, n FROM {_SIZES} x UNION ALL SELECT pair, 2, 'insert', whole, whole, n, n + 1 FROM {_SIZES} x""",
)
def _(g):
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return markup.text_diffs(g.part.select(c("p_partkey").alias("pair"), c("p_name").alias("base"), F.concat(first, F.lit(" &")).alias("derived")))


@query("m07_link_targets", "SELECT DISTINCT txt, link_target FROM tags WHERE link_target IS NOT NULL")
def _(g):
    return markup.link_targets(g.tags, "txt", "link_target")


_MAPPING = "(SELECT DISTINCT 'ns' AS namespace, p_type AS tag, '' AS css_class, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'Sized' ELSE p_type || 'Tag' END AS cls FROM part WHERE p_type <> 'PROMO')"


def _mapping(g):
    cls = F.when(c("p_type").isin("SMALL", "LARGE"), "Sized").otherwise(F.concat("p_type", F.lit("Tag")))
    return g.part.where("p_type <> 'PROMO'").select(F.lit("ns").alias("namespace"), c("p_type").alias("tag"), F.lit("").alias("css_class"), cls.alias("cls")).distinct()


@query(
    "m08_mapped_tags",
    f"""SELECT p_partkey, m.cls FROM part JOIN {_MAPPING} m ON m.tag = p_type UNION ALL SELECT p_partkey, '(none)' FROM part WHERE p_type = 'PROMO'""",
)
def _(g):
    tags = g.part.select("p_partkey", F.lit("ns").alias("namespace"), c("p_type").alias("tag"), F.lit("").alias("css_class"))
    mapped, lacking = markup.map_tags(tags, _mapping(g))
    return mapped.select("p_partkey", "cls").union(lacking.select("p_partkey", F.lit("(none)")))


@query("m08_inverted_mapping", f"SELECT cls, min(tag) AS tag, count(*) = 1 AS is_unique FROM {_MAPPING} m GROUP BY cls HAVING count(*) = 1 UNION ALL SELECT cls, NULL, FALSE FROM {_MAPPING} m GROUP BY cls HAVING count(*) > 1")
def _(g):
    unique, several = markup.invert_mapping(_mapping(g))
    return unique.select("cls", "tag", F.lit(True).alias("is_unique")).union(several.select("cls", F.lit(None).cast("string"), F.lit(False)))


@query(
    "m09_separators",
    f"SELECT CAST(doc_id AS STRING) AS doc, replace({_CLEAN}, chr(10), chr(30)) || chr(30) AS text FROM documents",
)
def _(g):
    return markup.to_ranges(_xml_documents(g), "doc_id", "xml", separated=["p"]).where("tag_index = 0").select("doc", "text")


@query(
    "m10_typed_tags",
    """SELECT tag, CASE WHEN start_index % 3 = 0 THEN start_index * 2 END AS number, link_target AS target, CASE WHEN start_index % 5 = 0 THEN DATE '2020-01-01' + CAST(start_index % 300 AS INT) END AS day FROM tags""",
)
def _(g):
    i = c("start_index")
    attribute = lambda test, name, value: g.tags.where(test).select("tag", F.lit(name).alias("name"), value.alias("value"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), i % 300).cast("string")
    attributes = (
        attribute(i % 3 == 0, "n", (i * 2).cast("string"))
        .union(attribute(i % 3 == 1, "n", F.lit("many")))
        .union(attribute(c("link_target").isNotNull(), "href", c("link_target")))
        .union(attribute(i % 5 == 0, "when", day))
    )
    kinds = {"number": ("n", "int"), "target": ("href", "string"), "day": ("when", "date")}
    return markup.typed_tags(g.tags.select("tag"), attributes, kinds)


def _statements(g):
    return g.triples.of().select("s", "p", "o")


@query(
    "n01_deletion_flags",
    """SELECT s, o FROM triples WHERE p = 'isDeleted' UNION ALL SELECT k.s, 'false' FROM (SELECT s, min(o) AS cls FROM triples WHERE p = 'type' GROUP BY s) k
    WHERE k.cls <> 'LinkValue' AND NOT EXISTS (SELECT 1 FROM triples f WHERE f.s = k.s AND f.p = 'isDeleted')""",
)
def _(g):
    return migrations.add_missing_deletion_flag(_statements(g), ["LinkValue"]).where("p = 'isDeleted'").select("s", "o")


@query(
    "n02_merged_permissions",
    """SELECT s, 'permissions' AS p, string_agg(part, '|' ORDER BY code) AS o FROM (SELECT 'part/' || CAST(l_partkey AS STRING) AS s, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 6 END AS code,
    CASE l_returnflag WHEN 'A' THEN 'RV ' WHEN 'N' THEN 'V ' ELSE 'M ' END || string_agg(DISTINCT 'g' || CAST(l_suppkey AS STRING), ',' ORDER BY 'g' || CAST(l_suppkey AS STRING)) AS part
    FROM lineitem GROUP BY 1, 2, l_returnflag) z GROUP BY s""",
)
def _(g):
    held = g.lineitem.select(
        F.concat(F.lit("part/"), c("l_partkey").cast("string")).alias("s"),
        F.concat(F.lit("has"), "l_returnflag").alias("p"),
        F.concat(F.lit("g"), c("l_suppkey").cast("string")).alias("o"),
    )
    return migrations.merge_permissions(held, {"hasA": "RV", "hasN": "V", "hasR": "M"})


@query(
    "n03_string_forms",
    """SELECT iri AS s, coalesce(as_string, CAST(as_int AS STRING), CAST(as_decimal AS STRING), as_node) AS o FROM vals WHERE vtype IN ('IntValue', 'DecimalValue', 'ListValue', 'TextValue')
    UNION ALL SELECT link_value, dst FROM links UNION ALL SELECT v.iri, strftime(date_trunc('month', o.o_orderdate), '%Y-%m-%d CE') || ' - ' || strftime(last_day(o.o_orderdate), '%Y-%m-%d CE')
    FROM vals v JOIN orders o ON v.resource = 'order/' || CAST(o.o_orderkey AS STRING) WHERE v.vtype = 'DateValue'""",
)
def _(g):
    dated = g.vals.where("vtype = 'DateValue'")
    facts = {"startJDN": c("start_jdn"), "endJDN": c("end_jdn"), "calendar": F.lit("GREGORIAN")}
    extra = dated.select(c("iri").alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.cast("string").alias("o")) for p, o in facts.items()])))
    out = migrations.fill_string_form(_statements(g).union(extra))
    return out.where("p = 'asString'").select("s", "o")


@query("n04_renamed_properties", "SELECT iri AS s, 'startJDN' AS p, CAST(start_jdn AS STRING) AS o FROM vals WHERE vtype = 'DateValue' UNION ALL SELECT iri, 'prec', prec FROM vals WHERE vtype = 'DateValue'")
def _(g):
    dated = g.vals.where("vtype = 'DateValue'")
    rows = dated.select(c("iri").alias("s"), F.lit("startJDC").alias("p"), c("start_jdn").cast("string").alias("o"))
    return migrations.rename_properties(rows.union(dated.select("iri", F.lit("prec"), "prec")), migrations.DAY_NUMBER_NAMES)


@query(
    "n05_value_projects",
    "SELECT p, count(*) AS n, count(DISTINCT s) AS n_subjects FROM (SELECT s, p, o FROM triples UNION ALL SELECT iri, 'project', project FROM resources) z GROUP BY p",
)
def _(g):
    named = g.resources.select("iri", F.lit("project"), "project").union(g.vals.select("iri", F.lit("project"), "project"))
    rows = migrations.drop_value_projects(_statements(g).union(named))
    # Hardly a subject has a property twice in one task: counting before the move only fills memory.
    held = rows.select("s", "p").repartition("s").groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("p").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_subjects"))


def _owned(g):
    return g.resources.select(c("iri").alias("s"), F.lit("permissions").alias("p"), F.replace("permissions", F.lit("Creator"), F.lit("Owner")).alias("o"))


@query("n06_owner_to_creator", "SELECT iri AS s, 'permissions' AS p, permissions AS o FROM resources")
def _(g):
    return migrations.owner_to_creator(_owned(g))


@query(
    "n07_creator_rights",
    """SELECT iri AS s, 'permissions' AS p, CASE k % 5 WHEN 0 THEN 'CR Creator|D ProjectMember|V KnownUser,UnknownUser' WHEN 1 THEN 'CR Creator|M ProjectMember|V KnownUser' WHEN 2 THEN 'CR Creator|V ProjectMember'
    WHEN 3 THEN 'CR Creator|D ProjectMember|RV UnknownUser' ELSE 'CR Creator' END AS o FROM resources""",
)
def _(g):
    rows = g.resources.select(c("iri").alias("s"), F.lit("permissions").alias("p"), c("permissions").alias("o"))
    return migrations.grant_creator(rows)


@query(
    "n08_region_labels",
    """SELECT 'part/' || CAST(p_partkey AS STRING) AS s, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS o FROM part""",
)
def _(g):
    iri = F.concat(F.lit("part/"), c("p_partkey").cast("string"))
    comment = F.concat(iri, F.lit("/c"))
    label = F.when(c("p_partkey") % 3 == 0, F.lit("a test")).when(c("p_partkey") % 7 != 0, c("p_name"))
    facts = [(iri, "type", F.lit("Region")), (iri, "label", label), (iri, "hasComment", comment), (comment, "asString", c("p_brand"))]
    rows = g.part.select(F.inline(F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in facts]))).where("o IS NOT NULL")
    return migrations.label_regions(rows).where("p = 'label'").select("s", "o")


@query(
    "n09_markup_classes",
    """SELECT tag AS s, 'type' AS p, CASE cls WHEN 'click' THEN 'new#StandoffBoldTag' WHEN 'view' THEN 'new#StandoffStyleElementTag' ELSE 'old#' || cls END AS o FROM tags""",
)
def _(g):
    name = F.when(c("cls") == "click", "StandoffBoldTag").when(c("cls") == "view", "StandoffStyleTag").otherwise(c("cls"))
    rows = g.tags.select(c("tag").alias("s"), F.lit("type").alias("p"), F.concat(F.lit("old#"), name).alias("o"))
    return migrations.rename_markup_classes(rows, "old#", "new#")


@query(
    "n10_gui_order",
    """SELECT 'r/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_partkey AS STRING) AS s, 'guiOrder' AS p, CAST(p_size AS STRING) AS o FROM order_parts JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 <> 0""",
)
def _(g):
    prop = lambda key: F.concat(F.lit("prop/"), key.cast("string"))
    order = F.when(c("p_partkey") % 4 != 0, c("p_size").cast("string"))
    facts = [("type", F.lit("ObjectProperty")), ("guiOrder", order)]
    props = g.part.select(prop(c("p_partkey")).alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts]))).where("o IS NOT NULL")
    iri = F.concat_ws("/", F.lit("r"), c("l_orderkey").cast("string"), c("l_partkey").cast("string"))
    facts = [("type", F.lit("Restriction")), ("onProperty", prop(c("l_partkey")))]
    rest = g.order_parts.select(iri.alias("s"), F.inline(F.array(*[F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts])))
    return migrations.move_gui_order(props.union(rest)).where("p = 'guiOrder'")


@query(
    "n11_all_steps",
    """SELECT iri AS s, 'permissions' AS p, CASE k % 5 WHEN 0 THEN 'CR Creator|D ProjectMember|V KnownUser,UnknownUser' WHEN 1 THEN 'CR Creator|M ProjectMember|V KnownUser' WHEN 2 THEN 'CR Creator|V ProjectMember'
    WHEN 3 THEN 'CR Creator|D ProjectMember|RV UnknownUser' ELSE 'CR Creator' END AS o FROM resources""",
)
def _(g):
    steps = [
        migrations.owner_to_creator,
        lambda t: migrations.rename_properties(t, migrations.DAY_NUMBER_NAMES),
        migrations.drop_value_projects,
        migrations.grant_creator,
    ]
    return migrations.run(_owned(g), steps)


def _work_folder(g, name):
    return f"{shared_dir(g.spark).rstrip('/')}/wovengraph/{name}-{uuid.uuid4().hex}"


_DT = "http://www.w3.org/2001/XMLSchema#integer"


def _lines(g):

    rows = g.documents.select(
        F.concat(F.lit("g"), (c("doc_id") % 3).cast("string")).alias("graph"),
        F.concat(F.lit("http://d/"), c("doc_id").cast("string")).alias("s"),
        F.lit("http://p/text").alias("p"),
        c("text").alias("o"),
        F.lit("literal").alias("o_kind"),
        F.lit(None).cast("string").alias("o_dt"),
        c("lang").alias("o_lang"),
        F.lit("iri").alias("s_kind"),
    )
    sizes = g.documents.select(
        F.lit("g9"), F.concat(F.lit("b"), c("doc_id").cast("string")), F.lit("http://p/size"), c("n_chars").cast("string"),
        F.lit("literal"), F.lit(_DT), F.lit(None), F.lit("blank"),
    )
    return rows.union(sizes)


@query(
    "s01_lines_round_trip",
    f"""SELECT 'g' || CAST(doc_id % 3 AS STRING) AS graph, 'http://d/' || CAST(doc_id AS STRING) AS s, 'http://p/text' AS p, text AS o, 'literal' AS o_kind, NULL AS o_dt, lang AS o_lang, 'iri' AS s_kind FROM documents
    UNION ALL SELECT 'g9', 'b' || CAST(doc_id AS STRING), 'http://p/size', CAST(n_chars AS STRING), 'literal', '{_DT}', NULL, 'blank' FROM documents""",
)
def _(g):
    return ntriples.parse_lines(ntriples.format_lines(_lines(g)), "default")


@query(
    "s01_stored_graphs",
    """SELECT graph, count(*) AS n FROM (SELECT project AS graph FROM resources WHERE project <> 'project/2' UNION ALL SELECT 'project/2' FROM resources WHERE project = 'project/2' AND cls LIKE 'Part/%'
    UNION ALL SELECT project FROM resources WHERE project = 'project/1') z GROUP BY graph""",
)
def _(g):
    path = _work_folder(g, "store")
    labels = g.triples.of("label")
    ntriples.save_graphs(labels, path)
    ntriples.save_graphs(labels.where((c("graph") == "project/2") & c("s").startswith("part/")), path)
    ntriples.save_graphs(labels.where(c("graph") == "project/1"), path, replace=False)
    return g.spark.read.parquet(path).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


@query("s03_reset", "SELECT project AS graph, count(*) AS n FROM resources WHERE cls LIKE 'Order/%' AND project <> 'project/0' GROUP BY project")
def _(g):
    path = _work_folder(g, "store")
    labels = g.triples.of("label")
    ntriples.save_graphs(labels, path)
    ntriples.reset(labels.where((c("graph") != "project/0") & c("s").startswith("order/")), path)
    return g.spark.read.parquet(path).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s04_bulk_ingest",
    """SELECT 'c' || CAST(o_orderkey AS STRING) AS client_id, 'placedBy' AS prop, CASE WHEN c_custkey IS NULL THEN 'ref:u' || CAST(o_custkey AS STRING) END AS target,
    CASE WHEN c_custkey IS NULL THEN 'dangling reference' ELSE 'linked' END AS problem FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 5 <> 0""",
)
def _(g):
    id_ = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    orders = g.orders.select(id_("c", c("o_orderkey")).alias("client_id"))
    customers = g.customer.where("c_custkey % 5 <> 0").select(id_("u", c("c_custkey")).alias("client_id"))
    values = g.orders.select(id_("c", c("o_orderkey")).alias("client_id"), F.lit("total").alias("prop"), "o_totalprice")
    links = g.orders.select(id_("c", c("o_orderkey")).alias("client_id"), F.lit("placedBy").alias("prop"), id_("ref:u", c("o_custkey")).alias("target"))
    _, _, made, problems = ingest.bulk_ingest(orders.union(customers), values, links, "http://data/0001", "batch-1")
    return problems.union(made.select("client_id", "prop", F.lit(None).cast("string"), F.lit("linked")))


@query(
    "s05_catalogue",
    """SELECT 'nation/' || CAST(n_nationkey AS STRING) AS project, n_name AS longname, d.dataset, d.title, CAST(0 AS BIGINT) AS part, d.files FROM
    (SELECT c_nationkey, 'customer/' || CAST(c_custkey AS STRING) AS dataset, c_name AS title, string_agg(CAST(o_orderkey AS STRING), ',' ORDER BY o_orderkey) AS files,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY 'customer/' || CAST(c_custkey AS STRING)) AS rn FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_custkey, c_name) d
    JOIN nation ON n_nationkey = c_nationkey WHERE rn <= 20""",
)
def _(g):
    id_ = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    projects = g.nation.select(id_("nation/", c("n_nationkey")).alias("project"), c("n_name").alias("longname"))
    datasets = g.customer.select(id_("nation/", c("c_nationkey")).alias("project"), id_("customer/", c("c_custkey")).alias("dataset"), c("c_name").alias("title"))
    files = g.orders.select(id_("customer/", c("o_custkey")).alias("dataset"), c("o_orderkey").alias("seqnum"), c("o_orderkey").cast("string").alias("file"))
    rows = sinks.catalogue(projects, datasets, files, limit=20)
    return rows.withColumn("files", F.array_join("files.file", ","))


@query(
    "s06_jsonld",
    """SELECT r.iri, r.label, (SELECT count(*) FROM vals v WHERE v.resource = r.iri) AS n_values, (SELECT count(*) FROM labels_by_lang l WHERE l.node = r.iri) AS n_labels,
    (SELECT max(v.as_int) FROM vals v WHERE v.resource = r.iri AND v.prop = 'hasSize') AS size FROM resources r""",
)
def _(g):
    literal = F.coalesce("as_string", c("as_int").cast("string"), c("as_decimal").cast("string"), c("as_boolean").cast("string"), "as_uri", "as_node", c("start_jdn").cast("string"))
    values = g.vals.select("resource", "prop", c("iri").alias("value"), literal.alias("literal"))
    labels = g.labels_by_lang.select(c("node").alias("iri"), "lang", "label")
    rows = sinks.resources_jsonld(g.resources, values, labels)
    doc = F.from_json("json", "`@id` string, label string, values map<string,array<struct<`@id`:string,`@value`:string>>>, labels array<struct<`@language`:string,`@value`:string>>")
    out = rows.select("iri", doc.alias("d"))
    counted = F.coalesce(F.aggregate(F.map_values("d.values"), F.lit(0), lambda acc, x: acc + F.size(x)), F.lit(0)).cast("long")
    size = c("d.values")["hasSize"][0]["@value"].cast("int")
    return out.select("iri", c("d.label").alias("label"), counted.alias("n_values"), F.coalesce(F.size("d.labels"), F.lit(0)).cast("long").alias("n_labels"), size.alias("size"))


@query(
    "s07_subject_view",
    """SELECT s, CAST(0 AS BIGINT) AS part, count(*) AS n, string_agg(DISTINCT p, ',' ORDER BY p) AS props FROM (SELECT DISTINCT s, p, o FROM triples) z GROUP BY s""",
)
def _(g):
    rows = sinks.subject_view(g.triples.by_subject())
    props = F.array_join(F.array_distinct(F.transform("statements", lambda x: x["p"])), ",")
    return rows.select("s", "part", F.size("statements").cast("long").alias("n"), props.alias("props"))
