"""Inference and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import inference, integrity
from wovengraph.plans import fixture
from wovengraph.plans.q_hierarchy import INHERITED_SQL, _inherited
from wovengraph.plans.registry import query
from wovengraph.session import settle

c = F.col
FIX = fixture.FIXTURES
FIX["inherited"] = INHERITED_SQL
FIX["held"] = "SELECT resource AS s, prop, iri AS o, is_deleted FROM vals UNION ALL SELECT src, prop, dst, is_deleted FROM links"
FIX["cards"] = "SELECT r.iri AS s, i.cls, i.prop, i.card FROM resources r JOIN inherited i ON i.cls = r.cls"
FIX["types"] = "SELECT iri, cls FROM resources UNION ALL SELECT iri, vtype FROM vals"
_REPORT = "SELECT '{rule}' AS rule, {subject} AS subject, {prop} AS property, CAST({detail} AS STRING) AS detail FROM {rest}"


def _report(rule, subject, prop, detail, rest):
    return _REPORT.format(rule=rule, subject=subject, prop=prop, detail=detail, rest=rest)


def _constraints(g, column):
    return g.prop_constraints.select("prop", c(column).alias("cls"))


def _rules(g):
    return inference.compile_rules(g.class_closure, g.prop_closure, _constraints(g, "subject_class"), _constraints(g, "object_class"))


def _own_rules(g):
    """Without the classes' own bases."""
    return inference.compile_rules(g.class_closure.limit(0), g.prop_closure, _constraints(g, "subject_class"), _constraints(g, "object_class"))


def _held(g):
    return integrity.holdings(g.vals, g.links)


def _types(g):
    return g.resources.select("iri", "cls").union(g.vals.select("iri", "vtype"))


def _cards(g):
    return inference.cardinality_table(g.resources, _inherited(g))


_PROPS = "(SELECT t.s, coalesce(k.ancestor, t.p) AS p, t.o, t.o_kind FROM triples t LEFT JOIN prop_closure k ON k.node = t.p WHERE t.p <> 'type')"
_DOMAIN = f"SELECT q.s, d.subject_class AS o FROM {_PROPS} q JOIN prop_constraints d ON d.prop = q.p"
_RANGE = f"SELECT q.o AS s, d.object_class AS o FROM {_PROPS} q JOIN prop_constraints d ON d.prop = q.p WHERE q.o_kind <> 'literal'"


@query("r01_types_by_domain", f"SELECT DISTINCT s, o FROM ({_DOMAIN})")
def _(g):
    return inference.types_of(g.triples.of(), _own_rules(g), "s")


@query("r02_types_by_range", f"SELECT DISTINCT s, o FROM ({_RANGE})")
def _(g):
    return inference.types_of(g.triples.of(), _own_rules(g), "o")


@query(
    "r03_property_hierarchy",
    "SELECT k.node AS s, 'subPropertyOf' AS p, k.ancestor AS o, (SELECT count(*) FROM vals v WHERE v.prop = k.node) AS used FROM prop_closure k",
)
def _(g):
    used = g.vals.groupBy(c("prop").alias("s")).agg(F.count(F.lit(1)).alias("used"))
    rows = inference.hierarchy_statements(g.prop_closure, "subPropertyOf").join(used, "s", "left")
    return rows.withColumn("used", F.coalesce("used", F.lit(0)))


@query("r04_inherited_properties", f"SELECT p, count(*) AS n FROM {_PROPS} q GROUP BY p")
def _(g):
    rows = inference.inherited_properties(g.triples.of(), g.prop_closure)
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("r05_class_hierarchy", "SELECT node AS s, 'subClassOf' AS p, ancestor AS o FROM class_closure")
def _(g):
    return inference.hierarchy_statements(g.class_closure, "subClassOf")


@query("r06_inherited_types", "SELECT t.s, coalesce(k.ancestor, t.o) AS o FROM triples t LEFT JOIN class_closure k ON k.node = t.o WHERE t.p = 'type'")
def _(g):
    return inference.inherited_types(g.triples.of("type").select("s", "o"), g.class_closure)


@query(
    "r07_everything_is_a_resource",
    """SELECT o, count(*) AS n FROM (SELECT DISTINCT s, 'Resource' AS o FROM (SELECT s FROM triples UNION ALL SELECT o FROM triples WHERE o_kind <> 'literal') a
    UNION ALL SELECT DISTINCT p, 'Property' FROM (SELECT p FROM triples UNION ALL SELECT * FROM (VALUES ('first'), ('rest'), ('value')) AS a(p)) q) z GROUP BY o""",
)
def _(g):
    rows = inference.everything_is_a_resource(g.triples.of()).where("p = 'type' AND o IN ('Resource', 'Property')").distinct()
    return rows.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r_infer_all",
    f"""WITH found AS (SELECT s, o FROM triples WHERE p = 'type' UNION {_DOMAIN} UNION {_RANGE}),
    every AS (SELECT s, p, o FROM triples UNION SELECT s, p, o FROM {_PROPS} q UNION
    SELECT f.s, 'type', coalesce(k.ancestor, f.o) FROM found f LEFT JOIN class_closure k ON k.node = f.o
    UNION SELECT node, 'subClassOf', ancestor FROM class_closure UNION SELECT node, 'subPropertyOf', ancestor FROM prop_closure)
    SELECT e.p, count(*) AS n, count(*) FILTER (WHERE t.s IS NOT NULL) AS n_asserted FROM every e
    LEFT JOIN (SELECT DISTINCT s, p, o FROM triples) t ON t.s = e.s AND t.p = e.p AND t.o = e.o GROUP BY e.p""",
)
def _(g):
    rows = inference.infer(
        g.triples.by_subject(), g.class_closure, g.prop_closure, _constraints(g, "subject_class"), _constraints(g, "object_class")
    )
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_if("asserted").alias("n_asserted"))


_AXIOM_ROWS = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in inference.AXIOMS + inference.MEMBERSHIP)


@query(
    "r_infer_axioms",
    f"""WITH ax AS (SELECT * FROM (VALUES {_AXIOM_ROWS}) AS a(s, p, o)),
    every_t AS (SELECT s, p, o, o_kind FROM triples UNION ALL SELECT s, p, o, 'iri' FROM ax),
    cls_up AS (SELECT node AS s, ancestor AS o FROM class_closure UNION SELECT s, o FROM ax WHERE p = 'subClassOf' UNION SELECT s, 'Literal' FROM ax WHERE p = 'type' AND o = 'Datatype'
        UNION SELECT s, s FROM ax WHERE p = 'subClassOf' UNION SELECT o, o FROM ax WHERE p = 'subClassOf' UNION SELECT s, s FROM ax WHERE p = 'type' AND o = 'Datatype' UNION SELECT 'Literal', 'Literal'
        UNION SELECT c.s, k.o FROM cls_up c JOIN ax k ON k.p = 'subClassOf' AND k.s = c.o),
    prop_up2 AS (SELECT node AS s, ancestor AS o FROM prop_closure UNION SELECT * FROM (VALUES ('isDefinedBy', 'seeAlso'), ('_1', 'member'), ('isDefinedBy', 'isDefinedBy'), ('seeAlso', 'seeAlso'), ('_1', '_1'), ('member', 'member')) v),
    rules AS (SELECT prop, subject_class AS cls, 's' AS side FROM prop_constraints UNION SELECT prop, object_class, 'o' FROM prop_constraints
        UNION SELECT s, o, CASE p WHEN 'domain' THEN 's' ELSE 'o' END FROM ax WHERE p IN ('domain', 'range') AND o <> 'Resource'),
    props AS (SELECT t.s, coalesce(k.o, t.p) AS p, t.o, t.o_kind FROM every_t t LEFT JOIN prop_up2 k ON k.s = t.p WHERE t.p <> 'type'),
    found AS (SELECT s, o FROM every_t WHERE p = 'type' UNION SELECT q.s, r.cls FROM props q JOIN rules r ON r.prop = q.p AND r.side = 's'
        UNION SELECT q.o, r.cls FROM props q JOIN rules r ON r.prop = q.p AND r.side = 'o' WHERE q.o_kind <> 'literal'),
    every AS (SELECT s, p, o FROM every_t UNION SELECT s, p, o FROM props UNION SELECT f.s, 'type', coalesce(k.o, f.o) FROM found f LEFT JOIN cls_up k ON k.s = f.o
        UNION SELECT s, 'subClassOf', o FROM cls_up UNION SELECT s, 'subPropertyOf', o FROM prop_up2)
    SELECT p, CASE WHEN p = 'type' THEN o ELSE '' END AS cls, count(*) AS n FROM every GROUP BY 1, 2""",
)
def _(g):
    rows = inference.infer(
        g.triples.by_subject(), g.class_closure, g.prop_closure, _constraints(g, "subject_class"), _constraints(g, "object_class"), axioms=True
    )
    return rows.groupBy("p", F.when(c("p") == "type", c("o")).otherwise("").alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def _every_sql(name, rows):
    props = f"(SELECT t.s, coalesce(k.ancestor, t.p) AS p, t.o, t.o_kind FROM {rows} t LEFT JOIN prop_closure k ON k.node = t.p WHERE t.p <> 'type')"
    return f"""{name} AS (SELECT s, p, o FROM {rows} UNION SELECT s, p, o FROM {props} q UNION SELECT f.s, 'type', coalesce(k.ancestor, f.o) FROM (SELECT s, o FROM {rows} WHERE p = 'type'
    UNION SELECT q.s, d.subject_class FROM {props} q JOIN prop_constraints d ON d.prop = q.p UNION SELECT q.o, d.object_class FROM {props} q JOIN prop_constraints d ON d.prop = q.p
    WHERE q.o_kind <> 'literal') f LEFT JOIN class_closure k ON k.node = f.o)"""


_LATE = "starts_with(s, 'customer/') OR starts_with(s, 'text/1')"


@query(
    "r_infer_added",
    f"""WITH old AS (SELECT * FROM triples WHERE NOT ({_LATE})), {_every_sql('every_old', 'old')}, {_every_sql('every_new', 'triples')}
    SELECT p, count(*) AS n FROM (SELECT * FROM every_new EXCEPT SELECT * FROM every_old) GROUP BY p""",
)
def _(g):
    rules, triples = settle(_rules(g)), g.triples.of()
    late = c("s").startswith("customer/") | c("s").startswith("text/1")
    return inference.infer_new(triples.where(late), triples.where(~late), rules).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("r08_cardinality_table", "SELECT s, cls, prop, card FROM cards")
def _(g):
    return _cards(g)


@query(
    "v01_empty_strings",
    _report("empty_string", "iri", "prop", "'as_string'", "vals WHERE CASE WHEN resource LIKE 'part/%' AND vorder = 2 THEN '' ELSE as_string END = ''"),
)
def _(g):
    spoiled = F.when(c("resource").startswith("part/") & (c("vorder") == 2), "").otherwise(c("as_string"))
    return integrity.empty_strings(g.vals.withColumn("as_string", spoiled))


@query(
    "v02_unconstrained_properties",
    "SELECT 'no_object_class' AS rule, k.node AS subject, k.node AS property, 'hasValue' AS detail FROM prop_closure k WHERE k.ancestor = 'hasValue' "
    "AND k.node <> 'hasValue' AND k.node NOT IN (SELECT prop FROM prop_constraints) AND k.node IN (SELECT prop FROM vals)",
)
def _(g):
    used = g.vals.select(c("prop").alias("subject"))
    return integrity.unconstrained_properties(g.prop_closure, g.prop_constraints, "hasValue").join(used, "subject", "left_semi").select(*integrity.COLUMNS)


@query(
    "v03_subject_class",
    _report("subject_class", "h.s", "h.prop", "r.cls", "held h JOIN prop_constraints p ON p.prop = h.prop JOIN resources r ON r.iri = h.s "
    "WHERE NOT EXISTS (SELECT 1 FROM class_closure k WHERE k.node = r.cls AND k.ancestor = p.subject_class)"),
)
def _(g):
    return integrity.wrong_subject_class(_held(g), g.resources.select("iri", "cls"), g.class_closure, g.prop_constraints)


@query(
    "v04_object_class",
    _report("object_class", "h.s", "h.prop", "h.o || ' ' || coalesce(t.cls, '(none)')", "held h JOIN prop_constraints p ON p.prop = h.prop LEFT JOIN types t ON t.iri = h.o "
    "WHERE coalesce(t.cls, '(none)') <> p.object_class AND NOT EXISTS (SELECT 1 FROM class_closure k WHERE k.node = t.cls AND k.ancestor = p.object_class)"),
)
def _(g):
    return integrity.wrong_object_class(_held(g), _types(g), g.class_closure, g.prop_constraints)


def _missing(card):
    return _report(f"missing_{card}", "c.s", "c.prop", "NULL", f"cards c WHERE c.card = '{card}' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.s = c.s AND h.prop = c.prop)")


@query("v05_missing_some", _missing("1-n"))
def _(g):
    return integrity.missing(_cards(g), _held(g), "1-n")


@query("v06_missing_one", _missing("1"))
def _(g):
    return integrity.missing(_cards(g), _held(g), "1")


@query(
    "v07_several_labels",
    _report("several_labels", "l.node", "'label'", "count(DISTINCT l.label)", "labels_by_lang l WHERE EXISTS (SELECT 1 FROM cards c WHERE c.s = l.node AND c.prop = 'label' AND c.card = '1') "
    "GROUP BY l.node HAVING count(DISTINCT l.label) > 1"),
)
def _(g):
    return integrity.several_labels(_cards(g), g.labels_by_lang.select(c("node").alias("s"), "label"))


_SUPPLIED = "(SELECT DISTINCT 'part/' || CAST(l_partkey AS STRING) AS s, 'suppliedBy' AS prop, CAST(l_suppkey AS STRING) AS o FROM lineitem)"


@query(
    "v08_several",
    _report("several", "q.s", "q.prop", "count(DISTINCT q.o)", f"{_SUPPLIED} q GROUP BY q.s, q.prop HAVING count(DISTINCT q.o) > 1"),
)
def _(g):
    part = F.concat(F.lit("part/"), c("l_partkey").cast("string"))
    supplied = g.lineitem.select(part.alias("s"), F.lit("suppliedBy").alias("prop"), c("l_suppkey").cast("string").alias("o"), F.lit(False).alias("is_deleted"))
    parts = g.resources.where(c("iri").startswith("part/"))
    cards = parts.select(c("iri").alias("s"), F.lit("suppliedBy").alias("prop"), F.lit("0-1").alias("card"))
    return integrity.too_many(cards, supplied, deletable=False)


@query(
    "v09_several_live",
    _report("several_live", "h.s", "h.prop", "count(DISTINCT h.o)", "held h WHERE NOT h.is_deleted AND EXISTS (SELECT 1 FROM cards c WHERE c.s = h.s AND c.prop = h.prop AND c.card IN ('1', '0-1')) "
    "GROUP BY h.s, h.prop HAVING count(DISTINCT h.o) > 1"),
)
def _(g):
    return integrity.too_many(_cards(g), _held(g), deletable=True)


@query(
    "v10_no_cardinality",
    _report("no_cardinality", "s", "prop", "cls", "(SELECT DISTINCT h.s, h.prop, r.cls FROM held h JOIN resources r ON r.iri = h.s "
    "WHERE NOT EXISTS (SELECT 1 FROM inherited i WHERE i.cls = r.cls AND i.prop = h.prop)) z"),
)
def _(g):
    return integrity.no_cardinality(_held(g), g.resources.select("iri", "cls"), _inherited(g))


_PARENTS = "(VALUES ('click','view'),('error','click'),('view','view'),('purchase','view'),('signup','view')) AS pc(cls, parent_class)"


@query(
    "v11_markup_parent",
    _report("markup_parent", "t.tag", "t.cls", "p.cls", f"tags t JOIN tags p ON p.tag = t.parent LEFT JOIN (SELECT * FROM {_PARENTS}) x ON x.cls = t.cls "
    "WHERE x.parent_class IS NULL OR x.parent_class <> p.cls"),
)
def _(g):
    return integrity.wrong_markup_parent(g.tags, g.spark.sql(f"SELECT * FROM {_PARENTS}"))


@query(
    "v12_ingest_problems",
    """WITH r AS (SELECT iri AS client_id, cls FROM resources WHERE cls NOT LIKE 'Page/%'), v AS (SELECT resource AS client_id, prop, CASE WHEN prop = 'hasSource' THEN 'IntValue' ELSE vtype END AS vtype FROM vals WHERE resource NOT LIKE 'page/%'),
    l AS (SELECT src AS client_id, prop, CASE WHEN prop = 'inRegion' THEN 'x/' ELSE '' END || dst AS target_id FROM links),
    sub AS (SELECT client_id, prop FROM v UNION ALL SELECT client_id, prop FROM l),
    n AS (SELECT s.client_id, s.prop, r.cls, count(*) AS n FROM sub s JOIN r ON r.client_id = s.client_id GROUP BY ALL)
    SELECT rule, subject, property, detail FROM (
    SELECT 'value_type' AS rule, v.client_id AS subject, v.prop AS property, v.vtype AS detail FROM v JOIN prop_constraints p ON p.prop = v.prop WHERE v.vtype <> p.object_class
    UNION ALL SELECT 'unknown_target', l.client_id, l.prop, l.target_id FROM l WHERE l.target_id NOT IN (SELECT client_id FROM r)
    UNION ALL SELECT 'target_class', l.client_id, l.prop, t.cls FROM l JOIN r t ON t.client_id = l.target_id JOIN prop_constraints p ON p.prop = l.prop
      WHERE NOT EXISTS (SELECT 1 FROM class_closure k WHERE k.node = t.cls AND k.ancestor = p.object_class)
    UNION ALL SELECT 'no_cardinality', n.client_id, n.prop, n.cls FROM n WHERE NOT EXISTS (SELECT 1 FROM inherited i WHERE i.cls = n.cls AND i.prop = n.prop)
    UNION ALL SELECT 'too_many', n.client_id, n.prop, CAST(n.n AS STRING) FROM n JOIN inherited i ON i.cls = n.cls AND i.prop = n.prop AND i.card IN ('1', '0-1') WHERE n.n > 1
    UNION ALL SELECT 'missing', r.client_id, i.prop, i.card FROM r JOIN inherited i ON i.cls = r.cls AND i.card IN ('1', '1-n')
      WHERE NOT EXISTS (SELECT 1 FROM sub s WHERE s.client_id = r.client_id AND s.prop = i.prop)) z""",
)
def _(g):
    resources = g.resources.where(~c("cls").startswith("Page/")).select(c("iri").alias("client_id"), "cls")
    vtype = F.when(c("prop") == "hasSource", "IntValue").otherwise(c("vtype"))
    values = g.vals.where(~c("resource").startswith("page/")).select(c("resource").alias("client_id"), "prop", vtype.alias("vtype"))
    target = F.concat(F.when(c("prop") == "inRegion", "x/").otherwise(""), "dst")
    links = g.links.select(c("src").alias("client_id"), "prop", target.alias("target_id"))
    return integrity.ingest_problems(resources, values, links, _inherited(g), g.prop_constraints, g.class_closure)


# Each data class gets its own cardinalities, so that the check grows with the classes.
_OWN = """SELECT e.child AS cls, c.prop, CASE WHEN length(e.child) % 2 = 0 THEN '0-n' ELSE '1' END AS card FROM class_edges e JOIN inherited c ON c.cls = e.parent"""


@query(
    "v13_incompatible_overrides",
    f"""WITH own AS ({_OWN}), pairs AS (SELECT cls, prop, card, prop AS base_prop FROM own UNION SELECT o.cls, o.prop, o.card, k.ancestor FROM own o JOIN prop_closure k ON k.node = o.prop)
    SELECT 'incompatible_cardinality' AS rule, p.cls AS subject, p.prop AS property, p.card || ' ' || p.base_prop || ' ' || i.card AS detail
    FROM pairs p JOIN class_edges e ON e.child = p.cls JOIN inherited i ON i.cls = e.parent AND i.prop = p.base_prop
    WHERE p.card <> i.card AND NOT (i.card = '0-n' OR (i.card IN ('0-1', '1-n') AND p.card = '1'))""",
)
def _(g):
    up = _inherited(g).select(c("cls").alias("parent"), "prop")
    card = F.when(F.length("child") % 2 == 0, "0-n").otherwise("1")
    own = g.class_edges.join(up, "parent").select(c("child").alias("cls"), "prop", card.alias("card"))
    return integrity.incompatible_overrides(own, g.class_edges, _inherited(g), g.prop_closure)


@query(
    "v14_constraint_not_narrower",
    """WITH used AS (SELECT r.cls AS prop, split_part(r.cls, '/', 1) AS base, r.cls AS own, CASE WHEN r.cls LIKE 'Part/%' THEN 'Agent' ELSE 'Doc' END AS wanted FROM (SELECT DISTINCT cls FROM resources WHERE cls LIKE 'Part/%' OR cls LIKE 'Text/%') r)
    SELECT 'subject_class' AS rule, prop AS subject, base AS property, own || ' ' || wanted AS detail FROM used u
    WHERE NOT EXISTS (SELECT 1 FROM class_closure k WHERE k.node = u.own AND k.ancestor = u.wanted)""",
)
def _(g):
    used = g.resources.where(c("cls").startswith("Part/") | c("cls").startswith("Text/")).select("cls").distinct()
    base = F.split_part("cls", F.lit("/"), F.lit(1))
    wanted = F.when(c("cls").startswith("Part/"), "Agent").otherwise("Doc")
    own = used.select(c("cls").alias("prop"), c("cls").alias("subject_class"))
    bases = used.select(base.alias("prop"), wanted.alias("subject_class")).distinct()
    closure = used.select(c("cls").alias("node"), base.alias("ancestor"))
    return integrity.constraint_not_narrower(own.union(bases), closure, g.class_closure, "subject_class")


@query(
    "v15_class_outside_constraint",
    """SELECT 'class_not_in_constraint' AS rule, i.cls AS subject, i.prop AS property, p.subject_class AS detail FROM inherited i JOIN prop_constraints p ON p.prop = i.prop
    WHERE i.cls IN (SELECT cls FROM resources) AND NOT EXISTS (SELECT 1 FROM class_closure k WHERE k.node = i.cls AND k.ancestor = p.subject_class)""",
)
def _(g):
    used = _inherited(g).join(g.resources.select("cls"), "cls", "left_semi")
    return integrity.class_outside_constraint(used, g.prop_constraints, g.class_closure)


@query(
    "v16_duplicate_values",
    """SELECT 'duplicate_value' AS rule, 'supplier/' || CAST(l_suppkey AS STRING) AS subject, 'quantity' AS property, CAST(CAST(l_quantity AS INT) AS STRING) AS detail
    FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_suppkey, l_quantity HAVING count(*) > 1""",
)
def _(g):
    resource = F.concat(F.lit("supplier/"), c("l_suppkey").cast("string"))
    values = g.lineitem.select(resource.alias("resource"), F.lit("quantity").alias("prop"), (c("l_linenumber") == 7).alias("is_deleted"), "l_quantity")
    return integrity.duplicate_values(values, c("l_quantity").cast("int").cast("string"))


@query(
    "v16_redundant_versions",
    """SELECT 'redundant_version' AS rule, iri AS subject, NULL AS property, as_string AS detail FROM vals WHERE prop = 'hasName' AND (vorder <> 0 OR as_string LIKE 'Customer%')""",
)
def _(g):
    names = g.vals.where("prop = 'hasName'")
    changed = F.when((c("vorder") == 0) & ~c("as_string").startswith("Customer"), F.upper("as_string")).otherwise(c("as_string"))
    edits = names.select(c("iri").alias("value"), changed.alias("literal"))
    return integrity.redundant_versions(edits, names.select(c("iri").alias("value"), c("as_string").alias("literal")))


_ATTRIBUTES = """(SELECT tag, 'id' AS name FROM tags WHERE start_index % 3 <> 0 UNION ALL SELECT tag, 'href' FROM tags WHERE start_index % 4 = 1
    UNION ALL SELECT tag, 'href' FROM tags WHERE start_index % 8 = 1)"""
_RULES = "(VALUES ('click','id','1'),('click','href','0-1'),('view','id','0-n'),('error','href','1-n')) AS rq(cls, name, card)"


@query(
    "v17_markup_attributes",
    f"""WITH n AS (SELECT a.tag, a.name, t.cls, count(*) AS n FROM {_ATTRIBUTES} a JOIN tags t ON t.tag = a.tag GROUP BY ALL), rq AS (SELECT * FROM {_RULES})
    SELECT 'unsupported_attribute' AS rule, tag AS subject, name AS property, cls AS detail FROM n WHERE NOT EXISTS (SELECT 1 FROM rq WHERE rq.cls = n.cls AND rq.name = n.name)
    UNION ALL SELECT 'repeated_attribute', tag, n.name, CAST(n AS STRING) FROM n JOIN rq ON rq.cls = n.cls AND rq.name = n.name AND rq.card IN ('1', '0-1') WHERE n > 1
    UNION ALL SELECT 'missing_attribute', t.tag, rq.name, t.cls FROM tags t JOIN rq ON rq.cls = t.cls AND rq.card IN ('1', '1-n') WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.tag = t.tag AND n.name = rq.name)""",
)
def _(g):
    i = c("start_index")
    named = lambda test, name: g.tags.where(test).select("tag", F.lit(name).alias("name"))
    attributes = named(i % 3 != 0, "id").union(named(i % 4 == 1, "href")).union(named(i % 8 == 1, "href"))
    return integrity.markup_attribute_problems(g.tags, attributes, g.spark.sql(f"SELECT * FROM {_RULES}"))


@query(
    "v18_text_references",
    """WITH found AS (SELECT txt, link_target AS target FROM tags WHERE link_target IS NOT NULL), declared AS (SELECT txt, link_target AS target FROM tags WHERE start_index % 10 <> 0 AND link_target IS NOT NULL
    UNION ALL SELECT txt, 'order/' || CAST(start_index + 14990 AS STRING) FROM tags WHERE start_index % 100 = 0)
    SELECT rule, txt AS subject, NULL AS property, target AS detail FROM (SELECT DISTINCT 'undeclared_reference' AS rule, txt, target FROM found f WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.txt = f.txt AND d.target = f.target)
    UNION ALL SELECT DISTINCT 'unused_reference', txt, target FROM declared d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE d.txt = f.txt AND d.target = f.target)
    UNION ALL SELECT DISTINCT 'unknown_target', txt, target FROM declared WHERE target NOT IN (SELECT iri FROM resources)) z""",
)
def _(g):
    found = g.tags.where("link_target IS NOT NULL").select(c("txt").alias("text"), c("link_target").alias("target"), "start_index")
    extra = F.concat(F.lit("order/"), (c("start_index") + 14990).cast("string"))
    declared = found.where("start_index % 10 <> 0").select("text", "target")
    declared = declared.union(g.tags.where("start_index % 100 = 0").select("txt", extra))
    return integrity.text_reference_problems(declared, found.select("text", "target"), g.resources.select(c("iri").alias("target")))
