"""The graph tables, mapped from the relational input tables.

The mapping is SQL text shared by both engines of the correctness check; query
logic is not shared. ``Graph`` gives the same tables as lazy DataFrames.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.operators import closure, ordering, tokenindex
from wovengraph.session import new_folder, settle
from wovengraph.sources import relational

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the test graph: five permission literals, chosen by key.
PERMISSIONS = [
    "CR Creator|D ProjectMember|V KnownUser,UnknownUser",
    "CR Creator|M ProjectMember|V KnownUser",
    "CR Creator|V ProjectMember",
    "D ProjectMember|RV UnknownUser",
    "CR Creator",
]


def _perm(key: str, shift: int = 0) -> str:
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PERMISSIONS))
    return f"CASE ({key} + {shift}) % 5 {whens} END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _owner(key: str) -> str:
    return f"'user/' || {_text(f'{key} % 10')} AS creator, 'project/' || {_text(f'{key} % 4')} AS project"


def _resource(table: str, kind: str, key: str, cls: str, label: str, deleted: str = "FALSE") -> str:
    return (
        f"SELECT '{kind}/' || {_text(key)} AS iri, CAST({key} AS BIGINT) AS k, {cls} AS cls, {label} AS label, "
        f"{_owner(key)}, {_perm(key)} AS permissions, {deleted} AS is_deleted FROM {table}"
    )


_VALUE_COLUMNS = {
    "as_string": "STRING",
    "as_int": "INT",
    "as_decimal": "DECIMAL(18,2)",
    "as_boolean": "BOOLEAN",
    "as_uri": "STRING",
    "as_node": "STRING",
    "start_jdn": "INT",
    "end_jdn": "INT",
    "prec": "STRING",
}


def _value(table: str, kind: str, key: str, prop: str, vtype: str, shift: int, deleted: str = "FALSE", **cols: str) -> str:
    literals = ", ".join(f"CAST({cols.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _VALUE_COLUMNS.items())
    subject = f"'{kind}/' || {_text(key)}"
    return (
        f"SELECT {subject} || '/{prop}' AS iri, {subject} AS resource, '{prop}' AS prop, '{vtype}' AS vtype, "
        f"CAST({key} % 3 AS INT) AS vorder, {literals}, {_owner(key)}, {_perm(key, shift)} AS permissions, "
        f"{deleted} AS is_deleted FROM {table}"
    )


def _link(table: str, src: str, key: str, prop: str, dst: str, count: str, shift: int, deleted: str = "FALSE") -> str:
    return (
        f"SELECT '{src}/' || {_text(key)} || '/{prop}/' || {dst} AS link_value, '{src}/' || {_text(key)} AS src, "
        f"'{prop}' AS prop, {dst} AS dst, CAST({count} AS BIGINT) AS ref_count, {_owner(key)}, "
        f"{_perm(key, shift)} AS permissions, {deleted} AS is_deleted FROM {table}"
    )


def _union(*branches: str) -> str:
    return " UNION ALL ".join(branches)


def _jdn(expr: str) -> str:
    return f"@JDN({expr})"


_month_start = _jdn("date_trunc('month', o_orderdate)")
_month_end = _jdn("last_day(o_orderdate)")

FIXTURES: dict[str, str] = {
    "resources": _union(
        _resource("orders", "order", "o_orderkey", "'Order/' || o_orderpriority", "'Order ' || " + _text("o_orderkey"), "o_orderstatus = 'P'"),
        _resource("customer", "customer", "c_custkey", "'Customer/' || c_mktsegment", "c_name"),
        _resource("supplier", "supplier", "s_suppkey", "'Supplier'", "s_name"),
        _resource("part", "part", "p_partkey", "'Part/' || p_type || '/' || p_brand", "p_name"),
        _resource("documents", "text", "doc_id", "'Text/' || lang", "'Text ' || " + _text("doc_id")),
        _resource("pages", "page", "page_id", "'Page/' || split_part(url, '/', 3)", "url"),
        _resource("nation", "nation", "n_nationkey", "'Place'", "n_name"),
        _resource("region", "region", "r_regionkey", "'Place'", "r_name"),
    ),
    "vals": _union(
        _value("orders", "order", "o_orderkey", "hasTotal", "DecimalValue", 1, as_decimal="o_totalprice"),
        _value("orders", "order", "o_orderkey", "hasDate", "DateValue", 2, "o_orderkey % 13 = 0", start_jdn=_month_start, end_jdn=_month_end, prec="'MONTH'"),
        _value("orders", "order", "o_orderkey", "isFulfilled", "BooleanValue", 3, as_boolean="o_orderstatus = 'F'"),
        _value("customer", "customer", "c_custkey", "hasBalance", "DecimalValue", 1, as_decimal="c_acctbal"),
        _value("customer", "customer", "c_custkey", "hasPlace", "ListValue", 0, as_node="'nation/' || " + _text("c_nationkey")),
        _value("customer", "customer", "c_custkey", "hasName", "TextValue", 0, as_string="c_name"),
        _value("supplier", "supplier", "s_suppkey", "hasBalance", "DecimalValue", 1, as_decimal="s_acctbal"),
        _value("supplier", "supplier", "s_suppkey", "hasPlace", "ListValue", 0, as_node="'nation/' || " + _text("s_nationkey")),
        _value("part", "part", "p_partkey", "hasSize", "IntValue", 1, as_int="p_size"),
        _value("part", "part", "p_partkey", "hasName", "TextValue", 0, "p_partkey % 13 = 0", as_string="p_name"),
        _value("part", "part", "p_partkey", "hasBrand", "TextValue", 2, as_string="p_brand"),
        _value("part", "part", "p_partkey", "hasPrice", "DecimalValue", 4, as_decimal="p_retailprice"),
        _value("documents", "text", "doc_id", "hasText", "TextValue", 0, as_string="text"),
        _value("documents", "text", "doc_id", "hasSource", "TextValue", 1, as_string="source"),
        _value("pages", "page", "page_id", "hasUrl", "UriValue", 0, as_uri="url"),
    ),
    "order_parts": "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey",
    "links": _union(
        _link("orders", "order", "o_orderkey", "placedBy", "'customer/' || " + _text("o_custkey"), "1", 1, "o_orderkey % 17 = 0"),
        _link("order_parts", "order", "l_orderkey", "hasPart", "'part/' || " + _text("l_partkey"), "n", 0),
        _link("customer", "customer", "c_custkey", "locatedIn", "'nation/' || " + _text("c_nationkey"), "1", 0),
        _link("supplier", "supplier", "s_suppkey", "locatedIn", "'nation/' || " + _text("s_nationkey"), "1", 0),
        _link("documents WHERE doc_id > 0", "text", "doc_id", "cites", "'text/' || CAST(CAST((doc_id - doc_id % 2) / 2 AS BIGINT) AS STRING)", "1 + doc_id % 3", 1, "doc_id % 23 = 0"),
        _link("nation", "nation", "n_nationkey", "inRegion", "'region/' || " + _text("n_regionkey"), "1", 0),
    ),
    "class_edges": _union(
        "SELECT * FROM (VALUES ('Agent','Resource'),('Customer','Agent'),('Supplier','Agent'),('Doc','Resource'),"
        "('Order','Doc'),('Text','Doc'),('Page','Doc'),('Thing','Resource'),('Part','Thing'),('Place','Thing')) "
        "AS e(child, parent)",
        "SELECT DISTINCT 'Order/' || o_orderpriority, 'Order' FROM orders",
        "SELECT DISTINCT 'Customer/' || c_mktsegment, 'Customer' FROM customer",
        "SELECT DISTINCT 'Part/' || p_type, 'Part' FROM part",
        "SELECT DISTINCT 'Part/' || p_type || '/' || p_brand, 'Part/' || p_type FROM part",
        "SELECT DISTINCT 'Text/' || lang, 'Text' FROM documents",
        "SELECT DISTINCT 'Page/' || split_part(url, '/', 3), 'Page' FROM pages",
    ),
    "prop_edges": "SELECT * FROM (VALUES ('placedBy','hasLinkTo'),('cites','hasLinkTo'),('hasPart','hasLinkTo'),('locatedIn','isPartOf'),"
    "('inRegion','isPartOf'),('isPartOf','hasLinkTo'),('hasLinkTo','resourceProperty'),('hasValue','resourceProperty'),"
    "('hasTotal','hasAmount'),('hasBalance','hasAmount'),('hasPrice','hasAmount'),('hasAmount','hasValue'),"
    "('hasDate','hasValue'),('isFulfilled','hasValue'),('hasPlace','hasValue'),('hasName','hasText'),('hasBrand','hasText'),"
    "('hasSource','hasText'),('hasText','hasValue'),('hasSize','hasValue'),('hasUrl','hasValue')) AS e(child, parent)",
    "prop_constraints": "SELECT * FROM (VALUES ('placedBy','Order','Customer'),('hasPart','Order','Part'),('cites','Text','Text/en'),"
    "('locatedIn','Agent','Place'),('inRegion','Place','Place'),('hasLinkTo','Resource','Resource'),"
    "('isPartOf','Resource','Resource'),('hasTotal','Order','DecimalValue'),('hasBalance','Customer','DecimalValue'),"
    "('hasPrice','Part','DecimalValue'),('hasAmount','Resource','DecimalValue'),('hasDate','Order','DateValue'),"
    "('isFulfilled','Order','BooleanValue'),('hasPlace','Agent','ListValue'),('hasName','Resource','TextValue'),"
    "('hasBrand','Part','TextValue'),('hasSource','Text','TextValue'),('hasText','Resource','TextValue'),"
    "('hasSize','Part','IntValue'),('hasValue','Resource','Value')) AS c(prop, subject_class, object_class)",
    "cardinalities": "SELECT * FROM (VALUES ('Resource','label','1',0),('Resource','hasAmount','0-n',1),"
    "('Order','hasTotal','1',1),('Order','hasDate','0-1',2),('Order','isFulfilled','1',3),('Order','placedBy','1',4),"
    "('Order','hasPart','0-1',5),('Customer','hasBalance','0-1',1),('Customer','hasName','1',2),('Customer','hasPlace','1',3),"
    "('Agent','locatedIn','1',4),('Part','hasName','1-n',1),('Part','hasSize','1',2),('Part','hasPrice','0-1',3),"
    "('Text','hasText','1',1),('Text','hasSource','0-n',2),('Text','hasDate','0-n',3),('Text','cites','1-n',4),('Supplier','hasName','1',5),('Part','hasBrand','0-n',4),('Page','hasUrl','1',1),"
    "('Page','hasText','0-1',2),('Place','inRegion','0-1',1)) AS c(cls, prop, card, gui_order)",
    "list_nodes": _union(
        "SELECT 'world' AS node, CAST(NULL AS STRING) AS parent, 0 AS position, 'World' AS name",
        "SELECT 'region/' || CAST(r_regionkey AS STRING), 'world', CAST(r_regionkey AS INT), r_name FROM region",
        "SELECT 'nation/' || CAST(n_nationkey AS STRING), 'region/' || CAST(n_regionkey AS STRING), CAST(n_nationkey AS INT), n_name FROM nation",
        "SELECT 'customer/' || CAST(c_custkey AS STRING), 'nation/' || CAST(c_nationkey AS STRING), "
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS INT) END, c_name FROM customer",
    ),
    "labels_by_lang": _union(
        "SELECT 'part/' || CAST(p_partkey AS STRING) AS node, 'en' AS lang, p_name AS label FROM part WHERE p_partkey % 3 <> 0",
        "SELECT 'part/' || CAST(p_partkey AS STRING), 'de', 'de ' || p_name FROM part WHERE p_partkey % 2 = 0",
        "SELECT 'part/' || CAST(p_partkey AS STRING), 'fr', 'fr ' || p_brand FROM part WHERE p_partkey % 5 <> 1",
    ),
    "users": "SELECT * FROM (VALUES ('user/0',TRUE,TRUE),('user/1',FALSE,TRUE),('user/2',FALSE,TRUE),('user/3',FALSE,TRUE),"
    "('user/4',FALSE,TRUE),('user/5',FALSE,TRUE),('user/6',FALSE,TRUE),('user/9',FALSE,TRUE),('anonymous',FALSE,FALSE)) "
    "AS u(user_id, is_system_admin, is_known)",
    "memberships": "SELECT * FROM (VALUES ('user/1','project/1','ProjectMember'),('user/1','project/1','ProjectAdmin'),"
    "('user/2','project/2','ProjectMember'),('user/2','project/2','group/editors'),('user/3','project/3','ProjectMember'),"
    "('user/4','project/0','ProjectMember'),('user/4','project/1','ProjectMember'),('user/5','project/1','ProjectMember'),"
    "('user/6','project/2','group/readers'),('user/6','project/2','ProjectMember'),('user/0','system','SystemAdmin')) "
    "AS m(user_id, project, grp)",
    "admin_rights": "SELECT * FROM (VALUES ('user/1','project/1')) AS a(user_id, project)",
    "default_permissions": "SELECT * FROM (VALUES "
    "('project/0','ProjectMember',NULL,NULL,'M Creator|V KnownUser'),('project/1','ProjectMember',NULL,NULL,'D Creator|V ProjectMember'),"
    "('project/1','ProjectAdmin',NULL,NULL,'CR ProjectAdmin|M Creator'),('project/2','group/editors',NULL,NULL,'CR group/editors'),"
    "('project/2','group/readers',NULL,NULL,'V group/readers'),('project/0',NULL,'Order','hasTotal','RV KnownUser'),"
    "('system',NULL,'Order','hasDate','V UnknownUser'),('project/1',NULL,'Part',NULL,'V ProjectMember'),"
    "('system',NULL,'Text',NULL,'V KnownUser'),('project/3',NULL,NULL,'hasName','M ProjectMember'),"
    "('system',NULL,NULL,'hasUrl','V UnknownUser'),('project/3','KnownUser',NULL,NULL,'RV KnownUser')) "
    "AS d(project, grp, cls, prop, permissions)",
    "versions": "SELECT 'v/' || CAST(event_id AS STRING) AS value, user_id, event_id, "
    "'v/' || CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS STRING) AS prev_value, "
    "event_id % 7 = 3 AS is_deleted, event_type AS body, 'user/' || CAST(event_id % 10 AS STRING) AS creator, "
    "'project/' || CAST(event_id % 4 AS STRING) AS project, " + _perm("event_id") + " AS permissions FROM events",
    "tags": "SELECT 't/' || CAST(event_id AS STRING) AS tag, 'text/' || CAST(user_id AS STRING) AS txt, event_type AS cls, "
    "CAST(event_id % 1000 AS INT) AS start_pos, CAST(event_id % 1000 + event_id % 7 AS INT) AS end_pos, CAST(event_id AS INT) AS start_index, "
    "CASE WHEN event_id % 5 <> 0 THEN 't/' || CAST(event_id - event_id % 5 AS STRING) END AS parent, "
    "md5(event_type || CAST(event_id AS STRING)) AS uuid, "
    "CASE WHEN event_type = 'click' THEN 'order/' || CAST(event_id % 2000 AS STRING) END AS link_target FROM events",
    "map_entries": "SELECT 'user/' || CAST(user_id AS STRING) AS map, 'k' || split_part(split_part(props, ': ', 2), '}', 1) AS key, "
    "event_id, event_type AS value FROM events",
}

# One plan per table, session and data folder; closures are written once, like any ontology.
_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def _dialect(sql: str, engine: str) -> str:
    """Fill in the one expression the two engines spell differently."""
    out, marker = "", "@JDN("
    while marker in sql:
        head, rest = sql.split(marker, 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        arg = rest[: end - 1]
        day = f"CAST({arg} AS DATE)"
        diff = f"datediff({day}, DATE '1970-01-01')" if engine == "spark" else f"datediff('day', DATE '1970-01-01', {day})"
        out, sql = out + head + f"({diff} + 2440588)", rest[end:]
    return out + sql


def used_fixtures(sql: str, within: str | None = None) -> list[str]:
    """Fixtures named in a query, their own inputs first."""
    found: list[str] = []
    for name in FIXTURES:
        if name != within and re.search(rf"(?<![\w'.]){name}\b(?!')", sql):
            found += [n for n in [*used_fixtures(FIXTURES[name], name), name] if n not in found]
    return found


def fixture_ctes(sql: str) -> list[str]:
    return [f"{name} AS ({_dialect(FIXTURES[name], 'duckdb')})" for name in used_fixtures(sql)]


class Graph:
    """The graph tables over one data folder, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _once(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _TABLES:
            _TABLES[key] = build()
        return _TABLES[key]

    def table(self, name: str) -> DataFrame:
        return self._once(name, lambda: self.spark.read.parquet(f"{self.path}/{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            return self._once(name, lambda: self._mapped(name))
        if name in BASE_TABLES:
            return self.table(name)
        raise AttributeError(name)

    def _mapped(self, name: str) -> DataFrame:
        sql = _dialect(FIXTURES[name], "spark")
        ctes = [f"{n} AS ({_dialect(FIXTURES[n], 'spark')})" for n in used_fixtures(FIXTURES[name], name)]
        if ctes:
            sql = f"WITH {', '.join(ctes)} {sql}"
        sql = sql.replace("{", "{{").replace("}", "}}")
        inputs = {t: self.table(t) for t in BASE_TABLES if re.search(rf"\b{t}\b", sql)}
        for table in inputs:
            sql = re.sub(rf"(?<=FROM ){table}\b", "{" + table + "}", sql)
        return self.spark.sql(sql, **inputs)

    @cached_property
    def versions(self) -> DataFrame:
        key = F.col("event_id").cast("string")
        permission = F.element_at(F.array(*[F.lit(p) for p in PERMISSIONS]), (F.col("event_id") % 5 + 1).cast("int"))
        chained = ordering.with_previous(self.events, ["user_id"], ["ts", "event_id"], "event_id", "_prev")
        return chained.select(
            F.concat(F.lit("v/"), key).alias("value"),
            "user_id",
            "event_id",
            F.concat(F.lit("v/"), F.col("_prev").cast("string")).alias("prev_value"),
            (F.col("event_id") % 7 == 3).alias("is_deleted"),
            F.col("event_type").alias("body"),
            F.concat(F.lit("user/"), (F.col("event_id") % 10).cast("string")).alias("creator"),
            F.concat(F.lit("project/"), (F.col("event_id") % 4).cast("string")).alias("project"),
            permission.alias("permissions"),
        )

    @cached_property
    def class_closure(self) -> DataFrame:
        return self._once("class closure", lambda: settle(closure.ancestors(self.class_edges)))

    @cached_property
    def prop_closure(self) -> DataFrame:
        return self._once("prop closure", lambda: settle(closure.ancestors(self.prop_edges)))

    @cached_property
    def list_closure(self) -> DataFrame:
        edges = self.list_nodes.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent")
        return self._once("list closure", lambda: settle(closure.ancestors(edges)))

    @cached_property
    def list_labels(self) -> DataFrame:
        return self._once("list labels", lambda: closure.tree_labels(self.list_nodes))

    @cached_property
    def token_index(self) -> tokenindex.TokenIndex:
        build = lambda: tokenindex.TokenIndex(self.spark, new_folder(self.spark)).build(tokenindex.entries(self.resources, self.vals))
        return self._once("token index", build)

    @cached_property
    def changed_index(self) -> tokenindex.TokenIndex:
        """Every seventh label is new, every eleventh text is gone."""

        def build():
            label = F.when(F.col("k") % 7 == 0, F.concat(F.lit("Renamed "), "label")).otherwise(F.col("label"))
            renamed = self.resources.where("k % 7 = 0")
            cleared = self.resources.where("k % 11 = 0").select(F.col("iri").alias("resource"))
            gone = ordering.sifted(self.vals, cleared, ["resource"]).join(cleared, "resource", "left_semi")
            none = self.vals.limit(0)
            index = tokenindex.TokenIndex(self.spark, new_folder(self.spark)).build(tokenindex.entries(self.resources, self.vals))
            index.change(tokenindex.entries(renamed, none), tokenindex.entries(renamed.withColumn("label", label), none))
            old = tokenindex.entries(self.resources, gone).where("value <> ''")
            return index.change(old, old.limit(0))

        return self._once("changed index", build)

    @cached_property
    def triples(self) -> relational.StatementTables:
        return relational.StatementTables(self.resources, self.vals, self.links)


# The same statements for the other engine.
TRIPLES_SQL = (
    "SELECT project AS graph, iri AS s, 'type' AS p, cls AS o, 'iri' AS o_kind FROM resources "
    "UNION ALL SELECT project, iri, 'label', label, 'literal' FROM resources "
    "UNION ALL SELECT project, iri, 'creator', creator, 'iri' FROM resources "
    "UNION ALL SELECT project, iri, 'isDeleted', CAST(is_deleted AS STRING), 'literal' FROM resources "
    "UNION ALL SELECT project, resource, prop, iri, 'iri' FROM vals "
    "UNION ALL SELECT project, iri, 'type', vtype, 'iri' FROM vals "
    "UNION ALL SELECT project, iri, 'valueOrder', CAST(vorder AS STRING), 'literal' FROM vals "
    "UNION ALL SELECT project, iri, 'asString', as_string, 'literal' FROM vals WHERE as_string IS NOT NULL "
    "UNION ALL SELECT project, iri, 'asInt', CAST(as_int AS STRING), 'literal' FROM vals WHERE as_int IS NOT NULL "
    "UNION ALL SELECT project, iri, 'asDecimal', CAST(as_decimal AS STRING), 'literal' FROM vals WHERE as_decimal IS NOT NULL "
    "UNION ALL SELECT project, iri, 'asNode', as_node, 'iri' FROM vals WHERE as_node IS NOT NULL "
    "UNION ALL SELECT project, src, prop, dst, 'iri' FROM links WHERE NOT is_deleted "
    "UNION ALL SELECT project, src, prop || 'Value', link_value, 'iri' FROM links "
    "UNION ALL SELECT project, link_value, 'type', 'LinkValue', 'iri' FROM links "
    "UNION ALL SELECT project, link_value, 'subject', src, 'iri' FROM links "
    "UNION ALL SELECT project, link_value, 'predicate', prop, 'iri' FROM links "
    "UNION ALL SELECT project, link_value, 'object', dst, 'iri' FROM links"
)
FIXTURES["triples"] = TRIPLES_SQL


# The closures in SQL, for queries that state them by name.
FIXTURES_SQL_ONLY = {
    "class_up": "SELECT child AS node, parent AS ancestor, 1 AS depth FROM class_edges UNION "
    "SELECT class_up.node, e.parent, class_up.depth + 1 FROM class_up JOIN class_edges e ON e.child = class_up.ancestor",
    "class_closure": "SELECT node, ancestor, min(depth) AS depth FROM (SELECT * FROM class_up UNION ALL "
    "SELECT child, child, 0 FROM class_edges UNION ALL SELECT parent, parent, 0 FROM class_edges) q GROUP BY node, ancestor",
    "prop_up": "SELECT child AS node, parent AS ancestor, 1 AS depth FROM prop_edges UNION "
    "SELECT prop_up.node, e.parent, prop_up.depth + 1 FROM prop_up JOIN prop_edges e ON e.child = prop_up.ancestor",
    "prop_closure": "SELECT node, ancestor, min(depth) AS depth FROM (SELECT * FROM prop_up UNION ALL "
    "SELECT child, child, 0 FROM prop_edges UNION ALL SELECT parent, parent, 0 FROM prop_edges) q GROUP BY node, ancestor",
    "list_up": "SELECT node, parent AS ancestor, 1 AS depth FROM list_nodes WHERE parent IS NOT NULL UNION "
    "SELECT list_up.node, e.parent, list_up.depth + 1 FROM list_up JOIN list_nodes e ON e.node = list_up.ancestor WHERE e.parent IS NOT NULL",
    "list_closure": "SELECT * FROM list_up UNION ALL SELECT node, node, 0 FROM list_nodes",
    # Codes per user and subject; subjects are resources and values.
    "grants": "SELECT iri, creator, project, CASE split_part(part, ' ', 1) WHEN 'RV' THEN 1 WHEN 'V' THEN 2 WHEN 'M' THEN 6 "
    "WHEN 'D' THEN 7 WHEN 'CR' THEN 8 END AS code, unnest(string_split(split_part(part, ' ', 2), ',')) AS grp FROM "
    "(SELECT iri, creator, project, unnest(string_split(permissions, '|')) AS part FROM "
    "(SELECT iri, creator, project, permissions FROM resources UNION ALL SELECT iri, creator, project, permissions FROM vals "
    "UNION ALL SELECT link_value, creator, project, permissions FROM links) s) p",
    "subject_codes": "SELECT s.iri, u.user_id, CASE WHEN u.is_system_admin OR EXISTS (SELECT 1 FROM admin_rights a WHERE "
    "a.user_id = u.user_id AND a.project = s.project) THEN 8 ELSE coalesce("
    "max(CASE WHEN (u.is_known AND (s.grp = 'KnownUser' OR (s.grp = 'Creator' AND s.creator = u.user_id) OR EXISTS "
    "(SELECT 1 FROM memberships m WHERE m.user_id = u.user_id AND m.project = s.project AND m.grp = s.grp))) OR "
    "(NOT u.is_known AND s.grp = 'UnknownUser') THEN s.code END), max(CASE WHEN s.grp = 'UnknownUser' THEN s.code END)) END AS code "
    "FROM grants s JOIN users u ON TRUE GROUP BY s.iri, s.project, u.user_id, u.is_system_admin, u.is_known",
}
FIXTURES.update(FIXTURES_SQL_ONLY)
