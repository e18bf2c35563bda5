"""Typed value filters and full-text search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import access, fulltext, paging, pattern, tokenindex, values
from wovengraph.plans.registry import query

c = F.col

# Filters that all have the same shape: property, type, literal, operator, operand, SQL test.
_MARCH = (2450509, 2450539)
_SIMPLE = {
    "f01_int_eq": ("hasSize", "IntValue", "=", 7, "as_int = 7"),
    "f01_int_ne": ("hasSize", "IntValue", "!=", 7, "as_int <> 7"),
    "f01_int_lt": ("hasSize", "IntValue", "<", 7, "as_int < 7"),
    "f01_int_le": ("hasSize", "IntValue", "<=", 7, "as_int <= 7"),
    "f01_int_gt": ("hasSize", "IntValue", ">", 40, "as_int > 40"),
    "f01_int_ge": ("hasSize", "IntValue", ">=", 40, "as_int >= 40"),
    "f02_decimal_eq": ("hasPrice", "DecimalValue", "=", "900.10", "as_decimal = 900.10"),
    "f02_decimal_ne": ("hasPrice", "DecimalValue", "!=", "900.10", "as_decimal <> 900.10"),
    "f02_decimal_lt": ("hasTotal", "DecimalValue", "<", "20000.5", "as_decimal < 20000.5"),
    "f02_decimal_le_int": ("hasTotal", "DecimalValue", "<=", 20000, "as_decimal <= 20000"),
    "f02_decimal_gt": ("hasBalance", "DecimalValue", ">", "9000.25", "as_decimal > 9000.25"),
    "f02_decimal_ge": ("hasBalance", "DecimalValue", ">=", "9000.25", "as_decimal >= 9000.25"),
    "f03_boolean_eq": ("isFulfilled", "BooleanValue", "=", True, "as_boolean"),
    "f03_boolean_ne": ("isFulfilled", "BooleanValue", "!=", True, "NOT as_boolean"),
    "f04_string_eq": ("hasBrand", "TextValue", "=", "Brand#7", "as_string = 'Brand#7'"),
    "f04_string_ne": ("hasBrand", "TextValue", "!=", "Brand#7", "as_string <> 'Brand#7'"),
    "f05_uri_exists_ne": ("hasUrl", "UriValue", "!=", "http://x", "as_uri <> 'http://x'"),
    "f06_date_overlap": ("hasDate", "DateValue", "=", _MARCH, "2450509 <= end_jdn AND 2450539 >= start_jdn"),
    "f07_date_no_overlap": ("hasDate", "DateValue", "!=", _MARCH, "2450509 > end_jdn OR 2450539 < start_jdn"),
    "f08_date_before": ("hasDate", "DateValue", "<", _MARCH, "end_jdn < 2450509"),
    "f09_date_not_after": ("hasDate", "DateValue", "<=", _MARCH, "start_jdn <= 2450539"),
    "f10_date_after": ("hasDate", "DateValue", ">", _MARCH, "start_jdn > 2450539"),
    "f11_date_not_before": ("hasDate", "DateValue", ">=", _MARCH, "end_jdn >= 2450509"),
    "f14_exists": ("hasPlace", "ListValue", "exists", None, "as_node IS NOT NULL"),
    "f15_like": ("hasName", "TextValue", "like", "^RED|bolt$", "regexp_matches(as_string, '(?i)^RED|bolt$')"),
    "f16_not_like": ("hasName", "TextValue", "not_like", "RED", "NOT regexp_matches(as_string, '(?i)RED')"),
    "f18_not_equal_text": ("hasSource", "TextValue", "!=", "src3", "as_string <> 'src3'"),
    "f21_color_as_string": ("hasBrand", "ColorValue", "=", "Brand#12", "as_string = 'Brand#12'"),
    "f21_geometry_exists": ("hasSource", "GeomValue", "exists", None, "as_string IS NOT NULL"),
}


def _register_simple(name, prop, vtype, op, operand, test):
    column = values.LITERAL[vtype]
    sql = f"SELECT resource, iri AS value, CAST({column} AS STRING) AS literal FROM vals WHERE prop = '{prop}' AND NOT is_deleted AND ({test})"

    @query(name, sql)
    def _(g):
        return values.value_filter(g.vals, prop, op, operand, vtype).withColumn("literal", c("literal").cast("string"))


for _name, _spec in _SIMPLE.items():
    _register_simple(_name, *_spec)


@query("f05_uri_eq", "SELECT v.resource, v.iri AS value FROM vals v JOIN pages p ON p.url = v.as_uri WHERE v.prop = 'hasUrl' AND p.page_id = 3")
def _(g):
    wanted = g.pages.where("page_id = 3").select(c("url").alias("literal"))
    found = values.value_filter(g.vals, "hasUrl", "exists", value_type="UriValue")
    return found.join(wanted, "literal").select("resource", "value")


@query(
    "j07_theta_dates",
    """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    WHERE date_trunc('month', l.l_shipdate) <= last_day(o.o_orderdate) AND last_day(l.l_shipdate) >= date_trunc('month', o.o_orderdate)""",
)
def _(g):
    shipped = F.trunc("l_shipdate", "MM"), F.last_day("l_shipdate")
    ordered = F.trunc("o_orderdate", "MM"), F.last_day("o_orderdate")
    joined = g.lineitem.join(g.orders, c("l_orderkey") == c("o_orderkey"))
    overlap = (shipped[0] <= ordered[1]) & (shipped[1] >= ordered[0])
    return joined.where(overlap).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "j07_period_overlap",
    """WITH seasons AS (SELECT k, start_jdn, start_jdn + CAST(k % 90 AS INT) AS end_jdn FROM (SELECT p_size AS k,
    2449719 + CAST(p_size AS INT) * 45 AS start_jdn FROM part GROUP BY p_size))
    SELECT s.k, v.resource FROM seasons s JOIN vals v ON v.prop = 'hasDate' AND s.start_jdn <= v.end_jdn AND s.end_jdn >= v.start_jdn""",
)
def _(g):
    start = F.lit(2449719) + c("p_size") * 45
    seasons = g.part.select(c("p_size").alias("k"), start.alias("start_jdn"), (start + c("p_size") % 90).alias("end_jdn")).distinct()
    dates = g.vals.where(c("prop") == "hasDate").select("resource", "start_jdn", "end_jdn")
    joined = values.period_overlap_join(seasons, dates)
    return joined.select(c("l_k").alias("k"), c("r_resource").alias("resource"))


@query(
    "f12_list_subtree",
    """SELECT v.resource, v.iri AS value, v.as_node AS literal FROM vals v JOIN list_closure k ON k.node = v.as_node
    AND k.ancestor = 'region/2' WHERE v.prop = 'hasPlace' AND NOT v.is_deleted""",
)
def _(g):
    return values.list_filter(g.vals, "hasPlace", "region/2", g.list_labels)


@query(
    "f13_link_target",
    """SELECT l.src AS resource, l.link_value, l.dst, r.label AS target_label, r.creator AS target_creator, r.project AS target_project,
    r.permissions AS target_permissions FROM links l JOIN resources r ON r.iri = l.dst AND NOT r.is_deleted
    WHERE NOT l.is_deleted AND l.prop = 'placedBy' AND l.dst = 'customer/7'""",
)
def _(g):
    return values.link_filter(g.links, g.resources, "placedBy", "customer/7")


@query(
    "f13_link_exists",
    """SELECT l.src AS resource, l.dst FROM links l JOIN resources r ON r.iri = l.dst AND NOT r.is_deleted
    WHERE NOT l.is_deleted AND l.prop = 'hasPart'""",
)
def _(g):
    return values.link_filter(g.links, g.resources, "hasPart").select("resource", "dst")


@query("f17_regex", "SELECT iri FROM resources WHERE regexp_matches(label, '(?i)^ORDER [0-9]*7$')")
def _(g):
    return g.resources.where(values.regex(c("label"), "^ORDER [0-9]*7$", "i")).select("iri")


@query(
    "f19_all_criteria",
    """SELECT a.resource FROM vals a JOIN vals b ON b.resource = a.resource AND b.prop = 'hasPrice' AND b.as_decimal < 1000 AND NOT b.is_deleted
    JOIN vals d ON d.resource = a.resource AND d.prop = 'hasName' AND d.as_string LIKE '%red%' AND NOT d.is_deleted
    WHERE a.prop = 'hasSize' AND a.as_int > 10 AND NOT a.is_deleted""",
)
def _(g):
    criteria = [("hasSize", ">", 10, "IntValue"), ("hasPrice", "<", 1000, "DecimalValue"), ("hasName", "like", "red", "TextValue")]
    return values.all_criteria(g.vals, criteria)


@query(
    "f20_scope",
    """SELECT r.iri FROM resources r JOIN class_closure k ON k.node = r.cls AND k.ancestor = 'Doc'
    WHERE r.project = 'project/2' AND r.creator = 'user/6'""",
)
def _(g):
    return values.scope(g.resources, "project/2", "Doc", "user/6", g.class_closure).select("iri")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


@query(
    "x01_text_index",
    f"""SELECT token, count(*) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token""",
)
def _(g):
    index = fulltext.text_index(g.documents, "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


_TEXTS = """SELECT iri AS resource, '' AS value, label AS text FROM resources WHERE NOT is_deleted
    UNION ALL SELECT v.resource, v.iri, v.as_string FROM vals v JOIN resources r ON r.iri = v.resource AND NOT r.is_deleted
    WHERE v.vtype = 'TextValue' AND NOT v.is_deleted"""
# After an edit: every seventh label is new, every eleventh text is gone.
_EDITED = f"""SELECT x.resource, x.value, CASE WHEN x.value = '' AND r.k % 7 = 0 THEN 'Renamed ' || x.text ELSE x.text END AS text
    FROM ({_TEXTS}) x JOIN resources r ON r.iri = x.resource WHERE x.value = '' OR r.k % 11 <> 0"""


@query(
    "x01_stored_index",
    f"SELECT token, count(*) AS n, count(*) FILTER (value = '') AS labels FROM (SELECT value, unnest({_TOKENS.format('text')}) AS token FROM ({_TEXTS})) GROUP BY token",
)
def _(g):
    held = g.token_index.rows()
    return held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") == "").alias("labels"))


@query(
    "x01_changed_index",
    f"SELECT token, count(*) AS n, count(*) FILTER (value = '') AS labels FROM (SELECT value, unnest({_TOKENS.format('text')}) AS token FROM ({_EDITED})) GROUP BY token",
)
def _(g):
    held = g.changed_index.rows()
    return held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("value") == "").alias("labels"))


@query("x02_stored_terms", f"SELECT resource, value FROM ({_TEXTS}) WHERE list_has_all({_TOKENS.format('text')}, ['red', 'widget'])")
def _(g):
    return g.token_index.search("Red, widget!")


@query("x02_stored_any", f"SELECT resource, value FROM ({_TEXTS}) WHERE list_has_any({_TOKENS.format('text')}, ['blue', 'unheard'])")
def _(g):
    return g.token_index.search("blue unheard", "or")


@query(
    "x03_stored_typing",
    f"""SELECT resource, value FROM (SELECT resource, value, {_TOKENS.format('text')} AS t FROM ({_TEXTS}))
    WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'ther'))) > 0""",
)
def _(g):
    return g.token_index.search("the ther", typing=True)


@query(
    "x03_changed_typing",
    f"""SELECT resource, value FROM (SELECT resource, value, {_TOKENS.format('text')} AS t FROM ({_EDITED}))
    WHERE list_contains(t, 'renamed') AND len(list_filter(t, lambda x: starts_with(x, 're'))) > 0""",
)
def _(g):
    return g.changed_index.search("renamed re", typing=True)


@query(
    "x04_stored_phrase",
    f"""SELECT resource, value FROM (SELECT resource, value, lower(text) AS text, {_TOKENS.format('text')} AS t FROM ({_TEXTS}))
    WHERE contains(text, 'the on') AND list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'on'))) > 0""",
)
def _(g):
    live = g.resources.where(~c("is_deleted"))
    labels = live.select(c("iri").alias("resource"), F.lit("").alias("value"), c("label").alias("text"))
    texts = labels.union(g.vals.where("vtype = 'TextValue' AND NOT is_deleted").select("resource", "iri", "as_string"))
    return g.token_index.phrase("the on", texts, fulltext.has_phrase_typing(c("text"), "the on"))


@query(
    "x02_all_terms_index",
    f"""SELECT doc_id AS subject FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
    WHERE list_has_all(t, ['the', 'and', 'of'])""",
)
def _(g):
    index = fulltext.text_index(g.documents, "doc_id", "text")
    return fulltext.search_index(index, ["the", "and", "of"])


@query(
    "x02_all_terms",
    f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS.format('text')}, ['der', 'und'])",
)
def _(g):
    return g.documents.where(fulltext.has_terms(c("text"), ["der", "und"])).select("doc_id")


@query(
    "x03_typing",
    f"""SELECT doc_id FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
    WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'ther'))) > 0""",
)
def _(g):
    return g.documents.where(fulltext.has_terms_typing(c("text"), "the ther")).select("doc_id")


@query(
    "x03_typing_index",
    f"""SELECT doc_id AS subject FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)
    WHERE list_contains(t, 'the') AND len(list_filter(t, lambda x: starts_with(x, 'ther'))) > 0""",
)
def _(g):
    index = fulltext.text_index(g.documents, "doc_id", "text")
    return fulltext.search_index(index, ["the", "ther"], prefix_last=True)


@query(
    "x04_phrase_typing",
    "SELECT doc_id FROM documents WHERE contains(lower(text), 'the on') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') "
    "AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])on')",
)
def _(g):
    return g.documents.where(fulltext.has_phrase_typing(c("text"), "the on")).select("doc_id")


@query(
    "x05_match_property",
    f"SELECT resource, iri AS value FROM vals WHERE prop = 'hasName' AND NOT is_deleted AND list_has_all({_TOKENS.format('as_string')}, ['red', 'widget'])",
)
def _(g):
    rows = g.vals.where((c("prop") == "hasName") & ~c("is_deleted"))
    return rows.where(fulltext.has_terms(c("as_string"), ["red", "widget"])).select("resource", c("iri").alias("value"))


@query(
    "x05_match_property_or",
    f"SELECT resource, iri AS value FROM vals WHERE prop = 'hasName' AND NOT is_deleted AND list_has_any({_TOKENS.format('as_string')}, ['red', 'widget'])",
)
def _(g):
    rows = g.vals.where((c("prop") == "hasName") & ~c("is_deleted"))
    return rows.where(fulltext.has_terms(c("as_string"), ["red", "widget"], "or")).select("resource", c("iri").alias("value"))


@query(
    "x06_match_boolean",
    f"""SELECT doc_id FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) WHERE list_has_all(t, ['the', 'of'])
    AND NOT list_has_all(t, ['ther', 'and'])""",
)
def _(g):
    return g.documents.where(fulltext.has_boolean(c("text"), "+the of -ther -and")).select("doc_id")


@query(
    "x06_match_boolean_any",
    f"""SELECT doc_id FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents) WHERE list_contains(t, 'the')
    AND NOT list_has_any(t, ['ther', 'ing'])""",
)
def _(g):
    return g.documents.where(fulltext.has_boolean(c("text"), "+the -ther -ing", "any")).select("doc_id")


@query(
    "x07_contains_in_pattern",
    f"""SELECT l.src AS ord, l.dst AS part FROM links l JOIN vals v ON v.resource = l.dst AND v.prop = 'hasName' AND NOT v.is_deleted
    AND list_has_all({_TOKENS.format('v.as_string')}, ['blue']) WHERE l.prop = 'hasPart' AND NOT l.is_deleted""",
)
def _(g):
    named = g.vals.where((c("prop") == "hasName") & ~c("is_deleted") & fulltext.has_terms(c("as_string"), ["blue"]))
    parts = pattern.match(g.triples, "?ord", "hasPart", "?part")
    return parts.join(named.select(c("resource").alias("part")), "part", "left_semi").select("ord", "part")


_HITS = f"""SELECT iri AS resource, NULL AS value FROM resources WHERE NOT is_deleted AND list_has_all({_TOKENS.format('label')}, ['red'])
    UNION ALL SELECT v.resource, v.iri FROM vals v JOIN resources r ON r.iri = v.resource AND NOT r.is_deleted
    WHERE v.vtype = 'TextValue' AND NOT v.is_deleted AND list_has_all({_TOKENS.format('v.as_string')}, ['red'])"""


def _red(g):
    return fulltext.hits(g.resources, g.vals, lambda text: fulltext.has_terms(text, ["red"]))


@query("x08_hits", _HITS)
def _(g):
    return _red(g)


@query(
    "x09_grouped_hits",
    f"SELECT resource, CAST(0 AS BIGINT) AS part, coalesce(string_agg(value, ',' ORDER BY value), '') AS matches FROM ({_HITS}) GROUP BY resource",
)
def _(g):
    return fulltext.grouped_hits(_red(g)).withColumn("matches", F.array_join("matches", ","))


@query("x10_hit_count", f"SELECT count(DISTINCT resource) AS n FROM ({_HITS})")
def _(g):
    return fulltext.count_hits(_red(g))


_SEEN = "SELECT iri, code FROM subject_codes WHERE user_id = 'user/2' AND code IS NOT NULL"


def _profiles(g):
    return access.user_profiles(g.users, g.memberships, g.admin_rights)


@query(
    "x10_both_counts",
    f"""SELECT count(DISTINCT h.resource) AS n, count(DISTINCT CASE WHEN s.iri IS NOT NULL AND (h.value IS NULL OR w.iri IS NOT NULL) THEN h.resource END) AS n_visible
    FROM ({_HITS}) h LEFT JOIN ({_SEEN}) s ON s.iri = h.resource LEFT JOIN ({_SEEN}) w ON w.iri = h.value""",
)
def _(g):
    return fulltext.count_before_and_after(_red(g), fulltext.visible_hits(_red(g), g.resources, g.vals, _profiles(g), "user/2"))


@query(
    "x11_label_search",
    f"""SELECT iri, label FROM (SELECT iri, label, {_TOKENS.format('label')} AS t FROM resources WHERE NOT is_deleted)
    WHERE list_contains(t, 'small') AND len(list_filter(t, lambda x: starts_with(x, 'ri'))) > 0""",
)
def _(g):
    return fulltext.label_search(g.resources, "small ri").select("iri", "label")


@query(
    "x11_label_count",
    f"""SELECT count(DISTINCT iri) AS n FROM (SELECT iri, label, {_TOKENS.format('label')} AS t FROM resources WHERE NOT is_deleted)
    WHERE len(list_filter(t, lambda x: starts_with(x, 'customer'))) > 0""",
)
def _(g):
    return fulltext.count_hits(fulltext.label_search(g.resources, "customer").select(c("iri").alias("resource")))


@query(
    "x12_result_rows",
    f"""SELECT h.resource, r.label, CAST(0 AS BIGINT) AS part, coalesce(string_agg(v.prop || ':' || v.as_string, '|' ORDER BY v.prop, v.iri), '') AS matches
    FROM ({_HITS}) h JOIN resources r ON r.iri = h.resource LEFT JOIN vals v ON v.iri = h.value GROUP BY h.resource, r.label""",
)
def _(g):
    rows = fulltext.result_rows(_red(g), g.resources, g.vals)
    shown = F.transform("matches", lambda m: F.concat(m["prop"], F.lit(":"), m["literal"]))
    return rows.withColumn("matches", F.array_join(shown, "|"))


@query(
    "x12_rows_for_user",
    f"""SELECT h.resource, r.label, CAST(0 AS BIGINT) AS part, s.code AS rights, p.url AS preview, coalesce(CAST(p.page_id + 1000 AS INT), 32) AS preview_x,
    coalesce(CAST(p.page_id * 3 + 800 AS INT), 32) AS preview_y, coalesce(string_agg(v.prop || ':' || v.as_string, '|' ORDER BY v.prop, v.iri), '') AS matches
    FROM ({_HITS}) h JOIN ({_SEEN}) s ON s.iri = h.resource JOIN resources r ON r.iri = h.resource LEFT JOIN vals v ON v.iri = h.value
    LEFT JOIN ({_SEEN}) w ON w.iri = h.value LEFT JOIN pages p ON 'part/' || p.page_id = h.resource
    WHERE h.value IS NULL OR w.iri IS NOT NULL GROUP BY h.resource, r.label, s.code, p.url, p.page_id""",
)
def _(g):
    previews = g.pages.select(
        F.concat(F.lit("part/"), "page_id").alias("resource"), c("url").alias("preview"), (c("page_id") + 1000).cast("int").alias("preview_x"), (c("page_id") * 3 + 800).cast("int").alias("preview_y")
    )
    rows = fulltext.rows_for_user(_red(g), g.resources, g.vals, previews, _profiles(g), "user/2")
    shown = F.transform("matches", lambda m: F.concat(m["prop"], F.lit(":"), m["literal"]))
    return rows.withColumn("matches", F.array_join(shown, "|"))


@query(
    "x13_suggestions",
    f"""SELECT v.resource, CAST(0 AS BIGINT) AS part, string_agg(v.as_string, '; ' ORDER BY coalesce(o.gui_order, 0), v.vorder, v.iri) AS texts
    FROM vals v LEFT JOIN (SELECT prop, min(gui_order) AS gui_order FROM cardinalities GROUP BY prop) o ON o.prop = v.prop
    WHERE v.vtype = 'TextValue' AND NOT v.is_deleted AND v.resource IN (SELECT resource FROM ({_HITS})) GROUP BY v.resource""",
)
def _(g):
    orders = g.cardinalities.groupBy("prop").agg(F.min("gui_order").alias("gui_order"))
    return fulltext.suggestions(_red(g), g.vals, orders).withColumn("texts", F.array_join("texts", "; "))


@query(
    "search_page_with_scope",
    f"""SELECT resource FROM (SELECT DISTINCT resource FROM ({_HITS})) h JOIN resources r ON r.iri = h.resource
    WHERE r.project = 'project/1' ORDER BY resource LIMIT 25""",
)
def _(g):
    in_scope = values.scope(g.resources, project="project/1").select(c("iri").alias("resource"))
    found = _red(g).select("resource").distinct().join(in_scope, "resource", "left_semi")
    return paging.page(found, [c("resource")], 0)
