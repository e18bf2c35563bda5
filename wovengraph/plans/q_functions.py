"""Scalar function queries over texts made from the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.functions import dates, text
from wovengraph.plans import fixture
from wovengraph.plans.registry import query

c = F.col

_Y, _M, _D = (f"CAST({f}(o_orderdate) AS STRING)" for f in ("year", "month", "day"))
_M2, _D2 = f"lpad({_M}, 2, '0')", f"lpad({_D}, 2, '0')"
fixture.FIXTURES["date_texts"] = (
    f"SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'GREGORIAN:' || {_Y} || '-' || {_M2} || '-' || {_D2} "
    f"WHEN 1 THEN 'GREGORIAN:' || {_Y} || '-' || {_M} WHEN 2 THEN 'GREGORIAN:' || {_Y} || ' CE' "
    f"WHEN 3 THEN 'GREGORIAN:' || {_Y} || '-' || {_M2} || '-' || {_D2} || ':2002-12' "
    f"WHEN 4 THEN 'JULIAN:' || {_Y} || '-' || {_M2} || '-' || {_D2} WHEN 5 THEN 'JULIAN:' || CAST(o_orderkey % 4000 + 1 AS STRING) || '-' || {_M} || ' BCE' "
    f"WHEN 6 THEN 'GREGORIAN:' || {_Y} || '-13' WHEN 7 THEN 'JULIAN:' || {_Y} || '-02-30' "
    f"ELSE 'GREGORIAN:' || {_Y} || ':' || CAST(1990 + o_orderkey % 20 AS STRING) END AS txt FROM orders"
)
# Another form of the day count for the old calendar, with divisions towards zero.
_OLD = (
    "(367 * {y} - CAST(trunc(7 * ({y} + 5001 + CAST(trunc(({m} - 9) / 7.0) AS BIGINT)) / 4.0) AS BIGINT) "
    "+ CAST(trunc(275 * {m} / 9.0) AS BIGINT) + {d} + 1729777)"
)
_DAY = "(datediff('day', DATE '1970-01-01', CAST({} AS DATE)) + 2440588)"


@query(
    "c01_parse_period",
    f"""SELECT k, txt, CASE WHEN good THEN split_part(txt, ':', 1) END AS calendar,
    CASE WHEN good THEN s END AS start_jdn, CASE WHEN good THEN e END AS end_jdn, CASE WHEN good THEN p1 END AS start_prec,
    CASE WHEN good THEN p2 END AS end_prec FROM (SELECT *, kind NOT IN (6, 7) AND s <= e AS good FROM
    (SELECT q.*, CASE WHEN kind IN (0, 3, 4) THEN 'DAY' WHEN kind IN (1, 5) THEN 'MONTH' ELSE 'YEAR' END AS p1,
    CASE WHEN kind IN (0, 4) THEN 'DAY' WHEN kind IN (1, 3, 5) THEN 'MONTH' ELSE 'YEAR' END AS p2,
    CASE kind WHEN 0 THEN {_DAY.format('d')} WHEN 1 THEN {_DAY.format("date_trunc('month', d)")} WHEN 3 THEN {_DAY.format('d')}
    WHEN 4 THEN {_OLD.format(y='year(d)', m='month(d)', d='day(d)')} WHEN 5 THEN {_OLD.format(y='(-(k % 4000))', m='month(d)', d='1')}
    ELSE {_DAY.format("date_trunc('year', d)")} END AS s,
    CASE kind WHEN 0 THEN {_DAY.format('d')} WHEN 1 THEN {_DAY.format('last_day(d)')} WHEN 3 THEN {_DAY.format("'2002-12-31'")}
    WHEN 4 THEN {_OLD.format(y='year(d)', m='month(d)', d='day(d)')}
    WHEN 5 THEN {_OLD.format(y="(-(k % 4000) + CASE WHEN month(d) = 12 THEN 1 ELSE 0 END)", m='(month(d) % 12 + 1)', d='0')}
    WHEN 8 THEN {_DAY.format("make_date(CAST(1990 + k % 20 AS BIGINT), 12, 31)")}
    ELSE {_DAY.format("make_date(year(d), 12, 31)")} END AS e
    FROM (SELECT t.k, t.txt, t.k % 9 AS kind, o.o_orderdate AS d FROM date_texts t JOIN orders o ON o.o_orderkey = t.k) q))""",
)
def _(g):
    return dates.with_period(g.date_texts, "txt", "p").select("k", "txt", "p.*").drop("error")


@query(
    "c02_gregorian_jdn",
    f"SELECT o_orderkey AS k, {_DAY.format('o_orderdate')} AS jdn FROM orders",
)
def _(g):
    d = c("o_orderdate")
    return g.orders.select(c("o_orderkey").alias("k"), dates.jdn(F.year(d), F.month(d), F.day(d), F.lit(False)).alias("jdn"))


@query(
    "c02_julian_jdn",
    f"""SELECT o_orderkey AS k, {_OLD.format(y='(year(o_orderdate) - CAST(o_orderkey % 6000 AS BIGINT))', m='month(o_orderdate)',
    d='least(day(o_orderdate), 28)')} AS jdn FROM orders""",
)
def _(g):
    d = c("o_orderdate")
    number = dates.jdn(F.year(d) - c("o_orderkey") % 6000, F.month(d), F.least(F.day(d), F.lit(28)), F.lit(True))
    return g.orders.select(c("o_orderkey").alias("k"), number.alias("jdn"))


@query(
    "c02_jdn_round_trip",
    "SELECT o_orderkey AS k, TRUE AS same_gregorian, TRUE AS same_julian FROM orders",
)
def _(g):
    n = (F.lit(1000000) + c("o_orderkey") * 37 % 1500000).cast("int")
    back = {}
    for name, julian in (("same_gregorian", F.lit(False)), ("same_julian", F.lit(True))):
        d = dates.from_jdn(n, julian)
        back[name] = dates.jdn(d["year"], d["month"], d["day"], julian) == n
    return g.orders.select(c("o_orderkey").alias("k"), *[v.alias(k) for k, v in back.items()])


@query(
    "c03_precision_periods",
    f"""SELECT o_orderkey AS k, {_DAY.format("date_trunc('year', o_orderdate)")} AS y1, {_DAY.format("make_date(year(o_orderdate), 12, 31)")} AS y2,
    {_DAY.format("date_trunc('month', o_orderdate)")} AS m1, {_DAY.format('last_day(o_orderdate)')} AS m2, {_DAY.format('o_orderdate')} AS d1 FROM orders""",
)
def _(g):
    rows = g.orders.select(c("o_orderkey").alias("k"), "o_orderdate")
    for name, fmt in (("y", "yyyy"), ("m", "yyyy-MM"), ("d", "yyyy-MM-dd")):
        rows = rows.withColumn("txt", F.concat(F.lit("GREGORIAN:"), F.date_format("o_orderdate", fmt)))
        rows = dates.with_period(rows, "txt", name)
    return rows.select(
        "k",
        c("y.start_jdn").alias("y1"),
        c("y.end_jdn").alias("y2"),
        c("m.start_jdn").alias("m1"),
        c("m.end_jdn").alias("m2"),
        c("d.start_jdn").alias("d1"),
    )


@query(
    "c04_period_errors",
    """SELECT k, CASE WHEN k % 9 IN (6, 7) THEN 'invalid date' WHEN k % 9 = 8 AND year(o_orderdate) > 1990 + k % 20 THEN 'start is after end' END AS error
    FROM date_texts JOIN orders ON o_orderkey = k""",
)
def _(g):
    return dates.with_period(g.date_texts, "txt", "p").select("k", "p.error")


@query(
    "c05_date_text",
    """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y CE') WHEN 1 THEN strftime(o_orderdate, '%Y-%m CE')
    ELSE strftime(o_orderdate, '%Y-%m-%d CE') END AS txt FROM orders""",
)
def _(g):
    n = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) + 2440588
    precision = F.when(c("o_orderkey") % 3 == 0, "YEAR").when(c("o_orderkey") % 3 == 1, "MONTH").otherwise("DAY")
    return g.orders.select(c("o_orderkey").alias("k"), dates.date_text(n, F.lit(False), precision).alias("txt"))


@query(
    "c06_date_fields",
    """SELECT o_orderkey AS k, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
    CAST(day(o_orderdate) AS INT) AS day, 'CE' AS era FROM orders""",
)
def _(g):
    n = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) + 2440588
    return g.orders.select(c("o_orderkey").alias("k"), dates.date_fields(n, F.lit(False)).alias("d")).select("k", "d.*")


@query(
    "c07_eras",
    """SELECT k, CASE WHEN txt LIKE '% BCE' THEN k % 4000 + 1 END AS bce_year, txt LIKE '% CE' AS named_ce FROM date_texts WHERE k % 9 IN (2, 5)""",
)
def _(g):
    rows = dates.with_period(g.date_texts.where((c("k") % 9).isin(2, 5)), "txt", "p")
    fields = dates.date_fields(c("p.start_jdn"), c("p.calendar") == "JULIAN")
    return rows.select(
        "k",
        F.when(fields["era"] == "BCE", fields["year"].cast("long")).alias("bce_year"),
        (F.endswith(c("txt"), F.lit(" CE"))).alias("named_ce"),
    )


fixture.FIXTURES["raw_texts"] = (
    "SELECT event_id AS k, event_type, value, CASE event_id % 6 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN '-' || CAST(user_id AS STRING) "
    "WHEN 2 THEN CAST(event_id AS STRING) || '.25' WHEN 3 THEN 'true' WHEN 4 THEN event_type ELSE 'False' END AS txt FROM events"
)


@query(
    "c08_validate_scalars",
    """SELECT k, CASE WHEN k % 6 IN (0, 1) THEN CAST(txt AS INT) END AS i,
    CASE WHEN k % 6 IN (0, 1, 2) THEN CAST(CAST(txt AS DECIMAL(18,2)) AS STRING) END AS d,
    CASE k % 6 WHEN 3 THEN TRUE WHEN 5 THEN FALSE END AS b FROM raw_texts""",
)
def _(g):
    return g.raw_texts.select(
        "k",
        text.valid_int(c("txt")).alias("i"),
        text.valid_decimal(c("txt")).cast("decimal(18,2)").cast("string").alias("d"),
        text.valid_boolean(c("txt")).alias("b"),
    )


@query(
    "c08_validate_date_time",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS dt FROM orders""",
)
def _(g):
    good, bad = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("o_orderdate", "yyyy-MM-dd")
    wrong = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-01T00:00:00"))
    key = c("o_orderkey")
    txt = F.when(key % 3 == 0, good).when(key % 3 == 1, bad).otherwise(wrong)
    return g.orders.select(key.alias("k"), text.valid_date_time(txt).alias("dt"))


@query(
    "c09_validate_forms",
    """SELECT k, k % 4 <> 3 AS iri, k % 3 <> 2 AS color, k % 2 = 0 AS name, k % 5 <> 4 AS path, k % 3 <> 1 AS code, TRUE AS geometry FROM raw_texts""",
)
def _(g):
    k, kind = c("k"), c("event_type")
    hexa = F.lpad(F.hex(k % 65536), 4, "0")
    iri = F.when(k % 4 != 3, F.concat(F.lit("http://example.org/"), kind, F.lit("/"), k.cast("string"))).otherwise(F.concat(F.lit("bad "), kind))
    color = F.when(k % 3 == 0, F.concat(F.lit("#ab"), hexa)).when(k % 3 == 1, F.lit("#0fF")).otherwise(F.concat(F.lit("#"), hexa))
    name = F.when(k % 2 == 0, F.concat(kind, F.lit("-1.x"))).otherwise(F.concat(F.lit("1"), kind))
    path = F.when(k % 5 != 4, F.concat(kind, F.lit("/a/b_1"))).otherwise(F.concat(kind, F.lit("//b")))
    code = F.when(k % 3 != 1, hexa).otherwise(F.concat(hexa, F.lit("g")))
    geometry = F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))
    return g.raw_texts.select(
        "k",
        text.valid_iri(iri).isNotNull().alias("iri"),
        text.valid_color(color).isNotNull().alias("color"),
        text.valid_name(name).isNotNull().alias("name"),
        text.valid_map_path(path).isNotNull().alias("path"),
        text.valid_project_code(code).isNotNull().alias("code"),
        text.valid_geometry(geometry).isNotNull().alias("geometry"),
    )


@query(
    "c10_escape",
    r"""SELECT doc_id, replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), '''', '\'''), chr(9), '\t'), chr(10), '\n') AS escaped,
    TRUE AS same FROM documents WHERE NOT contains(text, chr(13)) AND text <> ''""",
)
def _(g):
    rows = g.documents.select("doc_id", "text", text.escape(c("text")).alias("escaped")).where("escaped IS NOT NULL")
    return rows.select("doc_id", "escaped", (text.unescape(c("escaped")) == c("text")).alias("same"))


@query(
    "c11_iri_parts",
    """SELECT p_partkey AS k, 'http://example.org/ontology/' || CASE WHEN p_partkey % 2 = 0 THEN '08a' || CAST(p_partkey % 10 AS STRING) || '/' ELSE '' END || p_type AS ontology,
    replace(p_name, ' ', '_') AS entity, CASE WHEN p_partkey % 2 = 0 THEN '08a' || CAST(p_partkey % 10 AS STRING) END AS project_code,
    CASE WHEN p_partkey % 2 = 0 THEN 'p08a' || CAST(p_partkey % 10 AS STRING) || '-' ELSE '' END || p_type AS prefix FROM part""",
)
def _(g):
    key = c("p_partkey")
    code = F.when(key % 2 == 0, F.concat(F.lit("08a"), (key % 10).cast("string"), F.lit("/"))).otherwise("")
    iri = F.concat(F.lit("http://example.org/ontology/"), code, c("p_type"), F.lit("#"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return g.part.select(key.alias("k"), text.iri_parts(iri).alias("x")).select("k", "x.*")


@query(
    "c12_link_value_names",
    "SELECT src, prop || 'Value' AS lp, prop AS back FROM links",
)
def _(g):
    from wovengraph.operators import pattern

    rows = g.links.select("src", pattern.link_value_property(c("prop")).alias("lp"))
    return rows.withColumn("back", pattern.link_property(c("lp")))


@query(
    "c13_schema",
    """SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN 'internal:' || substr(url, 8) ELSE url END AS internal FROM pages""",
)
def _(g):
    return g.pages.select("page_id", text.to_schema(c("url"), "http://", "internal:").alias("internal"))


@query(
    "c14_uuid_base64",
    """SELECT p_partkey AS k, replace(replace(rtrim(to_base64(unhex(md5(p_name || CAST(p_partkey AS STRING)))), '='), '+', '-'), '/', '_') AS short, TRUE AS same FROM part""",
)
def _(g):
    digits = F.md5(F.concat("p_name", c("p_partkey").cast("string")))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    uuid = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts])
    rows = g.part.select(c("p_partkey").alias("k"), uuid.alias("uuid"), text.uuid_to_base64(uuid).alias("short"))
    return rows.select("k", "short", (text.base64_to_uuid(c("short")) == c("uuid")).alias("same"))


@query(
    "c14_minted_iris",
    """SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_iris, TRUE AS right_length FROM part""",
)
def _(g):
    uuid = text.stable_uuid(F.lit("part"), c("p_partkey").cast("string"))
    iri = text.resource_iri("http://data.example.org", F.lit("08A1"), F.lit("parts"), uuid)
    rows = g.part.select(iri.alias("iri"), text.value_iri(iri, uuid).alias("value"))
    whole = F.length("iri") == len("http://data.example.org/08A1/parts/") + 22
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("iri").alias("n_iris"), F.bool_and(whole).alias("right_length"))


@query(
    "c15_project_graph",
    """SELECT c_custkey AS k, 'http://data' || CASE WHEN c_custkey % 2 = 0 THEN '/00' || CAST(10 + c_custkey % 80 AS STRING) ELSE '' END || '/' || c_mktsegment AS graph FROM customer""",
)
def _(g):
    key = c("c_custkey")
    code = F.when(key % 2 == 0, F.concat(F.lit("00"), (key % 80 + 10).cast("string")))
    return g.customer.select(key.alias("k"), text.project_graph("http://data", code, c("c_mktsegment")).alias("graph"))


@query(
    "c16_value_texts",
    """SELECT o_orderkey AS k, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d CE') || ' - ' || strftime(last_day(o_orderdate), '%Y-%m-%d CE') AS period,
    strftime(o_orderdate, '%Y-%m-%d CE') AS single, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' - ' ||
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS STRING) AS interval_text FROM orders""",
)
def _(g):
    n = lambda col: F.datediff(col, F.lit("1970-01-01").cast("date")) + 2440588
    price = c("o_totalprice").cast("decimal(18,2)")
    return g.orders.select(
        c("o_orderkey").alias("k"),
        dates.period_text(n(F.trunc("o_orderdate", "MM")), n(F.last_day("o_orderdate")), F.lit(False)).alias("period"),
        dates.period_text(n(c("o_orderdate")), n(c("o_orderdate")), F.lit(False)).alias("single"),
        dates.interval_text(price, (price + 1).cast("decimal(18,2)")).alias("interval_text"),
    )


@query(
    "c17_client_references",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'http://other/' || CAST(o_custkey AS STRING)
    WHEN c_custkey IS NOT NULL THEN 'customer/' || CAST(c_custkey AS STRING) END AS target
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 7 <> 0""",
)
def _(g):
    key = c("o_custkey").cast("string")
    target = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("http://other/"), key)).otherwise(F.concat(F.lit("ref:c"), key))
    ids = g.customer.where("c_custkey % 7 <> 0").select(
        F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("client_id"),
        F.concat(F.lit("customer/"), c("c_custkey").cast("string")).alias("iri"),
    )
    return text.resolve_client_references(g.orders.select(c("o_orderkey").alias("k"), target.alias("target")), "target", ids)


@query(
    "c18_property_names",
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'http://onto/' || lower(p_type) || '#' || replace(p_name, ' ', '_') END AS iri FROM part""",
)
def _(g):
    joiner = F.when(c("p_partkey") % 2 == 0, "__").otherwise(":")
    name = F.concat(F.lower("p_type"), joiner, F.replace("p_name", F.lit(" "), F.lit("_")))
    return g.part.select(c("p_partkey").alias("k"), text.property_iri(name, "http://onto/").alias("iri"))
