"""Operators against brute force and known answers on small fixtures."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wovengraph.functions import dates, text
from wovengraph.operators import access, closure, edits, fulltext, inference, integrity, markup, migrations, ordering, pattern, values, views, walks
from wovengraph.plans import catalog
from wovengraph.sources import ingest, ntriples, sinks

c = F.col


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Ordering: the split path must give what the plain path gives, also with one hot group.


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(50), i) for i in range(3000)]
    return spark.createDataFrame(data, "k string, v int, i int"), data


@pytest.mark.parametrize("order", [["v", "i"], ["-v", "i"]])
def test_numbered_split(skewed, order):
    df, _ = skewed
    plain = ordering.numbered(df, ["k"], order)
    split = ordering.numbered(df, ["k"], order, hot_rows=300, ranges=7)
    assert rows(split) == rows(plain)


def test_numbered_without_keys(skewed):
    df, data = skewed
    got = ordering.numbered(df, [], ["v", "i"], hot_rows=100, ranges=5)
    want = {i: n + 1 for n, (_, v, i) in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    assert {r["i"]: r["pos"] for r in got.collect()} == want


def test_two_hot_groups_are_cut_by_their_own_rows(spark):
    """The groups' values lie apart; each must still be cut into several ranges."""
    df = spark.range(4000).select(F.when(c("id") < 2000, "a").otherwise("b").alias("k"), (c("id") + F.when(c("id") < 2000, 0).otherwise(10**9)).alias("v"))
    cut = ordering.ranged(df, ["k"], ["v"], 16)
    per = cut.groupBy("k", "_range").count()
    assert per.agg(F.max("count")).first()[0] < 1000 and min(r["count"] for r in per.groupBy("k").count().collect()) >= 4
    got = ordering.numbered(df, ["k"], ["v"], hot_rows=500, ranges=16)
    assert got.where((c("pos") - 1) % 2000 != (c("v") % 10**9) % 2000).isEmpty()


def test_page_by_rank_reads_one_range(spark):
    from wovengraph.operators import paging

    df = spark.range(300_000).select(((c("id") * 7919) % 300_000).alias("v"))
    ranked = paging.Ranked(df, [c("v")], 8)
    assert ranked.total == 300_000 and len(ranked.ranges) == 8
    for start, count in ((0, 25), (250_000, 25), (299_990, 25), (ranked.ranges[1][1] - 3, 10), (400_000, 5)):
        assert [r["v"] for r in ranked.slice(start, count).collect()] == list(range(start, min(start + count, 300_000)))
    deep = paging.page(df, [c("v")], 10_000)
    assert [r["v"] for r in deep.collect()] == list(range(250_000, 250_025))
    assert "GreaterThanOrEqual(_at" in deep._jdf.queryExecution().toString()


def test_with_previous_split(skewed):
    df, _ = skewed
    plain = ordering.with_previous(df, ["k"], ["v", "i"], "i", "prev")
    split = ordering.with_previous(df, ["k"], ["v", "i"], "i", "prev", hot_rows=300, ranges=7)
    norm = lambda d: sorted((r["i"], -1 if r["prev"] is None else r["prev"]) for r in d.collect())
    assert norm(split) == norm(plain)


def test_lists_come_whole_in_bounded_parts(skewed):
    df, data = skewed
    got = ordering.listed(df, ["k"], ["v", "i"], c("i"), "items", part_rows=100, hot_rows=300).collect()
    assert max(len(r["items"]) for r in got) <= 100
    joined = {}
    for r in sorted(got, key=lambda r: (r["k"], r["part"])):
        joined.setdefault(r["k"], []).extend(r["items"])
    want = {}
    for k, v, i in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert joined == want


def test_first_by_and_first_n(skewed):
    df, data = skewed
    best = {}
    for k, v, i in data:
        best[k] = min(best.get(k, (999, 0)), (v, i))
    assert {r["k"]: (r["v"], r["i"]) for r in ordering.first_by(df, ["k"], ["v", "i"]).collect()} == best
    assert ordering.first_n(df, ["k"], ["v", "i"], 3).groupBy("k").count().agg(F.max("count")).first()[0] == 3


# Hierarchies.


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "child string, parent string")


def test_closure_of_a_diamond(spark):
    got = rows(closure.ancestors(edges(spark, [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")])))
    assert ("d", "a", 2) in got and ("a", "a", 0) in got and len(got) == 9


def test_cycle_is_an_error(spark):
    with pytest.raises(closure.CycleError):
        closure.ancestors(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]))


def test_deep_lists_orphans_and_cycles(spark):
    deep = [(f"n{i:04}", f"n{i - 1:04}" if i else None, 0) for i in range(1500)]
    lost = [("o1", "gone", 1), ("o2", "o1", 1), ("c1", "c3", 1), ("c2", "c1", 1), ("c3", "c2", 1), ("c4", "c3", 1)]
    nodes = spark.createDataFrame(deep + lost, "node string, parent string, position int").coalesce(2)
    got = {r["node"]: r for r in closure.nested_list(nodes).collect()}
    assert len(got) == 1500 and got["n1499"]["level"] == 1499 and got["n1499"]["root"] == "n0000"
    assert got["n0002"]["sort_path"].split("/") == [f"0000000000:n000{i}" for i in range(3)]
    problems = {r["node"]: r["problem"] for r in closure.unplaced(nodes).collect()}
    assert problems == {"o1": "absent_parent", "o2": "absent_parent", "c1": "cycle", "c2": "cycle", "c3": "cycle", "c4": "cycle"}
    assert {r["node"]: r["level"] for r in closure.subtree(nodes, "n1497").collect()} == {"n1497": 0, "n1498": 1, "n1499": 2}
    starts = spark.createDataFrame([("n0003",)], "node string")
    assert [tuple(r) for r in closure.node_paths(nodes, starts).orderBy("up").collect()] == [("n0003", k, f"n000{3 - k}") for k in (0, 1, 2)]
    with pytest.raises(closure.CycleError):
        closure.node_paths(nodes, spark.createDataFrame([("c4",)], "node string"))
    pairs = closure.ancestors(nodes.where("node LIKE 'n%' AND parent IS NOT NULL").select(F.col("node").alias("child"), "parent"))
    assert pairs.count() == 1500 * 1501 // 2 and pairs.agg(F.max("depth")).first()[0] == 1499



def test_tree_labels_against_brute_force(spark):
    rng = random.Random(4)
    data, up = [], {}
    for k in range(400):
        parent = None if k < 3 else "gone" if k == 3 else f"n{rng.randrange(max(0, k - 40), k)}" if rng.random() < 0.5 else f"n{rng.randrange(min(k, 12))}"
        up[f"n{k}"] = parent
        data.append((f"n{k}", parent, rng.choice([None, 1, 2, 3])))
    data += [("c1", "c2", 1), ("c2", "c1", 1), ("below", "c1", 1), ("n5", "n4", 9)]
    by_node = {}
    for row in data:
        by_node[row[0]] = min(by_node.get(row[0], row), row, key=lambda r: (r[1] or "", r[2] or 0))
    below = {}
    for node, parent, position in by_node.values():
        below.setdefault(parent, []).append((position is None, position or 0, node))
    want = {}

    def walk(node, root, level, at):
        first = at
        for _, _, child in sorted(below.get(node, [])):
            at = walk(child, root, level + 1, at + 1)
        want[node] = (root, level, first, at)
        return at

    for top in [n for n, p, _ in by_node.values() if p in (None, "gone")]:
        walk(top, top, 0, 0)
    nodes = spark.createDataFrame(data, "node string, parent string, position int")
    labels = closure.tree_labels(nodes)
    got = {r["node"]: (r["root"], r["level"], r["pre"], r["last"]) for r in labels.where("root IS NOT NULL").collect()}
    assert got == want
    problems = {r["node"]: r["problem"] for r in closure.unplaced(labels).collect()}
    assert problems.pop("below") == problems.pop("c1") == problems.pop("c2") == "cycle"
    assert set(problems.values()) == {"absent_parent"} and set(problems) == {n for n, x in want.items() if x[0] == "n3"}
    some = spark.createDataFrame([(n,) for n in want], "node string")
    paths = {}
    for r in closure.node_paths(labels, some).collect():
        paths.setdefault(r["start"], {})[r["up"]] = r["node"]
    for node, (_, level, _, _) in want.items():
        way, at = {}, node
        for step in range(level):
            way[step], at = at, by_node[at][1]
        assert paths.get(node, {}) == way
    assert closure.tree_labels(nodes.limit(0)).isEmpty()


def test_deep_chain_labels(spark):
    chain = spark.createDataFrame([(f"n{k:04}", f"n{k - 1:04}" if k else None, 0) for k in range(1500)], "node string, parent string, position int")
    labels = closure.tree_labels(chain)
    assert rows(labels.select("level", "pre", "last")) == [(k, k, 1499) for k in range(1500)]
    last = spark.createDataFrame([("n1499",)], "node string")
    assert closure.node_paths(labels, last).where(c("node") != F.format_string("n%04d", 1499 - c("up"))).isEmpty()


def test_strictest_inherited_cardinality_wins(spark):
    cards = spark.createDataFrame(
        [("a", "p", "0-n", 1), ("b", "p", "1", 2), ("a", "q", "0-1", 1), ("d", "sub", "1", 3)], "cls string, prop string, card string, gui_order int"
    )
    props = closure.ancestors(edges(spark, [("sub", "q")]))
    got = closure.inherited_cardinalities(edges(spark, [("d", "a"), ("d", "b")]), props, cards)
    assert rows(got.where("cls = 'd'").select("prop", "card", "origin")) == [("p", "1", "b"), ("sub", "1", "d")]


def test_chain_heads_of_uneven_chains(spark):
    data = []
    for name, n in (("a", 1), ("b", 2), ("c", 37)):
        data += [(f"{name}{i}", f"{name}{i - 1}" if i else None) for i in range(n)]
    got = walks.chain_heads(spark.createDataFrame(data, "value string, prev_value string"))
    want = sorted((f"{x}{i}", f"{x}{n - 1}", n - 1 - i) for x, n in (("a", 1), ("b", 2), ("c", 37)) for i in range(n))
    assert rows(got) == want


def test_neighbourhood_is_breadth_first(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")]
    df = spark.createDataFrame([(f"{s}{t}", s, "p", t) for s, t in links], "link_value string, src string, prop string, dst string")
    nodes, walked = walks.neighbourhood(df, spark.createDataFrame([("a",)], "node string"), 2)
    assert rows(nodes.select("node", "depth")) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert rows(walked.select("link_value")) == [("ab",), ("ac",), ("bc",), ("ca",), ("cd",)]
    capped, _ = walks.neighbourhood(df, spark.createDataFrame([("a",)], "node string"), 1, per_node=1)
    assert rows(capped.select("node")) == [("a",), ("b",)]


# Patterns.


def test_join_on_unbound_variable_must_be_asked_for(spark):
    left = spark.createDataFrame([("s1", None), ("s2", "x")], "s string, v string")
    right = spark.createDataFrame([("s1", "y"), ("s2", "z"), ("s2", "x")], "s string, v string")
    with pytest.raises(ValueError):
        pattern.conjoin(left, right, nullable=("v",))
    assert rows(pattern.conjoin(left, right, ("v",), compatible=True)) == [("s1", "y"), ("s2", "x")]
    with pytest.raises(ValueError):
        pattern.conjoin(left, right.toDF("a", "b"))


def test_minus_and_not_exists_differ_without_shared_variables(spark):
    left, right = spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([("b",)], "y string")
    assert pattern.minus(left, right).count() == 1
    assert pattern.not_exists(left, right).count() == 0


# Values.


def test_operator_matrix():
    for vtype, op in (("BooleanValue", "<"), ("GeomValue", "="), ("UriValue", ">"), ("Link", "!=")):
        with pytest.raises(values.IllegalOperator):
            values.check_operator(vtype, op)


def test_not_like_is_existential(spark):
    data = [("v1", "r", "red"), ("v2", "r", "blue"), ("v3", "q", "red")]
    df = spark.createDataFrame(data, "iri string, resource string, as_string string").selectExpr("*", "'p' AS prop", "false AS is_deleted")
    assert rows(values.value_filter(df, "p", "not_like", "RED").select("resource")) == [("r",)]


def test_period_overlap_join_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda n: [(i, s, s + rng.randrange(100)) for i in range(n) for s in [rng.randrange(1000)]]
    a, b = make(60), make(60)
    schema = "id int, start_jdn int, end_jdn int"
    got = values.period_overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])
    assert rows(got.select("l_id", "r_id")) == want


# Dates.


def test_periods_of_any_length_take_few_slots(spark):
    rng = random.Random(9)
    make = lambda n: [(k, s, s + rng.choice([0, 1, 30, 365, 40_000, 1_461_000]) - (k % 9 == 0) * 2) for k in range(n) for s in [rng.randrange(-3000, 1_500_000)]]
    data = [make(120), make(90) + [(900, None, 5), (901, 5, None), (902, 0, 2_000_000_000)]]
    left, right = (spark.createDataFrame(d, "id int, start_jdn int, end_jdn int") for d in data)
    got = sorted(tuple(r) for r in values.period_overlap_join(left, right).select("l_id", "r_id").collect())
    ok = lambda r: r[1] is not None and r[2] is not None and r[1] <= r[2]
    assert got == sorted((a[0], b[0]) for a in data[0] for b in data[1] if ok(a) and ok(b) and a[1] <= b[2] and a[2] >= b[1])
    assert values.period_overlap_join(left.limit(0), right).isEmpty()


def test_known_days(spark):
    texts = [("JULIAN:1291-08-01",), ("JULIAN:44-03-15 BCE",), ("GREGORIAN:2000-01-01",), ("GREGORIAN:1582-10-15",), ("JULIAN:1582-10-05",), ("JULIAN:1900-02-29",), ("GREGORIAN:1900-02-29",)]
    got = dates.with_period(spark.createDataFrame(texts, "t string"), "t").collect()
    assert [r["period"]["start_jdn"] for r in got] == [2192808, 1705426, 2451545, 2299161, 2299161, 2415092, None]
    assert got[-1]["period"]["error"] == "invalid date"


def test_day_text_with_era(spark):
    df = spark.createDataFrame([(1705426,)], "n int")
    out = df.select(*[dates.date_text(c("n"), F.lit(True), F.lit(p)).alias(p) for p in ("DAY", "MONTH", "YEAR")]).first()
    assert tuple(out) == ("0044-03-15 BCE", "0044-03 BCE", "0044 BCE")


def test_every_day_of_some_centuries(spark):
    base = date(1890, 1, 1).toordinal()
    df = spark.range(base, base + 60000).select(c("id"), (c("id") + 1721425).cast("int").alias("n"))
    d = dates.from_jdn(c("n"), F.lit(False))
    got = df.select("id", d.alias("d")).collect()
    assert all((r["d"]["year"], r["d"]["month"], r["d"]["day"]) == (x.year, x.month, x.day) for r in got for x in [date.fromordinal(r["id"])])


# Text functions.


def test_escape_round_trip(spark):
    samples = ["a\\nb", "line\nbreak", 'say "hi"', "tab\t'q'", "back\\\\slash"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    assert [r[0] for r in df.select(text.unescape(text.escape(c("t")))).collect()] == samples
    assert [r[0] for r in spark.createDataFrame([("",), ("a\rb",)], "t string").select(text.escape(c("t"))).collect()] == [None, None]


def test_uuid_forms(spark):
    u = "0123abcd-4567-89ef-fedc-ba9876543210"
    short = spark.createDataFrame([(u,)], "u string").select(text.uuid_to_base64(c("u")).alias("s"))
    assert len(short.first()["s"]) == 22
    assert short.select(text.base64_to_uuid(c("s"))).first()[0] == u


# Full text.


def test_boolean_search(spark):
    df = spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "Red"), (4, "blue")], "id int, t string")
    found = lambda s, n="all": [r["id"] for r in df.where(fulltext.has_boolean(c("t"), s, n)).orderBy("id").collect()]
    assert found("+red -green -blue") == [2, 3]
    assert found("+red -green -blue", "any") == [3]


def test_signs_alone_find_nothing(spark):
    df = spark.createDataFrame([("a b",), ("--",), ("",)], "t string")
    for test in (fulltext.has_terms(c("t"), ["--"]), fulltext.has_terms(c("t"), []), fulltext.has_terms_typing(c("t"), "?! "), fulltext.has_phrase_typing(c("t"), ""), fulltext.has_boolean(c("t"), "+ -")):
        assert df.where(test).isEmpty()
    assert df.where(fulltext.has_terms(c("t"), ["A-b"])).count() == 1


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([("a", "Alpha beta"), ("b", "beta gamma"), ("c", "Übung beta")], "id string, t string")
    path = str(tmp_path / "index")
    fulltext.write_index(fulltext.text_index(df, "id", "t"), path)
    index = fulltext.read_index(spark, path)
    assert rows(fulltext.search_index(index, ["beta", "ga"], prefix_last=True)) == [("b",)]
    assert rows(fulltext.search_index(index, ["übung", "alpha"], "or")) == [("a",), ("c",)]
    plan = fulltext.search_index(index, ["gamma"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "PartitionFilters: [(slot" in plan


def test_token_index_with_parts(spark, tmp_path):
    from wovengraph.operators import tokenindex

    def found(state):
        res = spark.createDataFrame([(k, t, False) for k, t in state.items()], "iri string, label string, is_deleted boolean")
        return tokenindex.entries(res, spark.createDataFrame([], "iri string, resource string, vtype string, is_deleted boolean, as_string string"))

    rng, letters = random.Random(8), "abcdefgh"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 3)))
    state = {f"r{k}": ", ".join(word() for _ in range(rng.randint(0, 6))) for k in range(300)}
    index = tokenindex.TokenIndex(spark, str(tmp_path / "index"), 6).build(found(state))
    for _ in range(2):
        some = rng.sample(sorted(state), 60)
        before = {k: state[k] for k in some}
        state.update({k: " ".join(word() for _ in range(4)) for k in some[:40]})
        state.update(dict.fromkeys(some[40:], ""))
        index.change(found(before), found({k: state[k] for k in some}))
    check = lambda held: {k for k, t in state.items() if held([w for w in t.replace(",", " ").split()])}
    for at in (index, index.compact(str(tmp_path / "one"))):
        for a, b in (("a", "b"), ("c", "ab"), ("ha", "h")):
            got = lambda *x, **y: {r["resource"] for r in at.search(*x, **y).collect()}
            assert got(f"{a} {b}") == check(lambda t: a in t and b in t)
            assert got(f"{a}!{b}", "or") == check(lambda t: a in t or b in t)
            assert got(f"{a} {b}", typing=True) == check(lambda t: a in t and any(w.startswith(b) for w in t))
    assert index.search("?!").isEmpty() and index.search("zzz").isEmpty()
    assert at.files().count() > 1 and at.newest() == 0 and index.newest() == 2
    plan = at.scan([("abc", "abc")])._jdf.queryExecution().toString()
    low, high = at.files().where("low <= 'abc' AND high >= 'abc'").count(), at.files().count()
    assert "EqualTo(token,abc)" in plan and 0 < low < high
    assert len(at.scan([("abc", "abc")]).inputFiles()) == low


def test_token_index_changes_in_one_pass_and_merges_only_parts(spark, tmp_path):
    from wovengraph.operators import tokenindex

    entries = lambda *rows: spark.createDataFrame(rows, "token string, resource string, value string")
    old = entries(("red", "a", ""), ("hat", "a", "a/1"), ("red", "b", ""))
    index = tokenindex.TokenIndex(spark, str(tmp_path / "index"), 2).build(old)
    assert "RepartitionByExpression" not in index.search("red hat")._jdf.queryExecution().optimizedPlan().toString()
    added = []
    index._add, add = (lambda rows, version: (added.append(rows), add(rows, version))), index._add
    index.change(old, entries(("red", "a", ""), ("cap", "a", "a/1")))
    assert rows(added[0].select("token", "resource", "value", "removed")) == [("cap", "a", "a/1", False), ("hat", "a", "a/1", True), ("red", "b", "", True)]
    assert added[0]._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert rows(index.search("red")) == [("a", "")] and index.search("hat").isEmpty() and rows(index.search("ca", typing=True)) == [("a", "a/1")]


# Access.


@pytest.fixture(scope="module")
def profiles(spark):
    users = spark.createDataFrame([("root", True, True), ("padmin", False, True), ("m", False, True), ("none", False, False)], "user_id string, is_system_admin boolean, is_known boolean")
    members = spark.createDataFrame([("m", "p1", "ProjectMember"), ("padmin", "p1", "ProjectMember")], "user_id string, project string, grp string")
    return access.user_profiles(users, members, spark.createDataFrame([("padmin", "p1")], "user_id string, project string"))


def test_codes(spark, profiles):
    subjects = spark.createDataFrame(
        [("s1", "m", "p1", "CR Creator|V ProjectMember"), ("s2", "x", "p1", "M ProjectMember|RV UnknownUser"), ("s3", "x", "p2", "V UnknownUser"), ("s4", "x", "p2", "D ProjectMember")],
        "iri string, creator string, project string, permissions string",
    )
    codes = lambda u: [r["code"] for r in access.with_code(subjects, profiles, u).orderBy("iri").collect()]
    assert codes("m") == [8, 6, 2, None]
    assert codes("none") == [None, 1, 2, None]
    assert codes("padmin") == [8, 8, 2, None]
    assert codes("root") == [8, 8, 8, 8]
    with pytest.raises(ValueError):
        access.with_code(subjects, profiles, "nobody")


def test_least_code_with_missing(spark):
    df = spark.createDataFrame([(3, None), (2, 6), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(access.least_code(c("a"), c("b"))).collect()] == [None, 2, None]


# Rules and edits.


def test_compatible_cardinalities(spark):
    good = {("1", "1"), ("0-1", "0-1"), ("1", "0-1"), ("0-n", "0-n"), ("1-n", "0-n"), ("0-1", "0-n"), ("1", "0-n"), ("1-n", "1-n"), ("1", "1-n")}
    cards = closure.STRICTNESS
    df = spark.createDataFrame([(a, b) for a in cards for b in cards], "d string, b string")
    got = {(r["d"], r["b"]) for r in df.where(integrity.compatible(c("d"), c("b"))).collect()}
    assert got == good


def test_infer_marks_asserted(spark):
    t = spark.createDataFrame([("g", "x", "knows", "y", "iri"), ("g", "x", "type", "Man", "iri")], "graph string, s string, p string, o string, o_kind string")
    classes, props = closure.ancestors(edges(spark, [("Man", "Person")])), closure.ancestors(edges(spark, [("knows", "related")]))
    pairs = spark.createDataFrame([("related", "Person")], "prop string, cls string")
    got = {(r["s"], r["p"], r["o"]): r["asserted"] for r in inference.infer(t, classes, props, pairs, pairs).collect()}
    assert got[("x", "type", "Man")] and got[("x", "knows", "y")]
    assert got[("x", "related", "y")] is False and got[("y", "type", "Person")] is False


def _infer_by_hand(statements, classes, props, domains, ranges):
    up = lambda x, closure: {a for n, a in closure if n == x}
    found = {}
    for s, p, o, kind in statements:
        found[(s, p, o)] = True
    for s, p, o, kind in statements:
        held = [(s, "type", b) for b in up(o, classes)] if p == "type" else [(s, q, o) for q in up(p, props) | {p}]
        if p != "type":
            of = lambda pairs: {b for q, c in pairs if q in up(p, props) | {p} for b in up(c, classes) | {c}}  # noqa: B023, E731
            held += [(s, "type", c) for c in of(domains)] + [(o, "type", c) for c in of(ranges) if kind != "literal"]
        for row in held:
            found.setdefault(row, False)
    return sorted((*row, asserted) for row, asserted in found.items())


def test_rules_by_hand_and_each_statement_moved_once(spark):
    rng = random.Random(5)
    below = [("A", "B"), ("B", "C"), ("D", "C")], [("p", "q"), ("q", "r"), ("kind", "type"), ("u", "kind")]
    classes, props = (closure.ancestors(edges(spark, e)).select("node", "ancestor") for e in below)
    domains, ranges = [("q", "A"), ("w", "D"), ("kind", "E")], [("r", "B"), ("p", "F")]
    pairs = lambda rows: spark.createDataFrame(rows, "prop string, cls string")
    data = [(f"n{rng.randrange(6)}", rng.choice(["p", "q", "w", "x", "kind", "u"]), f"n{rng.randrange(6)}", rng.choice(["iri", "literal"])) for _ in range(150)]
    data += [(f"n{rng.randrange(6)}", "type", rng.choice("ABDXF"), "iri") for _ in range(12)] + data[:5]
    triples = spark.createDataFrame([("g", *r) for r in data], "graph string, s string, p string, o string, o_kind string")
    rules = inference.compile_rules(classes, props, pairs(domains), pairs(ranges))
    got = inference.apply_rules(triples, rules)
    closed = [[tuple(r) for r in x.collect()] for x in (classes, props)]
    assert rows(got) == _infer_by_hand(data, *closed, domains, ranges)
    # Statements and types are dealt out before they are multiplied, and a hierarchy does not make all of it run twice.
    every = inference.infer(triples, classes, props, pairs(domains), pairs(ranges))
    assert every._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    assert "anti" not in every._jdf.queryExecution().optimizedPlan().toString().lower()


def test_added_statements_meet_only_what_bears_on_their_nodes(spark):
    rng = random.Random(9)
    below = [("A", "B"), ("B", "C"), ("D", "C")], [("p", "q"), ("q", "r"), ("kind", "type"), ("u", "kind")]
    classes, props = (closure.ancestors(edges(spark, e)).select("node", "ancestor") for e in below)
    pairs = lambda rows: spark.createDataFrame(rows, "prop string, cls string")
    rules = inference.compile_rules(classes, props, pairs([("q", "A"), ("w", "D"), ("kind", "E")]), pairs([("r", "B"), ("p", "F")]))
    node = lambda n: f"n{rng.randrange(n)}"
    said = lambda n: (node(n), rng.choice(["p", "q", "w", "x", "kind", "u"]), node(n), rng.choice(["iri", "literal"]))
    kinds = lambda n: [(node(n), "type", rng.choice("ABDXF"), "iri") for _ in range(8)]
    table = lambda data: spark.createDataFrame([("g", *r) for r in data], "graph string, s string, p string, o string, o_kind string")
    new = [*[said(8) for _ in range(25)], *kinds(8), ("n1", "p", None, "iri")]
    old = [*[said(30) for _ in range(90)], *kinds(30), *new[:3], ("n1", "q", None, "iri"), (None, "p", "n2", "iri")]
    far = [("z1", "p", "z2", "iri"), ("z3", "type", "A", "iri")]
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(inference.infer_added(table(new), inference.apply_rules(table(old), rules), rules))
    assert len(want) > 20
    assert plain(inference.infer_new(table(new), table(old), rules)) == want
    assert plain(inference.infer_new(table(new), table(old + far), rules)) == want


def test_double_edit_is_rejected(spark):
    state = spark.createDataFrame([("v", None, True, False, "old")], "iri string, prev_value string, is_current boolean, is_deleted boolean, body string")
    batch = spark.createDataFrame([("v", "v1", "a"), ("v", "v2", "b")], "iri string, new_iri string, body string")
    new, rejected = edits.new_versions(state, batch, "body")
    assert rows(new.select("iri", "is_current")) == [("v", False), ("v1", True)]
    assert rows(rejected) == [("v", "v2", "edited twice")]


def test_repeats_in_a_batch_are_rejected(spark):
    links = spark.createDataFrame([("l0", "a", "p", "b", 1, False)], "link_value string, src string, prop string, dst string, ref_count long, is_deleted boolean")
    batch = spark.createDataFrame([("l3", "a", "p", "c"), ("l2", "a", "p", "c"), ("l4", "a", "p", "b"), ("l2", "a", "p", "c")], "link_value string, src string, prop string, dst string")
    new, rejected = edits.create_links(links, batch)
    assert rows(new.select("link_value")) == [("l0",), ("l2",)]
    assert rows(rejected.select("link_value", "reason")) == [("l2", "repeated in the batch"), ("l3", "repeated in the batch"), ("l4", "exists")]
    cards = spark.createDataFrame([("C", "p", "1", 0)], "cls string, prop string, card string, gui_order int")
    more = spark.createDataFrame([("C", "p", "0-n", 1), ("C", "q", "0-n", 1), ("C", "q", "0-1", 2)], cards.schema)
    assert rows(edits.add_cardinalities(cards, more).select("prop", "card")) == [("p", "1"), ("q", "0-1")]
    files = spark.createDataFrame([("r", "full", "f1", "x", True, None)], "resource string, quality string, iri string, file string, is_current boolean, prev_value string")
    twice = spark.createDataFrame([("r", "full", "f3", "z"), ("r", "full", "f2", "y")], "resource string, quality string, iri string, file string")
    assert rows(edits.replace_qualities(files, twice).select("iri", "is_current")) == [("f1", False), ("f2", True)]


# Mark-up.


def test_tags_are_parsed_once_for_both_results_of_a_mapping(spark):
    docs = spark.createDataFrame([("d", "<a><b/></a>")], "doc string, xml string")
    tags = markup.to_ranges(docs, "doc", "xml", namespaces=True).withColumn("css_class", F.lit(""))
    mapped, lacking = markup.map_tags(tags, spark.createDataFrame([("", "a", "", "A")], "namespace string, tag string, css_class string, cls string"))
    assert rows(mapped.select("tag", "cls")) == [("a", "A")] and rows(lacking.select("tag")) == [("b",)]
    assert "MapInArrow" not in mapped.union(lacking.withColumn("cls", F.lit(None)))._jdf.queryExecution().optimizedPlan().toString()


def test_markup_rows_are_handed_on_in_bounded_batches():
    schema = markup.pa.schema([("doc", markup.pa.string()), ("text", markup.pa.string())])
    texts = [("d", "x" * 1000) for _ in range(10_000)] + [("e", None)] * 40_000
    got = list(markup._held(iter(texts), schema))
    assert [r for b in got for r in zip(*b.to_pydict().values())] == texts
    assert max(b.num_rows for b in got) <= markup.HELD_ROWS
    assert max(sum(len(t or "") for t in b.to_pydict()["text"]) for b in got) <= markup.HELD_CHARS + 1000
    assert list(markup._held(iter([]), schema)) == []


def test_markup_round_trip_with_milestones(spark):
    xml = '<doc><p>a <b id="x">bold</b> &amp; <hi sID="1"/>over</p><p>lap<hi eID="1"/> end<br/></p></doc>'
    docs = spark.createDataFrame([("d", xml), ("bad", "<a><b></a>")], "doc string, xml string")
    ranges = markup.to_ranges(docs, "doc", "xml")
    assert ranges.where("error IS NOT NULL").select("doc").collect() == [("bad",)]
    good = ranges.where("doc = 'd'")
    assert good.where("tag_index = 0").first()["text"] == "a bold & overlap end"
    assert rows(markup.to_xml(good).select("doc", "xml")) == [("d", xml)]
    pairs, problems = markup.pair_milestones(good)
    assert rows(pairs.select("start_pos", "end_pos", "tag_index", "end_index")) == [(9, 16, 3, 5)]
    assert problems.count() == 0
    rest = good.where("tag <> 'hi'").select("doc", "text", "tag", "start_pos", "end_pos", "tag_index", "parent", "attributes")
    again = rest.unionByName(markup.as_milestones(pairs), allowMissingColumns=True)
    assert markup.to_xml(again).first()["xml"] == xml


def test_two_roots_are_an_error(spark):
    tags = spark.createDataFrame([("d", "ab", "a", 0, 1, 0, None, {}), ("d", None, "b", 1, 2, 1, None, {})], "doc string, text string, tag string, start_pos int, end_pos int, tag_index int, parent int, attributes map<string,string>")
    assert markup.to_xml(tags).first()["error"] == "one root tag is needed"


def test_html_is_read_leniently(spark):
    docs = spark.createDataFrame([("h", "<ul><li>one<li>two</ul><script>x<y</script><br>tail")], "doc string, html string")
    got = markup.to_ranges(docs, "doc", "html", html=True)
    assert got.where("tag_index = 0").first()["text"] == "onetwotail"


def test_inline_diff(spark):
    pairs = spark.createDataFrame([("1", "the old <text>", "the new <text>")], "pair string, base string, derived string")
    got = markup.inline_diffs(pairs, markup.text_diffs(pairs)).first()["marked"]
    assert got == "the <del>old</del><ins>new</ins> &lt;text&gt;"


# Sources and sinks.


def test_lines(spark):
    lines = [
        '<http://s> <http://p> "a \\"quoted\\" text\\n" .',
        '<http://s> <http://p> "x"^^<http://t> <http://g> . # "note"',
        '_:b1 <http://p> _:b2 .',
        '<http://s> <http://p> "chat"@fr-CH .',
        "# comment",
        "",
        '<http://s> <http://p> "broken .',
    ]
    got = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "d").collect()
    assert [(r["graph"], r["s"], r["o"], r["o_kind"], r["o_dt"], r["o_lang"]) for r in got[:4]] == [
        ("d", "http://s", 'a "quoted" text\n', "literal", None, None),
        ("http://g", "http://s", "x", "literal", "http://t", None),
        ("d", "b1", "b2", "blank", None, None),
        ("d", "http://s", "chat", "literal", None, "fr-CH"),
    ]
    assert len(got) == 5 and got[4]["s"] is None


def test_ingest_is_repeatable_and_reports(spark):
    res = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "client_id string")
    vals = spark.createDataFrame([("a", "p"), ("z", "p")], "client_id string, prop string")
    links = spark.createDataFrame([("a", "to", "ref:c"), ("a", "to", "ref:b"), ("c", "to", "http://x/1")], "client_id string, prop string, target string")
    made, _, new_links, problems = ingest.bulk_ingest(res, vals, links, "http://d", "batch")
    assert rows(made) == rows(ingest.bulk_ingest(res, vals, links, "http://d", "batch")[0])
    assert new_links.count() == 2
    assert sorted(r["problem"] for r in problems.collect()) == ["dangling reference", "duplicate client ID", "unknown owner"]


def test_subject_view_parts(spark):
    df = spark.createDataFrame([("s", f"p{i}", "o") for i in range(25)], "s string, p string, o string")
    got = sinks.subject_view(df, part_rows=10).collect()
    assert sorted(len(r["statements"]) for r in got) == [5, 10, 10]


def test_subject_view_keeps_each_statement_once_in_order(spark):
    data = [("a", f"p{i % 25:02}", "o") for i in range(50)] + [("b", "q", o) for o in "cabca"] + [(None, "q", "x")]
    df = spark.createDataFrame(data, "s string, p string, o string")
    got = sorted((r["s"] or "", r["part"], [tuple(x) for x in r["statements"]]) for r in sinks.subject_view(df, part_rows=10).collect())
    want = [(s, k, sorted({(p, o) for t, p, o in data if (t or "") == s})[10 * k : 10 * k + 10]) for s, n in (("", 1), ("a", 3), ("b", 1)) for k in range(n)]
    assert got == want
    # Subjects that fill one part are not numbered: no window, no table of distinct statements.
    small = spark.createDataFrame(data[50:], "s string, p string, o string")
    assert "Window" not in sinks.subject_view(small)._jdf.queryExecution().optimizedPlan().toString()


def test_objects_named_by_all_count_once_before_the_join(spark):
    triples = spark.createDataFrame([("g", f"s{i}", "p", "hub" if i % 10 else f"s{i + 1}", "iri") for i in range(200)], "graph string, s string, p string, o string, o_kind string")
    entities = spark.createDataFrame([("hub",), ("s1",), ("s2",)], "entity string")
    found = pattern.used_as_object(entities, triples)
    assert rows(found) == [("hub",), ("s1",)]
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()


def test_visible_agrees_with_codes(spark, profiles):
    strings = ["CR Creator|V ProjectMember", "RV ProjectMember|V UnknownUser", "D OtherMember", "M KnownUser|CR UnknownUser", "V XProjectMember,ProjectMember"]
    data = [(f"{i}{cr}{p}", cr, p, s) for i, s in enumerate(strings) for cr in ("m", "x") for p in ("p1", "p2")]
    df = spark.createDataFrame(data, "iri string, creator string, project string, permissions string")
    people = profiles.select("user_id", F.struct(*profiles.columns).alias("_u"))
    for user in ("root", "padmin", "m", "none"):
        by_row = df.withColumn("user_id", F.lit(user)).join(people, "user_id").select("iri", access.code_for("_u").alias("code"))
        assert rows(access.with_code(df, profiles, user).select("iri", F.coalesce("code", F.lit(0)))) == rows(by_row.select("iri", F.coalesce("code", F.lit(0))))
        for needed, least in access.CODES.items():
            want = rows(by_row.where(c("code") >= least).select("iri"))
            assert rows(access.visible(df, profiles, user, needed).select("iri")) == want, (user, needed)


def test_escapes_and_blank_graphs_of_lines(spark):
    """Escaped backslashes before letters, code points by number, blank graphs; bad escapes are no statements."""
    literals = {
        r"a\\r\r\\\\n\n": "a\\r\r\\\\n\n",
        r"é \U0001F600 😀 \\u00e9 \\é": "é 😀 😀 \\u00e9 \\é",
        r"say \"it\"\t\b\f\'": "say \"it\"\t\b\f'",
        "a\x1fb\x02 c\x85": "a\x1fb\x02 c\x85",
        "": "",
    }
    lines = [f'<http://s> <http://p> "{x}" .' for x in literals]
    bad = [r'<s> <p> "\x" .', r'<s> <p> "\ud800" .', r'<s> <p> "\U00110000" .', '<s> <p> "a"b" .', "\x02<s> <p> <o> .", r'<s> <p> "a\" .']
    others = [r"<http://é> <p> <> _:g .", "_:a <p> _:b <g\\u0031> . # note", '<s> <p> "x"@en _:h.', '<s> <p> "1"^^<dt> <g>.', "# none", " ", None]
    got = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines + bad + others], "value string"), "d").collect()
    assert [r["o"] for r in got[: len(lines)]] == list(literals.values())
    assert all(r["s"] == "http://s" and r["graph"] == "d" and r["o_kind"] == "literal" for r in got[: len(lines)])
    rejected = got[len(lines) : len(lines) + len(bad)]
    assert [r["o"] for r in rejected] == bad and all(r["s"] is None and r["o_kind"] is None for r in rejected)
    rest = [(r["graph"], r["s"], r["s_kind"], r["o"], r["o_kind"], r["o_dt"], r["o_lang"]) for r in got[len(lines) + len(bad) :]]
    assert rest == [
        ("_:g", "http://é", "iri", "", "iri", None, None),
        ("g1", "a", "blank", "b", "blank", None, None),
        ("_:h", "s", "iri", "x", "literal", None, "en"),
        ("g", "s", "iri", "1", "literal", "dt", None),
    ]
    sound = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines + others], "value string"), "d")
    assert ntriples.parse_lines(ntriples.format_lines(sound), "x").collect() == sound.collect()


def test_namespaces_of_nested_declarations(spark):
    """The nearest declaration counts; attributes with a prefix keep its namespace; unknown prefixes are errors."""
    docs = [
        ("a", '<x:a xmlns:x="u"><b xmlns="v" x:k="1" k="2"><x:c xmlns:x="w}"/><c xmlns=""/></b><x:d/></x:a>'),
        ("b", "<x:a/>"),
        ("c", None),
    ]
    df = spark.createDataFrame(docs, "doc string, xml string")
    got = markup.to_ranges(df, "doc", "xml", namespaces=True).orderBy("doc", "tag_index").collect()
    assert [(r["namespace"], r["tag"], r["parent"]) for r in got if r["doc"] == "a"] == [
        ("u", "a", None), ("v", "b", 0), ("w}", "c", 1), ("", "c", 1), ("u", "d", 0)
    ]
    assert got[1]["attributes"] == {"{u}k": "1", "k": "2"} and got[0]["attributes"] == {}
    assert all(r["error"] and r["tag"] is None for r in got if r["doc"] != "a")


def test_statements_divided_in_one_pass(spark):
    rows = [("a", "type", "Part/x"), ("a", "label", "A"), ("b", "type", "Order"), ("b", "label", None), ("v", "type", "IntValue"), ("v", "asInt", "1"), ("v2", "type", "TextValue"), ("n", "label", "no type")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    mains = spark.createDataFrame([("a",), ("a",), ("v2",)], "s string")
    got = views.with_part(triples, mains)
    want = {"main": [rows[0], rows[1]], "dependent": [rows[2], rows[3]], "value": rows[4:7]}
    assert sorted(map(str, got.collect())) == sorted(str(Row(s=s, p=p, o=o, kind=k)) for k, of in want.items() for s, p, o in of)
    parts = views.split_result(triples, mains)
    assert {k: sorted(map(str, df.collect())) for k, df in parts.items()} == {k: sorted(str(Row(s=s, p=p, o=o)) for s, p, o in of) for k, of in want.items()}


def test_split_result_counts_in_one_pass(spark):
    plan = catalog.QUERIES["b06_split_result"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_value_projects_are_looked_up_once_for_all_parts(spark):
    parts = [spark.createDataFrame(x, "s string, p string, o string") for x in (
        [("r1", "type", "Thing"), ("r1", "project", "p1"), ("v1", "project", "p1")],
        [("v1", "type", "TextValue"), ("v1", "type", "IntValue"), ("v2", "project", "p2")],
        [("v2", "type", "LinkValue"), ("r2", "project", "p2"), ("r2", "project", "p3")],
    )]
    out = migrations.drop_value_projects(parts[0].union(parts[1]).union(parts[2]))
    assert joins(out) == 1
    assert rows(out.where("p = 'project'").select("s", "o")) == [("r1", "p1"), ("r2", "p2"), ("r2", "p3")]
    assert out.where("p = 'type'").count() == 4


def test_token_index_reads_a_single_part_as_it_lies(spark, tmp_path):
    from wovengraph.operators import tokenindex

    schema = "token string, resource string, value string"
    found = spark.createDataFrame([("red", "a", ""), ("red", "a", ""), ("hat", "b", "b/1")], schema)
    index = tokenindex.TokenIndex(spark, str(tmp_path / "index"), 2).build(found)
    plan = index.rows()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Repartition" not in plan
    assert rows(index.rows()) == [("hat", "b", "b/1"), ("red", "a", "")]
    index.change(found.where("token = 'hat'"), found.limit(0))
    assert rows(index.rows()) == [("red", "a", "")]


def test_index_entries_look_resources_up_once(spark):
    from wovengraph.operators import tokenindex

    part = lambda iri: spark.createDataFrame([(iri, "a", "TextValue", False, "x y")], "iri string, resource string, vtype string, is_deleted boolean, as_string string")
    res = spark.createDataFrame([("a", "red", False), ("a", "red", False), ("b", "hat", True)], "iri string, label string, is_deleted boolean")
    out = tokenindex.entries(res.distinct(), part("v1").union(part("v2")).union(part("v3")))
    assert joins(out) == 1 and out.count() == 7


def test_missing_properties_are_looked_up_once(spark):
    batch = lambda *rows: spark.createDataFrame(rows, "client_id string, cls string")
    resources = batch(("a", "Thing")).union(batch(("b", "Thing"))).union(batch(("c", "Other")))
    needed = resources.join(spark.createDataFrame([("Thing", "name")], "cls string, prop string"), "cls")
    held = spark.createDataFrame([("a", "name"), ("a", "name")], "client_id string, prop string")
    left = ordering.lacking(needed, held, ["client_id", "prop"])
    assert rows(left.select("client_id", "prop")) == [("b", "name")]
    assert rows(ordering.having(needed, held, ["client_id", "prop"]).select("client_id")) == [("a",)]
    links = spark.createDataFrame([], "client_id string, prop string, target_id string")
    values = spark.createDataFrame([("a", "name", "TextValue")], "client_id string, prop string, vtype string")
    cards = spark.createDataFrame([("Thing", "name", "1")], "cls string, prop string, card string")
    wanted = spark.createDataFrame([("name", "TextValue")], "prop string, object_class string")
    closure = spark.createDataFrame([("Thing", "Thing")], "node string, ancestor string")
    out = integrity.ingest_problems(resources, values, links, cards, wanted, closure)
    assert rows(out) == [("missing", "b", "name", "1")]
    assert "LeftAnti" not in out.where("rule = 'missing'")._jdf.queryExecution().optimizedPlan().toString()


def test_requests_their_resource_rejects_meet_no_values(spark, profiles, monkeypatch):
    res = [("r1", "C", False, "M KnownUser"), ("r2", "C", True, "M KnownUser"), ("r3", "C", False, "V KnownUser")]
    res = spark.createDataFrame([(*r, "x", "p1") for r in res], "iri string, cls string, is_deleted boolean, permissions string, creator string, project string")
    literals = "as_string string, as_int int, as_decimal decimal(18,2), as_boolean boolean, as_uri string, as_node string, start_jdn int, end_jdn int, prec string"
    none = (None,) * 8
    vals = spark.createDataFrame([("v1", "r1", "one", "T", 4, "a", *none, False), ("v2", "r1", "many", "T", 2, "b", *none, False)], f"iri string, resource string, prop string, vtype string, vorder int, {literals}, is_deleted boolean")
    asked = [(1, "none", "many", "T", "w1", "x"), (2, "r2", "many", "T", "w2", "x"), (3, "r1", "odd", "T", "w3", "x"), (4, "r1", "many", "U", "w4", "x"), (5, "r3", "many", "T", "w5", "x"),
             (6, "r1", "many", "T", "v1", "x"), (7, "r1", "many", "T", "w1", "y"), (8, "r1", "many", "T", "w8", "b"), (9, "r1", "one", "T", "w9", "z"), (10, "r1", "many", "T", "w10", "z"), (11, "r1", "many", "T", "w11", "z"), (12, "r1", "many", "T", None, "q")]
    new = spark.createDataFrame([(*r, *none) for r in asked], f"seq long, resource string, prop string, vtype string, iri string, {literals}")
    types = spark.createDataFrame([("one", "T"), ("many", "T")], "prop string, vtype string")
    cards = spark.createDataFrame([("C", "one", "0-1"), ("C", "many", "0-n")], "cls string, prop string, card string")
    held = []
    monkeypatch.setattr(edits, "sifted", lambda rows, others, keys: held.append(others.count()) or ordering.sifted(rows, others, keys))
    state, rejected = edits.replay_values(vals, res, new, types, cards, profiles, "m")
    want = {1: "unknown resource", 2: "deleted resource", 3: "unknown property", 4: "wrong type", 5: "no right", 6: "IRI exists", 7: "IRI exists", 8: "same value", 9: "no more values allowed", 11: "same value"}
    assert {r["seq"]: r["reason"] for r in rejected.collect()} == want and rejected.count() == len(want)
    assert rows(state.where("iri LIKE 'w%'").select("iri", "vorder", "as_string")) == [("w10", 3, "z")]
    assert held and set(held) == {6}


def test_sifted_rows_are_all_that_can_meet(spark):
    left = spark.range(20_000).select(F.when(c("id") % 5 > 0, c("id").cast("string")).alias("k"), (c("id") % 3).alias("n"))
    right = spark.createDataFrame([("1", 1), (None, 0), ("12", 0), ("x", 2)], "k string, n long")
    kept = ordering.sifted(left, right, ["k", "n"])
    met = left.join(right, [left["k"].eqNullSafe(right["k"]), left["n"] == right["n"]], "left_semi")
    assert met.exceptAll(kept).isEmpty() and met.count() <= kept.count() < met.count() + 50
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert ordering.sifted(left, right.limit(0), ["k", "n"]).isEmpty()


def test_only_texts_of_later_parts_are_merged(spark, tmp_path):
    from wovengraph.operators import tokenindex

    schema = "token string, resource string, value string"
    found = spark.createDataFrame([(t, f"r{k}", v) for k in range(200) for t in ("red", "hat") for v in ("", "v")] + [("red", None, "")], schema)
    index = tokenindex.TokenIndex(spark, str(tmp_path / "index"), 2).build(found)
    index.change(found.where("resource = 'r1' AND value = 'v'"), spark.createDataFrame([("cap", "r1", "v"), ("cap", "new", "v")], schema))
    index.change(found.where("resource IS NULL"), found.limit(0))
    merged = []
    index._current, current = (lambda held: merged.append(held.count()) or current(held)), index._current
    gone = spark.createDataFrame([("red", "r1", "v"), ("hat", "r1", "v"), ("red", None, "")], schema)
    want = found.exceptAll(gone).union(spark.createDataFrame([("cap", "r1", "v"), ("cap", "new", "v")], schema))
    got = index.rows()
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert 8 <= merged[0] < 30


@pytest.fixture(scope="module")
def statement_tables(spark):
    from wovengraph.sources import relational

    res = spark.createDataFrame([(f"r{k}", "C", f"L{k}", "u", "p", k % 2 == 0) for k in range(6)] + [(None, "C", "x", "u", "p", False)], "iri string, cls string, label string, creator string, project string, is_deleted boolean")
    val = [(f"r{k % 4}/v{k % 9}", f"r{k % 4}", "text" if k % 3 else None, "T", k % 2, "a" if k % 2 else None, k, None, "p") for k in range(30)]
    val = spark.createDataFrame(val, "iri string, resource string, prop string, vtype string, vorder int, as_string string, as_int int, as_node string, project string").withColumn("as_decimal", F.lit(None).cast("decimal(18,2)"))
    links = spark.createDataFrame([(f"l{k % 5}", f"r{k % 3}", "to", f"r{k % 6}", k % 2 == 0, "p") for k in range(12)], "link_value string, src string, prop string, dst string, is_deleted boolean, project string")
    return relational.StatementTables(res, val, links)


def test_statements_by_subject_are_the_same(statement_tables):
    from wovengraph.sources import relational

    one, other = statement_tables.of().select("s", "p", "o", "o_kind"), relational.flat(statement_tables.by_subject())
    assert one.count() == other.count() and one.exceptAll(other).isEmpty()


def test_subject_view_of_arrays(statement_tables, spark):
    view = lambda df, n: sorted((r["s"] or "", r["part"], str(r["statements"])) for r in sinks.subject_view(df, part_rows=n).collect())
    flat_rows = statement_tables.of().select("s", "p", "o")
    for n in (3, 10_000):
        assert view(statement_tables.by_subject(), n) == view(flat_rows, n)
    plan = sinks.subject_view(statement_tables.by_subject())._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1


def test_groups_are_counted_in_slots_first(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ordering, "settle", lambda df: written.append(df.columns) or df)
    df = spark.range(100).select((c("id") % 10).cast("string").alias("k"), c("id").alias("v"))
    plain = rows(ordering.numbered(df, ["k"], ["v"]))
    assert written[0] == ["_slot", "_n"]
    assert rows(ordering.numbered(df, ["k"], ["v"], hot_rows=5, ranges=3).select("k", "v", "pos")) == plain


def test_inference_from_arrays_moves_them_once(statement_tables, spark):
    pairs = lambda data: spark.createDataFrame(data, "prop string, cls string")
    classes, props = (closure.ancestors(edges(spark, e)).select("node", "ancestor") for e in ([("C", "D"), ("T", "V")], [("to", "linked"), ("text", "held"), ("creator", "by")]))
    domains, ranges = pairs([("linked", "D"), ("held", "D")]), pairs([("to", "C"), ("text", "T"), ("by", "U")])
    classes = classes.union(spark.createDataFrame([("C", None)], "node string, ancestor string"))
    by_subject = statement_tables.by_subject()
    for axioms in (False, True):
        got, want = (inference.infer(t, classes, props, domains, ranges, axioms) for t in (by_subject, statement_tables.of()))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rules = inference.compile_rules(classes, props, domains, ranges)
    assert inference.apply_rules(by_subject, rules)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
    # What bears on nodes moves once: the repartition is the one that brings a node's rules together.
    wide = inference._types(by_subject, inference.settle(rules))._jdf.queryExecution().executedPlan().toString()
    assert wide.count("Exchange hashpartitioning") == 1


def test_stated_statements_are_sifted_before_they_move(spark, monkeypatch):
    seen = []

    def sift(df, others, keys):
        out = ordering.sifted(df, others, keys)
        seen.append((df.count(), out.count()))
        return out

    monkeypatch.setattr(inference, "sifted", sift)
    table = lambda data: spark.createDataFrame([(s, p, o, "iri") for s, p, o in data], "s string, p string, o string, o_kind string")
    classes, props = (closure.ancestors(edges(spark, e)).select("node", "ancestor") for e in ([("A", "B")], [("p", "q")]))
    pairs = spark.createDataFrame([("q", "A")], "prop string, cls string")
    old = [(f"n{k}", "p", f"n{k + 1}") for k in range(500)]
    got = inference.infer_new(table([("n3", "p", "m"), ("n4", "type", "B")]), table(old), inference.compile_rules(classes, props, pairs, pairs))
    assert rows(got.select("s", "p", "o")) == [("m", "type", "A"), ("m", "type", "B"), ("n3", "p", "m"), ("n3", "q", "m")]
    assert seen[0][0] == 1000 and seen[0][1] < 20
