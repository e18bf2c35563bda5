"""Graph patterns over a statement table (graph, s, p, o, o_kind).

A pattern result has one column per variable, named without the leading
question mark. An unbound variable is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_var(term: str) -> bool:
    return term.startswith("?")


def statements(triples, prop: str | None = None) -> DataFrame:
    """A statement table, or the part of a table set that can hold the property."""
    return triples if isinstance(triples, DataFrame) else triples.of(prop)


def match(triples, s: str, p: str, o: str, graph: str | None = None) -> DataFrame:
    """Statements matching the pattern; a repeated variable means equality."""
    bound: dict[str, Column] = {}
    condition = F.lit(True)
    for column, term in (("s", s), ("p", p), ("o", o), ("graph", graph)):
        if term is None:
            continue
        if not _is_var(term):
            condition = condition & (F.col(column) == term)
        elif term[1:] in bound:
            condition = condition & (F.col(column) == bound[term[1:]])
        else:
            bound[term[1:]] = F.col(column)
    rows = statements(triples, None if _is_var(p) else p)
    return rows.where(condition).select(*[c.alias(v) for v, c in bound.items()])


def match_any_property(triples, s: str, prop: str, o: str, prop_closure: DataFrame, as_var: str = "p") -> DataFrame:
    """Match the property or any property below it (closure: node, ancestor)."""
    below = prop_closure.where(F.col("ancestor") == prop).select(F.col("node").alias(as_var))
    return match(triples, s, f"?{as_var}", o).join(below, as_var)


def instances_of(resources: DataFrame, cls: str, class_closure: DataFrame) -> DataFrame:
    """Resources whose class is the given one or below it."""
    below = class_closure.where(F.col("ancestor") == cls).select(F.col("node").alias("cls"))
    return resources.join(below, "cls", "left_semi")


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def conjoin(left: DataFrame, right: DataFrame, nullable: tuple[str, ...] = (), compatible: bool = False) -> DataFrame:
    """Both patterns, joined on the variables they share.

    Joining on a variable that an optional part may leave unbound must be
    asked for: with ``compatible`` an unbound side agrees with any value.
    """
    on = shared(left, right)
    if not on:
        raise ValueError("the patterns share no variable")
    risky = [c for c in on if c in nullable]
    if not risky:
        return left.join(right, on)
    if not compatible:
        raise ValueError(f"possibly unbound: {risky}")
    firm = [c for c in on if c not in risky]
    if not firm:
        raise ValueError("a join needs at least one variable that is always bound")
    l, r = left.alias("l"), right.alias("r")
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in firm])
    for c in risky:
        condition = condition & (
            F.col(f"l.{c}").isNull() | F.col(f"r.{c}").isNull() | (F.col(f"l.{c}") == F.col(f"r.{c}"))
        )
    columns = [F.col(f"l.{c}") for c in firm] + [F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in risky]
    columns += [F.col(f"l.{c}") for c in left.columns if c not in on] + [F.col(f"r.{c}") for c in right.columns if c not in on]
    return l.join(r, condition).select(*columns)


def pattern(triples, *patterns: tuple[str, str, str]) -> DataFrame:
    """A conjunction of statement patterns over a statement table or table set."""
    return reduce(conjoin, [match(triples, *p) for p in patterns])


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left")


def not_exists(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Drop solutions for which the correlated pattern has a match.

    ``condition`` may refer to the sides by the aliases l and r.
    """
    l, r = left.alias("l"), right.alias("r")
    terms = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in shared(left, right)]
    if condition is not None:
        terms.append(condition)
    if not terms:
        return left.limit(0) if not right.isEmpty() else left
    return l.join(r, reduce(lambda a, b: a & b, terms), "left_anti")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, shared(left, right), "left_semi")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Remove solutions agreeing on the shared variables; none shared, none removed."""
    on = shared(left, right)
    return left.join(right, on, "left_anti") if on else left


def union(*parts: DataFrame) -> DataFrame:
    """Branches may bind different variables; what a branch lacks is unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def values(df: DataFrame, var: str, allowed: list[str] | DataFrame) -> DataFrame:
    """Bind a variable to a set: a literal list, or a one-column table of any size."""
    if isinstance(allowed, DataFrame):
        return df.join(allowed.toDF(var), var, "left_semi")
    return df.where(F.col(var).isin(allowed))


def construct(solutions: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    """Statements built from every solution; incomplete ones are left out, equal ones kept once."""

    def term(t: str) -> Column:
        return F.col(t[1:]).cast("string") if _is_var(t) else F.lit(t)

    rows = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
    return solutions.select(F.inline(rows)).dropna().distinct()


def ask(requests: DataFrame, found: DataFrame, name: str = "found") -> DataFrame:
    """Answer existence for a whole table of requests."""
    on = shared(requests, found)
    hits = found.select(*on).distinct().withColumn(name, F.lit(True))
    return requests.join(hits, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def link_property(name: Column) -> Column:
    return F.regexp_replace(name, "Value$", "")


def link_value_property(name: Column) -> Column:
    return F.concat(name, F.lit("Value"))


def expand_links(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Links that hold: the reified link is live and so is its target."""
    live = resources.where(~F.col("is_deleted")).select(F.col("iri").alias("dst"))
    return links.where(~F.col("is_deleted")).join(live, "dst", "left_semi")


def used_as_object(entities: DataFrame, triples, ignoring: list[str] = ()) -> DataFrame:
    """Entities (column ``entity``) that any statement refers to.

    Every object counts once: a task drops its repeats before they are dealt out, so one that all statements name fills no task.
    """
    uses = statements(triples).where(F.col("o_kind") == "iri")
    if ignoring:
        uses = uses.where(~F.col("p").isin(list(ignoring)))
    return entities.join(uses.select(F.col("o").alias("entity")).distinct(), "entity", "left_semi")


def best_label(labels: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """One label per node: preferred language, then fallback, then the smallest text."""
    of = lambda lang: F.min(F.when(F.col("lang") == lang, F.col("label")))
    return labels.groupBy("node").agg(F.coalesce(of(preferred), of(fallback), F.min("label")).alias("label"))
