"""Access control as joins: permission codes for all users at once.

Permission strings look like ``CR g1|V g2,g3``. Users: (user_id,
is_system_admin, is_known); memberships: (user_id, project, grp);
admin_rights: (user_id, project).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# The code of each permission.
CODES = {"RV": 1, "V": 2, "M": 6, "D": 7, "CR": 8}
HIGHEST = 8


def permission_code(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[name]


def parse_permissions(df: DataFrame, column: str = "permissions") -> DataFrame:
    """One row per (permission, group) of the string; an unknown permission has a null code."""
    part = df.select(*df.columns, F.explode(F.split(column, "\\|")).alias("_part"))
    split = part.withColumns({"permission": F.split_part("_part", F.lit(" "), F.lit(1)), "_groups": F.split_part("_part", F.lit(" "), F.lit(2))})
    rows = split.select(*df.columns, "permission", F.explode(F.split("_groups", ",")).alias("grp"))
    return rows.withColumn("code", permission_code(F.col("permission")))


def _best(permissions: Column, groups: Column) -> Column:
    """Highest code the string grants to any of the groups (null without one)."""
    codes = F.transform(
        F.split(permissions, "\\|"),
        lambda part: F.when(
            F.arrays_overlap(F.split(F.split_part(part, F.lit(" "), F.lit(2)), ","), groups),
            permission_code(F.split_part(part, F.lit(" "), F.lit(1))),
        ),
    )
    return F.array_max(codes)


def user_profiles(users: DataFrame, memberships: DataFrame, admin_rights: DataFrame) -> DataFrame:
    """(user_id, flags, groups per project as a map, administered projects)."""
    per_project = memberships.groupBy("user_id", "project").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    maps = per_project.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("project", "groups"))).alias("project_groups"))
    admin = admin_rights.groupBy("user_id").agg(F.array_sort(F.collect_set("project")).alias("admin_of"))
    return users.join(maps, "user_id", "left").join(admin, "user_id", "left")


def code_for(user: Column | str, subject: dict[str, Column] | None = None) -> Column:
    """Code of a user (a profile struct) on a subject row (creator, project, permissions)."""
    u = F.col(user) if isinstance(user, str) else user
    s = subject or {n: F.col(n) for n in ("creator", "project", "permissions")}
    member = F.coalesce(u["project_groups"][s["project"]], F.array().cast("array<string>"))
    creator = F.when(s["creator"] == u["user_id"], F.array(F.lit("Creator"))).otherwise(F.array().cast("array<string>"))
    known = F.concat(F.array(F.lit("KnownUser")), member, creator)
    unknown = F.array(F.lit("UnknownUser"))
    granted = F.coalesce(_best(s["permissions"], F.when(u["is_known"], known).otherwise(unknown)), _best(s["permissions"], unknown))
    admin = u["is_system_admin"] | F.coalesce(F.array_contains(u["admin_of"], s["project"]), F.lit(False))
    return F.when(admin, F.lit(HIGHEST)).otherwise(granted)


def codes_for_requests(requests: DataFrame, subjects: DataFrame, profiles: DataFrame) -> DataFrame:
    """Codes for given (user_id, iri) requests, however many users there are."""
    people = profiles.select("user_id", F.struct(*profiles.columns).alias("_user"))
    found = requests.join(subjects.select("iri", "creator", "project", "permissions"), "iri").join(people, "user_id")
    return found.select("user_id", "iri", code_for("_user").alias("code"))


def profile_of(profiles: DataFrame, user_id: str) -> Row:
    rows = profiles.where(F.col("user_id") == user_id).limit(1).collect()
    if not rows:
        raise ValueError(f"unknown user: {user_id}")
    return rows[0]


def _granted(permissions: list[str], groups: list[str]) -> Column:
    """Does the string grant one of the permissions to one of the groups? One search, inside generated code."""
    names = "|".join(re.escape(g) for g in groups)
    return F.rlike("permissions", F.lit(rf"(?:^|\|)(?:{'|'.join(permissions)}) (?:[^|]*,)?(?:{names})(?:,|\||$)"))


def _by_project(user: Row, test) -> Column:
    """A test on the groups the user has in the project of the row; ``test`` maps groups to a column."""
    base = ["KnownUser"] if user["is_known"] else ["UnknownUser"]
    out = test(base)
    for project, groups in sorted((user["project_groups"] or {}).items()) if user["is_known"] else []:
        out = F.when(F.col("project") == project, test(base + sorted(groups))).otherwise(out)
    return out


def _known_grant(user: Row, permissions: list[str]) -> Column:
    own = (F.col("creator") == user["user_id"]) & _granted(permissions, ["Creator"])
    by_group = _by_project(user, lambda groups: _granted(permissions, groups))
    return by_group | own if user["is_known"] else by_group


def _is_admin(user: Row) -> Column:
    return F.lit(bool(user["is_system_admin"])) | F.coalesce(F.col("project").isin(user["admin_of"] or []), F.lit(False))


def with_code(subjects: DataFrame, profiles: DataFrame, user_id: str, name: str = "code") -> DataFrame:
    """Add one user's code: a column expression, no join."""
    user = profile_of(profiles, user_id)
    from_high = sorted(CODES.items(), key=lambda pair: -pair[1])
    code = F.when(_is_admin(user), HIGHEST)
    for permission, value in from_high:
        code = code.when(_known_grant(user, [permission]), value)
    for permission, value in from_high:
        code = code.when(_granted([permission], ["UnknownUser"]), value)
    return subjects.withColumn(name, code)


def has_at_least(code: Column, needed: str) -> Column:
    return F.coalesce(code >= CODES[needed], F.lit(False))


def visible(subjects: DataFrame, profiles: DataFrame, user_id: str, needed: str = "RV") -> DataFrame:
    """Rows on which the user has at least the permission. An unknown user's grants count where the user has none."""
    user = profile_of(profiles, user_id)
    enough = [p for p, code in CODES.items() if code >= CODES[needed]]
    fallback = _granted(enough, ["UnknownUser"])
    if len(enough) < len(CODES):
        fallback = fallback & ~_known_grant(user, list(CODES))
    return subjects.where(_is_admin(user) | _known_grant(user, enough) | fallback)


def least_code(a: Column, b: Column) -> Column:
    """The lower of two codes; a missing one means no access."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def value_projects(values: DataFrame, resources: DataFrame) -> DataFrame:
    """The project of each value as its resource has it, with what is wrong: (iri, project, problem)."""
    owner = resources.select(F.col("iri").alias("resource"), F.col("project").alias("_project"))
    rows = values.join(owner, "resource", "left")
    problem = F.when(F.col("_project").isNull(), "no project").when(
        F.col("project").isNotNull() & (F.col("project") != F.col("_project")), "projects differ"
    )
    return rows.select("iri", F.col("_project").alias("project"), problem.alias("problem"))


def only_fully_visible(parts: DataFrame) -> DataFrame:
    """Keep resources all of whose matched parts are visible.

    parts: (resource, code) - one row for every value and dependent resource of
    the match. One aggregation with map-side partial results.
    """
    shown = parts.groupBy("resource").agg(F.bool_and(F.col("code").isNotNull()).alias("_shown"))
    return shown.where("_shown").select("resource")


def hide_links_to(values: DataFrame, visible_targets: DataFrame) -> DataFrame:
    """Drop link values (column ``target``) whose target may not be seen; other values stay."""
    seen = visible_targets.select(F.col("iri").alias("target"), F.lit(True).alias("_seen"))
    rows = values.join(seen, "target", "left")
    return rows.where(F.col("target").isNull() | F.col("_seen")).select(*values.columns)


def with_placeholder(hits: DataFrame, visible_iris: DataFrame, placeholder: str) -> DataFrame:
    """Keep the number and places of hits; hidden ones become the placeholder."""
    seen = visible_iris.select("iri", F.lit(True).alias("_seen"))
    rows = hits.join(seen, "iri", "left")
    return rows.withColumn("shown", F.when(F.col("_seen"), F.col("iri")).otherwise(F.lit(placeholder))).drop("_seen")


def only_requested(values: DataFrame, requested: DataFrame) -> DataFrame:
    """Values of the properties asked for; requested: (prop) or (resource, prop)."""
    return values.join(requested, requested.columns, "left_semi")


# Which groups count first. Other groups are custom ones.
ADMIN_RANKS = {"ProjectAdmin": 1, "ProjectMember": 3, "KnownUser": 4}
BUILT_IN = ["ProjectAdmin", "ProjectMember", "KnownUser", "SystemAdmin", "Creator", "UnknownUser"]
CUSTOM_RANK = 2
FALLBACK = "CR Creator"


def group_rank(group: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in ADMIN_RANKS.items() for x in pair])
    return F.when(group.isin(BUILT_IN), ranks[group]).otherwise(CUSTOM_RANK)


def administrative_permissions(memberships: DataFrame, grants_by_group: DataFrame) -> DataFrame:
    """Administrative permissions per (user, project): those of the first rank that has any.

    grants_by_group: (project, grp, permission). Every member is a known user.
    """
    groups = memberships.select("user_id", "project", "grp").union(
        memberships.select("user_id", "project", F.lit("KnownUser"))
    )
    found = groups.distinct().join(grants_by_group, ["project", "grp"]).withColumn("rank", group_rank(F.col("grp")))
    best = found.groupBy("user_id", "project").agg(F.min("rank").alias("rank"))
    return found.join(best, ["user_id", "project", "rank"]).select("user_id", "project", "rank", "permission").distinct()


def default_permissions_for(defaults: DataFrame, project: Column, grp=None, cls=None, prop=None) -> DataFrame:
    """Default permissions for exactly this group, class or property; what is not given must be unset."""

    def agrees(column: str, wanted) -> Column:
        return F.col(column).isNull() if wanted is None else F.col(column) == wanted

    return defaults.where((F.col("project") == project) & agrees("grp", grp) & agrees("cls", cls) & agrees("prop", prop))


def default_object_permissions(requests: DataFrame, defaults: DataFrame, memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Default permissions of new objects: the first level that has any, else the creator's.

    requests: (request, user_id, project, cls, prop), with a null property for
    a new resource. All levels are looked up in one join of the requests with
    the (few) rules of their project and of the system.
    """
    groups = memberships.groupBy("user_id", "project").agg(F.collect_set("grp").alias("groups"))
    asked = requests.join(users.select("user_id", "is_system_admin"), "user_id").join(groups, ["user_id", "project"], "left")
    asked = asked.withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    rules = defaults.select(
        F.col("project").alias("_in"), F.col("grp").alias("_grp"), F.col("cls").alias("_cls"), F.col("prop").alias("_prop"), "permissions"
    )
    asked = asked.select("*", F.explode(F.array("project", F.lit("system"))).alias("_in"))
    rows = asked.join(rules, "_in")
    c = F.col
    own = c("_in") == c("project")
    member = lambda g: F.array_contains("groups", g)
    by_group = own & c("_grp").isNotNull() & c("_cls").isNull() & c("_prop").isNull()
    both = c("_grp").isNull() & (c("_cls") == c("cls")) & (c("_prop") == c("prop"))
    by_class = c("_grp").isNull() & c("prop").isNull() & (c("_cls") == c("cls")) & c("_prop").isNull()
    by_prop = c("_grp").isNull() & c("_cls").isNull() & (c("_prop") == c("prop"))
    level = (
        F.when(by_group & (c("_grp") == "ProjectAdmin") & (member(F.lit("ProjectAdmin")) | c("is_system_admin")), 0)
        .when(both & own, 1)
        .when(both, 2)
        .when(by_class & own, 3)
        .when(by_class, 4)
        .when(by_prop & own, 5)
        .when(by_prop, 6)
        .when(by_group & ~c("_grp").isin(BUILT_IN) & F.array_contains("groups", c("_grp")), 7)
        .when(by_group & (c("_grp") == "ProjectMember") & (member(F.lit("ProjectMember")) | c("is_system_admin")), 8)
        .when(by_group & (c("_grp") == "KnownUser"), 9)
    )
    found = rows.withColumn("level", level).where("level IS NOT NULL").select("request", "level", "permissions").distinct()
    best = found.groupBy("request").agg(F.min("level").alias("level"))
    chosen = format_permissions(parse_permissions(found.join(best, ["request", "level"])), ["request", "level"], descending=True)
    return requests.select("request").join(chosen, "request", "left").select(
        "request", F.coalesce("level", F.lit(10)).alias("level"), F.coalesce("permissions", F.lit(FALLBACK)).alias("permissions")
    )


def highest_per_group(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Without repeated entries and without those a higher one of the same group covers."""
    return parsed.groupBy(*keys, "grp").agg(F.max_by("permission", "code").alias("permission"), F.max("code").alias("code"))


def format_permissions(parsed: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    """Permission rows back to a string per key, groups sorted; permissions by code.

    The groups named in one permission string are few, so the lists are short.
    """
    best = highest_per_group(parsed, keys)
    per_code = best.groupBy(*keys, "permission", "code").agg(F.array_join(F.array_sort(F.collect_set("grp")), ",").alias("_groups"))
    order = -F.col("code") if descending else F.col("code")
    text = F.concat_ws(" ", "permission", "_groups")
    rows = per_code.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("_parts"))
    return rows.select(*keys, F.array_join("_parts.t", "|").alias("permissions"))


def link_end_permissions(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Creator, project and permissions of both ends of every link."""

    def end(column: str, side: str) -> DataFrame:
        return resources.select(
            F.col("iri").alias(column), *[F.col(c).alias(f"{side}_{c}") for c in ("creator", "project", "permissions")]
        )

    return links.select("link_value", "src", "dst").join(end("src", "source"), "src").join(end("dst", "target"), "dst")


def members(memberships: DataFrame, project: str | None = None, grp: str = "ProjectMember") -> DataFrame:
    rows = memberships.where(F.col("grp") == grp)
    return (rows.where(F.col("project") == project) if project else rows).select("user_id", "project").distinct()


def visible_markup_links(links: DataFrame, resources: DataFrame, profiles: DataFrame, user_id: str) -> DataFrame:
    """Code of every link: mark-up links (``is_markup``) need both ends, others also the link itself."""
    codes = with_code(resources, profiles, user_id).select("iri", "code")
    src, dst = codes.toDF("src", "_src"), codes.toDF("dst", "_dst")
    rows = with_code(links, profiles, user_id, "_own").join(src, "src", "left").join(dst, "dst", "left")
    both = least_code(F.col("_src"), F.col("_dst"))
    return rows.select("link_value", F.when(F.col("is_markup"), both).otherwise(least_code(both, F.col("_own"))).alias("code"))


def permission_sets(users: DataFrame, memberships: DataFrame, admin_rights: DataFrame) -> DataFrame:
    """Groups and rights of each user by project: (user_id, project, groups, is_project_admin)."""
    groups = memberships.groupBy("user_id", "project").agg(F.array_sort(F.collect_set("grp")).alias("groups"))
    admin = admin_rights.select("user_id", "project", F.lit(True).alias("_admin")).distinct()
    rows = users.join(groups, "user_id", "left").join(admin, ["user_id", "project"], "left")
    return rows.select(
        "user_id", "project", F.coalesce("groups", F.array().cast("array<string>")).alias("groups"),
        F.coalesce("_admin", F.lit(False)).alias("is_project_admin"), "is_system_admin",
    )
