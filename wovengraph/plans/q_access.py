"""Access control queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wovengraph.operators import access
from wovengraph.plans import fixture
from wovengraph.plans.registry import query

c = F.col
FIX = fixture.FIXTURES
_USERS = ["user/0", "user/1", "user/2", "user/3", "user/4", "user/5", "user/6", "user/9", "anonymous"]
FIX["requests"] = (
    "SELECT CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(_USERS)) + " END AS user_id, "
    "'order/' || CAST(o_orderkey AS STRING) AS iri FROM orders"
)
# Members and rules that follow from the data, so that the work grows with it.
FIX["staff"] = (
    "SELECT 'c/' || CAST(c_custkey AS STRING) AS user_id, 'project/' || CAST(c_nationkey % 4 AS STRING) AS project, "
    "CASE c_custkey % 4 WHEN 0 THEN 'ProjectAdmin' WHEN 1 THEN 'ProjectMember' WHEN 2 THEN 'group/' || c_mktsegment ELSE 'KnownUser' END AS grp FROM customer "
    "UNION ALL SELECT 'c/' || CAST(c_custkey AS STRING), 'project/' || CAST(c_nationkey % 4 AS STRING), 'ProjectMember' FROM customer WHERE c_custkey % 3 = 0"
)
FIX["staff_users"] = (
    "SELECT 'c/' || CAST(c_custkey AS STRING) AS user_id, c_custkey % 50 = 7 AS is_system_admin, TRUE AS is_known FROM customer"
)
FIX["admin_grants"] = (
    "SELECT * FROM (VALUES ('project/0','ProjectAdmin','ProjectAdminAll'),('project/0','ProjectMember','ProjectResourceCreate'),"
    "('project/0','KnownUser','Look'),('project/1','group/BUILDING','GroupAdmin'),('project/1','ProjectMember','ProjectResourceCreate'),"
    "('project/1','group/BUILDING','ProjectResourceCreate'),('project/2','KnownUser','Look'),('project/3','group/MACHINERY','GroupAdmin')) AS a(project, grp, permission)"
)


def _profiles(g):
    return access.user_profiles(g.users, g.memberships, g.admin_rights)


@query(
    "h01_parsed_permissions",
    """SELECT iri, split_part(part, ' ', 1) AS permission, unnest(string_split(split_part(part, ' ', 2), ',')) AS grp FROM
    (SELECT iri, unnest(string_split(permissions, '|')) AS part FROM resources) p""",
)
def _(g):
    return access.parse_permissions(g.resources.select("iri", "permissions")).select("iri", "permission", "grp")


@query("h02_permission_codes", "SELECT code, count(*) AS n FROM grants GROUP BY code")
def _(g):
    subjects = g.resources.select("iri", "permissions").union(g.vals.select("iri", "permissions")).union(g.links.select("link_value", "permissions"))
    parsed = access.parse_permissions(subjects)
    return parsed.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "h03_codes_for_requests",
    "SELECT q.user_id, q.iri, s.code FROM requests q JOIN subject_codes s ON s.iri = q.iri AND s.user_id = q.user_id",
)
def _(g):
    return access.codes_for_requests(g.requests, g.resources, _profiles(g))


@query("h03_codes_for_user", "SELECT iri, code FROM subject_codes WHERE user_id = 'user/2' AND iri IN (SELECT iri FROM resources)")
def _(g):
    return access.with_code(g.resources, _profiles(g), "user/2").select("iri", "code")


@query(
    "h04_admins",
    """SELECT s.iri, s.user_id, s.code FROM subject_codes s JOIN resources r ON r.iri = s.iri
    WHERE (s.user_id = 'user/0' OR (s.user_id = 'user/1' AND r.project = 'project/1')) AND r.cls LIKE 'Part/%'""",
)
def _(g):
    parts = g.resources.where(c("cls").startswith("Part/"))
    system = access.with_code(parts, _profiles(g), "user/0").select("iri", F.lit("user/0").alias("user_id"), "code")
    project = access.with_code(parts.where(c("project") == "project/1"), _profiles(g), "user/1")
    return system.union(project.select("iri", F.lit("user/1").alias("user_id"), "code"))


@query("h05_unknown_user_fallback", "SELECT iri, code FROM subject_codes WHERE user_id = 'user/9' AND iri IN (SELECT iri FROM vals)")
def _(g):
    return access.with_code(g.vals, _profiles(g), "user/9").select("iri", "code")


@query("h06_at_least", "SELECT iri, coalesce(code >= 2, FALSE) AS may_view FROM subject_codes WHERE user_id = 'anonymous' AND iri IN (SELECT iri FROM resources)")
def _(g):
    rows = access.with_code(g.resources, _profiles(g), "anonymous")
    return rows.select("iri", access.has_at_least(c("code"), "V").alias("may_view"))


@query(
    "h07_value_projects",
    """SELECT v.iri, r.project, CASE WHEN r.project IS NULL THEN 'no project' WHEN v.vorder = 1 AND v.prop = 'hasSize' AND r.project <> 'project/3' THEN 'projects differ' END AS problem
    FROM vals v LEFT JOIN resources r ON r.iri = v.resource AND r.cls NOT LIKE 'Page/%'""",
)
def _(g):
    owners = g.resources.where(~c("cls").startswith("Page/"))
    moved = (c("vorder") == 1) & (c("prop") == "hasSize")
    return access.value_projects(g.vals.withColumn("project", F.when(moved, "project/3")), owners)


@query(
    "h08_least_code",
    """SELECT v.iri, CASE WHEN a.code IS NOT NULL AND b.code IS NOT NULL THEN least(a.code, b.code) END AS code FROM vals v
    JOIN subject_codes a ON a.iri = v.iri AND a.user_id = 'user/4' JOIN subject_codes b ON b.iri = v.resource AND b.user_id = 'user/4'""",
)
def _(g):
    own = access.with_code(g.vals, _profiles(g), "user/4", "a").select("iri", "resource", "a")
    res = access.with_code(g.resources, _profiles(g), "user/4", "b").select(c("iri").alias("resource"), "b")
    return own.join(res, "resource").select("iri", access.least_code(c("a"), c("b")).alias("code"))


@query(
    "h09_fully_visible",
    """SELECT DISTINCT v.resource FROM vals v WHERE NOT EXISTS (SELECT 1 FROM vals w JOIN subject_codes s ON s.iri = w.iri
    AND s.user_id = 'user/3' AND s.code IS NULL WHERE w.resource = v.resource)""",
)
def _(g):
    return access.only_fully_visible(access.with_code(g.vals, _profiles(g), "user/3"))


@query(
    "h10_hidden_link_targets",
    """SELECT l.link_value FROM links l JOIN subject_codes s ON s.iri = l.dst AND s.user_id = 'user/3' AND s.code >= 1
    UNION ALL SELECT iri FROM vals WHERE prop = 'hasSize'""",
)
def _(g):
    seen = access.visible(g.resources, _profiles(g), "user/3")
    rows = g.links.select("link_value", c("dst").alias("target"))
    rows = rows.union(g.vals.where("prop = 'hasSize'").select("iri", F.lit(None).cast("string")))
    return access.hide_links_to(rows, seen).select("link_value")


@query(
    "h11_placeholder",
    """SELECT r.iri, CASE WHEN s.code >= 1 THEN r.iri ELSE 'hidden' END AS shown FROM resources r JOIN subject_codes s ON s.iri = r.iri AND s.user_id = 'user/6'""",
)
def _(g):
    return access.with_placeholder(g.resources.select("iri"), access.visible(g.resources, _profiles(g), "user/6"), "hidden")


@query(
    "h12_only_requested",
    "SELECT iri, prop FROM vals WHERE prop IN (SELECT prop FROM cardinalities WHERE cls = 'Order')",
)
def _(g):
    wanted = g.cardinalities.where("cls = 'Order'").select("prop")
    return access.only_requested(g.vals, wanted).select("iri", "prop")


@query(
    "h13_administrative",
    """WITH all_groups AS (SELECT DISTINCT user_id, project, grp FROM (SELECT * FROM staff UNION ALL SELECT user_id, project, 'KnownUser' FROM staff) z),
    ranked AS (SELECT a.user_id, a.project, p.permission, CASE a.grp WHEN 'ProjectAdmin' THEN 1 WHEN 'ProjectMember' THEN 3 WHEN 'KnownUser' THEN 4 ELSE 2 END AS rank
    FROM all_groups a JOIN admin_grants p ON p.project = a.project AND p.grp = a.grp)
    SELECT DISTINCT user_id, project, rank, permission FROM (SELECT *, min(rank) OVER (PARTITION BY user_id, project) AS top FROM ranked) WHERE rank = top""",
)
def _(g):
    return access.administrative_permissions(g.staff, g.admin_grants)


@query(
    "h14_default_object_permissions",
    """WITH asked AS (SELECT s.user_id AS request, s.user_id, s.project, u.is_system_admin, list(DISTINCT s.grp) AS groups,
    CASE split_part(s.user_id, '/', 2)::INT % 3 WHEN 0 THEN 'Order' WHEN 1 THEN 'Part' ELSE 'Text' END AS cls,
    CASE split_part(s.user_id, '/', 2)::INT % 5 WHEN 0 THEN 'hasTotal' WHEN 1 THEN 'hasDate' WHEN 2 THEN 'hasName' WHEN 3 THEN 'hasUrl' END AS prop
    FROM staff s JOIN staff_users u ON u.user_id = s.user_id GROUP BY s.user_id, s.project, u.is_system_admin),
    lv AS (SELECT a.request, d.permissions, CASE
    WHEN d.grp = 'ProjectAdmin' AND d.project = a.project AND (list_contains(a.groups, 'ProjectAdmin') OR a.is_system_admin) THEN 0
    WHEN d.grp IS NULL AND d.cls = a.cls AND d.prop = a.prop THEN CASE WHEN d.project = a.project THEN 1 ELSE 2 END
    WHEN a.prop IS NULL AND d.grp IS NULL AND d.cls = a.cls AND d.prop IS NULL THEN CASE WHEN d.project = a.project THEN 3 ELSE 4 END
    WHEN d.grp IS NULL AND d.cls IS NULL AND d.prop = a.prop THEN CASE WHEN d.project = a.project THEN 5 ELSE 6 END
    WHEN d.grp LIKE 'group/%' AND list_contains(a.groups, d.grp) THEN 7
    WHEN d.grp = 'ProjectMember' AND (list_contains(a.groups, 'ProjectMember') OR a.is_system_admin) THEN 8
    WHEN d.grp = 'KnownUser' THEN 9 END AS level FROM asked a JOIN default_permissions d ON d.project = a.project OR d.project = 'system')
    SELECT a.request, coalesce(b.level, 10) AS level, coalesce(b.permissions, 'CR Creator') AS permissions FROM asked a LEFT JOIN
    (SELECT request, min(level) AS level, arg_min(permissions, level) AS permissions FROM lv WHERE level IS NOT NULL GROUP BY request) b ON b.request = a.request""",
)
def _(g):
    number = F.split_part("user_id", F.lit("/"), F.lit(2)).cast("int")
    requests = g.staff.select("user_id", "project").distinct().select(
        c("user_id").alias("request"),
        "user_id",
        "project",
        F.when(number % 3 == 0, "Order").when(number % 3 == 1, "Part").otherwise("Text").alias("cls"),
        F.when(number % 5 == 0, "hasTotal").when(number % 5 == 1, "hasDate").when(number % 5 == 2, "hasName").when(number % 5 == 3, "hasUrl").alias("prop"),
    )
    return access.default_object_permissions(requests, g.default_permissions, g.staff, g.staff_users)


@query(
    "h15_defaults_by_class",
    """SELECT r.iri, d.permissions FROM resources r JOIN default_permissions d ON d.project = 'system' AND d.cls = split_part(r.cls, '/', 1)
    AND d.prop IS NULL AND d.grp IS NULL""",
)
def _(g):
    rules = access.default_permissions_for(g.default_permissions, F.lit("system"), cls=c("cls"))
    rows = g.resources.select("iri", F.split_part("cls", F.lit("/"), F.lit(1)).alias("cls"))
    return rows.join(rules.select("cls", c("permissions")), "cls").select("iri", "permissions")


@query(
    "h16_highest_per_group",
    """SELECT r.project, p.grp, max(CASE p.permission WHEN 'RV' THEN 1 WHEN 'V' THEN 2 WHEN 'M' THEN 6 WHEN 'D' THEN 7 ELSE 8 END) AS code FROM resources r JOIN
    (SELECT iri, split_part(part, ' ', 1) AS permission, unnest(string_split(split_part(part, ' ', 2), ',')) AS grp FROM
    (SELECT iri, unnest(string_split(permissions, '|')) AS part FROM resources) q) p ON p.iri = r.iri GROUP BY r.project, p.grp""",
)
def _(g):
    parsed = access.parse_permissions(g.resources.select("project", "permissions"))
    return access.highest_per_group(parsed, ["project"]).select("project", "grp", "code")


@query(
    "h17_formatted",
    """SELECT iri, CASE k % 5 WHEN 0 THEN 'V KnownUser,UnknownUser|D ProjectMember|CR Creator' WHEN 1 THEN 'V KnownUser|M ProjectMember|CR Creator'
    WHEN 2 THEN 'V ProjectMember|CR Creator' WHEN 3 THEN 'RV UnknownUser|D ProjectMember' ELSE 'CR Creator' END AS permissions FROM resources""",
)
def _(g):
    return access.format_permissions(access.parse_permissions(g.resources.select("iri", "permissions")), ["iri"])


@query(
    "h18_link_ends",
    """SELECT l.link_value, a.creator AS source_creator, a.permissions AS source_permissions, b.project AS target_project, b.permissions AS target_permissions
    FROM links l JOIN resources a ON a.iri = l.src JOIN resources b ON b.iri = l.dst""",
)
def _(g):
    rows = access.link_end_permissions(g.links, g.resources)
    return rows.select("link_value", "source_creator", "source_permissions", "target_project", "target_permissions")


@query("h19_members", "SELECT DISTINCT user_id, project FROM staff WHERE grp = 'ProjectMember' AND project = 'project/1'")
def _(g):
    return access.members(g.staff, "project/1")


@query("h19_admin_members", "SELECT DISTINCT user_id, project FROM staff WHERE grp = 'ProjectAdmin'")
def _(g):
    return access.members(g.staff, grp="ProjectAdmin")


@query(
    "h20_permission_sets",
    """SELECT u.user_id, s.project, coalesce(s.groups, '') AS groups, s.project = 'project/2' AND split_part(u.user_id, '/', 2)::INT % 4 = 0 AS is_project_admin, u.is_system_admin
    FROM staff_users u JOIN (SELECT user_id, project, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups FROM staff GROUP BY user_id, project) s ON s.user_id = u.user_id""",
)
def _(g):
    rights = g.staff.where("project = 'project/2' AND grp = 'ProjectAdmin'").select("user_id", "project")
    return access.permission_sets(g.staff_users, g.staff, rights).withColumn("groups", F.array_join("groups", ","))


@query(
    "h21_markup_links",
    """SELECT l.link_value, CASE WHEN a.code IS NULL OR b.code IS NULL THEN NULL WHEN l.prop = 'cites' THEN least(a.code, b.code)
    WHEN o.code IS NOT NULL THEN least(a.code, b.code, o.code) END AS code FROM links l
    JOIN subject_codes a ON a.iri = l.src AND a.user_id = 'user/2' JOIN subject_codes b ON b.iri = l.dst AND b.user_id = 'user/2'
    JOIN subject_codes o ON o.iri = l.link_value AND o.user_id = 'user/2' WHERE l.prop IN ('cites', 'placedBy')""",
)
def _(g):
    links = g.links.where("prop IN ('cites', 'placedBy')").withColumn("is_markup", c("prop") == "cites")
    return access.visible_markup_links(links, g.resources, _profiles(g), "user/2")
