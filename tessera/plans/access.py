"""Queries of organisation tags, permissions and users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import access as A
from tessera.operators import uploads as U
from tessera.plans import roles as X
from tessera.plans.registry import query
from tessera.session import table

S = SparkSession


@query("acl_tag_closure", f"WITH RECURSIVE {X.TAGS}, {X.CLOSURE} SELECT * FROM closure")
def tag_closure(spark: S, sf: str) -> DataFrame:
    return A.ancestors(X.tags(spark, sf))


@query("acl_effective_tags", f"WITH RECURSIVE {X.USERS}, {X.TAGS}, {X.CLOSURE}, {X.EFFECTIVE} SELECT * FROM effective")
def effective_tags(spark: S, sf: str) -> DataFrame:
    return A.effective_tags(X.users(spark, sf), X.tags(spark, sf))


@query("acl_visible_docs", f"""WITH RECURSIVE {X.FILES}, {X.USERS}, {X.TAGS}, {X.CLOSURE}, {X.EFFECTIVE}
SELECT u.user_id, f.file_id FROM users u CROSS JOIN files f
WHERE u.user_id % 20 = 0 AND (f.is_public OR f.owner_id = u.user_id OR f.org_tag IN (SELECT tag FROM effective e WHERE e.user_id = u.user_id))""")
def visible_docs(spark: S, sf: str) -> DataFrame:
    """What users may search. The pairs are a search's result, so its query set is asked: every user whose id is divisible by 20."""
    return A.visible(X.files(spark, sf), X.users(spark, sf).where("user_id % 20 = 0"), X.tags(spark, sf))


@query("acl_search_filter", f"WITH {X.FILES} SELECT file_id FROM files WHERE owner_id = 7 OR is_public OR org_tag IN ('NATION_6', 'NATION_3')")
def search_filter(spark: S, sf: str) -> DataFrame:
    rows = X.files(spark, sf)
    return rows.where(A.permitted(F.col("owner_id"), F.col("is_public"), F.col("org_tag"), 7, ["NATION_6", "NATION_3"])).select("file_id")


@query("acl_search_filter_no_tags", f"WITH {X.FILES} SELECT file_id FROM files WHERE owner_id = 7 OR is_public")
def search_filter_no_tags(spark: S, sf: str) -> DataFrame:
    return X.files(spark, sf).where(A.permitted(F.col("owner_id"), F.col("is_public"), F.col("org_tag"), 7, [])).select("file_id")


@query("acl_request_decision", f"""WITH {X.FILES}, {X.USERS}
SELECT f.file_id, CASE WHEN f.is_public OR f.org_tag IS NULL OR f.org_tag = '' OR f.org_tag = 'DEFAULT' THEN 'allow:open' WHEN u.user_id = f.owner_id THEN 'allow:owner'
  WHEN u.role = 'ADMIN' THEN 'allow:admin' WHEN starts_with(f.org_tag, 'PRIVATE_') THEN 'deny:private' WHEN list_contains(string_split(u.org_tags, ','), f.org_tag) THEN 'allow:tag' ELSE 'deny:tag' END AS decision
FROM files f JOIN users u ON u.user_id = f.file_id % 53 + 1""")
def request_decision(spark: S, sf: str) -> DataFrame:
    rows = X.files(spark, sf).withColumn("user_id", F.col("file_id") % 53 + 1).join(X.users(spark, sf), "user_id")
    decision = A.request_decision(F.col("user_id"), F.col("role"), A.split_tags(F.col("org_tags")), F.col("owner_id"), F.col("is_public"), F.col("org_tag"))
    return rows.select("file_id", decision.alias("decision"))


@query("tag_tree", f"""WITH RECURSIVE {X.TAGS},
tree AS (SELECT tag_id, 0 AS depth, tag_id AS path FROM tags WHERE parent_tag IS NULL
  UNION ALL SELECT t.tag_id, r.depth + 1, r.path || '/' || t.tag_id FROM tree r JOIN tags t ON t.parent_tag = r.tag_id) SELECT * FROM tree""")
def tag_tree(spark: S, sf: str) -> DataFrame:
    return A.tag_tree(X.tags(spark, sf))


@query("tag_would_cycle", f"""WITH RECURSIVE {X.TAGS}, {X.CLOSURE}
SELECT a.tag_id, b.tag_id AS new_parent, EXISTS (SELECT 1 FROM closure c WHERE c.tag_id = b.tag_id AND c.ancestor = a.tag_id) AS cycle
FROM tags a CROSS JOIN tags b""")
def tag_would_cycle(spark: S, sf: str) -> DataFrame:
    tags = X.tags(spark, sf)
    moves = tags.select("tag_id").crossJoin(tags.select(F.col("tag_id").alias("new_parent")))  # each of a few dozen tags under each
    return A.would_cycle(tags, moves)


@query("tag_delete_violations", f"""WITH {X.USERS}, {X.TAGS}
SELECT tag_id, 'default' AS violation FROM tags WHERE tag_id = 'DEFAULT'
UNION ALL SELECT tag_id, 'children' FROM tags t WHERE EXISTS (SELECT 1 FROM tags c WHERE c.parent_tag = t.tag_id)
UNION ALL SELECT tag_id, 'assigned' FROM tags t WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT unnest(string_split(org_tags, ',')) AS x FROM users) WHERE x = t.tag_id)""")
def tag_delete_violations(spark: S, sf: str) -> DataFrame:
    return A.delete_violations(X.tags(spark, sf), X.users(spark, sf))


@query("unused_tags", f"""WITH {X.USERS}, {X.TAGS}, {X.FILES}
SELECT tag_id FROM tags t WHERE NOT EXISTS (SELECT 1 FROM tags c WHERE c.parent_tag = t.tag_id)
  AND NOT EXISTS (SELECT 1 FROM users u WHERE u.primary_org = t.tag_id OR list_contains(string_split(u.org_tags, ','), t.tag_id)) AND NOT EXISTS (SELECT 1 FROM files f WHERE f.org_tag = t.tag_id)""")
def unused_tags(spark: S, sf: str) -> DataFrame:
    return A.unused_tags(X.tags(spark, sf), X.users(spark, sf), X.files(spark, sf))


@query("user_list_page", f"""WITH {X.USERS}, f AS (SELECT * FROM users WHERE list_contains(string_split(org_tags, ','), 'NATION_6') AND contains(username, '1') AND role = 'USER')
SELECT user_id, username, (SELECT count(*) FROM f) AS total, CAST(ceil((SELECT count(*) FROM f) / 7.0) AS BIGINT) AS pages FROM f ORDER BY created DESC, user_id LIMIT 7""")
def user_list_page(spark: S, sf: str) -> DataFrame:
    return A.user_page(X.users(spark, sf), 1, 7, "1", "NATION_6", "USER").select("user_id", "username", "total", "pages")


@query("user_tag_details", f"""WITH {X.USERS}, {X.TAGS},
l AS (SELECT user_id, unnest(string_split(org_tags, ',')) AS tag_id, unnest(range(0, len(string_split(org_tags, ',')))) AS pos FROM users)
SELECT user_id, CAST(pos AS INTEGER) AS pos, tag_id, name FROM l JOIN tags USING (tag_id)""")
def user_tag_details(spark: S, sf: str) -> DataFrame:
    return A.user_tag_details(X.users(spark, sf), X.tags(spark, sf))


@query("user_tag_assignment", f"""WITH {X.USERS}
SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(['NATION_3', 'ASIA'], list_filter(string_split(org_tags, ','), lambda x: starts_with(x, 'PRIVATE_'))))), ',') AS org_tags FROM users""")
def user_tag_assignment(spark: S, sf: str) -> DataFrame:
    assigned = F.array(F.lit("NATION_3"), F.lit("ASIA"))
    return X.users(spark, sf).select("user_id", A.assign_tags(F.col("org_tags"), assigned).alias("org_tags"))


@query("user_primary_org", f"WITH {X.USERS} SELECT user_id, coalesce(nullif(primary_org, ''), string_split(org_tags, ',')[1], 'DEFAULT') AS primary_org FROM users")
def user_primary_org(spark: S, sf: str) -> DataFrame:
    return X.users(spark, sf).select("user_id", A.primary_org(F.col("primary_org"), F.col("org_tags")).alias("primary_org"))


@query("user_resolution", f"""WITH {X.USERS}, w AS (SELECT CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE username END AS who FROM users UNION ALL SELECT 'nobody')
SELECT who, coalesce(a.user_id, b.user_id) AS user_id FROM w LEFT JOIN users a ON CAST(a.user_id AS VARCHAR) = who LEFT JOIN users b ON b.username = who""")
def user_resolution(spark: S, sf: str) -> DataFrame:
    users = X.users(spark, sf)
    asked = users.select(F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(F.col("username")).alias("who"))
    return A.resolve_users(asked.unionByName(spark.createDataFrame([("nobody",)], "who string")), users)


@query("user_registration", "SELECT c_name AS username, 'PRIVATE_' || c_name AS org_tags, 'PRIVATE_' || c_name AS primary_org, 'USER' AS role FROM customer")
def user_registration(spark: S, sf: str) -> DataFrame:
    private = F.concat(F.lit(A.PRIVATE_PREFIX), "c_name")
    return table(spark, sf, "customer").select(F.col("c_name").alias("username"), private.alias("org_tags"), private.alias("primary_org"), F.lit("USER").alias("role"))


@query("uploads_view", f"WITH {X.FILES}, {X.TAGS} SELECT f.file_id, f.org_tag, coalesce(t.name, f.org_tag) AS org_tag_name FROM files f LEFT JOIN tags t ON t.tag_id = f.org_tag")
def uploads_view(spark: S, sf: str) -> DataFrame:
    return U.uploaded_view(X.files(spark, sf), X.tags(spark, sf)).select("file_id", "org_tag", "org_tag_name")


@query("tag_children_lookup", f"WITH {X.TAGS} SELECT tag_id, name FROM tags WHERE parent_tag = 'ASIA'")
def tag_children_lookup(spark: S, sf: str) -> DataFrame:
    return X.tags(spark, sf).where("parent_tag = 'ASIA'").select("tag_id", "name")


@query("role_labels", f"WITH {X.USERS} SELECT user_id, 'ROLE_' || role AS authority FROM users")
def role_labels(spark: S, sf: str) -> DataFrame:
    return X.users(spark, sf).select("user_id", F.concat(F.lit("ROLE_"), "role").alias("authority"))


_CALLS = "(VALUES (1, '/', CAST(NULL AS STRING)), (2, '/app.js', NULL), (3, '/a/app.js', NULL), (4, '/chat/x/y', NULL), (5, '/api/v1/users/login', NULL), (6, '/api/v1/upload/part', NULL), (7, '/api/v1/upload', 'USER'), (8, '/api/v1/admin/users', 'USER'), (9, '/api/v1/admin', 'ADMIN'), (10, '/api/v1/other', 'USER'), (11, '/api/v1/other', NULL), (12, '/api/search/hybrid', 'GUEST'), (13, '/api/v1/users/primary-org', 'USER'), (14, '/api/v1/administration', 'USER')) AS t(id, path, role)"


def _endpoint_sql() -> str:
    def arm(pattern: str, roles: str) -> str:
        test = f"path = '{pattern}'" if "*" not in pattern else f"(path = '{pattern[:-3]}' OR starts_with(path, '{pattern[:-2]}'))" if pattern.endswith("/**") else f"(starts_with(path, '/') AND ends_with(path, '{pattern[2:]}') AND NOT contains(substr(path, 2), '/'))"
        return f"WHEN {test} THEN {'TRUE' if roles == 'any' else 'coalesce(role IN (' + ', '.join(repr(r) for r in roles.split(',')) + '), FALSE)'}"

    return f"SELECT id, CASE {' '.join(arm(*e) for e in A.ENDPOINTS)} ELSE role IS NOT NULL END AS allowed FROM {_CALLS.replace('STRING', 'VARCHAR')}"


@query("endpoint_roles", _endpoint_sql())
def endpoint_roles(spark: S, sf: str) -> DataFrame:
    return X.values(spark, _CALLS).select("id", A.endpoint_allowed(F.col("path"), F.col("role")).alias("allowed"))
