"""Organisation tags and access: closures, permission filters, decisions, guards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

DEFAULT_TAG = "DEFAULT"
PRIVATE_PREFIX = "PRIVATE_"
#: Tasks over which the files of one tag are dealt.
DEALT = 32


def split_tags(tags: Column) -> Column:
    """A comma-separated list as an array without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def ancestors(tags: DataFrame) -> DataFrame:
    """tags (tag_id, parent_tag) -> (tag_id, ancestor, depth), each tag its own ancestor at depth 0.

    Distances double from round to round, so a tree of any depth takes its logarithm of rounds, each a written table. Of
    several ways the shortest counts, so a cycle adds every tag on it once and ends.
    """
    one = tags.where(F.col("parent_tag").isNotNull()).select("tag_id", F.col("parent_tag").alias("ancestor"), F.lit(1).alias("depth"))
    # a parent that is no tag of the table is an ancestor too, but has none
    pairs = written(tags.select("tag_id", F.col("tag_id").alias("ancestor"), F.lit(0).alias("depth")).unionByName(one).groupBy("tag_id", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
    before, now = 0, pairs.count()
    while now > before:
        above = pairs.where("depth > 0").select(F.col("tag_id").alias("ancestor"), F.col("ancestor").alias("_above"), F.col("depth").alias("_more"))
        further = pairs.join(above, "ancestor").select("tag_id", F.col("_above").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
        pairs = written(pairs.unionByName(further).groupBy("tag_id", "ancestor").agg(F.min("depth").alias("depth")), "ancestors")
        before, now = now, pairs.count()
    return pairs


def effective_tags(users: DataFrame, tags: DataFrame) -> DataFrame:
    """users (user_id, org_tags) -> (user_id, tag): direct tags, their ancestors and the default tag."""
    direct = users.select("user_id", F.explode(split_tags(F.col("org_tags"))).alias("tag_id"))
    above = direct.join(ancestors(tags), "tag_id").select("user_id", F.col("ancestor").alias("tag"))
    everyone = users.select("user_id", F.lit(DEFAULT_TAG).alias("tag"))
    return direct.select("user_id", F.col("tag_id").alias("tag")).unionByName(above).unionByName(everyone).distinct()


def visible(files: DataFrame, users: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, file_id) pairs a user may search: own, public, or tagged with an effective tag. For a given set of users.

    Each pair comes from the first arm that holds for it: public, own, tagged. So the pairs, which may be thousands of times
    the input, are neither shuffled nor compared. A tag's files are dealt over DEALT tasks, each with the tag's users.
    """
    asked = users.select("user_id")
    kept = files.select("file_id", "owner_id", F.col("org_tag").alias("tag"), F.coalesce("is_public", F.lit(False)).alias("_public"))
    # users outside: a task repeats its few files for each of them, which files of pairs compress well
    public = asked.crossJoin(kept.where("_public").select("file_id"))
    closed = kept.where("NOT _public")
    own = asked.join(closed.select("file_id", F.col("owner_id").alias("user_id")), "user_id").select("user_id", "file_id")
    held = effective_tags(users, tags).join(closed.select("tag").distinct(), "tag", "left_semi").join(asked, "user_id")
    held = held.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    dealt = closed.withColumn("_deal", F.pmod(F.xxhash64("file_id"), F.lit(DEALT)).cast("int"))
    others = dealt.join(held, (dealt["tag"] == held["tag"]) & (dealt["_deal"] == held["_deal"]) & ~dealt["owner_id"].eqNullSafe(held["user_id"]))
    return public.unionByName(own).unionByName(others.select("user_id", "file_id"))


def permitted(owner: Column, public: Column, tag: Column, user: int, tags: list[str]) -> Column:
    """The same test for one user as a predicate that reaches the scan."""
    arm = tag.isin(*tags) if tags else F.lit(False)
    return (owner == user) | public | arm


def request_decision(user: Column, role: Column, direct_tags: Column, owner: Column, public: Column, tag: Column) -> Column:
    """Decision for one request; direct tags only, ancestors do not count."""
    return (
        F.when(public | tag.isNull() | (tag == "") | (tag == DEFAULT_TAG), "allow:open")
        .when(user == owner, "allow:owner")
        .when(role == "ADMIN", "allow:admin")
        .when(tag.startswith(PRIVATE_PREFIX), "deny:private")
        .when(F.array_contains(direct_tags, tag), "allow:tag")
        .otherwise("deny:tag")
    )


def tag_tree(tags: DataFrame) -> DataFrame:
    """(tag_id, depth, path) of the tags below a root, however deep; a path is the list of a tag's own ancestors."""
    roots = tags.where(F.col("parent_tag").isNull()).select(F.col("tag_id").alias("ancestor"), F.lit(True).alias("_root"))
    way = ancestors(tags).join(roots, "ancestor", "left").groupBy("tag_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("_up"), "ancestor"))).alias("_way"), F.max(F.when(F.col("_root"), F.col("depth"))).alias("depth"))
    return way.where(F.col("depth").isNotNull()).select("tag_id", "depth", F.array_join(F.transform("_way", lambda x: x["ancestor"]), "/").alias("path"))


def would_cycle(tags: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (tag_id, new_parent) -> with cycle: the new parent is the tag itself or lies below it."""
    above = ancestors(tags).select(F.col("tag_id").alias("new_parent"), F.col("ancestor").alias("_a")).distinct()
    hit = moves.join(above, "new_parent").where(F.col("_a") == F.col("tag_id")).select("tag_id", "new_parent").distinct().withColumn("_hit", F.lit(True))
    return moves.join(hit, ["tag_id", "new_parent"], "left").select("tag_id", "new_parent", F.coalesce("_hit", F.lit(False)).alias("cycle"))


def delete_violations(tags: DataFrame, users: DataFrame) -> DataFrame:
    """(tag_id, violation) for tags that must not be deleted: default, with children, or assigned to a user."""
    default = tags.where(F.col("tag_id") == DEFAULT_TAG).select("tag_id", F.lit("default").alias("violation"))
    parents = tags.where(F.col("parent_tag").isNotNull()).select(F.col("parent_tag").alias("tag_id")).distinct()
    with_children = tags.select("tag_id").join(parents, "tag_id", "left_semi").withColumn("violation", F.lit("children"))
    held = users.select(F.explode(split_tags(F.col("org_tags"))).alias("tag_id")).distinct()
    assigned = tags.select("tag_id").join(held, "tag_id", "left_semi").withColumn("violation", F.lit("assigned"))
    return default.unionByName(with_children).unionByName(assigned)


def unused_tags(tags: DataFrame, users: DataFrame, files: DataFrame) -> DataFrame:
    """Tags without a child, a user (listed or primary) and a file: three anti joins."""
    parents = tags.where(F.col("parent_tag").isNotNull()).select(F.col("parent_tag").alias("tag_id"))
    held = users.select(F.explode(F.array_append(split_tags(F.col("org_tags")), F.col("primary_org"))).alias("tag_id"))
    filed = files.select(F.col("org_tag").alias("tag_id"))
    rows = tags.select("tag_id")
    for other in (parents, held, filed):
        rows = rows.join(other.where(F.col("tag_id").isNotNull()).distinct(), "tag_id", "left_anti")
    return rows


def assign_tags(existing: Column, assigned: Column) -> Column:
    """Assigned tags and the private tag that is there already, sorted, as a list."""
    private = F.filter(split_tags(existing), lambda x: x.startswith(PRIVATE_PREFIX))
    return F.array_join(F.array_sort(F.array_union(assigned, private)), ",")


def primary_org(primary: Column, tags: Column) -> Column:
    """The primary tag, else the first tag, else the default."""
    return F.coalesce(F.when(primary != "", primary), F.get(split_tags(tags), 0), F.lit(DEFAULT_TAG))


def user_page(users: DataFrame, page: int, size: int, keyword: str | None = None, tag: str | None = None, role: str | None = None) -> DataFrame:
    """A page of users, newest first, with totals over the filtered list."""
    rows = users
    if tag:
        rows = rows.where(F.array_contains(split_tags(F.col("org_tags")), tag))
    if keyword:
        rows = rows.where(F.col("username").contains(keyword))
    if role:
        rows = rows.where(F.col("role") == role)
    total = rows.agg(F.count("*").alias("total"))
    picked = rows.orderBy(F.col("created").desc(), "user_id").offset((max(page, 1) - 1) * size).limit(size)
    return picked.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / size))


def user_tag_details(users: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, tag_id, name) for tags that exist, in list order."""
    listed = users.select("user_id", F.posexplode(split_tags(F.col("org_tags"))).alias("pos", "tag_id"))
    return listed.join(tags.select("tag_id", "name"), "tag_id").select("user_id", "pos", "tag_id", "name")


def resolve_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """requests (who) -> (who, user_id): an id if it is one, else a user name."""
    by_id = users.select(F.col("user_id").cast("string").alias("who"), F.col("user_id").alias("_by_id"))
    by_name = users.select(F.col("username").alias("who"), F.col("user_id").alias("_by_name"))
    return requests.join(by_id, "who", "left").join(by_name, "who", "left").select("who", F.coalesce("_by_id", "_by_name").alias("user_id"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(window)).where("_r = 1").drop("_r")


def find_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of files that equal a row of wanted in all columns of wanted: point lookups for many keys at once."""
    return files.join(wanted.distinct(), wanted.columns, "left_semi").select(*files.columns)


def active_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """tokens (user_id, token_id, expires_at) -> (user_id, active): distinct tokens that have not expired."""
    live = tokens.where(F.col("expires_at") > now)
    return live.groupBy("user_id").agg(F.count_distinct("token_id").alias("active"))


# ---- fixed values: path patterns with the roles that may call them, in order; the first match decides ----
ENDPOINTS = [
    ("/", "any"), ("/test.html", "any"), ("/static/test.html", "any"), ("/static/**", "any"), ("/*.js", "any"), ("/*.css", "any"), ("/*.ico", "any"),
    ("/chat/**", "any"), ("/ws/**", "any"),
    ("/api/v1/users/register", "any"), ("/api/v1/users/login", "any"),
    ("/api/v1/test/**", "any"),
    ("/api/v1/upload/**", "USER,ADMIN"), ("/api/v1/parse", "USER,ADMIN"), ("/api/v1/documents/download", "USER,ADMIN"), ("/api/v1/documents/preview", "USER,ADMIN"),
    ("/api/v1/users/conversation/**", "USER,ADMIN"),
    ("/api/search/**", "USER,ADMIN"),
    ("/api/chat/websocket-token", "any"),
    ("/api/v1/admin/**", "ADMIN"),
    ("/api/v1/users/primary-org", "USER,ADMIN"),
]
# ------------------------------------------------------------------------------------------------------------


def endpoint_pattern(pattern: str) -> str:
    """A path pattern as a regular expression: * stays within a segment, a last ** also stands for nothing."""
    parts = re.split(r"(/\*\*$|\*)", pattern)
    return "^" + "".join("(/.*)?" if p == "/**" else "[^/]*" if p == "*" else re.escape(p) for p in parts) + "$"


def endpoint_allowed(path: Column, role: Column) -> Column:
    """Whether a role (null: not signed in) may call a path; paths without a rule need some role."""
    decision = F.lit(None).cast("boolean")
    for pattern, roles in reversed(ENDPOINTS):
        may = F.lit(True) if roles == "any" else F.coalesce(role.isin(*roles.split(",")), F.lit(False))
        decision = F.when(path.rlike(endpoint_pattern(pattern)), may).otherwise(decision)
    return F.coalesce(decision, role.isNotNull())
