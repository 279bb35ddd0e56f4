"""Configuration look-ups and who may do what."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROTECTED = ["nota_fiscal_default", "conta_agua_default"]
THRESHOLD = 0.75


def resolve_layout_config(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """docs with config_schema and threshold: the active configuration of the layout and type, else of the layout."""
    ok = configs.where("is_active and coalesce(definition, '') not in ('', '{}')")
    top = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("config_id"))
    exact = ok.withColumn("_n", top(["layout", "document_type"])).where("_n = 1").select(F.col("layout").alias("e_l"), F.col("document_type").alias("e_t"), F.struct("schema_id", "confidence_threshold").alias("e"))
    loose = ok.withColumn("_n", top(["layout"])).where("_n = 1").select(F.col("layout").alias("l_l"), F.struct("schema_id", "confidence_threshold").alias("l"))
    rows = docs.join(exact, (F.col("layout") == F.col("e_l")) & (F.col("document_type") == F.col("e_t")), "left").join(loose, F.col("layout") == F.col("l_l"), "left")
    found = F.coalesce("e", "l")
    return rows.withColumn("config_schema", found["schema_id"]).withColumn("threshold", F.coalesce(found["confidence_threshold"], F.lit(THRESHOLD))).drop("e_l", "e_t", "e", "l_l", "l")


def resolve_schema(docs: DataFrame, layouts: DataFrame, schemas: DataFrame) -> DataFrame:
    """docs (layout, document_type, tenant_id, text_schema) with schema and tier.

    First the tenant's configuration of the layout, then the schema that the
    text names if it is active, then the tenant's configuration of the type;
    else pending_no_schema.
    """
    first = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("config_id"))
    on = layouts.where("is_active")
    by_layout = on.withColumn("_n", first(["tenant_id", "layout"])).where("_n = 1").select(F.col("tenant_id").alias("a_t"), F.col("layout").alias("a_l"), F.col("schema_id").alias("a"))
    by_type = on.withColumn("_n", first(["tenant_id", "document_type"])).where("_n = 1").select(F.col("tenant_id").alias("b_t"), F.col("document_type").alias("b_d"), F.col("schema_id").alias("b"))
    active = schemas.where("is_active").select(F.col("schema_id").alias("c")).distinct()
    rows = docs.join(by_layout, (F.col("tenant_id") == F.col("a_t")) & (F.col("layout") == F.col("a_l")), "left").join(active, F.col("text_schema") == F.col("c"), "left")
    rows = rows.join(by_type, (F.col("tenant_id") == F.col("b_t")) & (F.col("document_type") == F.col("b_d")), "left")
    tier = F.when(F.col("a").isNotNull(), "layout").when(F.col("c").isNotNull(), "text").when(F.col("b").isNotNull(), "document_type").otherwise("none")
    return rows.withColumn("schema", F.coalesce("a", "c", "b", F.lit("pending_no_schema"))).withColumn("tier", tier).drop("a_t", "a_l", "a", "b_t", "b_d", "b", "c")


def deletable_schemas(schemas: DataFrame, layouts: DataFrame) -> DataFrame:
    """(schema_id, outcome): forbidden if protected, conflict if a layout uses it, else ok."""
    used = layouts.select(F.col("schema_id").alias("u")).distinct()
    rows = schemas.join(used, F.col("schema_id") == F.col("u"), "left")
    return rows.select("schema_id", F.when(F.col("schema_id").isin(PROTECTED), "forbidden").when(F.col("u").isNotNull(), "conflict").otherwise("ok").alias("outcome"))


def upsert_config(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, where incoming ones take the place of those with the same key; the last of equal keys by seq counts."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(incoming.withColumn("_p", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_p"), F.desc("seq")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_p")


def grants(users: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, is_active, code) by way of roles."""
    r = role_permissions.select(F.col("role_id").alias("r_id"), "code")
    return users.join(r, F.col("role_id") == F.col("r_id")).select("user_id", "is_active", "code")


def entitled(users: DataFrame, role_permissions: DataFrame, code: str) -> DataFrame:
    """users with entitled: whether their role has the permission."""
    r = role_permissions.where(F.col("code") == code).select(F.col("role_id").alias("r_id")).distinct()
    return users.join(r, F.col("role_id") == F.col("r_id"), "left").withColumn("entitled", F.col("r_id").isNotNull()).drop("r_id")


def role_user_counts(roles: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("role_id").alias("u_role"), "user_id")
    return roles.join(u, F.col("role_id") == F.col("u_role"), "left").groupBy("role_id", "name").agg(F.count("user_id").alias("n"))


def last_admin_guard(users: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, is_last_admin): whether no other active user may manage both users and roles."""
    codes = F.countDistinct(F.when(F.col("code").isin("users.manage", "roles.manage"), F.col("code")))
    admins = grants(users, role_permissions).where("is_active").groupBy(F.col("user_id").alias("admin")).agg(codes.alias("n")).where("n = 2").select("admin")
    total = admins.agg(F.count("*").alias("admins"))
    rows = users.join(admins, F.col("user_id") == F.col("admin"), "left").join(F.broadcast(total))  # one row
    return rows.select("user_id", (F.col("admins") - F.col("admin").isNotNull().cast("int") == 0).alias("is_last_admin"))


def user_permissions(users: DataFrame, roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, role, permissions) with permissions in order; none without a role."""
    names = roles.select(F.col("role_id").alias("n_id"), F.col("name").alias("role"))
    codes = role_permissions.groupBy(F.col("role_id").alias("c_id")).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("permissions"))
    rows = users.join(names, F.col("role_id") == F.col("n_id"), "left").join(codes, F.col("role_id") == F.col("c_id"), "left")
    return rows.select("user_id", "role", F.coalesce("permissions", F.lit("")).alias("permissions"))


def list_configs(configs: DataFrame) -> DataFrame:
    return configs.orderBy("schema_id", "version")
