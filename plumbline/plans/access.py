"""Masks, row filters, grants, audit and secrets."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masks import mask
from ..operators import governance, protection
from ..specs import MaskPolicy, RowPolicy
from . import binding as b
from .registry import query


def people(t):
    return t.customer.select("*", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"))


_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"


@query("mask_kinds", f"""SELECT c_custkey, '***' AS redacted, CAST(NULL AS DOUBLE) AS redacted_number, CAST(NULL AS VARCHAR) AS nothing, sha256(c_name) AS hashed,
  '***@example.com' AS email, '***' || right(c_name, 4) AS last4, upper(left(c_mktsegment, 1)) AS custom FROM customer""")
def mask_kinds(t):
    name = F.col("c_name")
    return people(t).select("c_custkey", mask(name, "redact").alias("redacted"), mask(F.col("c_acctbal"), "redact", "double").alias("redacted_number"),
                            mask(name, "null").alias("nothing"), mask(name, "hash").alias("hashed"), mask(F.col("email"), "email").alias("email"),
                            mask(name, "last4").alias("last4"), mask(name, None, sql="upper(left(c_mktsegment, 1))").alias("custom"))


MASKS = (MaskPolicy("hash", column="c_name", exempt=("engineers",)), MaskPolicy("email", column="email", exempt=("engineers", "support")),
         MaskPolicy("null", column="c_acctbal", type="double", exempt=("finance",)))
ROWS = RowPolicy("c_mktsegment", {"analysts": ("BUILDING", "MACHINERY"), "support": ("FURNITURE",)}, exempt=("engineers",))


@query("mask_consumer", f"""SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment, '***@example.com' AS email
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def mask_consumer(t):
    return governance.secure_view(people(t), "ana@example.com", ["analysts"], MASKS, ROWS)


@query("mask_engineer", f"SELECT c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment, {_EMAIL} AS email FROM customer")
def mask_engineer(t):
    return governance.secure_view(people(t), "eve@example.com", ["engineers"], MASKS, ROWS)


@query("mask_writer", f"SELECT *, {_EMAIL} AS email FROM customer")
def mask_writer(t):
    """A writer is exempt from every mask and filter, so that what it writes is whole."""
    return governance.secure_view(people(t), "loader", [], MASKS, ROWS, writers=("loader",))


@query("mask_by_tag", "SELECT c_custkey, '***' || right(c_name, 4) AS c_name, c_nationkey, c_acctbal, '***' || right(c_mktsegment, 4) AS c_mktsegment FROM customer")
def mask_by_tag(t):
    tags = {"c_name": {"sensitivity": "personal"}, "c_mktsegment": {"sensitivity": "personal"}, "c_acctbal": {"sensitivity": "internal"}}
    return governance.secure_view(t.customer, "ana@example.com", [], [MaskPolicy("last4", tag=("sensitivity", "personal"))], tags=tags)


@query("row_filter", "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')")
def row_filter(t):
    return governance.secure_view(t.customer, "bo@example.com", ["analysts", "support"], rows=ROWS)


@query("row_filter_nobody", "SELECT COUNT(*) AS n FROM customer WHERE FALSE")
def row_filter_nobody(t):
    return governance.secure_view(t.customer, "bo@example.com", [], rows=ROWS).agg(F.count(F.lit(1)).alias("n"))


@query("row_filter_condition", "SELECT * FROM customer WHERE c_acctbal > 100 AND c_nationkey < 12")
def row_filter_condition(t):
    return governance.secure_view(t.customer, "bo@example.com", [], rows=RowPolicy(condition="c_acctbal > 100 AND c_nationkey < 12"))


@query("row_entitlements", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))")
def row_entitlements(t):
    """Customers are granted to their segment's group; a member of two groups sees the orders of both."""
    granted = t.customer.select(F.col("c_mktsegment").alias("member"), F.col("c_custkey").alias("value"))
    seen = governance.entitled_rows(t.orders, "o_custkey", granted, "bo@example.com", ["BUILDING", "HOUSEHOLD"])
    return seen.select("o_orderkey", "o_custkey", "o_totalprice")


READERS = ("Supplier#000000000", "Supplier#000000001", "Supplier#000000002", "Supplier#000000003", "nobody")


@query("protected_view", f"""WITH mem AS (SELECT s_name, CASE s_nationkey % 3 WHEN 0 THEN 'analysts' WHEN 1 THEN 'engineers' ELSE 'support' END AS g FROM supplier),
  who AS (SELECT reader, coalesce(g, 'none') AS g FROM (SELECT unnest({list(READERS)}) AS reader) LEFT JOIN mem ON s_name = reader)
  SELECT reader, c_custkey, CASE WHEN g = 'engineers' THEN c_name ELSE sha256(c_name) END AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment,
    CASE WHEN g IN ('engineers', 'support') THEN {_EMAIL} ELSE '***@example.com' END AS email
  FROM who JOIN customer ON g = 'engineers' OR g = 'analysts' AND c_mktsegment IN ('BUILDING', 'MACHINERY') OR g = 'support' AND c_mktsegment = 'FURNITURE'""")
def protected_view(t):
    """One view, read by the same SQL for several readers: members of a group by the table of suppliers, and one that has none."""
    group = F.when(F.col("s_nationkey") % 3 == 0, "analysts").when(F.col("s_nationkey") % 3 == 1, "engineers").otherwise("support")
    t.supplier.select(F.col("s_name").alias("principal"), group.alias("group_name")).createOrReplaceTempView("group_members")
    people(t).createOrReplaceTempView("people")
    t.spark.sql("DECLARE OR REPLACE VARIABLE reader STRING")
    protection.protect(t.spark, "protected_people", "people", "group_members", MASKS, ROWS, identity="reader")
    seen = []
    for reader in READERS:
        t.spark.sql(f"SET VAR reader = '{reader}'")
        seen.append(t.spark.sql("SELECT reader, * FROM protected_people"))
    t.spark.sql("SET VAR reader = NULL")
    return reduce(DataFrame.unionByName, seen)


@query("mask_coverage", """WITH s AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size >= 25), m AS (SELECT p_brand, p_name, COUNT(*) AS n FROM part WHERE p_size > 47 GROUP BY ALL)
  SELECT s.p_brand AS table_name, s.p_name AS column_name, coalesce(n, 0) AS methods FROM s LEFT JOIN m USING (p_brand, p_name) WHERE coalesce(n, 0) <> 1""")
def mask_coverage(t):
    named = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_name").alias("column_name"), "p_size")
    return governance.mask_coverage(named.where("p_size >= 25"), named.where("p_size > 47"))


# ---------------------------------------------------------------- grants: regions as roles, suppliers as principals
def members(t):
    who = F.when(F.col("s_acctbal") < 0, F.concat("s_name", F.lit("@example.com"))).otherwise(F.col("s_name"))
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("role"), who.alias("principal"), "s_acctbal"))


def scopes(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("r_name").alias("role"), F.concat_ws(".", F.lit("main"), F.lower("n_name")).alias("schema_name"))
    schemas = place.select("role", F.lit("read").alias("access"), F.lit("SCHEMA").alias("securable_type"), F.col("schema_name").alias("securable"))
    objects = (t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey"))
               .select("role", F.lit("execute").alias("access"), F.lit("FUNCTION").alias("securable_type"),
                       F.concat_ws(".", "schema_name", F.lower("c_mktsegment")).alias("securable")))
    return schemas.unionByName(objects)


_MEMBERS = """SELECT r_name AS role, s_name || CASE WHEN s_acctbal < 0 THEN '@example.com' ELSE '' END AS principal, s_acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_PLACES = "SELECT n_nationkey, r_name AS role, 'main.' || lower(n_name) AS schema_name FROM nation JOIN region ON n_regionkey = r_regionkey"
_PRIVILEGES = f"""SELECT role, 'USE CATALOG' AS privilege, 'CATALOG' AS securable_type, 'main' AS securable FROM ({_PLACES})
  UNION SELECT role, 'USE SCHEMA', 'SCHEMA', schema_name FROM ({_PLACES}) UNION SELECT role, 'SELECT', 'SCHEMA', schema_name FROM ({_PLACES})
  UNION SELECT role, 'EXECUTE', 'FUNCTION', schema_name || '.' || lower(c_mktsegment) FROM ({_PLACES}) JOIN customer ON c_nationkey = n_nationkey"""


def _grants_sql(condition: str) -> str:
    return f"SELECT DISTINCT principal, privilege, securable_type, securable FROM ({_MEMBERS}) JOIN ({_PRIVILEGES}) USING (role) WHERE {condition}"


def grants(t, condition: str):
    return governance.expand_grants(members(t).where(condition), scopes(t))


DECLARED, LIVE, DELIVERED = "s_acctbal >= 0 AND s_acctbal < 9000", "s_acctbal < 8000", "s_acctbal < 9500"


@query("grant_expand", _grants_sql("TRUE"))
def grant_expand(t):
    return grants(t, "TRUE")


@query("grants_to_individuals", f"SELECT DISTINCT principal FROM ({_MEMBERS}) WHERE s_acctbal < 0")
def grants_to_individuals(t):
    return governance.grants_to_individuals(grants(t, "TRUE"))


@query("grant_diff", f"""WITH d AS ({_grants_sql(DECLARED)}), l AS ({_grants_sql('s_acctbal < 8000 OR s_acctbal > 9800')}), r AS (SELECT * FROM ({_grants_sql('s_acctbal > 9900')}))
  SELECT *, 'not granted' AS problem FROM (SELECT * FROM d EXCEPT SELECT * FROM l)
  UNION ALL SELECT *, CASE WHEN row(principal, privilege, securable_type, securable) IN (SELECT row(principal, privilege, securable_type, securable) FROM r) THEN 'removed from the plan but still granted'
      WHEN contains(principal, '@') THEN 'granted to an individual' ELSE 'not declared' END
    FROM (SELECT * FROM l EXCEPT SELECT * FROM d) x
    WHERE securable_type <> 'CATALOG' OR row(principal, privilege, securable_type, securable) IN (SELECT row(principal, privilege, securable_type, securable) FROM r)""")
def grant_diff(t):
    return governance.audit_grants(grants(t, DECLARED), grants(t, "s_acctbal < 8000 OR s_acctbal > 9800"), grants(t, "s_acctbal > 9900"))


@query("consumer_exposure", f"""SELECT g.* FROM ({_grants_sql('TRUE')}) g WHERE securable_type <> 'CATALOG'
  AND split_part(securable, '.', 2) IN (SELECT lower(n_name) FROM nation WHERE n_regionkey < 2) AND principal IN (SELECT s_name FROM supplier WHERE s_acctbal > 5000)""")
def consumer_exposure(t):
    layer = F.when(F.col("n_regionkey") == 0, "bronze").when(F.col("n_regionkey") == 1, "silver").otherwise("gold")
    schemas = t.nation.select(F.concat_ws(".", F.lit("main"), F.lower("n_name")).alias("schema_name"), layer.alias("layer"))
    consumers = t.supplier.where("s_acctbal > 5000").select(F.col("s_name").alias("principal"))
    return governance.consumer_exposure(grants(t, "TRUE"), consumers, schemas)


@query("removal_set", f"({_grants_sql(DELIVERED)}) EXCEPT ({_grants_sql(DECLARED)})")
def removal_set(t):
    return governance.to_remove(grants(t, DELIVERED).unionByName(grants(t, LIVE)), grants(t, DECLARED))


# ---------------------------------------------------------------- audit
def audit_events(t):
    name = F.concat(F.lit("main."), F.col("event_type"), F.when(F.col("value") > 5, F.concat(F.lit(".t"), F.col("user_id"))).otherwise(""))
    return t.events.select(
        "event_id", F.col("ts").alias("event_time"), F.to_date("ts").alias("event_date"), F.struct(F.col("user_id").cast("string").alias("email")).alias("user_identity"),
        F.col("event_type").alias("action_name"), F.create_map(F.lit("full_name_arg"), name).alias("request_params"),
        F.struct(F.lit(200).alias("status_code")).alias("response"))


@query("audit_view", """SELECT CAST(ts AS DATE) AS event_date, CAST(user_id AS VARCHAR) AS principal, event_type AS action_name,
  'main.' || event_type || CASE WHEN value > 5 THEN '.t' || user_id ELSE '' END AS object_full_name, 200 AS status_code
  FROM events WHERE event_type IN ('purchase', 'signup') AND CAST(ts AS DATE) >= DATE '2024-01-24'""")
def audit_view(t):
    return governance.audit_view(audit_events(t), ["main.purchase", "main.signup", "main.sign"], 7, b.now()).drop("event_time")


@query("audit_summary", """SELECT COUNT(*) AS events, COUNT(DISTINCT 'main.' || event_type || CASE WHEN value > 5 THEN '.t' || user_id ELSE '' END) AS objects
  FROM events WHERE event_type = 'purchase' AND CAST(ts AS DATE) >= DATE '2024-01-31' - 90""")
def audit_summary(t):
    seen = governance.audit_view(audit_events(t), ["main.purchase"], 90, b.now())
    return seen.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("object_full_name").alias("objects"))


@query("unexempt_writers", """SELECT DISTINCT event_type AS source_table, 'day_' || dayofmonth(ts) AS target_table, user_id AS created_by FROM events
  WHERE CAST(ts AS DATE) >= DATE '2024-01-21' AND event_type IN ('purchase', 'error') AND value > 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value < 0.5)""")
def unexempt_writers(t):
    target = F.when(F.col("value") > 1, F.concat(F.lit("day_"), F.dayofmonth("ts")))
    lineage = t.events.select(F.col("event_type").alias("source_table"), target.alias("target_table"), F.col("user_id").alias("created_by"),
                              F.to_date("ts").alias("event_date"))
    masked = t.events.where("event_type IN ('purchase', 'error')").select(F.col("event_type").alias("table_name")).distinct()
    exempt = t.events.where("event_type = 'signup' AND value < 0.5").select(F.col("user_id").alias("principal"))
    return governance.unexempt_writers(lineage, masked, exempt, 10, b.now())


@query("secret_scan", """SELECT source, COUNT(*) AS documents, CAST(SUM(len(regexp_extract_all(text, 'token = "[0-9a-f]{40}"'))) AS BIGINT) AS secrets
  FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"') GROUP BY source""")
def secret_scan(t):
    found = governance.scan_secrets(t.documents, "text", 'token = "[0-9a-f]{40}"')
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("secrets").cast("bigint").alias("secrets"))
