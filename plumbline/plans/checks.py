"""Quality rules, their log, alerts and reports; quality and landing as streams."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import quality
from ..session import scratch
from ..specs import Rule
from ..streaming import landing as landing_stream
from ..streaming import quality as quality_stream
from . import binding as b
from . import build
from .marts import CHANGE_OPERATIONS, FRESH_SQL, user_changes, user_freshness, user_limits  # noqa: F401
from .registry import query

RULES = (
    Rule("main.customer", "not_null", ("c_custkey",), severity="critical", origin="key"),
    Rule("main.part", "not_null", ("p_size",)),
    Rule("main.customer", "unique", ("c_custkey",), severity="critical", origin="key"),
    Rule("main.lineitem", "unique", ("l_orderkey", "l_linenumber")),
    Rule("main.part", "unique", ("p_size", "p_brand")),
    Rule("main.orders", "accepted_values", ("o_orderstatus",), values=("F", "O", "P"), severity="critical"),
    Rule("main.orders", "accepted_values", ("o_orderpriority",), values=("1-URGENT", "2-HIGH")),
    Rule("main.part", "accepted_values", ("p_size",), values=(2, 3, 4)),
    Rule("main.lineitem", "range", ("l_quantity",), min=1, max=50, severity="critical"),
    Rule("main.customer", "range", ("c_acctbal",), min=0),
    Rule("main.part", "range", ("p_size",), max=40, tolerance="0.29"),
    Rule("main.shipment", "expression", name="shipped after order", expression="l_shipdate >= o_orderdate"),
    Rule("main.part", "expression", name="size known", expression="p_size > 0"),
    Rule("main.customer", "expression", name="balance stated", expression="c_acctbal IS NOT NULL", severity="critical"),
    Rule("main.lineitem", "references", ("l_orderkey",), to="main.orders.o_orderkey", origin="key"),
    Rule("main.lineitem", "references", ("l_partkey",), to="main.small_part.p_partkey"),
    Rule("main.part", "references", ("p_size",), to="main.small_part.p_size", name="size in use", tolerance="0.6"),
    Rule("main.orders", "row_count", min=1, severity="critical"),
    Rule("main.region", "row_count", min=1, max=4),
)


def tables(t):
    """The tables rules are about. Some sizes are null, and parents above size 25 are missing, so rules can fail."""
    part = t.part.withColumn("p_size", F.nullif("p_size", F.lit(1)))
    shipment = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {"main.customer": t.customer, "main.orders": t.orders, "main.part": part, "main.region": t.region, "main.lineitem": t.lineitem,
            "main.shipment": shipment, "main.small_part": part.where("p_size <= 25")}


_PART = "(SELECT * REPLACE (nullif(p_size, 1) AS p_size) FROM part)"
_SHIP = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _sql(rule_id, kind, column, severity, relation, failed, passed="failed_rows = 0"):
    table = rule_id.rsplit(".", 1)[0]
    col = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{rule_id}' AS rule_id, '{table}' AS table_name, '{kind}' AS rule_type, {col} AS column_name, '{severity}' AS severity,
  total_rows, failed_rows, {passed} AS passed FROM (SELECT COUNT(*) AS total_rows, {failed} AS failed_rows FROM {relation})"""


def _where(condition):
    return f"COUNT(*) FILTER (WHERE {condition})"


def _twice(relation, *cols):
    return f"(SELECT COUNT(*) OVER (PARTITION BY {', '.join(cols)}) > 1 AS twice FROM {relation})"


_ORACLE = {
    "not_null": (
        _sql("main.customer.not_null_c_custkey", "not_null", "c_custkey", "critical", "customer", _where("c_custkey IS NULL")),
        _sql("main.part.not_null_p_size", "not_null", "p_size", "warning", _PART, _where("p_size IS NULL"))),
    "unique": (
        _sql("main.customer.unique_c_custkey", "unique", "c_custkey", "critical", _twice("customer", "c_custkey"), _where("twice")),
        _sql("main.lineitem.unique_l_orderkey_l_linenumber", "unique", "l_orderkey, l_linenumber", "warning",
             _twice("lineitem", "l_orderkey", "l_linenumber"), _where("twice")),
        _sql("main.part.unique_p_size_p_brand", "unique", "p_size, p_brand", "warning", _twice(_PART, "p_size", "p_brand"), _where("twice"))),
    "accepted_values": (
        _sql("main.orders.accepted_values_o_orderstatus", "accepted_values", "o_orderstatus", "critical", "orders",
             _where("o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O', 'P')")),
        _sql("main.orders.accepted_values_o_orderpriority", "accepted_values", "o_orderpriority", "warning", "orders",
             _where("o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")),
        _sql("main.part.accepted_values_p_size", "accepted_values", "p_size", "warning", _PART, _where("p_size IS NOT NULL AND p_size NOT IN (2, 3, 4)"))),
    "range": (
        _sql("main.lineitem.range_l_quantity", "range", "l_quantity", "critical", "lineitem", _where("l_quantity < 1 OR l_quantity > 50")),
        _sql("main.customer.range_c_acctbal", "range", "c_acctbal", "warning", "customer", _where("c_acctbal < 0")),
        _sql("main.part.range_p_size", "range", "p_size", "warning", _PART, _where("p_size > 40"), "failed_rows <= floor(total_rows * 0.29)")),
    "expression": (
        _sql("main.shipment.shipped_after_order", "expression", None, "warning", _SHIP, _where("l_shipdate < o_orderdate")),
        _sql("main.part.size_known", "expression", None, "warning", _PART, _where("p_size IS NULL OR p_size <= 0")),
        _sql("main.customer.balance_stated", "expression", None, "critical", "customer", _where("c_acctbal IS NULL"))),
    "references": (
        _sql("main.lineitem.references_l_orderkey", "references", "l_orderkey", "warning", "lineitem", _where("l_orderkey NOT IN (SELECT o_orderkey FROM orders)")),
        _sql("main.lineitem.references_l_partkey", "references", "l_partkey", "warning", "lineitem",
             _where("l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 2 AND 25)")),
        _sql("main.part.size_in_use", "references", "p_size", "warning", _PART,
             _where("p_size IS NOT NULL AND p_size NOT IN (SELECT p_size FROM part WHERE p_size BETWEEN 2 AND 25)"),
             "failed_rows <= floor(total_rows * 0.6)")),
    "row_count": (
        _sql("main.orders.row_count", "row_count", None, "critical", "orders", "CAST(CASE WHEN COUNT(*) < 1 THEN 1 ELSE 0 END AS BIGINT)"),
        _sql("main.region.row_count", "row_count", None, "warning", "region", "CAST(CASE WHEN COUNT(*) < 1 OR COUNT(*) > 4 THEN 1 ELSE 0 END AS BIGINT)")),
}
RESULTS_SQL = " UNION ALL ".join(part for parts in _ORACLE.values() for part in parts)


def _kind(kind):
    @query(f"dq_{kind}", " UNION ALL ".join(_ORACLE[kind]))
    def plan(t):
        return quality.evaluate(tables(t), [r for r in RULES if r.type == kind]).drop("description")
    return plan


for _name in _ORACLE:
    _kind(_name)


@query("dq_results", RESULTS_SQL)
def dq_results(t):
    return quality.evaluate(tables(t), RULES).drop("description")


@query("dq_results_unfused", RESULTS_SQL)
def dq_results_unfused(t):
    return quality.evaluate(tables(t), RULES, fused=False).drop("description")


KEYS = {"main.customer": ("c_custkey",), "main.part": ("p_partkey",), "main.orders": ("o_orderkey",),
        "main.lineitem": ("l_orderkey", "l_linenumber"), "main.shipment": ("l_orderkey", "l_linenumber")}
HIDDEN = {"main.customer": ("c_name",), "main.part": ("p_name", "p_retailprice"), "main.orders": ("o_totalprice",),
          "main.lineitem": ("l_extendedprice",), "main.shipment": ("l_extendedprice", "o_totalprice")}

# Columns of a stored row, and its JSON. Only sizes of parts are null, and a null is left out.
_COLUMNS = {"customer": "c_custkey c_nationkey c_acctbal c_mktsegment", "part": "p_partkey p_brand p_type p_size",
            "orders": "o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority",
            "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_discount l_tax l_returnflag l_linestatus l_shipdate"}
_COLUMNS["shipment"] = _COLUMNS["lineitem"] + " " + _COLUMNS["orders"]


def _object(columns):
    shown = (f"{c}: " + (f"strftime({c}, '%Y-%m-%dT%H:%M:%S.000')" if c.endswith("date") else c) for c in columns)
    return f"CAST(to_json({{{', '.join(shown)}}}) AS VARCHAR)"


def _stored(table, rule, failing, relation=None):
    """The first 100 rows of a relation that fail a rule, by key and then by what is shown."""
    columns, key = _COLUMNS[table].split(), KEYS[f"main.{table}"]
    row = _object(columns)
    return f"""SELECT 'main.{table}.{rule}' AS rule_id, 'main.{table}' AS table_name, {_object(key)} AS row_key, replace({row}, ',"p_size":null', '') AS row_json
      FROM {relation or table} WHERE {failing} QUALIFY row_number() OVER (ORDER BY {', '.join([*key, *columns])}) <= 100"""


def _all_twice(relation, *cols):
    return f"(SELECT *, COUNT(*) OVER (PARTITION BY {', '.join(cols)}) > 1 AS twice FROM {relation})"


_SMALL = "FROM part WHERE p_size BETWEEN 2 AND 25"
QUARANTINE_SQL = " UNION ALL ".join((
    _stored("customer", "not_null_c_custkey", "c_custkey IS NULL"),
    _stored("customer", "unique_c_custkey", "twice", _all_twice("customer", "c_custkey")),
    _stored("customer", "range_c_acctbal", "c_acctbal < 0"),
    _stored("customer", "balance_stated", "c_acctbal IS NULL"),
    _stored("part", "not_null_p_size", "p_size IS NULL", _PART),
    _stored("part", "unique_p_size_p_brand", "twice", _all_twice(_PART, "p_size", "p_brand")),
    _stored("part", "accepted_values_p_size", "p_size NOT IN (2, 3, 4)", _PART),
    _stored("part", "range_p_size", "p_size > 40", _PART),
    _stored("part", "size_known", "p_size IS NULL OR p_size <= 0", _PART),
    _stored("part", "size_in_use", f"p_size NOT IN (SELECT p_size {_SMALL})", _PART),
    _stored("orders", "accepted_values_o_orderstatus", "o_orderstatus NOT IN ('F', 'O', 'P')"),
    _stored("orders", "accepted_values_o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    _stored("lineitem", "unique_l_orderkey_l_linenumber", "twice", _all_twice("lineitem", "l_orderkey", "l_linenumber")),
    _stored("lineitem", "range_l_quantity", "l_quantity NOT BETWEEN 1 AND 50"),
    _stored("lineitem", "references_l_orderkey", "l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    _stored("lineitem", "references_l_partkey", f"l_partkey NOT IN (SELECT p_partkey {_SMALL})"),
    _stored("shipment", "shipped_after_order", "l_shipdate < o_orderdate", f"(SELECT * FROM {_SHIP})")))


def quarantined(t, hidden=HIDDEN):
    """Failing rows of every rule that has rows; the rules about row counts have none."""
    return quality.quarantine(tables(t), RULES, KEYS, hidden, 100, two_scans=True)


@query("dq_quarantine", QUARANTINE_SQL)
def dq_quarantine(t):
    return quarantined(t)


@query("quarantine_leaks", f"""WITH stored AS (SELECT DISTINCT table_name FROM ({QUARANTINE_SQL}))
  SELECT table_name, column_name FROM (VALUES ('main.customer', 'c_acctbal'), ('main.part', 'p_partkey'), ('main.orders', 'o_custkey')) x(table_name, column_name)
  JOIN stored USING (table_name)""")
def quarantine_leaks(t):
    """Columns tagged sensitive after rows were stored: those found in the JSON of quarantined rows."""
    tagged = t.customer.agg(F.max("c_custkey")).select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("table_name"), F.lit(c).alias("column_name")) for a, c in (
            ("main.customer", "c_acctbal"), ("main.customer", "c_name"), ("main.part", "p_partkey"), ("main.orders", "o_custkey"))])).alias("x")).select("x.*")
    return quality.leaks(quarantined(t), tagged)


@query("quarantine_purge", f"SELECT rule_id, COUNT(*) AS n FROM ({QUARANTINE_SQL}) WHERE NOT (table_name = 'main.part' AND contains(row_json, 'p_size')) GROUP BY 1")
def quarantine_purge(t):
    kept = quality.purge(quarantined(t), {"main.part": ("p_size",), "main.customer": ("c_name",)})
    return kept.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- the log: days as runs, users and event types as rules
def log_runs(t):
    """A day is a check run; it is unfinished when its last event is an error."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    return (t.events.groupBy(F.to_date("ts").cast("string").alias("check_run_id"))
            .agg(F.min("ts").alias("started_at"), F.when(last != "error", F.max("ts")).alias("finished_at")))


def log_results(t):
    rule = F.concat(F.lit("main.gold.user_"), F.col("user_id"), F.lit("."), F.col("event_type"))
    failed = F.count_if(F.col("value") > 20)
    return (t.events.groupBy(F.to_date("ts").cast("string").alias("check_run_id"), "user_id", "event_type")
            .agg(F.count(F.lit(1)).alias("total_rows"), failed.alias("failed_rows"))
            .select("check_run_id", rule.alias("rule_id"), F.concat(F.lit("main.gold.user_"), F.col("user_id")).alias("table_name"),
                    F.col("event_type").alias("rule_type"), F.lit("value").alias("column_name"),
                    F.when(F.col("user_id") % 3 == 0, "critical").otherwise("warning").alias("severity"),
                    F.lit("value is at most 20").alias("description"), "total_rows", "failed_rows",
                    (F.col("failed_rows") == 0).alias("passed")))


_RUNS = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS check_run_id, MIN(ts) AS started_at,
  CASE WHEN arg_max(event_type, row(ts, event_id)) <> 'error' THEN MAX(ts) END AS finished_at FROM events GROUP BY 1"""
_LOG = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS check_run_id, 'main.gold.user_' || user_id || '.' || event_type AS rule_id,
  'main.gold.user_' || user_id AS table_name, event_type AS rule_type, 'value' AS column_name,
  CASE WHEN user_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity, 'value is at most 20' AS description, COUNT(*) AS total_rows,
  COUNT(*) FILTER (WHERE value > 20) AS failed_rows, COUNT(*) FILTER (WHERE value > 20) = 0 AS passed FROM events GROUP BY 1, user_id, event_type"""
_LAST = f"(SELECT check_run_id FROM ({_RUNS}) WHERE finished_at IS NOT NULL ORDER BY started_at DESC, check_run_id DESC LIMIT 1)"


@query("dq_latest", f"SELECT * FROM ({_LOG}) WHERE check_run_id = {_LAST}")
def dq_latest(t):
    return quality.latest(log_results(t), log_runs(t)).drop("run_started_at")


@query("dq_stamped", f"SELECT rule_id, failed_rows, (SELECT max(check_run_id) FROM ({_RUNS})) AS check_run_id, DATE '2024-01-31' AS checked_on FROM ({RESULTS_SQL})")
def dq_stamped(t):
    """Results of a run in progress: written under the latest started run, finished or not."""
    out = quality.stamped(quality.evaluate(tables(t), RULES), log_runs(t), b.now())
    return out.select("rule_id", "failed_rows", "check_run_id", F.to_date("checked_at").alias("checked_on"))


@query("dq_run_finish", f"SELECT check_run_id, CAST(CASE WHEN check_run_id = (SELECT max(check_run_id) FROM ({_RUNS})) THEN TIMESTAMP '2024-01-31' ELSE finished_at END AS DATE) AS finished_on FROM ({_RUNS})")
def dq_run_finish(t):
    return quality.finish(log_runs(t), b.now()).select("check_run_id", F.to_date("finished_at").alias("finished_on"))


@query("dq_run_summary", f"""SELECT u.check_run_id, COUNT(r.rule_id) AS rules, COUNT(*) FILTER (WHERE NOT passed) AS failing,
    COUNT(*) FILTER (WHERE NOT passed AND severity = 'critical') AS critical_failing, COUNT(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warning_failing
  FROM ({_RUNS}) u LEFT JOIN ({_LOG}) r USING (check_run_id) GROUP BY 1""")
def dq_run_summary(t):
    return quality.run_summary(log_runs(t), log_results(t)).drop("started_at", "finished_at")


@query("failing_rules", f"SELECT rule_id, severity, failed_rows || ' of ' || total_rows || ' rows fail' AS problem FROM ({_LOG}) WHERE check_run_id = {_LAST} AND NOT passed")
def failing_rules(t):
    return quality.failing(quality.latest(log_results(t), log_runs(t)))


@query("rules_without_results", f"SELECT DISTINCT rule_id FROM ({_LOG}) WHERE rule_id NOT IN (SELECT rule_id FROM ({_LOG}) WHERE check_run_id = {_LAST})")
def rules_without_results(t):
    return quality.missing_results(log_results(t).select("rule_id").distinct(), log_results(t), log_runs(t))


@query("run_too_old", f"SELECT {_LAST} AS check_run_id, TRUE AS older_than_delivery FROM (SELECT COUNT(*) FROM events)")
def run_too_old(t):
    return quality.run_too_old(log_runs(t), b.now()).drop("run_started_at")


def log_freshness(t):
    """Freshness of every user, logged under every run."""
    return user_freshness(t).join(log_results(t).select("check_run_id", F.substring_index("table_name", ".", -1).alias("table_name")).distinct(), "table_name")


@query("dq_alerts", f"""SELECT 'critical_failures' AS alert, CAST(a.n + c.n AS BIGINT) AS value, a.n + c.n > 0 AS fires
    FROM (SELECT COUNT(*) AS n FROM ({_LOG}) WHERE check_run_id = {_LAST} AND NOT passed AND severity = 'critical') a,
      (SELECT COUNT(*) AS n FROM conversations WHERE role = 'system') c
  UNION ALL SELECT 'stale_data', COUNT(*), COUNT(*) > 0 FROM ({FRESH_SQL}) WHERE stale AND 'main.gold.' || table_name IN (SELECT table_name FROM ({_LOG}) WHERE check_run_id = {_LAST})""")
def dq_alerts(t):
    tests = t.conversations.select(F.when(F.col("role") == "system", "critical_failures").otherwise("other").alias("alert"))
    return quality.alerts(quality.latest(log_results(t), log_runs(t)), quality.latest(log_freshness(t), log_runs(t)), tests)


@query("dq_report_latest", f"""SELECT 'gold.' || split_part(table_name, '.', 3) AS table_name, split_part(rule_id, '.', 4) AS rule, rule_id, rule_type, column_name, severity,
  description, total_rows, failed_rows, CASE WHEN passed THEN 'pass' ELSE 'fail' END AS status, CASE WHEN passed THEN 0 ELSE 1 END AS failing,
  CASE WHEN NOT passed AND severity = 'critical' THEN 1 ELSE 0 END AS critical_failing FROM ({_LOG}) WHERE check_run_id = {_LAST}""")
def dq_report_latest(t):
    return quality.report_latest(quality.latest(log_results(t), log_runs(t))).drop("run_started_at")


@query("dq_report_history", f"""SELECT CAST(check_run_id AS DATE) AS run_on, 'gold.' || split_part(table_name, '.', 3) AS table_name, rule_id, severity, failed_rows,
  CASE WHEN passed THEN 0 ELSE 1 END AS failing FROM ({_LOG})""")
def dq_report_history(t):
    return quality.report_history(log_results(t), log_runs(t)).withColumn("run_on", F.to_date("run_at")).drop("run_at")


@query("dq_report_quarantine", f"""SELECT table_name, split_part(rule_id, '.', 3) AS rule, CASE WHEN table_name <> 'main.customer' THEN severity END AS severity,
  row_key, row_json FROM ({QUARANTINE_SQL}) JOIN (SELECT rule_id, severity FROM ({RESULTS_SQL})) USING (rule_id)""")
def dq_report_quarantine(t):
    """Quarantined rows with the severity of their rule; a rule withdrawn since has none."""
    registry = quality.rule_table(t.spark, [r for r in RULES if r.table != "main.customer"])
    return quality.report_quarantine(quarantined(t).withColumn("checked_at", b.now()), registry).drop("checked_at")


@query("dq_report_freshness", f"""SELECT table_name, layer, age_hours, max_hours, CASE WHEN stale THEN 'stale' WHEN max_hours IS NULL THEN 'no limit' ELSE 'fresh' END AS status,
  CASE WHEN stale THEN 1 ELSE 0 END AS is_stale FROM ({FRESH_SQL}) WHERE 'main.gold.' || table_name IN (SELECT table_name FROM ({_LOG}) WHERE check_run_id = {_LAST})""")
def dq_report_freshness(t):
    return quality.report_freshness(quality.latest(log_freshness(t), log_runs(t))).drop("last_data_change", "run_started_at")


@query("stale_tables", f"""SELECT table_name, 'last changed ' || coalesce(CAST(age_hours AS VARCHAR), 'never') || ' hours ago (limit ' || max_hours || ')' AS problem
  FROM ({FRESH_SQL}) WHERE stale""")
def stale_tables(t):
    return quality.stale_tables(user_freshness(t))


@query("retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS")
def retention(t):
    return quality.retain(t.events, "ts", 10, b.now()).select("event_id")


# ---------------------------------------------------------------- rules as rows
_RULE_KINDS = ("not_null", "unique", "accepted_values", "range", "expression", "references", "row_count", "guess")


def proposed_rules(t):
    """A rule per part: its kind by size, its table and column by brand and type."""
    size = F.col("p_size")
    kind = F.get(F.array(*[F.lit(k) for k in _RULE_KINDS]), size % 8)
    return t.part.select(
        F.col("p_partkey").cast("string").alias("rule_id"), F.concat(F.lit("main."), F.col("p_brand")).alias("table_name"), kind.alias("rule_type"),
        F.when(size != 10, F.col("p_type")).alias("column_name"), F.when(size > 25, 0).otherwise(2).alias("n_values"),
        F.when(size < 40, 1).alias("min"), F.lit(None).cast("int").alias("max"), F.when(size % 3 == 0, F.col("p_name")).alias("name"),
        F.lit("x > 0").alias("expression"), F.concat(F.lit("main."), F.when(size == 5, "nowhere").otherwise(F.col("p_brand")), F.lit(".k")).alias("target"))


def live_columns(t):
    return (t.part.where("p_size <= 45").groupBy(F.concat(F.lit("main."), F.col("p_brand")).alias("table_name"), F.col("p_type").alias("column_name"))
            .agg(F.when(F.min("p_size") < 4, "STRING").otherwise("DECIMAL(10,2)").alias("data_type")))


@query("rule_problems", """WITH cols AS (SELECT 'main.' || p_brand AS table_name, p_type AS column_name, CASE WHEN min(p_size) < 4 THEN 'STRING' ELSE 'DECIMAL' END AS dt
    FROM part WHERE p_size <= 45 GROUP BY 1, 2),
  r AS (SELECT p_partkey, 'main.' || p_brand AS table_name, p_size AS s, p_size % 8 AS k, CASE WHEN p_size <> 10 THEN p_type END AS column_name FROM part),
  j AS (SELECT r.*, cols.dt, cols.table_name IS NOT NULL AS known FROM r LEFT JOIN cols ON r.table_name = cols.table_name AND r.column_name = cols.column_name)
  SELECT CAST(p_partkey AS VARCHAR) AS rule_id, problem FROM (SELECT p_partkey, CASE WHEN k = 7 THEN 'unknown rule type'
      WHEN column_name IS NULL AND k IN (0, 1, 2, 3, 5) THEN 'needs a column' WHEN column_name IS NOT NULL AND NOT known THEN 'no such column'
      WHEN k = 2 AND s > 25 THEN 'needs values' WHEN k = 3 AND s >= 40 THEN 'needs min or max' WHEN k = 3 AND dt = 'STRING' THEN 'not a comparable column'
      WHEN k = 4 AND s % 3 <> 0 THEN 'needs a name and an expression' WHEN k = 5 AND (s = 5 OR table_name NOT IN (SELECT table_name FROM cols)) THEN 'target is not a known table'
      WHEN k = 6 AND s >= 40 THEN 'needs min or max' END AS problem FROM j) WHERE problem IS NOT NULL""")
def rule_problems(t):
    return quality.rule_problems(proposed_rules(t), live_columns(t))


@query("rule_set", """WITH base AS (SELECT p_brand AS table_name, p_type AS column_name, p_size, p_partkey,
      CASE WHEN p_size % 2 = 0 THEN 'range' ELSE 'expression' END AS kind FROM part),
  c AS (SELECT table_name, kind AS rule_type, column_name, table_name || '.' || kind || '.' || column_name AS rule_id, 0 AS rnk, min(p_partkey) AS pos FROM base WHERE p_size = 1 OR p_size = 2 GROUP BY ALL),
  k AS (SELECT table_name, 'range' AS rule_type, column_name, table_name || '.key.' || column_name AS rule_id, 1 AS rnk, min(p_partkey) AS pos FROM base WHERE p_size = 3 GROUP BY ALL),
  s AS (SELECT table_name, kind AS rule_type, column_name, table_name || '.' || kind || '.' || column_name || CASE WHEN p_size > 30 THEN '.again' ELSE '' END AS rule_id, 2 AS rnk, min(p_partkey) AS pos FROM base WHERE p_size > 10 GROUP BY ALL),
  every AS (SELECT * FROM c UNION ALL SELECT * FROM k UNION ALL SELECT * FROM s WHERE NOT (rule_id LIKE '%LARGE')),
  ids AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY table_name, rule_id ORDER BY rnk, pos) = 1),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY table_name, rule_type, column_name ORDER BY rnk, pos, rule_id) AS nth FROM ids),
  kept AS (SELECT * FROM firsts WHERE rnk < 2 OR rule_type = 'expression' OR nth = 1)
  SELECT table_name, rule_id, rule_type, column_name, CASE rnk WHEN 0 THEN 'customer' WHEN 1 THEN 'key' ELSE 'agent' END AS origin FROM kept
  QUALIFY rnk < 2 OR row_number() OVER (PARTITION BY table_name, rnk ORDER BY pos, rule_id) <= 6""")
def rule_set(t):
    base = t.part.select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name"), "p_size", "p_partkey",
                         F.when(F.col("p_size") % 2 == 0, "range").otherwise("expression").alias("rule_type"))
    rule_id = F.concat_ws(".", "table_name", "rule_type", "column_name")
    by = ("table_name", "rule_type", "column_name", "rule_id")

    def ruled(df):
        return df.groupBy(*by).agg(F.min("p_partkey").alias("position"))

    customer = ruled(base.where("p_size IN (1, 2)").withColumn("rule_id", rule_id))
    key = ruled(base.where("p_size = 3").withColumn("rule_type", F.lit("range")).withColumn("rule_id", F.concat_ws(".", "table_name", F.lit("key"), "column_name")))
    again = F.concat(rule_id, F.when(F.col("p_size") > 30, ".again").otherwise(""))
    suggested = ruled(base.where("p_size > 10").withColumn("rule_id", again))
    rejected = base.where("column_name = 'LARGE'").select(rule_id.alias("rule_id")).distinct()
    return quality.assemble_rules(customer, key, suggested, rejected)


# ---------------------------------------------------------------- streams
STREAM_RULES = tuple(r for r in RULES if r.table == "main.lineitem" and r.type in ("range", "references"))


def table_path(t, name):
    """A table for a stream, whether it is a file or a folder of files: as a pattern, since a stream takes a plain path for a folder."""
    return f"{t.folder}/{name}.parque[t]"


@query("stream_quality", " UNION ALL ".join(f"SELECT rule_id, total_rows, failed_rows FROM ({_ORACLE[k][i]})" for k, i in (("range", 0), ("references", 0), ("references", 1))))
def stream_quality(t):
    """Order lines arriving as a stream, split by the rules; counts are read from the result log."""
    out = scratch(t.spark, "quality")
    stream = (t.spark.readStream.schema(t.lineitem.schema).parquet(table_path(t, "lineitem")))
    quality_stream.stream_quality(stream, STREAM_RULES, out, scratch(t.spark, "checkpoint"), tables(t))
    return quality_stream.results(t.spark, out)


@query("stream_quality_split", """SELECT 'good' AS part, COUNT(*) FILTER (WHERE p_size BETWEEN 2 AND 25) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'quarantine', COUNT(*) FILTER (WHERE p_size NOT BETWEEN 2 AND 25) FROM lineitem JOIN part ON l_partkey = p_partkey""")
def stream_quality_split(t):
    out = scratch(t.spark, "quality")
    stream = (t.spark.readStream.schema(t.lineitem.schema).parquet(table_path(t, "lineitem")))
    quality_stream.stream_quality(stream, STREAM_RULES, out, scratch(t.spark, "checkpoint"), tables(t))
    parts = [quality_stream.stored_rows(t.spark, out, p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n") for p in ("good", "quarantine")]
    return parts[0].unionByName(parts[1])


@query("stream_bronze", """SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance,
  COUNT(*) FILTER (WHERE FALSE) AS unnamed FROM customer GROUP BY 1""")
def stream_bronze(t):
    """The customers as landed files, loaded by two runs of the stream: the second finds nothing new."""
    root = scratch(t.spark, "landing")
    t.customer.write.option("header", True).csv(f"{root}/landing")
    for run in ("first", "second"):
        landing_stream.stream_bronze(t.spark, f"{root}/landing", f"{root}/bronze", f"{root}/checkpoint", t.customer.columns, run)
    return t.spark.read.parquet(f"{root}/bronze").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double").alias("balance"),
        F.count_if(F.col("_source_file").isNull()).alias("unnamed"))


@query("stream_bronze_headers", """SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS balance,
  COUNT(*) FILTER (WHERE c_acctbal >= 0) AS notes FROM customer GROUP BY 1""")
def stream_bronze_headers(t):
    """Files whose headers list the columns in two orders, some with a column that was not declared."""
    root = scratch(t.spark, "landing")
    columns = ["c_custkey", "c_mktsegment", "c_acctbal"]
    t.customer.where("c_acctbal < 0").select(*columns).write.option("header", True).csv(f"{root}/landing")
    t.customer.where("c_acctbal >= 0").select("c_acctbal", F.lit("seen").alias("note"), "c_mktsegment", "c_custkey").write.mode("append").option("header", True).csv(f"{root}/landing")
    landing_stream.stream_bronze(t.spark, f"{root}/landing", f"{root}/bronze", f"{root}/checkpoint", columns, "run")
    return t.spark.read.option("mergeSchema", True).parquet(f"{root}/bronze").groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(12,2)")).cast("double").alias("balance"), F.count("note").alias("notes"))


# ---------------------------------------------------------------- a whole run, written
@query("dq_check_run", f"SELECT '2024-01-31' AS check_run_id, rule_id, total_rows, failed_rows, passed, CAST(coalesce(n, 0) AS BIGINT) AS quarantined "
       f"FROM ({RESULTS_SQL}) LEFT JOIN (SELECT rule_id, COUNT(*) AS n FROM ({QUARANTINE_SQL}) GROUP BY 1) USING (rule_id)")
def dq_check_run(t):
    """Two runs of the check job into written logs, the second one repeated; the latest results with their quarantine."""
    root = scratch(t.spark, "dq")
    for run in ("2024-01-30", "2024-01-31", "2024-01-31"):
        build.check_run(t.spark, root, run, dt.datetime.fromisoformat(run), tables(t), RULES, KEYS, HIDDEN, user_changes(t), user_limits(t))
    build.drop_old(t.spark, root, 30, dt.datetime(2024, 2, 1))
    results = quality.latest(build.read_log(t.spark, root, "dq_results"), build.read_log(t.spark, root, "dq_runs"))
    stored = (quality.latest(build.read_log(t.spark, root, "dq_quarantine"), build.read_log(t.spark, root, "dq_runs"))
              .groupBy("rule_id").agg(F.count(F.lit(1)).alias("quarantined")))
    return (results.join(stored, "rule_id", "left").na.fill(0, ["quarantined"])
            .select("check_run_id", "rule_id", "total_rows", "failed_rows", "passed", "quarantined"))
