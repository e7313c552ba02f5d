"""Differences between versions, evaluation of answers, and the state of goals, jobs and documents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.compare import verdict
from ..operators import diff, evaluate, ops
from ..session import scratch
from ..sources import versions
from . import binding as b
from .registry import query, text_list


# ---------------------------------------------------------------- differences: customers before and after
def before(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


def after(t):
    """Buildings gained 1, negative balances left, negatives came back under new keys, the richest are listed twice."""
    base = before(t)
    changed = base.withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    spaced = changed.withColumn("c_name", F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("#  "))))
    kept = spaced.where("c_acctbal >= 1")
    added = base.where("c_acctbal < 0").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return kept.unionByName(added).unionByName(kept.where("c_acctbal > 9500"))


def spaced(df):
    return df.withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit("# ")))


_NOW = "CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END"


@query("table_diff", f"""SELECT c_custkey, CASE WHEN {_NOW} < 1 THEN 'missing' WHEN {_NOW} > 9500 THEN 'duplicated' ELSE 'changed' END AS problem,
    CASE WHEN {_NOW} >= 1 AND {_NOW} <= 9500 THEN 'c_acctbal' ELSE '' END AS changed, CAST(1 AS BIGINT) AS n_left,
    CAST(CASE WHEN {_NOW} < 1 THEN 0 WHEN {_NOW} > 9500 THEN 2 ELSE 1 END AS BIGINT) AS n_right
  FROM customer WHERE {_NOW} < 1 OR {_NOW} > 9500 OR c_mktsegment = 'BUILDING'
  UNION ALL SELECT -1 - c_custkey, 'extra', '', 0, 1 FROM customer WHERE c_acctbal < 0""")
def table_diff(t):
    found = diff.diff(spaced(before(t)), after(t), ["c_custkey"], ["c_name", "c_mktsegment", "c_acctbal"], loose_text=["c_name"])
    return found.withColumn("changed", text_list("changed"))


@query("version_diff", """SELECT c_custkey, 'changed' AS problem, 'c_acctbal,c_name' AS changed, CAST(1 AS BIGINT) AS n_left, CAST(1 AS BIGINT) AS n_right,
    TRUE AS read_in_part FROM customer WHERE c_custkey <= 3
  UNION ALL SELECT c_custkey, 'missing', '', 1, 0, TRUE FROM customer WHERE c_custkey = 4 UNION ALL SELECT -1, 'extra', '', 0, 1, TRUE""")
def version_diff(t):
    """Two written versions of all customers that differ in six keys: what buckets of equal digest hold is not read."""
    rows, few = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), F.col("c_custkey") <= 3
    new = rows.where("c_custkey <> 4").withColumns({"c_acctbal": F.when(few, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")),
                                                    "c_name": F.when(few, F.lower("c_name")).otherwise(F.col("c_name"))})
    new = new.unionByName(rows.where("c_custkey = 1").withColumn("c_custkey", F.lit(-1).cast("bigint")))
    paths = [scratch(t.spark, "version") for _ in range(2)]
    for df, path in zip((rows, new), paths):
        versions.write_version(df, path, ["c_custkey"], buckets=64)
    n = len(versions.changed_buckets(t.spark, *paths, ["c_custkey"]))
    found = versions.version_diff(t.spark, *paths, ["c_custkey"], ["c_name", "c_mktsegment", "c_acctbal"])
    return found.withColumn("changed", F.array_join(F.sort_array("changed"), ",")).withColumn("read_in_part", F.lit(n <= 6))


@query("set_difference", """SELECT c_custkey AS key, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')
  UNION ALL SELECT DISTINCT -o_custkey, 'extra' FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 490000""")
def set_difference(t):
    low = t.orders.where("o_orderpriority = '5-LOW'")
    right = low.select(F.col("o_custkey").alias("key")).unionByName(low.where("o_totalprice > 490000").select((-F.col("o_custkey")).alias("key")))
    return diff.set_difference(t.customer.select(F.col("c_custkey").alias("key")), right, ["key"])


def _shape(df, balance):
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("|", "c_mktsegment", balance.cast("decimal(12,2)")), 256))


def _assets_now(t):
    bal = F.col("c_acctbal")
    return _shape(t.customer.where(bal < 9000), bal).select("c_custkey", "fingerprint", (bal < 2000).alias("has_gaps"), (F.col("c_nationkey") < 20).alias("intact"))


def _assets_then(t):
    bal = F.col("c_acctbal")
    return _shape(t.customer.where(bal > 0), F.when(F.col("c_mktsegment") == "BUILDING", bal + 1).otherwise(bal)).select("c_custkey", "fingerprint")


@query("incremental_plan", """SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'orphan' WHEN c_acctbal <= 0 THEN 'new' WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 2000 THEN 'changed'
  WHEN c_mktsegment = 'BUILDING' THEN 'restore' WHEN c_nationkey < 20 THEN 'unchanged' ELSE 'restore' END AS action FROM customer""")
def incremental_plan(t):
    return diff.plan_changes(_assets_now(t), _assets_then(t), "c_custkey")


@query("full_plan", "SELECT c_custkey, CASE WHEN c_acctbal >= 9000 THEN 'orphan' ELSE 'new' END AS action FROM customer")
def full_plan(t):
    return diff.plan_changes(_assets_now(t), _assets_then(t), "c_custkey", full=True)


@query("certified_latest", """SELECT o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def certified_latest(t):
    return diff.certified_latest(t.orders, t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderpriority"], "o_orderdate", "o_orderkey")


@query("certified_plan", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def certified_plan(t):
    """The last certified payload of all, without a key."""
    return diff.certified_latest(t.orders, t.orders.where("o_orderstatus = 'F'").select("o_orderkey"), [], ["o_orderkey", "o_totalprice"], "o_orderdate", "o_orderkey")


@query("latest_by_sort", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_by_sort(t):
    return ops.latest_row(t.orders.where("o_orderstatus = 'O'"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- evaluation: events as answers, days as runs
_TARGET = "CASE user_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'space' ELSE 'batch' END"


def answers(t):
    target = F.get(F.array(F.lit("agent"), F.lit("space"), F.lit("batch")), F.col("user_id").cast("int") % 3)
    return t.events.select("event_id", "ts", target.alias("target"), F.to_date("ts").cast("string").alias("run_id"), (F.col("event_type") != "error").alias("correct"))


def thresholds(t):
    return answers(t).groupBy("target").agg(F.when(F.first("target") == "agent", 0.9).when(F.first("target") == "space", 0.8).otherwise(0.5).alias("threshold"))


@query("eval_pass_rate", f"""SELECT target, questions, correct, round(correct / questions, 4) AS pass_rate, threshold, correct / questions >= threshold AS passed,
    CAST(ceil(threshold * questions - 1e-9) AS BIGINT) AS needed, CAST(greatest(0, ceil(threshold * questions - 1e-9) - correct) AS BIGINT) AS shortfall
  FROM (SELECT {_TARGET} AS target, COUNT(*) AS questions, COUNT(*) FILTER (WHERE event_type <> 'error') AS correct,
    CASE {_TARGET} WHEN 'agent' THEN 0.9::DOUBLE WHEN 'space' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS threshold FROM events GROUP BY 1, 4)""")
def eval_pass_rate(t):
    return evaluate.pass_rate(answers(t), thresholds(t))


@query("eval_failures", f"""SELECT event_id, {_TARGET} AS target FROM events WHERE event_type = 'error' AND CAST(ts AS DATE) IN (SELECT max(CAST(ts AS DATE)) FROM events GROUP BY {_TARGET})""")
def eval_failures(t):
    runs = answers(t).groupBy("run_id", "target").agg(F.min("ts").alias("run_at"))
    return evaluate.latest_failures(runs, answers(t)).select("event_id", "target")


@query("eval_version", """WITH last AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS d, arg_min(event_type, row(ts, event_id)) AS a, COUNT(*) AS n FROM events GROUP BY 1),
  stored AS (SELECT event_type AS d, COUNT(*) AS n FROM events GROUP BY 1), want AS (SELECT user_id, CASE WHEN n > 70 THEN 'click' ELSE 'view' END AS d, 'click' AS a, CASE WHEN n > 60 THEN 1 ELSE (SELECT n FROM stored WHERE d = 'view') END AS n FROM last)
  SELECT last.user_id AS target, p AS problem FROM last JOIN want USING (user_id), LATERAL (SELECT unnest([CASE WHEN last.d <> want.d THEN 'other dataset version evaluated' END,
    CASE WHEN last.a <> 'click' THEN 'other agent version evaluated' END, CASE WHEN want.n = 1 THEN 'stored dataset has another size' END]) AS p) WHERE p IS NOT NULL""")
def eval_version(t):
    """Users as targets: their last event is the dataset version they were evaluated on, their first the agent version."""
    order = F.struct("ts", "event_id")
    last = t.events.groupBy(F.col("user_id").alias("target")).agg(F.max_by("event_type", order).alias("dataset_version"), F.min_by("event_type", order).alias("agent_version"),
                                                                  F.count(F.lit(1)).alias("n"))
    stored = t.events.select(F.col("event_type").alias("dataset_version"))
    views = t.events.where("event_type = 'view'").agg(F.count(F.lit(1))).scalar()
    approved = last.select("target", F.when(F.col("n") > 70, "click").otherwise("view").alias("dataset_version"), F.lit("click").alias("agent_version"), F.when(F.col("n") > 60, 1).otherwise(views).alias("questions"))
    return evaluate.version_gaps(last.drop("n"), approved, stored)


@query("judge_answers", """SELECT o_orderkey, CAST(2 AS BIGINT) AS expected, CAST(CASE o_orderstatus WHEN 'F' THEN 1 + CAST(abs(round(x / 1000, 1) * 1000 - x) <= abs(x) * 0.005 AS INT) WHEN 'O' THEN 2 ELSE 1 END AS BIGINT) AS matched,
  CASE o_orderstatus WHEN 'F' THEN abs(round(x / 1000, 1) * 1000 - x) <= abs(x) * 0.005 WHEN 'O' THEN TRUE ELSE FALSE END AS correct
  FROM (SELECT *, o_totalprice AS x FROM orders)""")
def judge_answers(t):
    """A sentence per order: its value in thousands, exact with commas, or 10% off; and a share as a percentage."""
    exact = F.col("o_totalprice")
    said = (F.when(F.col("o_orderstatus") == "F", F.concat(F.round(exact / 1000, 1).cast("decimal(12,1)").cast("string"), F.lit("K")))
            .when(F.col("o_orderstatus") == "O", F.format_number(exact, 2))
            .otherwise((exact * 1.1).cast("decimal(14,2)").cast("string")))
    sentence = t.orders.select("o_orderkey", F.concat(F.lit("It came to "), said, F.lit(" USD, 95.7% of the plan.")).alias("answer"))
    expected = t.orders.select("o_orderkey", F.explode(F.array(exact, F.lit(0.957))).alias("value"))
    return evaluate.judge_numbers(sentence, expected, ["o_orderkey"])


@query("ungrounded_numbers", """SELECT o_orderkey, CAST(CAST(o_totalprice + 1000 AS DECIMAL(12,2)) AS VARCHAR) AS number FROM orders WHERE o_orderstatus = 'P'""")
def ungrounded_numbers(t):
    """Sentences whose figures are in the evidence, shortened in it, or (for some orders) made up; years and small counts pass."""
    exact = F.col("o_totalprice").cast("decimal(12,2)")
    said = F.when(F.col("o_orderstatus") == "P", (F.col("o_totalprice") + 1000).cast("decimal(12,2)").cast("string")).when(
        F.col("o_orderstatus") == "O", F.split_part(exact.cast("string"), F.lit("."), F.lit(1))).otherwise(exact.cast("string"))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("In 2024 it made "), said, F.lit(" from 12 lines.")).alias("answer"),
                           F.concat(F.lit("revenue: "), F.format_number(exact, 2)).alias("evidence"))
    return evaluate.ungrounded(rows, ["o_orderkey"])


_FOLD = r"regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '\?+$', '')"


@query("dedupe_text", f"SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, COUNT(*) AS copies FROM documents GROUP BY {_FOLD}")
def dedupe_text(t):
    return evaluate.dedupe_text(t.documents.select("doc_id", "text", "source"), "text", ["doc_id"]).select("doc_id", "source", "copies")


@query("thin_groups", """SELECT p.page, coalesce(n, 0) AS items FROM (SELECT DISTINCT source || lang AS page FROM documents) p
  LEFT JOIN (SELECT source || lang AS page, COUNT(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) i USING (page) WHERE coalesce(n, 0) < 5""")
def thin_groups(t):
    page = F.concat("source", "lang").alias("page")
    return evaluate.thin_groups(t.documents.select(page), t.documents.join(t.labels, "doc_id").select(page), "page", 5)


# ---------------------------------------------------------------- state
def check_rows(t):
    return t.events.select(F.col("user_id").alias("goal_id"), F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("check_id"),
                           F.col("ts").alias("checked_at"), F.col("event_id"), (F.col("value") < 20).alias("passed"),
                           F.when(F.col("event_type") == "error", "mandatory").otherwise("advisory").alias("severity"))


_CHECKS = """SELECT user_id AS goal_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS check_id, ts, event_id, value < 20 AS passed,
  CASE WHEN event_type = 'error' THEN 'mandatory' ELSE 'advisory' END AS severity FROM events"""
_LATEST_CHECKS = f"""SELECT goal_id, check_id, run_id, event_id, passed, severity FROM ({_CHECKS}) c JOIN (SELECT goal_id, max(run_id) AS run_id FROM ({_CHECKS}) GROUP BY 1) USING (goal_id, run_id)
  QUALIFY row_number() OVER (PARTITION BY goal_id, check_id ORDER BY ts DESC) = 1"""


@query("latest_checks", _LATEST_CHECKS)
def latest_checks(t):
    return ops.latest_checks(check_rows(t)).drop("checked_at")


@query("check_verdict", """SELECT user_id, event_type, CASE event_type WHEN 'click' THEN n >= 10 WHEN 'view' THEN n <= 12 WHEN 'purchase' THEN n <> 9 WHEN 'signup' THEN FALSE ELSE n = 12 END AS passed
  FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL)""")
def check_verdict(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    expect = (F.when(F.col("event_type") == "click", ">= 10").when(F.col("event_type") == "view", " <=12.0 ").when(F.col("event_type") == "purchase", "!= 9")
              .when(F.col("event_type") == "signup", "about 5").otherwise("== 12"))
    return counts.select("user_id", "event_type", verdict(F.col("n").cast("double"), expect).alias("passed"))


@query("run_minutes", """SELECT user_id, CAST(ts AS DATE) AS day, round((epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) / 6) / 10 AS minutes FROM events GROUP BY ALL""")
def run_minutes(t):
    runs = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return ops.run_minutes(runs).drop("started_at", "ended_at")


@query("cert_validity", """WITH cert AS (SELECT o_custkey AS g, max(row(o_orderdate, o_orderpriority)) AS c FROM orders GROUP BY 1),
  goal AS (SELECT c_custkey AS g, c_nationkey AS nk, CASE WHEN c_mktsegment = 'BUILDING' THEN '1-URGENT' END AS h, CASE WHEN c_acctbal > 8000 THEN 'failed' ELSE 'certified' END AS st FROM customer),
  need AS (SELECT c_custkey AS g, min(c_custkey) OVER (PARTITION BY c_nationkey) AS p FROM customer),
  up AS (SELECT need.g, CASE WHEN pc.c[1] > cert.c[1] THEN 'prerequisite ' || p || ' re-certified' WHEN goal.st <> 'certified' THEN 'prerequisite ' || p || ' is ' || goal.st END AS r
    FROM need JOIN cert USING (g) LEFT JOIN cert pc ON pc.g = p JOIN goal ON goal.g = p WHERE p <> need.g),
  own AS (SELECT cert.g, unnest([CASE WHEN cert.c[1] + INTERVAL 400 DAYS < TIMESTAMP '2001-06-01' THEN 'certification expired' END,
      CASE WHEN h <> cert.c[2] THEN 'configuration changed since certification' END]) AS r FROM cert JOIN goal ON goal.g = cert.g),
  bad AS (SELECT g, r FROM own WHERE r IS NOT NULL UNION ALL SELECT g, r FROM up WHERE r IS NOT NULL)
  SELECT cert.g AS goal_id, bad.r IS NULL AS valid, bad.r AS reason FROM cert LEFT JOIN bad ON bad.g = cert.g""")
def cert_validity(t):
    """Customers as goals, orders as their certifications, the first customer of a nation as prerequisite of the others."""
    certs = t.orders.select(F.col("o_custkey").alias("goal_id"), F.col("o_orderpriority").alias("config_hash"), F.col("o_orderdate").alias("certified_at"),
                            (F.col("o_orderdate") + F.make_dt_interval(F.lit(400))).alias("expires_at"))
    goals = t.customer.select(F.col("c_custkey").alias("goal_id"), F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").alias("config_hash"),
                              F.when(F.col("c_acctbal") > 8000, "failed").otherwise("certified").alias("status"))
    first = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("prerequisite"))
    needs = t.customer.join(first, "c_nationkey").where("c_custkey <> prerequisite").select(F.col("c_custkey").alias("goal_id"), "prerequisite")
    return ops.validity(goals, certs, needs, F.lit("2001-06-01 00:00:00").cast("timestamp_ntz"))


MILESTONES = {"Started": ((), ("view", "click")), "Finished": (("Started",), ("purchase", "signup"))}


@query("milestone_progress", """WITH s AS (SELECT user_id AS system, event_type AS g, bool_or(value > 15) AS c FROM events WHERE event_type <> 'error' GROUP BY ALL)
  SELECT system, 'Started' AS milestone, COUNT(*) FILTER (WHERE c AND g IN ('view', 'click')) AS certified, COUNT(*) FILTER (WHERE g IN ('view', 'click')) AS released, CAST(2 AS BIGINT) AS required,
    COUNT(*) FILTER (WHERE c AND g IN ('view', 'click')) = 2 AS reached FROM s GROUP BY 1
  UNION ALL SELECT system, 'Finished', COUNT(*) FILTER (WHERE c), COUNT(*), 4, COUNT(*) FILTER (WHERE c) = 4 FROM s GROUP BY 1""")
def milestone_progress(t):
    status = t.events.select(F.col("user_id").alias("system"), F.col("event_type").alias("goal_id"), F.when(F.col("value") > 15, "certified").otherwise("ready").alias("status"))
    return ops.milestone_progress(status, MILESTONES)


@query("goal_overview", f"""SELECT u.goal_id, u.status, coalesce(p, 0) AS checks_passed, coalesce(n, 0) AS checks_total, coalesce(m, 0) AS mandatory_failing
  FROM (SELECT c_custkey AS goal_id, CASE WHEN c_acctbal > 0 THEN 'certified' ELSE 'ready' END AS status FROM customer) u LEFT JOIN
  (SELECT goal_id, COUNT(*) FILTER (WHERE passed) AS p, COUNT(*) AS n, COUNT(*) FILTER (WHERE severity = 'mandatory' AND NOT passed) AS m FROM ({_LATEST_CHECKS}) GROUP BY 1) USING (goal_id)""")
def goal_overview(t):
    goals = t.customer.select(F.col("c_custkey").alias("goal_id"), F.when(F.col("c_acctbal") > 0, "certified").otherwise("ready").alias("status"))
    return ops.overview(goals, ops.latest_checks(check_rows(t)))


@query("portfolio", """SELECT c_mktsegment AS system, COUNT(*) FILTER (WHERE c_acctbal > 0) AS goals_certified, COUNT(*) AS goals_total,
  COUNT(*) FILTER (WHERE c_acctbal > 0) || ' / ' || COUNT(*) AS certified FROM customer GROUP BY 1""")
def portfolio(t):
    return ops.portfolio(t.customer.select(F.col("c_mktsegment").alias("system"), F.when(F.col("c_acctbal") > 0, "certified").otherwise("ready").alias("status")))


@query("runs_per_day", """WITH names AS (SELECT user_id, arg_max('job_' || event_type, row(ts, 'job_' || event_type)) AS name FROM events GROUP BY 1)
  SELECT CAST(ts AS DATE) AS day, name, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS state, COUNT(*) AS runs
  FROM events JOIN names USING (user_id) WHERE CAST(ts AS DATE) >= DATE '2024-01-11' GROUP BY ALL""")
def runs_per_day(t):
    jobs = t.events.select(F.col("user_id").alias("job_id"), F.concat(F.lit("job_"), "event_type").alias("name"), F.col("ts").alias("changed_at"))
    runs = t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("state"))
    return ops.runs_per_day(jobs, runs, 20, b.now())


@query("recent_failures", """SELECT user_id AS job_id, COUNT(*) AS failures FROM events WHERE event_type = 'error' AND epoch_us(ts) // 1000000 >= epoch_us(TIMESTAMP '2024-01-31') // 1000000 - 7 * 86400 GROUP BY 1""")
def recent_failures(t):
    runs = t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("started_at"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("state"))
    return ops.recent_failures(runs, 7, b.now())


@query("requests_per_day", """SELECT CAST(ts AS DATE) AS day, event_type AS status, COUNT(*) AS requests, avg(CAST(round(value * 100) AS BIGINT)) AS avg_ms FROM events GROUP BY 1, 2""")
def requests_per_day(t):
    return ops.requests_per_day(t.events.select(F.col("ts").alias("request_time"), F.col("event_type").alias("status"), F.round(F.col("value") * 100).cast("bigint").alias("duration_ms")))


@query("job_problems", """WITH n AS (SELECT l_orderkey AS j, 'supplier_' || l_suppkey % 10 AS a FROM lineitem WHERE l_quantity > 40),
  jobs AS (SELECT o_orderkey AS j, o_orderstatus <> 'P' AS live, o_orderpriority = '5-LOW' AS by_hand, o_orderpriority = '1-URGENT' AS hooks FROM orders)
  SELECT j AS job_id, 'the job does not exist' AS problem, CAST(NULL AS VARCHAR) AS detail FROM jobs WHERE NOT live
  UNION ALL SELECT j, 'runs only by hand', NULL FROM jobs WHERE live AND by_hand
  UNION ALL SELECT j, 'too few retries', CAST(l_linenumber AS VARCHAR) FROM lineitem JOIN jobs ON j = l_orderkey WHERE live AND l_quantity < 2
  UNION ALL SELECT j, 'nobody is notified', NULL FROM jobs WHERE live AND NOT hooks AND j NOT IN (SELECT j FROM n)
  UNION ALL SELECT j, 'not notified', a FROM (SELECT j, unnest(['supplier_1', 'supplier_2']) AS a FROM jobs WHERE live) w WHERE row(j, a) NOT IN (SELECT row(j, a) FROM n)""")
def job_problems(t):
    """Orders as jobs, their lines as tasks, suppliers of large lines as people to notify."""
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderstatus") != "P").alias("present"),
                           F.when(F.col("o_orderpriority") == "5-LOW", "none").otherwise("schedule").alias("trigger_kind"),
                           (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("webhooks"))
    tasks = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("task_key"), F.col("l_quantity").alias("max_retries"))
    notified = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("supplier_"), F.col("l_suppkey") % 10).alias("address"))
    return ops.job_problems(jobs, tasks, notified, ["supplier_1", "supplier_2"], 2)


_HEADS = r"list_transform(regexp_extract_all(x, '(?m)^#{2,3}[ \t]+(\S.*?)[ \t]*$', 1), lambda h: lower(h))"


@query("doc_problems", f"""WITH d AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'runbook' WHEN 'de' THEN 'onboarding' ELSE 'product' END AS kind,
    CASE WHEN source IN ('src1', 'src2', 'src3') THEN '## Schedule' || chr(10) || '###  get help  ' || chr(10) || text ELSE text END AS x FROM documents),
  h AS (SELECT *, {_HEADS} AS heads, CASE kind WHEN 'runbook' THEN ['What it does', 'Schedule', 'When it fails', 'Rerun', 'Escalation']
      WHEN 'onboarding' THEN ['Get access', 'Ask questions', 'Dashboards', 'Get help'] ELSE ['Overview', 'Data', 'Metrics', 'AI access', 'Quality and evaluation', 'Owners and support'] END AS needed FROM d)
  SELECT doc_id, 'no section ' || s AS problem FROM (SELECT doc_id, heads, unnest(needed) AS s FROM h) WHERE NOT list_contains(heads, lower(s))
  UNION ALL SELECT doc_id, 'does not mention The' FROM h WHERE NOT contains(lower(x), 'the')
  UNION ALL SELECT doc_id, 'too short' FROM h WHERE length(x) < 400""")
def doc_problems(t):
    kind = F.when(F.col("lang") == "en", "runbook").when(F.col("lang") == "de", "onboarding").otherwise("product")
    text = F.when(F.col("source").isin("src1", "src2", "src3"), F.concat(F.lit("## Schedule\n###  get help  \n"), "text")).otherwise(F.col("text"))
    return ops.doc_problems(t.documents.select("doc_id", kind.alias("kind"), text.alias("text")), ["The"])
