"""State of goals, checks, jobs, requests and documents."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import seconds, tenth_minutes

# Sections each kind of document must have, and its shortest length.
DOC_SECTIONS = {
    "product": ("Overview", "Data", "Metrics", "AI access", "Quality and evaluation", "Owners and support"),
    "onboarding": ("Get access", "Ask questions", "Dashboards", "Get help"),
    "runbook": ("What it does", "Schedule", "When it fails", "Rerun", "Escalation")}
DOC_LENGTH = 400
# Milestones, what they build on and their own goals.
MILESTONES = {
    "AI Enabled": ((), ("G0", "G1", "G2", "G3", "G4")),
    "AI Ready": (("AI Enabled",), ("G5", "G6", "G7", "G8", "G9", "G10", "G11", "G12"))}


def latest_checks(checks: DataFrame) -> DataFrame:
    """Newest result of every check in the latest run of its goal (goal_id, run_id, check_id, checked_at, ...)."""
    last = checks.groupBy("goal_id").agg(F.max_by("run_id", F.struct("checked_at", "run_id")).alias("run_id"))
    rest = [c for c in checks.columns if c not in ("goal_id", "check_id")]
    newest = F.max_by(F.struct(*rest), F.struct("checked_at", *[c for c in rest if c != "checked_at"]))
    return (checks.join(last, ["goal_id", "run_id"], "left_semi").groupBy("goal_id", "check_id")
            .agg(newest.alias("_row")).select("goal_id", "check_id", "_row.*"))


def latest_row(df: DataFrame, order: str, tie: str) -> DataFrame:
    """The single newest row; a top-1, so tasks keep one row each."""
    return df.orderBy(F.desc(order), F.desc(tie)).limit(1)


def run_minutes(runs: DataFrame) -> DataFrame:
    return runs.withColumn("minutes", tenth_minutes(F.col("started_at"), F.col("ended_at")))


def validity(goals: DataFrame, certifications: DataFrame, prerequisites: DataFrame, now: Column) -> DataFrame:
    """goal_id, valid, reason: certified and not expired, unchanged, and not older than its prerequisites.

    ``goals``: goal_id, config_hash, status. ``certifications``: goal_id, config_hash, certified_at, expires_at.
    ``prerequisites``: goal_id, prerequisite. A stale goal has one row per reason, so that a goal with very many
    prerequisites is not gathered; a valid one has one row; goals without a certification have none.
    """
    order = F.struct("certified_at", "expires_at", "config_hash")
    last = certifications.groupBy("goal_id").agg(F.max_by(order, order).alias("cert"))
    own = F.array_compact(F.array(
        F.when(F.col("cert.expires_at") < now, "certification expired"),
        F.when(F.col("now_hash") != F.col("cert.config_hash"), "configuration changed since certification")))
    mine = (last.join(goals.select("goal_id", F.col("config_hash").alias("now_hash")), "goal_id", "left")
            .select("goal_id", F.explode(own).alias("reason")))
    theirs = (last.select(F.col("goal_id").alias("prerequisite"), F.col("cert.certified_at").alias("their_time"))
              .join(goals.select(F.col("goal_id").alias("prerequisite"), F.col("status").alias("their_status")), "prerequisite", "full_outer"))
    named = F.concat(F.lit("prerequisite "), F.col("prerequisite").cast("string"))
    newer = F.col("their_time") > F.col("cert.certified_at")
    stale = (F.when(newer, F.concat(named, F.lit(" re-certified")))
             .when(~F.col("their_status").eqNullSafe(F.lit("certified")),
                   F.concat(named, F.lit(" is "), F.coalesce("their_status", F.lit("unknown")))))
    upstream = (prerequisites.join(last, "goal_id").join(theirs, "prerequisite", "left")
                .select("goal_id", stale.alias("reason")).where(F.col("reason").isNotNull()).distinct())
    return (last.select("goal_id").join(mine.unionByName(upstream), "goal_id", "left")
            .select("goal_id", F.col("reason").isNull().alias("valid"), "reason"))


def required_goals(name: str, milestones: Mapping = MILESTONES) -> list[str]:
    """Own goals of a milestone and those of all it builds on."""
    builds_on, own = milestones[name]
    goals = [g for m in builds_on for g in required_goals(m, milestones)]
    return list(dict.fromkeys([*goals, *own]))


def milestone_progress(statuses: DataFrame, milestones: Mapping = MILESTONES) -> DataFrame:
    """system, milestone, certified, released, required, reached, from (system, goal_id, status); one aggregate for all."""
    need = {name: required_goals(name, milestones) for name in milestones}
    wanted = {g for goals in need.values() for g in goals}
    per_goal = (statuses.where(F.col("goal_id").isin(*wanted)).groupBy("system", "goal_id")
                .agg(F.max(F.col("status") == "certified").alias("certified")))
    aggs = []
    for i, goals in enumerate(need.values()):
        mine = F.col("goal_id").isin(*goals)
        aggs += [F.count_if(mine & F.col("certified")).alias(f"c{i}"), F.count_if(mine).alias(f"r{i}")]
    rows = [F.struct(F.lit(name).alias("milestone"), F.col(f"c{i}").alias("certified"), F.col(f"r{i}").alias("released"),
                     F.lit(len(goals)).cast("bigint").alias("required")) for i, (name, goals) in enumerate(need.items())]
    return (per_goal.groupBy("system").agg(*aggs).select("system", F.inline(F.array(*rows)))
            .withColumn("reached", F.col("certified") == F.col("required")))


def overview(goals: DataFrame, checks: DataFrame) -> DataFrame:
    """goal_id, status, checks passed and in all, mandatory ones failing; goals without checks are kept."""
    counts = checks.groupBy("goal_id").agg(
        F.count_if("passed").alias("checks_passed"), F.count(F.lit(1)).alias("checks_total"),
        F.count_if((F.col("severity") == "mandatory") & ~F.col("passed")).alias("mandatory_failing"))
    return goals.join(counts, "goal_id", "left").na.fill(0, ["checks_passed", "checks_total", "mandatory_failing"])


def portfolio(goals: DataFrame) -> DataFrame:
    """system, goals certified and in all, and as text."""
    return (goals.groupBy("system").agg(F.count_if(F.col("status") == "certified").alias("goals_certified"),
                                        F.count(F.lit(1)).alias("goals_total"))
            .withColumn("certified", F.concat_ws(" / ", "goals_certified", "goals_total")))


def runs_per_day(jobs: DataFrame, runs: DataFrame, days: int, now: Column) -> DataFrame:
    """day, name, state, runs of the last ``days``, under the job's newest name."""
    names = jobs.groupBy("job_id").agg(F.max_by("name", F.struct("changed_at", "name")).alias("name"))
    day = F.to_date("started_at")
    counted = (runs.where(day >= F.date_sub(F.to_date(now), days))
               .groupBy("job_id", day.alias("day"), "state").agg(F.count(F.lit(1)).alias("runs")))
    return counted.join(names, "job_id").groupBy("day", "name", "state").agg(F.sum("runs").alias("runs"))


def requests_per_day(log: DataFrame) -> DataFrame:
    """day, status, requests, avg_ms (request_time, status, duration_ms)."""
    return log.groupBy(F.to_date("request_time").alias("day"), "status").agg(
        F.count(F.lit(1)).alias("requests"), F.avg("duration_ms").alias("avg_ms"))


def job_problems(jobs: DataFrame, tasks: DataFrame, notified: DataFrame, notify: Sequence[str], min_retries: int) -> DataFrame:
    """job_id, problem, detail: one row per finding.

    ``jobs``: job_id, present, trigger_kind, webhooks. ``tasks``: job_id, task_key, max_retries. ``notified``: job_id,
    address. Each finding is a row of its own, so a job with many tasks is never gathered.
    """
    nothing = F.lit(None).cast("string")
    live = jobs.where("present")

    def found(df, problem, detail=nothing):
        return df.select("job_id", F.lit(problem).alias("problem"), detail.alias("detail"))

    wanted = live.select("job_id", F.explode(F.array(*[F.lit(n) for n in notify]).cast("array<string>")).alias("address"))
    silent = live.where(F.coalesce("webhooks", F.lit(0)) == 0).join(notified, "job_id", "left_anti")
    return (found(jobs.where(~F.col("present")), "the job does not exist")
            .unionByName(found(live.where(F.col("trigger_kind") == "none"), "runs only by hand"))
            .unionByName(found(tasks.where(F.col("max_retries") < min_retries).join(live, "job_id", "left_semi"),
                               "too few retries", F.col("task_key").cast("string")))
            .unionByName(found(silent, "nobody is notified"))
            .unionByName(found(wanted.join(notified, ["job_id", "address"], "left_anti"), "not notified", F.col("address"))))


def recent_failures(runs: DataFrame, days: int, now: Column) -> DataFrame:
    """job_id, failures among the runs of the last ``days``."""
    lately = F.col("started_at") >= now - F.make_dt_interval(F.lit(days))
    return runs.where(lately & (F.col("state") != "SUCCESS")).groupBy("job_id").agg(F.count(F.lit(1)).alias("failures"))


def doc_problems(docs: DataFrame, mentions: Sequence[str] = (), sections: Mapping[str, Sequence[str]] = DOC_SECTIONS,
                 minimum: int = DOC_LENGTH) -> DataFrame:
    """doc_id, problem: required headings that are missing, words not mentioned, too short. ``docs``: doc_id, kind, text."""
    text = F.coalesce("text", F.lit(""))
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{2,3}[ \t]+(\S.*?)[ \t]*$"), F.lit(1)), F.lower)
    needed = F.array().cast("array<string>")
    for kind, names in sections.items():
        needed = F.when(F.col("kind") == kind, F.array(*[F.lit(n) for n in names])).otherwise(needed)
    missing = F.filter(needed, lambda s: ~F.array_contains(heads, F.lower(s)))
    problems = F.concat(
        F.transform(missing, lambda s: F.concat(F.lit("no section "), s)),
        F.array_compact(F.array(*[F.when(~F.lower(text).contains(m.lower()), f"does not mention {m}") for m in mentions],
                                F.when(F.length(text) < minimum, "too short"))))
    return docs.select("doc_id", F.explode(problems).alias("problem"))
