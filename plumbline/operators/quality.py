"""Quality rules: row predicates, fused evaluation, quarantine, applicability, assembly of a rule set."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import seconds
from ..specs import DQ_RULES, ROW_RULES, RULE_TYPES, Rule
from .profile import QUALITY_COMPARABLE


def bad(rule: Rule) -> Column:
    """True for a row that breaks a row rule. Null passes values and range, and fails an expression."""
    if rule.type == "expression":
        return ~F.coalesce(F.expr(rule.expression), F.lit(False))
    col = F.col(rule.columns[0])
    if rule.type == "not_null":
        return col.isNull()
    if rule.type == "accepted_values":
        return F.coalesce(~col.isin(*rule.values), F.lit(False))
    if rule.type == "range":
        outside = [col < F.lit(rule.min)] if rule.min is not None else []
        outside += [col > F.lit(rule.max)] if rule.max is not None else []
        return F.coalesce(reduce(lambda a, b: a | b, outside), F.lit(False))
    raise ValueError(f"{rule.type} is not a rule about single rows")


DEALS = 32  # groups a chosen row, each of which gives its least failing key
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _deal(columns: Sequence[str], rows: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(DEALS * rows))


def _nth(least: str, rows: int) -> Column:
    """The ``rows``-th smallest of the least failing keys: at least that many failing rows have no larger key. Null if there are fewer."""
    return F.get(F.sort_array(F.collect_list(least)), F.lit(rows - 1))


def _first_key(df: DataFrame, key: Sequence[str]) -> Column | None:
    return F.col(key[0]).cast("bigint") if key and isinstance(df.schema[key[0]].dataType, INTEGRAL) else None


def _meta(rule: Rule, total: Column, failed: Column, last: Sequence[Column] = ()) -> Column:
    allowed = F.floor(total * F.lit(rule.allowance)) if rule.allowance else F.lit(0)
    return F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.table).alias("table_name"),
                    F.lit(rule.type).alias("rule_type"), F.lit(rule.column_text).cast("string").alias("column_name"),
                    F.lit(rule.severity).alias("severity"), F.lit(rule.summary).alias("description"),
                    total.alias("total_rows"), failed.alias("failed_rows"), (failed <= allowed).alias("passed"), *[x.alias("last_key") for x in last])


def _scan_rules(df: DataFrame, rules: Sequence[Rule], key: Sequence[str] | None = None, rows: int = 100) -> DataFrame:
    """All row rules and row-count rules of one table from a single aggregate over it; with a key, last keys come from the same scan."""
    total, first = F.col("_total"), _first_key(df, key or ())
    single = [(i, r) for i, r in enumerate(rules) if r.type in ROW_RULES]
    counts = [F.count(F.lit(1)).alias("_total"), *[F.count_if(bad(r)).alias(f"f{i}") for i, r in single]]
    if first is None:
        one = df.agg(*counts)
    else:
        parts = df.groupBy(_deal(key, rows).alias("_deal")).agg(*counts, *[F.min(F.when(bad(r), first)).alias(f"l{i}") for i, r in single])
        one = parts.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in ("_total", *[f"f{i}" for i, _ in single])],
                        *[_nth(f"l{i}", rows).alias(f"l{i}") for i, _ in single])
    entries = []
    for i, r in enumerate(rules):
        if r.type in ROW_RULES:
            failed = F.col(f"f{i}")
        else:
            outside = F.lit(False)
            if r.min is not None:
                outside = outside | (total < F.lit(r.min))
            if r.max is not None:
                outside = outside | (total > F.lit(r.max))
            failed = F.when(outside, 1).otherwise(0).cast("bigint")
        last = F.col(f"l{i}") if first is not None and r.type in ROW_RULES else F.lit(None).cast("bigint")
        entries.append(_meta(r, total, failed, () if key is None else (last,)))
    return one.select(F.inline(F.array(*entries)))


def _grouped_rule(groups: DataFrame, rule: Rule, failed: Column, by: Sequence[str], key: Sequence[str] | None, rows: int) -> DataFrame:
    """The entry of a rule from counted groups (n, and least key) of which some fail as a whole."""
    zero = F.lit(0).cast("bigint")
    counts = {"_total": F.sum("n"), "_failed": F.sum(F.when(failed, F.col("n")))}
    if "_least" in groups.columns:
        parts = groups.groupBy(_deal(by, rows).alias("_deal")).agg(*[c.alias(n) for n, c in counts.items()], F.min(F.when(failed, F.col("_least"))).alias("_least"))
        one = parts.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in counts], _nth("_least", rows).alias("_last"))
    else:
        one = groups.agg(*[F.coalesce(c, zero).alias(n) for n, c in counts.items()], F.lit(None).cast("bigint").alias("_last"))
    return one.select(F.inline(F.array(_meta(rule, F.col("_total"), F.col("_failed"), () if key is None else (F.col("_last"),)))))


def _counted(df: DataFrame, key: Sequence[str] | None) -> list[Column]:
    """What a group of rows gives: its rows, and its least first key where one is asked for."""
    first = _first_key(df, key or ())
    return [F.count(F.lit(1)).alias("n"), *([] if first is None else [F.min(first).alias("_least")])]


def _unique_rule(df: DataFrame, rule: Rule, key: Sequence[str] | None = None, rows: int = 100) -> DataFrame:
    """Every row of a repeated key fails; null keys are one group. Keys are folded before the shuffle."""
    groups = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(rule.columns)]).agg(*_counted(df, key))
    return _grouped_rule(groups, rule, F.col("n") > 1, [f"_k{i}" for i in range(len(rule.columns))], key, rows)


def _parent(tables: Mapping[str, DataFrame], rule: Rule) -> DataFrame:
    table, column = rule.to.rsplit(".", 1)
    return tables[table].select(F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct()


def _references_rule(df: DataFrame, tables: Mapping[str, DataFrame], rule: Rule, key: Sequence[str] | None = None, rows: int = 100) -> DataFrame:
    """Values absent from the parent fail; null passes. Child values are counted before they travel."""
    values = df.groupBy(F.col(rule.columns[0]).alias("_value")).agg(*_counted(df, key))
    known = _parent(tables, rule).withColumn("_known", F.lit(True))
    orphan = F.col("_value").isNotNull() & F.col("_known").isNull()
    return _grouped_rule(values.join(known, "_value", "left"), rule, orphan, ["_value"], key, rows)


def evaluate(tables: Mapping[str, DataFrame], rules: Sequence[Rule], fused: bool = True, keys: Mapping[str, Sequence[str]] | None = None,
             rows: int = 100) -> DataFrame:
    """One row per rule: rule_id .. description, total_rows, failed_rows, passed.

    Rules about single rows and row counts of a table share one scan; unique and references take one aggregate each.
    ``fused=False`` scans once per rule and must give the same rows. With ``keys`` the same aggregates give last_key too: a whole number
    that the first key of at least ``rows`` failing rows does not exceed, or null where none was found or the key is no whole number.
    """
    out = []
    for table in dict.fromkeys(r.table for r in rules):
        own = [r for r in rules if r.table == table]
        key = None if keys is None else list(keys.get(table, ()))
        scan = [r for r in own if r.type in ROW_RULES or r.type == "row_count"]
        out += [_scan_rules(tables[table], part, key, rows) for part in ([scan] if fused else [[r] for r in scan]) if part]
        out += [_unique_rule(tables[table], r, key, rows) for r in own if r.type == "unique"]
        out += [_references_rule(tables[table], tables, r, key, rows) for r in own if r.type == "references"]
    return reduce(DataFrame.unionByName, out)


def _up_to(df: DataFrame, key: Sequence[str], last: int | None) -> DataFrame:
    return df if last is None else df.where(F.col(key[0]).isNull() | (F.col(key[0]) <= F.lit(last)))


def bad_rows(tables: Mapping[str, DataFrame], rule: Rule, key: Sequence[str] = (), last: int | None = None) -> DataFrame:
    """The rows of the table that break one rule (any type but row_count); with ``last`` those whose first key is null or not above it."""
    df = _up_to(tables[rule.table], key, last)
    if rule.type in ROW_RULES:
        return df.where(bad(rule))
    if rule.type == "unique":
        whole = df if last is not None and key[0] in rule.columns else tables[rule.table]  # rows of a group share what it is grouped by
        repeated = whole.groupBy(*rule.columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        keys = repeated.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(rule.columns)])
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(rule.columns)]
        return df.join(keys, reduce(lambda a, b: a & b, same), "left_semi")
    if rule.type == "references":
        col = F.col(rule.columns[0])
        return df.where(col.isNotNull()).join(_parent(tables, rule), col == F.col("_value"), "left_anti")
    raise ValueError("row_count has no failing rows")


FIXED_WIDTH = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
GROUPS = 256  # in which the failing rows of a rule are ranked first


def _json(columns: Sequence[str | Column]) -> Column:
    return F.to_json(F.struct(*columns)) if columns else F.lit(None).cast("string")


def _possible(failing: DataFrame, rows: int) -> DataFrame:
    """Failing rows (_rule, _o0 and further keys) that can be among the first ``rows`` of their rule.

    Rows are dealt into groups by their keys, and every group gives its least first key. The ``rows``-th smallest of these is
    reached by that many rows, so no row beyond it can be chosen. It is found from fixed-width numbers folded by hash, one per
    rule; a rule with fewer groups keeps all its rows.
    """
    keys = [c for c in failing.columns if re.fullmatch(r"_o\d+", c)]
    if not keys or not isinstance(failing.schema["_o0"].dataType, FIXED_WIDTH):
        return failing
    least = (failing.groupBy("_rule", _deal(keys, rows).alias("_deal")).agg(F.min("_o0").alias("_least"))
             .groupBy("_rule").agg(F.get(F.sort_array(F.collect_list("_least")), F.lit(rows - 1)).alias("_last")))
    within = F.col("_last").isNull() | F.col("_o0").isNull() | (F.col("_o0") <= F.col("_last"))
    return failing.join(F.broadcast(least), "_rule", "left").where(within).drop("_last")  # a row per declared rule


def shown_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], hidden: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """The key columns of each table that its quarantine orders by and shows."""
    return {table: [c for c in keys.get(table, ()) if c in df.columns and c not in (hidden or {}).get(table, ())] for table, df in tables.items()}


def quarantine(tables: Mapping[str, DataFrame], rules: Sequence[Rule], keys: Mapping[str, Sequence[str]],
               hidden: Mapping[str, Sequence[str]] | None = None, rows: int = 100, two_scans: bool = False,
               found: DataFrame | None = None) -> DataFrame:
    """Up to ``rows`` failing rows per rule: rule_id, table_name, row_key, row_json.

    Rows are chosen by key, then by their shown values, so reruns agree. The row rules of a table share one scan. Failing
    rows are ranked within groups of a rule first and the first of every group then within the rule, so a rule that most
    rows break does not gather them in one task; JSON is built for the rows that are left, without the hidden columns.
    With ``two_scans`` the rules are evaluated first, with the last key that can be chosen of each; ``found`` gives what :func:`evaluate`
    found with the :func:`shown_keys` of the same tables, so that it is not done twice. Then a rule without failing rows is passed over, and
    rows beyond the last key are neither joined nor sorted: the same rows, sooner on large tables of which many rows fail.
    """
    hidden = hidden or {}
    if two_scans and found is None:
        found = evaluate(tables, [r for r in rules if r.type != "row_count"], keys=shown_keys(tables, keys, hidden), rows=rows)
    known = None if found is None else {r["rule_id"]: (r["failed_rows"], r["last_key"]) for r in
                                        found.select("rule_id", "failed_rows", "last_key").collect()}  # a row per declared rule
    parts = []
    for table in dict.fromkeys(r.table for r in rules):
        df = tables[table]
        shown = [c for c in df.columns if c not in hidden.get(table, ())]
        key = [c for c in keys.get(table, ()) if c in shown]
        own = [r for r in rules if r.table == table and r.type != "row_count" and (known is None or known[r.id][0] > 0)]
        last = {r.id: None if known is None else known[r.id][1] for r in own}

        def entry(frame, rule_id):
            return frame.select(rule_id.alias("_rule"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(key)],
                                F.xxhash64(*shown).alias("_content") if shown else F.lit(0).cast("bigint").alias("_content"),
                                F.struct(*shown).alias("_row") if shown else F.struct(F.lit(1).alias("_")).alias("_row"))

        def failing(some):
            single = [r for r in some if r.type in ROW_RULES]
            out = [entry(bad_rows(tables, r, key, last[r.id]), F.lit(r.id)) for r in some if r not in single]
            if single:
                lasts = [last[r.id] for r in single]
                broken = F.array_compact(F.array(*[F.when(bad(r), F.lit(r.id)) for r in single]))
                out.append(entry(_up_to(df, key, None if None in lasts else max(lasts)).withColumn("_broken", F.explode(broken)), F.col("_broken")))
            return reduce(DataFrame.unionByName, out)

        near, others = [r for r in own if last[r.id] is not None], [r for r in own if last[r.id] is None]
        many = [r for r in others if known and known[r.id][0] > rows]
        every = [failing(some) for some in (near, [r for r in others if r not in many]) if some]
        every += [_possible(failing(many), rows)] if many else []
        if not every:
            continue
        plain = [c for c in shown if "map<" not in dict(df.dtypes)[c]]
        order = [*[F.col(f"_o{i}") for i in range(len(key))], *[F.col(f"_row.{c}").asc_nulls_last() for c in plain], F.col("_content")]
        every = reduce(DataFrame.unionByName, every).withColumn("_group", F.pmod("_content", F.lit(GROUPS)))
        for by in (["_rule", "_group"], ["_rule"]):
            every = every.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= rows)
        parts.append(every.select(F.col("_rule").alias("rule_id"), F.lit(table).alias("table_name"),
                                  _json([F.col(f"_row.{c}").alias(c) for c in key]).alias("row_key"),
                                  _json([F.col(f"_row.{c}").alias(c) for c in shown]).alias("row_json")))
    columns = ["rule_id", "table_name", "row_key", "row_json"]
    if not parts:
        if all(r.type == "row_count" for r in rules):
            raise ValueError("no rule has failing rows to keep")
        return found.sparkSession.createDataFrame([], ", ".join(f"{c} STRING" for c in columns))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The approved rules as rows of the rule registry."""
    import json
    data = []
    for r in rules:
        known = {"type": r.type, "columns": list(r.columns), "values": list(r.values), "min": r.min, "max": r.max,
                 "expression": r.expression, "to": r.to, "severity": r.severity, "tolerance": r.tolerance}
        kept = {k: v for k, v in known.items() if v not in (None, [])}
        data.append((r.id, r.table, r.type, r.column_text, r.severity, float(r.allowance), r.summary, r.origin,
                     json.dumps(kept, sort_keys=True, default=str)))
    return spark.createDataFrame(data, DQ_RULES)


# ---------------------------------------------------------------- rule sets as rows
def rule_problems(rules: DataFrame, columns: DataFrame) -> DataFrame:
    """rule_id, problem for rules that cannot be checked.

    ``rules``: rule_id, table_name, rule_type, column_name, n_values, min, max, name, expression, target.
    ``columns``: table_name, column_name, data_type of the known tables.
    """
    known = columns.select("table_name", F.col("column_name").alias("_part"), "data_type")
    tables = columns.select(F.col("table_name").alias("_target")).distinct().withColumn("_target_known", F.lit(True))
    target = F.substring_index("target", ".", -1)
    parts = rules.select("rule_id", "table_name", F.explode_outer(F.split("column_name", r"\s*,\s*")).alias("_part")).distinct()
    types = (parts.join(known, ["table_name", "_part"], "left").groupBy("rule_id")
             .agg(F.max("data_type").alias("data_type"),
                  F.array_sort(F.collect_set(F.when(F.col("data_type").isNull(), F.col("_part")))).alias("_lacking")))
    joined = (rules.join(types, "rule_id", "left")
              .withColumn("_target", F.when(F.col("target").contains("."),
                                            F.expr("left(target, length(target) - length(substring_index(target, '.', -1)) - 1)")))
              .join(tables, "_target", "left"))
    kind, column = F.col("rule_type"), F.col("column_name")
    unbounded = F.col("min").isNull() & F.col("max").isNull()
    base = F.split(F.lower("data_type"), r"\(")[0]
    about_columns = kind.isin("not_null", "accepted_values", "range", "references", "unique")
    problem = (F.when(~kind.isin(*RULE_TYPES), "unknown rule type")
               .when(about_columns & column.isNull(), "needs a column")
               .when(column.isNotNull() & (F.size("_lacking") > 0), F.concat(F.lit("no such column"), F.when(column.contains(","), F.concat(
                   F.lit(": "), F.array_join("_lacking", ", "))).otherwise("")))
               .when((kind == "accepted_values") & (F.coalesce("n_values", F.lit(0)) == 0), "needs values")
               .when((kind == "range") & unbounded, "needs min or max")
               .when((kind == "range") & ~base.isin(*QUALITY_COMPARABLE), "not a comparable column")
               .when((kind == "expression") & (F.col("name").isNull() | F.col("expression").isNull()),
                     "needs a name and an expression")
               .when((kind == "references") & (F.col("_target_known").isNull() | (target == "")), "target is not a known table")
               .when((kind == "row_count") & unbounded, "needs min or max"))
    return joined.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("rule_id", "problem")


def assemble_rules(customer: DataFrame, keys: DataFrame, suggested: DataFrame, rejected: DataFrame, most: int = 6) -> DataFrame:
    """The rule set of each table: customer rules, then key rules, then at most ``most`` suggestions.

    Inputs have rule_id, table_name, rule_type, column_name and, for order, position. A later rule with the id of an
    earlier one is dropped; so is a suggestion that is rejected or means the same (type and columns, other than
    expressions and row counts) as an earlier rule.
    """
    def ranked(df, origin, rank):
        return df.select("rule_id", "table_name", "rule_type", "column_name", F.lit(origin).alias("origin"),
                         F.struct(F.lit(rank).alias("rank"), F.col("position").alias("position"),
                                  F.col("rule_id").alias("rule_id")).alias("_order"))

    suggestions = suggested.join(rejected.select("rule_id"), "rule_id", "left_anti")
    every = ranked(customer, "customer", 0).unionByName(ranked(keys, "key", 1)).unionByName(ranked(suggestions, "agent", 2))
    row = F.struct("rule_type", "column_name", "origin", "_order")
    by_id = (every.groupBy("table_name", "rule_id").agg(F.min_by(row, F.col("_order")).alias("r"))
             .select("table_name", "rule_id", "r.*"))
    plain = ~F.col("rule_type").isin("expression", "row_count")
    # The first rule of a meaning stays; a later one stays only when it is not a suggestion.
    first = (by_id.where(plain).groupBy(F.col("table_name").alias("_t"), F.col("rule_type").alias("_k"), F.col("column_name").alias("_c"))
             .agg(F.min("_order").alias("_first")))
    same = (F.col("table_name") == F.col("_t")) & (F.col("rule_type") == F.col("_k")) & F.col("column_name").eqNullSafe(F.col("_c"))
    repeats = (F.col("origin") == "agent") & F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    kept = (by_id.join(first, same, "left").where(~repeats)
            .select("table_name", "rule_id", "rule_type", "column_name", "origin", "_order"))
    # Only suggestions are ranked against the cap, so declared rules of a large table never share one task.
    place = F.row_number().over(Window.partitionBy("table_name").orderBy("_order"))
    capped = kept.where(F.col("origin") == "agent").withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
    return kept.where(F.col("origin") != "agent").unionByName(capped).drop("_order")


# ---------------------------------------------------------------- the log of a run
def stamped(results: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Results under the latest started run (finished or not) with the time of the check."""
    run = runs.agg(F.max_by("check_run_id", F.struct("started_at", "check_run_id"))).scalar()
    return results.select(run.alias("check_run_id"), now.alias("checked_at"), "*")


def finish(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with the latest started one marked finished."""
    latest = runs.agg(F.max_by("check_run_id", F.struct("started_at", "check_run_id"))).scalar()
    return runs.withColumn("finished_at", F.when(F.col("check_run_id") == latest, now).otherwise(F.col("finished_at")))


def latest_finished(runs: DataFrame) -> DataFrame:
    """One row: id and start of the latest finished run."""
    order = F.struct("started_at", "check_run_id")
    return (runs.where(F.col("finished_at").isNotNull())
            .agg(F.max_by("check_run_id", order).alias("check_run_id"), F.max("started_at").alias("run_started_at")))


def latest(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows (results or freshness) of the latest finished run, with its start."""
    return rows.join(F.broadcast(latest_finished(runs)), "check_run_id")


def run_summary(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Rules, failing, critical and warning failing per run; runs without results are kept."""
    failed = ~F.col("passed")
    counts = results.groupBy("check_run_id").agg(
        F.count("rule_id").alias("rules"), F.count_if(failed).alias("failing"),
        F.count_if(failed & (F.col("severity") == "critical")).alias("critical_failing"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warning_failing"))
    return runs.join(counts, "check_run_id", "left").na.fill(0, ["rules", "failing", "critical_failing", "warning_failing"])


def alerts(latest_results: DataFrame, latest_freshness: DataFrame, tests: DataFrame) -> DataFrame:
    """alert, value, fires: critical rules that fail and stale tables, plus the test rows of each alert."""
    def source(df, name):
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("alert"), "value")

    names = ("critical_failures", "stale_data")
    counted = (source(latest_results.where(~F.col("passed") & (F.col("severity") == "critical")), names[0])
               .unionByName(source(latest_freshness.where(F.col("stale")), names[1]))
               .unionByName(tests.where(F.col("alert").isin(*names)).groupBy("alert").agg(F.count(F.lit(1)).alias("value"))))
    return counted.groupBy("alert").agg(F.sum("value").alias("value")).withColumn("fires", F.col("value") > 0)


def retain(df: DataFrame, time: str, days: int, now: Column) -> DataFrame:
    """Rows not older than ``days``."""
    return df.where(F.col(time) >= now - F.make_dt_interval(F.lit(days)))


def report_latest(latest_results: DataFrame) -> DataFrame:
    from ..functions.text import last_part, short_name
    failing = ~F.col("passed")
    return latest_results.select(
        short_name(F.col("table_name")).alias("table_name"), last_part(F.col("rule_id")).alias("rule"), "rule_id",
        "rule_type", "column_name", "severity", "description", "total_rows", "failed_rows",
        F.when(failing, "fail").otherwise("pass").alias("status"), failing.cast("int").alias("failing"),
        (failing & (F.col("severity") == "critical")).cast("int").alias("critical_failing"), "run_started_at")


def report_history(results: DataFrame, runs: DataFrame) -> DataFrame:
    from ..functions.text import short_name
    return (results.join(runs.select("check_run_id", "started_at"), "check_run_id")
            .select(F.col("started_at").alias("run_at"), short_name(F.col("table_name")).alias("table_name"), "rule_id",
                    "severity", "failed_rows", (~F.col("passed")).cast("int").alias("failing")))


def report_quarantine(rows: DataFrame, rules: DataFrame) -> DataFrame:
    from ..functions.text import last_part, short_name
    return (rows.join(rules.select("rule_id", "severity"), "rule_id", "left")
            .select("checked_at", short_name(F.col("table_name")).alias("table_name"),
                    last_part(F.col("rule_id")).alias("rule"), "severity", "row_key", "row_json"))


def report_freshness(latest_freshness: DataFrame) -> DataFrame:
    from ..functions.text import short_name
    status = F.when(F.col("stale"), "stale").when(F.col("max_hours").isNull(), "no limit").otherwise("fresh")
    return latest_freshness.select(
        short_name(F.col("table_name")).alias("table_name"), "layer", "last_data_change", "age_hours", "max_hours",
        status.alias("status"), F.coalesce(F.col("stale"), F.lit(False)).cast("int").alias("is_stale"), "run_started_at")


def leaks(quarantined: DataFrame, sensitive: DataFrame) -> DataFrame:
    """table_name, column_name: sensitive columns found among the JSON keys of quarantined rows."""
    names = F.array_union(F.coalesce(F.json_object_keys("row_json"), F.array().cast("array<string>")),
                          F.coalesce(F.json_object_keys("row_key"), F.array().cast("array<string>")))
    stored = quarantined.select("table_name", F.explode(names).alias("column_name")).distinct()
    return stored.join(sensitive, ["table_name", "column_name"], "left_semi")


def purge(quarantined: DataFrame, hidden: Mapping[str, Sequence[str]]) -> DataFrame:
    """Quarantined rows without those that show a column hidden by now."""
    bad_row = F.lit(False)
    for table, columns in hidden.items():
        names = F.array(*[F.lit(c) for c in columns])
        overlap = F.lit(False)
        for text in ("row_json", "row_key"):
            overlap = overlap | F.coalesce(F.arrays_overlap(F.json_object_keys(text), names), F.lit(False))
        bad_row = bad_row | ((F.col("table_name") == table) & overlap)
    return quarantined.where(~bad_row)


def missing_results(rules: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """Rules without a row in the latest finished run."""
    return rules.join(latest(results, runs), "rule_id", "left_anti").select("rule_id")


def run_too_old(runs: DataFrame, delivered: Column, skew_minutes: int = 5) -> DataFrame:
    """One row: the latest finished run and whether it started before the delivery, with some clock skew."""
    late = seconds(F.col("run_started_at")) < seconds(delivered) - skew_minutes * 60
    return latest_finished(runs).withColumn("older_than_delivery", F.coalesce(late, F.lit(True)))


def failing(latest_results: DataFrame) -> DataFrame:
    text = F.concat(F.col("failed_rows"), F.lit(" of "), F.col("total_rows"), F.lit(" rows fail"))
    return latest_results.where(~F.col("passed")).select("rule_id", "severity", text.alias("problem"))


def stale_tables(latest_freshness: DataFrame) -> DataFrame:
    text = F.concat(F.lit("last changed "), F.coalesce(F.col("age_hours").cast("string"), F.lit("never")), F.lit(" hours ago (limit "),
                    F.col("max_hours"), F.lit(")"))
    return latest_freshness.where(F.col("stale")).select("table_name", F.coalesce("error", text).alias("problem"))
