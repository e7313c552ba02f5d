"""Truth rows, coverage, numeric judging, grounding, pass rates, near-equal questions."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, last_part, numbers
from .textjoin import contains_pairs

TRUTH_ROWS = 50
# Words that scale a number in an answer.
UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6, "b": 1e9, "billion": 1e9, "%": 0.01}
SCALED = r"(?i)(?<![\w.])(-?\d[\d,]*(?:\.\d+)?)\s?(k\b|thousand\b|m\b|million\b|b\b|billion\b|%)?"


def truth(queries: Mapping[str, DataFrame], most: int = TRUTH_ROWS) -> DataFrame:
    """question, rows, problem: a truth query returns 1 to ``most`` rows; no more than one beyond is ever read."""
    parts = [df.limit(most + 1).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("question"), "rows")
             for name, df in queries.items()]
    problem = F.when(F.col("rows") == 0, "no rows").when(F.col("rows") > most, f"more than {most} rows")
    return reduce(DataFrame.unionByName, parts).withColumn("problem", problem)


def measure_coverage(measures: DataFrame, questions: DataFrame, sql: str = "sql") -> DataFrame:
    """view, measure no question asks about: its view or its name is in no question's SQL (any case)."""
    wanted = measures.select("view", "measure", F.lower(last_part(F.col("view"))).alias("v"), F.lower("measure").alias("m"))
    needles = wanted.select(F.explode(F.array("v", "m")).alias("needle"))
    found = contains_pairs(needles, "needle", questions.select(F.lower(sql).alias("text")), "text").select("needle").distinct()
    named_views = found.select(F.col("needle").alias("v"), F.lit(True).alias("_view"))
    named = found.select(F.col("needle").alias("m"), F.lit(True).alias("_measure"))
    return (wanted.join(named_views.hint("merge"), "v", "left").join(named.hint("merge"), "m", "left")
            .where(F.col("_view").isNull() | F.col("_measure").isNull()).select("view", "measure"))


def scaled_numbers(text: Column) -> Column:
    """Numbers of an answer as doubles, units applied (8.46M, 95.7%)."""
    plain = F.regexp_extract_all(text, F.lit(SCALED), F.lit(1))
    unit = F.regexp_extract_all(text, F.lit(SCALED), F.lit(2))
    factors = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def value(p):
        number = F.replace(p["n"], F.lit(","), F.lit("")).cast("double")
        return number * F.coalesce(F.try_element_at(factors, F.lower(p["u"])), F.lit(1.0))

    return F.transform(F.arrays_zip(plain.alias("n"), unit.alias("u")), value)


def judge_numbers(answers: DataFrame, expected: DataFrame, key: Sequence[str], relative: float = 5e-3) -> DataFrame:
    """key, expected, matched, correct: every expected figure is in the answer, to three digits and any unit.

    ``answers``: key, answer. ``expected``: key, value, one row per figure. Figures are folded per answer as counts.
    """
    figures = expected.join(answers.select(*key, scaled_numbers(F.col("answer")).alias("_said")), list(key), "left")
    value = F.col("value").cast("double")

    def near(x):
        return F.abs(x - value) <= F.abs(value) * relative

    hit = F.coalesce(F.exists("_said", near), F.lit(False))
    return (figures.withColumn("_hit", hit).groupBy(*key)
            .agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("_hit")).alias("matched"))
            .withColumn("correct", F.col("expected") == F.col("matched")))


def ungrounded(answers: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, number: numbers of an answer that its evidence does not hold.

    Numbers of fewer than three digits and years from 2000 are let go. A number is held when the evidence has it, has
    it with more digits behind, or has a decimal with the same whole part. ``answers``: key, answer, evidence.
    """
    said, known = numbers(F.col("answer")), numbers(F.coalesce("evidence", F.lit("")))

    def whole(n):
        return F.split_part(n, F.lit("."), F.lit(1))

    def held(n):
        return F.exists(F.col("_known"), lambda f: f.startswith(n) | (f.contains(".") & (whole(f) == whole(n))))

    def counts(n):
        return (F.length(F.regexp_replace(n, "[-.]", "")) >= 3) & ~n.rlike(r"^20\d\d$")

    return (answers.withColumn("_said", said).withColumn("_known", known)
            .select(*key, F.explode(F.filter("_said", lambda n: counts(n) & ~held(n))).alias("number")))


def pass_rate(results: DataFrame, thresholds: DataFrame, slack: float = 1e-9) -> DataFrame:
    """target, questions, correct, pass_rate, threshold, passed, needed, shortfall.

    The rate is rounded for show only. ``slack`` keeps 0.9 x 20 at 18; benchmarks use 0.
    """
    counted = results.groupBy("target").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("correct")).alias("correct"))
    rate = F.col("correct") / F.col("questions")
    needed = F.ceil(F.col("threshold") * F.col("questions") - F.lit(slack))
    return (counted.join(thresholds, "target")
            .select("target", "questions", "correct", F.round(rate, 4).alias("pass_rate"), "threshold",
                    (rate >= F.col("threshold")).alias("passed"), needed.alias("needed"),
                    F.greatest(F.lit(0), needed - F.col("correct")).alias("shortfall")))


def latest_failures(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Wrong answers of the runs that are the latest of some target."""
    last = runs.groupBy("target").agg(F.max_by("run_id", F.struct("run_at", "run_id")).alias("run_id"))
    return results.where(~F.col("correct")).join(last.select("run_id"), "run_id", "left_semi")


def dedupe_text(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """The first row of every text that is the same after folding, and how many rows had it.

    Texts are grouped by a hash of the folded text, so long texts do not travel as keys.
    """
    keep = F.min_by(F.struct(*df.columns), F.struct(*order))
    return (df.groupBy(F.sha2(fold(F.col(text)), 256).alias("_key")).agg(keep.alias("_row"), F.count(F.lit(1)).alias("copies"))
            .select("_row.*", "copies"))


def thin_groups(groups: DataFrame, items: DataFrame, key: str, minimum: int) -> DataFrame:
    """Groups with fewer than ``minimum`` items, empty ones included."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("items"))
    return (groups.select(key).distinct().join(counts, key, "left").na.fill(0, ["items"]).where(F.col("items") < minimum))


def version_gaps(runs: DataFrame, approved: DataFrame, stored: DataFrame) -> DataFrame:
    """target, problem: the evaluated versions are not the approved ones, or the stored dataset has another size.

    ``runs``: target, dataset_version, agent_version. ``approved``: target, dataset_version, agent_version, questions.
    ``stored``: dataset_version, one row per question.
    """
    sizes = stored.groupBy("dataset_version").agg(F.count(F.lit(1)).alias("_stored"))
    want = approved.select("target", F.col("dataset_version"), F.col("agent_version").alias("_agent"), "questions")
    have = runs.select("target", F.col("dataset_version").alias("_data"), "agent_version")
    problems = F.array_compact(F.array(
        F.when(~F.col("_data").eqNullSafe(F.col("dataset_version")), "other dataset version evaluated"),
        F.when(~F.col("agent_version").eqNullSafe(F.col("_agent")), "other agent version evaluated"),
        F.when(~F.col("_stored").eqNullSafe(F.col("questions").cast("bigint")), "stored dataset has another size")))
    return (want.join(have, "target", "left").join(sizes, "dataset_version", "left")
            .select("target", F.explode(problems).alias("problem")))
