"""Primary keys, foreign keys and the quality rules they imply, tested on the data."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of columns worth trying as a key.
KEY_PATTERNS = ("(?i)_id$", "(?i)_key$", "(?i)_code$")

WHOLE = ("tinyint", "smallint", "int", "bigint")
AS_TEXT = (*WHOLE, "string", "date", "timestamp", "boolean")


def pk_holds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows, distinct, nulls, holds: at least one row, all different, none with a null part.

    Rows are folded per key first, so copies of one key leave their task as one row.
    """
    null_part = F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).withColumn("null_part", null_part)
    return (per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"),
                        F.coalesce(F.sum(F.when(F.col("null_part"), F.col("n"))), F.lit(0)).alias("nulls"))
            .withColumn("holds", (F.col("rows") > 0) & (F.col("rows") == F.col("distinct")) & (F.col("nulls") == 0)))


def pk_tests(frames: Mapping[str, DataFrame], candidates: Sequence[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """One row per (table, candidate key) with the result of :func:`pk_holds`; all candidates of a table share one scan."""
    asked: dict[str, list[tuple[str, ...]]] = {}
    for table, columns in candidates:
        asked.setdefault(table, []).append(tuple(columns))
    return reduce(DataFrame.unionByName, [part for table, keys in asked.items() for part in _tests_of(frames[table], table, keys)])


def _tests_of(df: DataFrame, table: str, candidates: Sequence[tuple[str, ...]]) -> list[DataFrame]:
    types = dict(df.dtypes)
    # Texts tell values of these types apart as the values themselves do; a key of another type is tested by itself.
    together = [k for k in candidates if all(types[c] in AS_TEXT for c in k)]
    together = together if len(together) > 1 else []
    out = [pk_holds(df, k).select(F.lit(table).alias("table_name"), F.lit(", ".join(k)).alias("key_columns"), "*")
           for k in candidates if k not in together]
    if together:
        each = F.array(*[F.struct(F.lit(i).alias("at"), F.array(*[F.col(c).cast("string") for c in k]).alias("key")) for i, k in enumerate(together)])
        counted = (df.select(F.inline(each)).groupBy("at", "key").agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("null_part", F.exists("key", lambda x: x.isNull())))
        sums = [x for i in range(len(together)) for x in (
            F.coalesce(F.sum(F.when(F.col("at") == i, F.col("n"))), F.lit(0)).alias(f"rows{i}"), F.count_if(F.col("at") == i).alias(f"distinct{i}"),
            F.coalesce(F.sum(F.when((F.col("at") == i) & F.col("null_part"), F.col("n"))), F.lit(0)).alias(f"nulls{i}"))]
        rows = [F.struct(F.lit(table).alias("table_name"), F.lit(", ".join(k)).alias("key_columns"), F.col(f"rows{i}").alias("rows"),
                         F.col(f"distinct{i}").alias("distinct"), F.col(f"nulls{i}").alias("nulls")) for i, k in enumerate(together)]
        found = counted.agg(*sums).select(F.inline(F.array(*rows)))
        out.append(found.withColumn("holds", (F.col("rows") > 0) & (F.col("rows") == F.col("distinct")) & (F.col("nulls") == 0)))
    return out


def fk_tests(frames: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """child_table, child_column, parent_table, parent_column, orphans: :func:`fk_orphans` of every edge, from one scan of each table.

    A value is brought together once with the number of rows of every column that holds it; what a child column holds and a parent
    column does not are orphans. The counts are fixed-width sums, so copies of a value are folded before they travel. An edge between
    columns of different types is compared by itself, as a join of the two.
    """
    ends = sorted({(c, cc) for c, cc, _, _ in edges} | {(p, pc) for _, _, p, pc in edges})
    kind = {(table, column): "bigint" if (dtype := dict(frames[table].dtypes)[column]) in WHOLE else dtype for table, column in ends}
    out = [_edge_rows([e], [F.col("orphans")], fk_orphans(frames[e[0]], e[1], frames[e[2]], e[3])) for e in edges if kind[e[:2]] != kind[e[2:]]]
    for one in sorted(set(kind.values())):
        alike = [e for e in edges if kind[e[:2]] == kind[e[2:]] == one]
        if not alike:
            continue
        used = sorted({e[:2] for e in alike} | {e[2:] for e in alike})
        values = []
        for table in sorted({t for t, _ in used}):
            held = F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).cast(one).alias("value")) for i, (t, c) in enumerate(used) if t == table])
            values.append(frames[table].select(F.inline(held)).where(F.col("value").isNotNull()))
        per_value = reduce(DataFrame.unionByName, values).groupBy("value").agg(*[F.count_if(F.col("at") == i).alias(f"n{i}") for i in range(len(used))])
        counts = [F.coalesce(F.sum(F.when(F.col(f"n{used.index(e[2:])}") == 0, F.col(f"n{used.index(e[:2])}"))), F.lit(0)) for e in alike]
        totals = per_value.agg(*[c.alias(f"e{i}") for i, c in enumerate(counts)])
        out.append(_edge_rows(alike, [F.col(f"e{i}") for i in range(len(alike))], totals))
    return reduce(DataFrame.unionByName, out)


def _edge_rows(edges: Sequence[tuple[str, str, str, str]], counts: Sequence[Column], totals: DataFrame) -> DataFrame:
    names = ("child_table", "child_column", "parent_table", "parent_column")
    return totals.select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, e)], c.alias("orphans")) for e, c in zip(edges, counts)])))


def fk_orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """orphans: non-null child values without a parent row; child values are counted before they travel."""
    values = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    return (values.join(parent.select(F.col(parent_column).alias("_value")), "_value", "left_anti")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")))


def key_candidates(table: str, columns: Sequence[str], patterns: Sequence[str] = KEY_PATTERNS) -> list[str]:
    """Columns whose name looks like a key, those that contain the table's own name first."""
    stem = table.rsplit(".", 1)[-1].lower().rstrip("s")
    likely = [c for c in columns if any(re.search(p, c) for p in patterns)]
    return sorted(likely, key=lambda c: stem not in c.lower())


def possible_keys(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The candidates one cheap scan does not rule out: none is null, and whole numbers span at least as many values as
    there are rows. Only the counts and bounds come to the driver."""
    whole = [c for c in names if dict(df.dtypes)[c] in WHOLE]
    bounds = [x for c in whole for x in (F.min(c).cast("decimal(20,0)").alias(f"lo_{c}"), F.max(c).cast("decimal(20,0)").alias(f"hi_{c}"))]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n_{c}") for c in names], *bounds).first()

    def possible(c):
        if seen["rows"] == 0 or seen[f"n_{c}"] < seen["rows"]:
            return False
        return c not in whole or seen[f"hi_{c}"] - seen[f"lo_{c}"] + 1 >= seen["rows"]

    return [c for c in names if possible(c)]


def infer_key(df: DataFrame, table: str, patterns: Sequence[str] = KEY_PATTERNS) -> DataFrame:
    """table_name, key_column: the first candidate that holds; no row when none does.

    Candidates that a scan of counts and bounds rules out are not counted; the values of the others are, in one shuffle.
    """
    candidates = key_candidates(table, df.columns, patterns)
    names = possible_keys(df, candidates) if candidates else []
    if not names:
        return df.sparkSession.createDataFrame([], "table_name STRING, key_column STRING")
    pairs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("key_column"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(names)])
    counted = (df.select(F.inline(pairs)).groupBy("rank", "key_column", "value").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("rank", "key_column").agg(F.max("n").alias("most")))
    return (counted.where(F.col("most") == 1)
            .agg(F.min_by("key_column", "rank").alias("key_column"))
            .where(F.col("key_column").isNotNull())
            .select(F.lit(table).alias("table_name"), "key_column"))


def resolve_keys(existing: DataFrame, declared: DataFrame, inferred: DataFrame, profiled: DataFrame,
                 tests: DataFrame) -> DataFrame:
    """table_name, key_columns, source, verified.

    Existing wins over declared, declared over inferred. An inferred key that does not hold gives way to the profiled
    one. The four inputs have table_name, key_columns; ``tests`` is the output of :func:`pk_tests`.
    """
    ranked = None
    for rank, (source, rows) in enumerate((("existing", existing), ("declared", declared), ("inferred", inferred),
                                           ("profiled", profiled))):
        part = rows.select("table_name", "key_columns", F.lit(source).alias("source"), F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    tested = ranked.join(tests.select("table_name", "key_columns", "holds"), ["table_name", "key_columns"], "left")
    verified = F.coalesce("holds", F.lit(False))
    # An unverified inferred key ranks behind a profiled one; existing and declared keys keep their place.
    place = F.when((F.col("source") == "inferred") & ~verified, 4).otherwise(F.col("rank"))
    first = F.min_by(F.struct("key_columns", "source", verified.alias("verified")), place)
    return tested.groupBy("table_name").agg(first.alias("k")).select("table_name", "k.key_columns", "k.source", "k.verified")


def resolve_foreign_keys(references: DataFrame, keys: DataFrame, orphans: DataFrame) -> DataFrame:
    """Kept foreign keys with their orphans: only references to exactly the verified single key column of another table.

    ``references``: child_table, child_column, parent_table, parent_column. ``orphans``: child_table, child_column,
    parent_table, orphans.
    """
    parents = (keys.where("verified").select(F.col("table_name").alias("parent_table"),
                                             F.col("key_columns").alias("parent_column")))
    return (references.where(F.col("child_table") != F.col("parent_table"))
            .join(parents, ["parent_table", "parent_column"], "left_semi")
            .join(orphans, ["child_table", "child_column", "parent_table"])
            .select("child_table", "child_column", "parent_table", "parent_column", "orphans",
                    (F.col("orphans") == 0).alias("verified")))


def key_rules(primary: DataFrame, foreign: DataFrame) -> DataFrame:
    """Rules the keys imply: not null per key column and unique (critical), references (warning).

    ``primary``: table_name, key_columns (comma separated). ``foreign``: child_table, child_column, parent_table,
    parent_column.
    """
    def rules(df, table, kind, columns, to, severity, reason):
        return df.select(table.alias("table_name"), F.lit(kind).alias("rule_type"), columns.alias("column_name"),
                         to.alias("target"), F.lit(severity).alias("severity"), F.lit("key").alias("origin"),
                         F.lit(reason).alias("reason"))

    nothing = F.lit(None).cast("string")
    table, columns = F.col("table_name"), F.col("key_columns")
    parts = primary.withColumn("_part", F.explode(F.split("key_columns", ", ")))
    return (rules(parts, table, "not_null", F.col("_part"), nothing, "critical", "primary key column")
            .unionByName(rules(primary, table, "unique", columns, nothing, "critical", "primary key"))
            .unionByName(rules(foreign, F.col("child_table"), "references", F.col("child_column"),
                               F.concat_ws(".", "parent_table", "parent_column"), "warning", "foreign key")))
