"""Business questions as SQL table functions, their test, and the scan of query texts."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..specs import Parameter, Tool
from . import statements
from .salting import salted_join

# Fixed value: words a read-only statement may not use.
WRITES = r"(?i)\b(EXECUTE\s+IMMEDIATE|INSERT|UPDATE|DELETE|MERGE|DROP|ALTER|CREATE|GRANT|REVOKE|TRUNCATE)\b"


def _literal(p: Parameter, value) -> str:
    text = "NULL" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({text} AS {p.type})"


def create_tool(spark: SparkSession, tool: Tool) -> None:
    """Register the tool as a temporary table function over the session's views."""
    params = ", ".join(f"`{p.name}` {p.type}" + (f" DEFAULT {_literal(p, p.default)}" if p.has_default else "") for p in tool.parameters)
    columns = ", ".join(f"`{c}` {t}" for c, t in tool.columns.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {tool.name}({params}) RETURNS TABLE ({columns}) RETURN {tool.body}")


def call_tool(spark: SparkSession, tool: Tool, args: Mapping[str, object]) -> DataFrame:
    """Call by name; parameters left out take their defaults."""
    unknown = set(args) - {p.name for p in tool.parameters}
    if unknown:
        raise ValueError(f"{tool.name} has no parameter {sorted(unknown)}")
    named = ", ".join(f"`{p.name}` => {_literal(p, args[p.name])}" for p in tool.parameters if p.name in args)
    return spark.sql(f"SELECT * FROM {tool.name}({named})")


def outside_reads(queries: DataFrame, allowed: DataFrame) -> DataFrame:
    """query_id, object: objects a query (query_id, sql) reads that are not allowed (full_name), or that are not fully named.

    Read is what stands in the place of a relation, in any list, join or subquery, and every three-part name mentioned elsewhere. A log
    repeats its statements: each text is walked once, after a shuffle, so that the walk is spread whatever the files of the log are, and
    found again by its hash; a text that very many queries share is joined in shares.
    """
    asked = queries.select("query_id", "sql", F.sha2("sql", 256).alias("_text")).where("sql IS NOT NULL")
    read = statements.with_reads(asked.select("_text", "sql").distinct(), "sql")
    short = F.filter("relations", lambda n: F.size(F.split(n, r"\.")) < 3)
    reads = read.select("_text", F.explode(F.array_union("full_names", short)).alias("object"))
    outside = reads.join(allowed.select(F.col("full_name").alias("object")), "object", "left_anti")
    return salted_join(asked.select("query_id", "_text"), written(outside.select("_text", "object"), "reads"), "_text", F.col("query_id")).select("query_id", "object")


def statement_problems(queries: DataFrame) -> DataFrame:
    """query_id, problem: why a statement is not one safe read."""
    body = F.trim(F.regexp_replace("sql", r";\s*$", ""))
    problems = F.array_compact(F.array(
        F.when(~body.rlike(r"(?i)^(SELECT|WITH)\b"), "not a SELECT"),
        F.when(body.contains(";"), "more than one statement"),
        F.when(body.rlike(WRITES), "writes"),
        F.when(body.contains("${") | body.rlike(r"(?i)IDENTIFIER\("), "builds identifiers")))
    return queries.select("query_id", F.explode(problems).alias("problem"))


def unused_parameters(tool: Tool) -> list[str]:
    import re
    return [p.name for p in tool.parameters if not re.search(rf"\b{re.escape(tool.name)}\.{re.escape(p.name)}\b", tool.body)]
