"""What a statement reads, from its tokens: strings, comments, quoted names and parentheses are told apart before names are looked at.

A statement becomes an array of tokens, a dotted name being one of them, and is walked once, in column functions. The walk keeps a
letter per open parenthesis: q for the statement, e for an expression, p for a parenthesis where a relation is expected, s after
SELECT, f inside a FROM list, w after it. A name in the place of a relation is a relation, be it after FROM, JOIN or a comma of
the list, in a subquery at any depth; names of the statement's own WITH, table functions and the FROM of EXTRACT and the like are none.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of SQL tokens, and the words the walk knows.
PART = r"(?:`[^`]*`|[A-Za-z_]\w*(?:-\w+)*)"
TOKEN = (r"--[^\n]*|/\*(?s:.*?)\*/|'(?:[^'\\]|\\(?s:.)|'')*'|" + r'"(?:[^"\\]|\\(?s:.))*"' + rf"|{PART}(?:\s*\.\s*{PART})*|\d[\w.]*|\S")
COMMENT = r"^(?:--|/\*)"
NAME = r"^[`A-Za-z_]"
ENDS_LIST = ("WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "MINUS", "WINDOW", "QUALIFY", "SORT", "CLUSTER", "DISTRIBUTE")
NO_RELATION = ("SELECT", "FROM", "JOIN", "VALUES", "LATERAL", "ONLY", "WITH", "TABLE", *ENDS_LIST)

# Words of expressions that are no columns.
WORDS = ("ALL", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "CURRENT", "CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_USER", "DATE", "DAY", "DESC",
         "DISTINCT", "DIV", "ELSE", "END", "ESCAPE", "EXISTS", "FALSE", "FILTER", "FIRST", "FOLLOWING", "FROM", "HOUR", "ILIKE", "IN", "INTERVAL", "IS", "LAST", "LIKE",
         "MINUTE", "MONTH", "NOT", "NULL", "NULLS", "OR", "ORDER", "OVER", "PARTITION", "PRECEDING", "QUARTER", "RANGE", "RLIKE", "ROW", "ROWS", "SECOND", "THEN",
         "TIMESTAMP", "TRUE", "UNBOUNDED", "WEEK", "WHEN", "WHERE", "WITHIN", "YEAR")


def tokens(sql: Column) -> Column:
    """The tokens of a statement, comments aside."""
    return F.filter(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(COMMENT))


def plain(name: Column) -> Column:
    return F.regexp_replace(name, r"[`\s]", "")


def parts_of(name: Column) -> Column:
    return F.regexp_count(name, F.lit(PART))


def _own_names(found: Column) -> Column:
    """Names that WITH gives, in lower case, with or without a list of columns."""
    def own(t: Column, i: Column) -> Column:
        before, after, then = F.upper(F.get(found, i - 1)), F.upper(F.get(found, i + 1)), F.get(found, i + 2)
        rest = F.slice(found, i + 2, F.size(found))
        closed = F.array_position(rest, F.lit(")")).cast("int")
        listed = (F.when((after == "AS") & (then == "("), True)
                  .when(after == "(", (F.upper(F.get(rest, closed)) == "AS") & (F.get(rest, closed + 1) == "(")))
        return F.when(before.isin("WITH", "RECURSIVE", ","), F.when(listed, F.lower(plain(t))))

    return F.filter(F.transform(found, own), lambda t: t.isNotNull())


def _walk(found: Column) -> Column:
    start = F.struct(F.lit("q").alias("open"), F.lit(False).alias("expects"), F.lit("").alias("before"), F.array().cast("array<string>").alias("names"))
    steps = F.transform(found, lambda t, i: F.struct(t.alias("t"), F.upper(t).alias("word"), F.get(found, i + 1).alias("next")))

    def step(state: Column, x: Column) -> Column:
        word, open_, expects = x["word"], state["open"], state["expects"]
        top, below = F.right(open_, F.lit(1)), F.left(open_, F.length(open_) - 1)
        opens_list = (word == "FROM") & top.isin("q", "s") & (state["before"] != "DISTINCT")
        in_list = top.isin("f", "p")
        names_relation = expects & x["t"].rlike(NAME) & ~word.isin(*NO_RELATION)
        now = (F.when(word == "(", F.concat(open_, F.when(expects, "p").otherwise("e")))
               .when((word == ")") & (F.length(open_) > 1), below)
               .when(word == "SELECT", F.concat(below, F.lit("s")))
               .when(opens_list, F.concat(below, F.lit("f")))
               .when(word.isin(*ENDS_LIST) & in_list, F.concat(below, F.lit("w")))
               .otherwise(open_))
        will = opens_list | (word.isin("JOIN", ",") & in_list) | (expects & word.isin("(", "LATERAL", "ONLY", "TABLE"))
        names = F.when(names_relation & ~F.coalesce(x["next"] == "(", F.lit(False)), F.array_append(state["names"], x["t"])).otherwise(state["names"])
        return F.struct(now.alias("open"), will.alias("expects"), word.alias("before"), names.alias("names"))

    return F.aggregate(steps, start, step, lambda state: state["names"])


def with_reads(queries: DataFrame, sql: str) -> DataFrame:
    """Adds to every statement ``relations``, the distinct names, without quotes, that stand where a relation does, and ``full_names``, the
    distinct three-part names mentioned anywhere, of longer names the first three parts.

    Single names that the statement's WITH gives are no relations. Tokens are found once, as a column of their own.
    """
    rows = queries.withColumn("_tokens", tokens(F.col(sql)))
    rows = rows.withColumns({"_own": _own_names(F.col("_tokens")), "_named": _walk(F.col("_tokens"))})
    named = F.filter("_named", lambda n: ~((parts_of(n) == 1) & F.array_contains("_own", F.lower(plain(n)))))
    long = F.filter("_tokens", lambda t: t.rlike(NAME) & (parts_of(t) >= 3))
    first = F.transform(long, lambda t: plain(F.regexp_extract(t, rf"^{PART}(?:\s*\.\s*{PART}){{2}}", 0)))
    return (rows.withColumns({"relations": F.array_distinct(F.transform(named, plain)), "full_names": F.array_distinct(first)})
            .drop("_tokens", "_own", "_named"))


def with_columns_named(expressions: DataFrame, expr: str) -> DataFrame:
    """Adds ``column_names`` to every expression: the distinct names in it, in lower case and without quotes, that are no functions, types of
    a cast, words of SQL, strings or numbers. A quoted name is never a word of SQL; a null expression names nothing."""
    rows = expressions.withColumn("_tokens", F.coalesce(tokens(F.col(expr)), F.array().cast("array<string>")))
    named = F.transform("_tokens", lambda t, i: F.when(
        t.rlike(NAME) & ~F.upper(t).isin(*WORDS) & ~F.coalesce(F.get("_tokens", i + 1) == "(", F.lit(False))
        & ~F.coalesce(F.upper(F.get("_tokens", i - 1)) == "AS", F.lit(False)), F.lower(plain(t))))
    return rows.withColumn("column_names", F.array_distinct(F.array_compact(named))).drop("_tokens")
