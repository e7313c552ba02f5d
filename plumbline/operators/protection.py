"""Masks and row filters as SQL functions, and views that decide at reading time what their reader sees."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from ..functions.masks import KINDS, STRING_ONLY
from ..specs import MaskPolicy, RowPolicy
from .governance import masks_for

CURRENT_USER = "current_user()"


def text_of(value) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mask_sql(kind: str | None, dtype: str, sql: str | None = None) -> str:
    """What a mask makes of the function's parameter ``value``; a custom expression names it so, too."""
    if sql is not None:
        return sql
    if kind not in KINDS:
        raise ValueError(f"unknown mask {kind!r}")
    if kind in STRING_ONLY and dtype != "string":
        raise ValueError(f"{kind} masks strings, not {dtype}")
    if kind == "null" or (kind == "redact" and dtype != "string"):
        return f"CAST(NULL AS {dtype})"
    return {"redact": "'***'", "hash": "sha2(value, 256)", "email": "regexp_replace(value, '^[^@]+', '***')",
            "last4": "concat('***', right(value, 4))"}[kind]


def _among(names: Sequence[str], view: str) -> str:
    """Is the reader, or a group of the reader, one of the names?"""
    return f"arrays_overlap({name_of(view + '_reader')}(), array({', '.join(map(text_of, names))}))" if names else "false"


def protect(spark: SparkSession, view: str, source: str, members: str, masks: Sequence[MaskPolicy] = (), rows: RowPolicy | None = None,
            writers: Sequence[str] = (), tags: Mapping[str, Mapping[str, str]] | None = None, identity: str = CURRENT_USER) -> None:
    """Creates the temporary view ``view`` over the relation ``source``: allowed rows, masked columns, decided for whoever reads it.

    ``members`` is a relation of principal, group_name. The reader is what ``identity`` gives, Spark's own user unless a service that reads
    for others names its own expression. One scalar function per mask and one for the rows, ``<view>_mask_<column>`` and ``<view>_rows``, ask
    ``<view>_reader``, the reader and its groups, a subquery that runs once per statement. An unknown reader has no groups: it
    sees masked columns and no filtered row. Policies that do not fit the columns are refused as :func:`governance.secure_view` does.
    """
    df = spark.table(source)
    types = dict(df.dtypes)
    chosen = masks_for(df, masks, tags or {})
    twice = [c for c, policies in chosen.items() if len(policies) > 1]
    if twice:
        raise ValueError(f"column {twice[0]} is masked by more than one method")
    if rows is not None and rows.condition is None and rows.column not in types:
        raise ValueError(f"no column {rows.column!r} to filter by")

    def function(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name_of(name)}({parameters}) RETURNS {returns} RETURN {body}")

    function(f"{view}_reader", "", "ARRAY<STRING>",
             f"(SELECT array_append(collect_set(group_name), {identity}) FROM {members} WHERE principal = {identity})")
    shown = []
    for c in df.columns:
        if c not in chosen:
            shown.append(name_of(c))
            continue
        policy, name = chosen[c][0], f"{view}_mask_{c}"
        body = f"CASE WHEN {_among((*policy.exempt, *writers), view)} THEN value ELSE {mask_sql(policy.kind, policy.type, policy.sql)} END"
        function(name, f"value {types[c]}", types[c], body)
        shown.append(f"{name_of(name)}({name_of(c)}) AS {name_of(c)}")
    seen = ""
    if rows is not None:
        exempt = _among((*rows.exempt, *writers), view)
        if rows.condition is not None:
            seen = f" WHERE {exempt} OR coalesce({rows.condition}, false)"
        else:
            allowed = [f"({_among((group,), view)} AND value IN ({', '.join(map(text_of, values))}))" for group, values in rows.by_group.items() if values]
            function(f"{view}_rows", f"value {types[rows.column]}", "BOOLEAN", " OR ".join([exempt, *allowed]))
            seen = f" WHERE {name_of(view + '_rows')}({name_of(rows.column)})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name_of(view)} AS SELECT {', '.join(shown)} FROM {source}{seen}")
