"""Masks, row filters, grants and audit, resolved for a principal when the plan is built."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import principal_kind
from ..functions.masks import mask
from ..specs import MaskPolicy, RowPolicy
from .diff import side_by_side
from .salting import salted_join

GRANT = ("principal", "privilege", "securable_type", "securable")


# ---------------------------------------------------------------- masks and filters
def is_member(names: Sequence[str], principal: str, groups: Sequence[str]) -> bool:
    """Is the principal one of the names, itself or through a group?"""
    return principal in names or any(g in names for g in groups)


def masks_for(df: DataFrame, policies: Sequence[MaskPolicy], tags: Mapping[str, Mapping[str, str]]) -> dict[str, list[MaskPolicy]]:
    """column -> policies that mask it: by name, or by tag and type."""
    types = dict(df.dtypes)
    out: dict[str, list[MaskPolicy]] = {}
    for p in policies:
        if p.tag is None:
            if p.column not in types:
                raise ValueError(f"no column {p.column!r} to mask")
            if types[p.column] != p.type:
                raise ValueError(f"mask of {p.column} is for {p.type}, the column is {types[p.column]}")
            hit = [p.column]
        else:
            key, value = p.tag
            hit = [c for c in df.columns if tags.get(c, {}).get(key) == value]
            wrong = [c for c in hit if types[c] != p.type]
            if wrong:
                raise ValueError(f"tag {key}={value} matches {wrong}, which are not {p.type}")
        for c in hit:
            out.setdefault(c, []).append(p)
    return out


def secure_view(df: DataFrame, principal: str, groups: Sequence[str], masks: Sequence[MaskPolicy] = (),
                rows: RowPolicy | None = None, writers: Sequence[str] = (),
                tags: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """What one principal sees of a table: allowed rows, masked columns.

    Membership is decided here, so the plan holds plain filters and projections that reach the scan. Build the view
    anew for every principal; never cache or share it.
    """
    if rows is not None and not is_member((*rows.exempt, *writers), principal, groups):
        df = df.where(_visible(rows, principal, groups))
    chosen = masks_for(df, masks, tags or {})
    out = []
    for c in df.columns:
        policies = chosen.get(c, [])
        if len(policies) > 1:
            raise ValueError(f"column {c} is masked by more than one method")
        if not policies or is_member((*policies[0].exempt, *writers), principal, groups):
            out.append(F.col(c))
        else:
            out.append(mask(F.col(c), policies[0].kind, policies[0].type, policies[0].sql).alias(c))
    return df.select(*out)


def _visible(rows: RowPolicy, principal: str, groups: Sequence[str]) -> Column:
    if rows.condition is not None:
        return F.coalesce(F.expr(rows.condition), F.lit(False))
    values = [v for name, allowed in rows.by_group.items() if is_member((name,), principal, groups) for v in allowed]
    return F.col(rows.column).isin(*values) if values else F.lit(False)


def entitled_rows(df: DataFrame, column: str, entitlements: DataFrame, principal: str, groups: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` value is granted, in a table (member, value), to the principal or one of its groups."""
    mine = entitlements.where(F.col("member").isin(principal, *groups)).select(F.col("value").alias(column))
    return df.join(mine, column, "left_semi")


def mask_coverage(sensitive: DataFrame, methods: DataFrame) -> DataFrame:
    """Sensitive columns not masked by exactly one method: table_name, column_name, methods."""
    per_column = methods.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("methods"))
    return (sensitive.select("table_name", "column_name").distinct().join(per_column, ["table_name", "column_name"], "left")
            .withColumn("methods", F.coalesce("methods", F.lit(0).cast("bigint"))).where(F.col("methods") != 1))


# ---------------------------------------------------------------- grants
def expand_grants(members: DataFrame, scopes: DataFrame, catalog_access: bool = True) -> DataFrame:
    """Distinct grants: every principal of a role on every scope of the role.

    ``members``: role, principal. ``scopes``: role, access (read, execute), securable_type (SCHEMA, TABLE, FUNCTION),
    securable as ``catalog.schema[.object]``. Privileges are made distinct per role before they meet the principals.
    """
    privilege = F.when(F.col("access") == "read", "SELECT").otherwise("EXECUTE")
    path = F.split("securable", r"\.")
    catalog, schema = path[0], F.array_join(F.slice(path, 1, 2), ".")

    def one(privilege, kind, name):
        return F.struct(privilege.alias("privilege"), kind.alias("securable_type"), name.alias("securable"))

    each = [one(F.lit("USE SCHEMA"), F.lit("SCHEMA"), schema), one(privilege, F.col("securable_type"), F.col("securable"))]
    if catalog_access:
        each.append(one(F.lit("USE CATALOG"), F.lit("CATALOG"), catalog))
    per_role = scopes.select("role", F.inline(F.array(*each))).distinct()
    # A role most principals hold is split over tasks by principal.
    holders = members.select("role", "principal").distinct()
    return salted_join(holders, per_role, "role", F.col("principal")).select(*GRANT).distinct()


def grants_to_individuals(grants: DataFrame) -> DataFrame:
    return grants.where(principal_kind(F.col("principal")) == "user").select("principal").distinct()


def audit_grants(declared: DataFrame, live: DataFrame, removed: DataFrame) -> DataFrame:
    """Grants with a problem: not granted, removed but still granted, not declared, granted to an individual."""
    both = side_by_side(declared, live, GRANT, ())
    gone = removed.select(*GRANT).distinct().withColumn("_removed", F.lit(True))
    undeclared = (F.when(F.col("_removed"), "removed from the plan but still granted")
                  .when(F.col("securable_type") == "CATALOG", None)
                  .when(principal_kind(F.col("principal")) == "user", "granted to an individual").otherwise("not declared"))
    problem = F.when(F.col("n_right") == 0, "not granted").when(F.col("n_left") == 0, undeclared)
    return (both.join(gone, list(GRANT), "left").withColumn("problem", problem)
            .where(F.col("problem").isNotNull()).select(*GRANT, "problem"))


def consumer_exposure(live: DataFrame, consumers: DataFrame, schemas: DataFrame) -> DataFrame:
    """Live grants of consumers on bronze or silver schemas or objects in them. ``schemas``: schema_name, layer."""
    raw = schemas.where(F.col("layer").isin("bronze", "silver")).select("schema_name")
    held = live.where(F.col("securable_type") != "CATALOG").withColumn(
        "schema_name", F.array_join(F.slice(F.split("securable", r"\."), 1, 2), "."))
    return (held.join(raw, "schema_name", "left_semi").join(consumers.select("principal"), "principal", "left_semi")
            .select(*GRANT))


def to_remove(delivered: DataFrame, declared: DataFrame) -> DataFrame:
    """Grants any certified plan delivered that are not declared now."""
    return delivered.select(*GRANT).distinct().join(declared, list(GRANT), "left_anti")


# ---------------------------------------------------------------- audit
def audit_view(events: DataFrame, schemas: Sequence[str], days: int, now: Column) -> DataFrame:
    """Events of the last ``days`` on an object that is one of the schemas or lies in one.

    ``events``: event_time, event_date, user_identity.email, action_name, request_params map, response.status_code.
    """
    name = F.col("request_params")["full_name_arg"]
    inside = name.isin(*schemas)
    for s in schemas:
        inside = inside | name.startswith(f"{s}.")
    return (events.where((F.col("event_date") >= F.date_sub(F.to_date(now), days)) & inside)
            .select("event_time", "event_date", F.col("user_identity.email").alias("principal"), "action_name",
                    name.alias("object_full_name"), F.col("response.status_code").alias("status_code")))


def unexempt_writers(lineage: DataFrame, masked: DataFrame, exempt: DataFrame, days: int, now: Column) -> DataFrame:
    """Who wrote tables from masked tables lately without being exempt from the masks.

    ``lineage``: source_table, target_table, created_by, event_date.
    """
    recent = lineage.where((F.col("event_date") >= F.date_sub(F.to_date(now), days)) & F.col("target_table").isNotNull())
    return (recent.join(masked.select(F.col("table_name").alias("source_table")), "source_table", "left_semi")
            .join(exempt.select(F.col("principal").alias("created_by")), "created_by", "left_anti")
            .select("source_table", "target_table", "created_by").distinct())


def scan_secrets(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text holds secrets, with how many."""
    found = F.regexp_count(F.col(text), F.lit(pattern))
    return docs.withColumn("secrets", found).where(F.col("secrets") > 0)
