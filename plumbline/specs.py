"""Declarations (rules, metric views, tools, policies) and the result tables as DDL."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

# ---------------------------------------------------------------- quality rules
ROW_RULES = ("not_null", "accepted_values", "range", "expression")
RULE_TYPES = (*ROW_RULES, "unique", "references", "row_count")


@dataclass(frozen=True)
class Rule:
    """One quality rule of one table. ``to`` is ``table.column`` for references."""

    table: str
    type: str
    columns: tuple[str, ...] = ()
    name: str | None = None
    values: tuple = ()
    min: object = None
    max: object = None
    expression: str | None = None
    to: str | None = None
    severity: str = "warning"
    tolerance: str | None = None
    description: str | None = None
    origin: str = "customer"

    def __post_init__(self):
        if self.type not in RULE_TYPES:
            raise ValueError(f"unknown rule type {self.type!r}")

    @property
    def id(self) -> str:
        given = self.name or "_".join((self.type, *self.columns))
        return f"{self.table}.{re.sub(r'[^a-z0-9]+', '_', given.lower()).strip('_')}"

    @property
    def column_text(self) -> str | None:
        return ", ".join(self.columns) or None

    @property
    def allowance(self) -> Decimal:
        """Exact share of rows that may fail; text in, so 0.29 stays 0.29."""
        return Decimal(self.tolerance or "0")

    @property
    def summary(self) -> str:
        if self.description:
            return self.description
        what = self.column_text
        if self.type == "row_count":
            return f"row count {_bounds(self.min, self.max)}"
        return {"not_null": f"{what} is never null",
                "unique": f"{what} is unique",
                "accepted_values": f"{what} is one of {', '.join(map(str, self.values))}",
                "range": f"{what} {_bounds(self.min, self.max)}",
                "expression": f"every row satisfies {self.expression}",
                "references": f"{what} exists in {self.to}"}[self.type]


def _bounds(low, high) -> str:
    return " and ".join(t for t in (f">= {low}" if low is not None else "", f"<= {high}" if high is not None else "") if t)


# ---------------------------------------------------------------- metric views
@dataclass(frozen=True)
class Field:
    name: str
    expr: str
    display_name: str | None = None
    comment: str | None = None
    synonyms: tuple[str, ...] = ()
    format: str | None = None
    temporal: bool = False


@dataclass(frozen=True)
class Join:
    """Many-to-one join from the source; ``on`` maps source columns to columns of the joined table."""

    name: str
    source: str
    on: Mapping[str, str]


@dataclass(frozen=True)
class MetricView:
    name: str
    source: str
    dimensions: Sequence[Field]
    measures: Sequence[Field]
    joins: Sequence[Join] = ()
    filter: str | None = None
    comment: str | None = None

    def dimension(self, name: str) -> Field:
        return _named(self.dimensions, name, f"{self.name} has no dimension")

    def measure(self, name: str) -> Field:
        return _named(self.measures, name, f"{self.name} has no measure")


def _named(fields, name, problem):
    found = [f for f in fields if f.name == name]
    if not found:
        raise ValueError(f"{problem} {name!r}")
    return found[0]


@dataclass(frozen=True)
class Tile:
    kind: str
    measures: tuple[str, ...]
    dimension: str | None = None
    series: str | None = None


# ---------------------------------------------------------------- tools and policies
@dataclass(frozen=True)
class Parameter:
    name: str
    type: str
    default: object = None
    has_default: bool = False


@dataclass(frozen=True)
class Tool:
    """A table function: typed parameters and one SELECT that names them as ``tool.parameter``."""

    name: str
    parameters: Sequence[Parameter]
    columns: Mapping[str, str]
    body: str


@dataclass(frozen=True)
class MaskPolicy:
    """Masks one named column, or every column tagged ``tag = value`` whose type is ``type``."""

    kind: str
    column: str | None = None
    tag: tuple[str, str] | None = None
    type: str = "string"
    exempt: tuple[str, ...] = ()
    sql: str | None = None


@dataclass(frozen=True)
class RowPolicy:
    """Rows a principal may see: by group membership on one column, or a condition."""

    column: str | None = None
    by_group: Mapping[str, tuple] = field(default_factory=dict)
    condition: str | None = None
    exempt: tuple[str, ...] = ()


# ---------------------------------------------------------------- result tables
INGESTION_LOG = "run_id STRING, source STRING, source_file STRING, rows_loaded BIGINT, loaded_at TIMESTAMP"
DQ_RUNS = "check_run_id STRING, started_at TIMESTAMP, finished_at TIMESTAMP"
DQ_RESULTS = ("check_run_id STRING, checked_at TIMESTAMP, rule_id STRING, table_name STRING, rule_type STRING, "
    "column_name STRING, severity STRING, description STRING, total_rows BIGINT, failed_rows BIGINT, "
    "passed BOOLEAN")
DQ_QUARANTINE = ("check_run_id STRING, checked_at TIMESTAMP, rule_id STRING, table_name STRING, row_key STRING, "
    "row_json STRING")
DQ_FRESHNESS = ("check_run_id STRING, checked_at TIMESTAMP, table_name STRING, layer STRING, "
    "last_data_change TIMESTAMP, age_hours DOUBLE, max_hours DOUBLE, stale BOOLEAN, error STRING")
DQ_RULES = ("rule_id STRING, table_name STRING, rule_type STRING, column_name STRING, severity STRING, "
    "tolerance DOUBLE, description STRING, origin STRING, definition STRING")
ASSET_INVENTORY = ("layer STRING, full_name STRING, kind STRING, column_count INT, row_count BIGINT, "
    "last_updated TIMESTAMP, has_comment BOOLEAN, readable BOOLEAN, error STRING")
