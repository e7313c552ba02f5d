"""Metric views: a definition compiled to joins, a filter and one aggregate; reconciliation with independent SQL; tiles."""
from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compare import close_relative, relative_difference
from ..functions.text import squeeze
from ..session import few_or_merged, written
from ..specs import MetricView, Tile
from . import statements
from .diff import digest, is_fixed, side_by_side, with_text

MIN_COMMENT = 20


# ---------------------------------------------------------------- definition
def view_problems(view: MetricView, sources: Mapping[str, DataFrame], bronze: Sequence[str] = ()) -> list[str]:
    """Why a definition cannot be used; analysis only, nothing runs."""
    out = []
    names = [f.name for f in (*view.dimensions, *view.measures)]
    out += [f"field {n} is defined twice" for n in sorted({n for n in names if names.count(n) > 1})]
    joins = [j.name for j in view.joins]
    out += [f"join {n} is defined twice" for n in sorted({n for n in joins if joins.count(n) > 1})]
    for s in [view.source, *[j.source for j in view.joins]]:
        if s not in sources:
            out.append(f"source {s} is unknown")
        elif s in bronze:
            out.append(f"source {s} is bronze")
    if not out:
        try:
            query(view, sources, [d.name for d in view.dimensions], [m.name for m in view.measures]).schema
        except Exception as e:  # the analyser's own words say what is wrong
            out.append(str(e).splitlines()[0])
    return out


def definition_problems(views: DataFrame, joins: DataFrame, fields: DataFrame, references: DataFrame, columns: DataFrame,
                        schema: str) -> DataFrame:
    """view, object, problem: why definitions kept as tables cannot be used, one row per finding; any number of views is one plan.

    ``views``: view, source. ``joins``: view, name, source. ``fields``: view, kind (dimension, measure), name, expr.
    ``references``: view, measure, sql, by (array), returns (array of the statement's columns). ``columns``: source, layer, column of every table
    that may be used. ``schema`` is where metric views live. A name in an expression is a column of the view's source or of a joined one,
    or follows the name of a join (or ``source``). Null expressions and statements are findings; repeated definitions count as defined twice.
    """
    def finding(df, thing, problem):
        return df.select("view", thing.alias("object"), problem.alias("problem"))

    def twice(df, what):
        many = df.groupBy("view", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return finding(many, F.col("name"), F.lit(f"{what} is defined twice"))

    tables = columns.groupBy("source").agg(F.max(F.col("layer") == "bronze").alias("_bronze"))
    used = (views.select("view", "source", F.lit("source").alias("name")).unionByName(joins.select("view", "source", "name")))
    asked = used.select("view", "source").distinct().join(tables, "source", "left")
    about = F.when(F.col("_bronze").isNull(), "source is unknown").when(F.col("_bronze"), "source is bronze")
    found = [twice(fields, "field"), twice(joins, "join"), finding(asked.where(about.isNotNull()), F.col("source"), about),
             finding(views.groupBy("view").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), F.col("view"), F.lit("view is defined twice")),
             finding(fields.where(F.coalesce(F.trim("expr"), F.lit("")) == ""), F.col("name"), F.lit("no expression"))]
    # Names are told from strings, functions and words of SQL by tokens, then met with what the view can see.
    # A text that many definitions share is read once; what is as long as the definitions is merged.
    texts = written(statements.with_columns_named(fields.select("expr").where("expr IS NOT NULL").distinct(), "expr"), "texts")
    named = (fields.select("view", F.col("name").alias("field"), "expr").join(few_or_merged(texts), "expr")
             .select("view", "field", F.explode("column_names").alias("_name")))
    seen = used.join(few_or_merged(columns.select("source", F.lower("column").alias("_column"))), "source")
    visible = seen.select("view", F.explode(F.array(F.col("_column"), F.concat_ws(".", F.lower("name"), "_column"))).alias("_name")).distinct()
    unresolved = named.join(visible.hint("merge"), ["view", "_name"], "left_anti").distinct()
    found.append(finding(unresolved, F.col("field"), F.concat(F.lit("unknown name "), "_name")))
    known = fields.where("kind = 'dimension'").select("view", F.col("name").alias("_by"))
    asked_by = references.select("view", "measure", F.explode(F.array_distinct("by")).alias("_by"))
    found.append(finding(asked_by.join(known.hint("merge"), ["view", "_by"], "left_anti"), F.col("measure"), F.concat("_by", F.lit(" is not a dimension"))))
    known_measures = fields.where("kind = 'measure'").select("view", F.col("name").alias("measure"))
    found.append(finding(references.join(known_measures.hint("merge"), ["view", "measure"], "left_anti"), F.col("measure"), F.lit("reference of no measure")))
    missing = F.array_except(F.concat(F.array(F.lit("value")), F.coalesce("by", F.array().cast("array<string>"))), F.coalesce("returns", F.array().cast("array<string>")))
    found.append(finding(references.select("view", "measure", F.explode(missing).alias("_c")), F.col("measure"), F.concat(F.lit("returns no column "), "_c")))
    reads = statements.with_reads(references.select("sql").where("sql IS NOT NULL").distinct(), "sql")
    own = F.exists(F.array_union("relations", "full_names"), lambda n: F.exists(F.slice(F.split(F.lower(n), r"\."), 1, F.size(F.split(n, r"\.")) - 1),
                                                                                lambda part: part == schema.lower()))
    dependent = few_or_merged(written(reads.where(own).select("sql"), "dependent"))
    found.append(finding(references.select("view", "measure", "sql").join(dependent, "sql"), F.col("measure"), F.lit(f"reads {schema}; it must be independent")))
    found.append(finding(references.where(F.coalesce(F.trim("sql"), F.lit("")) == ""), F.col("measure"), F.lit("no statement")))
    return reduce(DataFrame.unionByName, found)


def reference_problems(spark: SparkSession, view: MetricView, sql: str, by: Sequence[str], own_schema: str | None = None) -> list[str]:
    """Why a reference query cannot check a measure: unknown dimensions, missing columns, reading the metric schema."""
    known = {d.name for d in view.dimensions}
    out = [f"{b} is not a dimension" for b in by if b not in known]
    if own_schema and re.search(rf"\b{re.escape(own_schema)}\s*\.", sql, re.I):
        return [*out, f"reads {own_schema}; it must be independent"]
    try:
        columns = spark.sql(sql).columns
    except Exception as e:
        return [*out, str(e).splitlines()[0]]
    return out + [f"returns no column {c}" for c in ("value", *by) if c not in columns]


def field_rows(spark: SparkSession, views: Sequence[MetricView]) -> DataFrame:
    """One row per field of the views: view, kind, name and its texts."""
    rows = [(v.name, kind, f.name, f.expr, f.display_name, f.comment, list(f.synonyms), f.format)
            for v in views for kind, fields in (("dimension", v.dimensions), ("measure", v.measures)) for f in fields]
    return spark.createDataFrame(rows, "view STRING, kind STRING, name STRING, expr STRING, display_name STRING, "
                                       "comment STRING, synonyms ARRAY<STRING>, format STRING")


def field_gaps(fields: DataFrame) -> DataFrame:
    """view, name, gaps: which of display_name, comment, synonyms (and format of a measure) a field lacks."""
    def empty(c):
        return F.coalesce(F.trim(c) == "", F.lit(True))

    gaps = F.array_compact(F.array(
        F.when(empty("display_name"), "display_name"), F.when(empty("comment"), "comment"),
        F.when(F.coalesce(F.size("synonyms"), F.lit(0)) < 1, "synonyms"),
        F.when((F.col("kind") == "measure") & empty("format"), "format")))
    return fields.withColumn("gaps", gaps).where(F.size("gaps") > 0).select("view", "kind", "name", "gaps")


def thin_comments(views: DataFrame) -> DataFrame:
    """Views whose comment is missing or shorter than the minimum."""
    text = F.coalesce(F.trim("comment"), F.lit(""))
    return views.where(F.length(text) < MIN_COMMENT).select(
        "view", F.when(text == "", "no description").otherwise("too short").alias("problem"))


def definition_diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("view", "kind", "name"),
                    texts: Sequence[str] = ("expr", "comment"), exact: Sequence[str] = ("display_name", "format")) -> DataFrame:
    """One row per field property that differs: keys, property, left, right. White space in the texts does not count,
    an empty value equals a missing one."""
    def properties(df):
        values = [*[F.struct(F.lit(c).alias("property"), F.nullif(squeeze(F.col(c)), F.lit("")).alias("value")) for c in texts],
                  *[F.struct(F.lit(c).alias("property"), F.nullif(F.col(c), F.lit("")).alias("value")) for c in exact]]
        return df.select(*keys, F.inline(F.array(*values)))

    by, old, new = [*keys, "property"], properties(left), properties(right)
    found = (side_by_side(old, new, by, ["value"]).where(~F.col("left.value").eqNullSafe(F.col("right.value")))
             .select(*by, F.col("left.value").alias("_old"), F.col("right.value").alias("_new")))
    found = with_text(with_text(found, old, by, "value", "_old", "left"), new, by, "value", "_new", "right")
    return found.select(*by, "left", "right")


# ---------------------------------------------------------------- query
class Dimensions:
    """Dimension columns by name, remembering which were asked for."""

    def __init__(self, view: MetricView):
        self.view, self.used = view, []

    def __getitem__(self, name: str) -> Column:
        found = self.view.dimension(name)
        self.used.append(found.expr)
        return F.expr(found.expr)


def query(view: MetricView, sources: Mapping[str, DataFrame], dimensions: Sequence[str] = (),
          measures: Sequence[str] = (), where: Callable[[Dimensions], Column] | None = None) -> DataFrame:
    """Measures by dimensions, for rows where ``where(dimensions)`` holds.

    Plain column names mean the source; a joined table is a struct named after its join. It is read only when a field
    in use names it, and only the fields named: joins are many-to-one and left, so leaving one out changes no row.
    """
    dims = [view.dimension(d) for d in dimensions]
    vals = [view.measure(m) for m in measures]
    asked = Dimensions(view)
    condition = where(asked) if where else None
    used = " ".join([*[f.expr for f in (*dims, *vals)], *asked.used, view.filter or ""])
    df = sources[view.source]
    for j in view.joins:
        fields = sorted(set(re.findall(rf"\b{re.escape(j.name)}\.(\w+)", used)))
        if fields:
            keys = {b: f"_{j.name}_{b}" for b in j.on.values()}
            side = sources[j.source].select(F.struct(*fields).alias(j.name), *[F.col(b).alias(k) for b, k in keys.items()])
            on = [F.col(a) == F.col(keys[b]) for a, b in j.on.items()]
            df = df.join(side, reduce(lambda x, y: x & y, on), "left").drop(*keys.values())
    if view.filter:
        df = df.where(view.filter)
    if condition is not None:
        df = df.where(condition)
    groups = [F.expr(d.expr).alias(d.name) for d in dims]
    aggs = [F.expr(m.expr).alias(m.name) for m in vals]
    return df.groupBy(*groups).agg(*aggs) if aggs else df.select(*groups).distinct()


# ---------------------------------------------------------------- reconciliation
def reconcile(view_rows: DataFrame, reference: DataFrame, by: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per group of either side: by, view_value, reference_value, problem (null when they agree), difference.

    Both sides have the ``by`` columns and ``value``. Groups are null-safe: a null group is not an empty one.
    """
    def numbers(df):
        return df.select(*by, F.col("value").cast("double").alias("value"))

    both = side_by_side(numbers(view_rows), numbers(reference), by, ["value"])
    a, b = F.col("left.value"), F.col("right.value")
    problem = (F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), "group only on one side")
               .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "group repeated")
               .when(~close_relative(a, b, tolerance), "values differ"))
    return both.select(*by, a.alias("view_value"), b.alias("reference_value"), problem.alias("problem"),
                       relative_difference(a, b).alias("difference"), (F.col("n_right") > 0).alias("in_reference"))


def reconcile_verdict(compared: DataFrame) -> DataFrame:
    """One row: groups of the reference, mismatches, worst relative difference, ok."""
    return compared.agg(
        F.count_if(F.col("in_reference")).alias("groups"),
        F.count("problem").alias("mismatches"),
        F.coalesce(F.max("difference"), F.lit(0.0)).alias("worst_difference"),
        (F.count("problem") == 0).alias("ok"))


def compare_keyed(got: DataFrame, want: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, column, got, want, problem: a tool result against independent rows, numbers to the cent.

    Only columns of ``want`` are compared. Text is compared as text.
    """
    from ..functions.compare import close_to_truth
    got, want = got.select(*keys, *values), want.select(*keys, *values)
    hashed = [v for v in values if not (is_fixed(got, v) and is_fixed(want, v))]
    got, want = (df.withColumns({v: F.col(v).cast("string") for v in hashed}) if hashed else df for df in (got, want))
    both = side_by_side(got, want, keys, values)
    types, nothing = dict(want.dtypes), F.lit(None).cast("string")
    problem_of = []
    for v in values:
        a, b = F.col(f"left.{v}"), F.col(f"right.{v}")
        text = v in hashed or types[v] in ("boolean", "date") or types[v].startswith("timestamp")
        same = a.eqNullSafe(b) if text else close_to_truth(a.cast("double"), b.cast("double"))
        shown = [nothing, nothing] if v in hashed else [a.cast("string"), b.cast("string")]
        marks = [a, b] if v in hashed else [F.lit(None).cast("bigint")] * 2
        problem_of.append(F.struct(F.lit(v).alias("column"), shown[0].alias("got"), shown[1].alias("want"), F.when(~same, "differs").alias("problem"),
                                   marks[0].alias("_got"), marks[1].alias("_want")))
    missing = (F.when(F.col("n_left") == 0, "missing from the result").when(F.col("n_right") == 0, "not in the matching rows")
               .when((F.col("n_left") > 1) | (F.col("n_right") > 1), "group repeated"))
    none = F.lit(None).cast("bigint")
    whole = F.array(F.struct(nothing.alias("column"), nothing.alias("got"), nothing.alias("want"), missing.alias("problem"), none.alias("_got"), none.alias("_want")))
    found = (both.select(*keys, F.inline(F.when(missing.isNotNull(), whole).otherwise(F.array(*problem_of))))
             .where(F.col("problem").isNotNull()))
    if hashed:  # the texts of the values that differ
        by = [*keys, "column"]
        for side, df in (("got", got), ("want", want)):
            texts = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("column"), F.col(v).alias("text"), digest(F.col(v)).alias("_mark"))
                                                             for v in hashed])))
            texts = texts.where(F.col("_mark").isNotNull()).distinct().toDF(*[f"_key_{k}" for k in by], "_text", "_mark")
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in by], F.col(f"_{side}") == F.col("_mark"))
            found = found.join(texts, same, "left").withColumn(side, F.coalesce(side, "_text")).drop(*texts.columns)
    return found.drop("_got", "_want")


def shape_problems(got: DataFrame, columns: Sequence[str] = (), min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    """One row: rows of a result, the columns it lacks, and whether its size is within bounds."""
    lacking = [c for c in columns if c not in got.columns]
    ok = F.lit(not lacking)
    if min_rows is not None:
        ok = ok & (F.col("rows") >= min_rows)
    if max_rows is not None:
        ok = ok & (F.col("rows") <= max_rows)
    return (got.agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("lacking", F.array(*[F.lit(c) for c in lacking]).cast("array<string>")).withColumn("ok", ok))


# ---------------------------------------------------------------- tiles
@dataclass(frozen=True)
class Shape:
    """What a kind of tile shows: how many measures, whether along a dimension, of time, and whether split into series."""

    measures: range
    along: bool
    of_time: bool = False
    series: bool = False


MANY = 1_000
SHAPES = {"counter": Shape(range(1, 2), along=False), "line": Shape(range(1, 4), along=True, of_time=True, series=True),
          "bar": Shape(range(1, 4), along=True, series=True), "table": Shape(range(0, MANY), along=True)}


def tile_problem(tile: Tile, view: MetricView) -> str | None:
    """How a tile departs from the shape of its kind, or from the fields of its view; null when it can be drawn."""
    shape, wrong = SHAPES[tile.kind], []
    fields = {d.name: d for d in view.dimensions} | {m.name: m for m in view.measures}
    shown = {"measure": tile.measures, "dimension": (tile.dimension,) if tile.dimension else (), "series": (tile.series,) if tile.series else ()}
    wrong += [f"{view.name} has no {part} {name}" for part, names in shown.items() for name in names
              if fields.get(name) not in (view.measures if part == "measure" else view.dimensions)]
    room = shape.measures if not tile.series else range(shape.measures.start, 2)
    if len(tile.measures) not in room:
        wrong.append(f"a {tile.kind} shows {room.start} to {room.stop - 1} measures here")
    if bool(tile.dimension) is not shape.along:
        wrong.append(f"a {tile.kind} is drawn {'along' if shape.along else 'without'} a dimension")
    elif shape.of_time and not getattr(fields.get(tile.dimension), "temporal", False):
        wrong.append(f"a {tile.kind} is drawn along time")
    if tile.series and (not shape.series or tile.series == tile.dimension):
        wrong.append(f"a {tile.kind} is not split by {tile.series}")
    return "; ".join(wrong) or None


def tile(spec: Tile, view: MetricView, sources: Mapping[str, DataFrame],
         where: Callable[[Dimensions], Column] | None = None) -> DataFrame:
    problem = tile_problem(spec, view)
    if problem:
        raise ValueError(problem)
    return query(view, sources, [d for d in (spec.dimension, spec.series) if d], spec.measures, where)


def tile_rows(tiles: Mapping[str, DataFrame]) -> DataFrame:
    """tile, rows, empty for every tile."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tile"), "rows") for name, df in tiles.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("empty", F.col("rows") == 0)


def resolve_kpis(references: DataFrame, measures: DataFrame) -> DataFrame:
    """reference, view, measure, problem.

    ``references``: reference, either ``view.measure`` (a view may be named by its last parts) or a measure or display
    name only one view has. ``measures``: view, measure, display_name.
    """
    # Every way to write a measure is one row, so resolving is one equi join.
    parts = F.split("view", r"\.")
    depth = F.sequence(F.lit(1), F.size(parts))
    suffixes = F.transform(depth, lambda n: F.array_join(F.slice(parts, -n, n), "."))
    dotted = measures.select(F.explode(suffixes).alias("_view"), "view", "measure").select(
        F.concat_ws(".", "_view", "measure").alias("_way"), "view", "measure")
    named = (measures.select(F.explode(F.array_distinct(F.array_compact(F.array(F.lower("measure"), F.lower("display_name"))))).alias("_way"),
                             "view", "measure"))
    ways = dotted.unionByName(named)
    way = F.when(F.col("reference").contains("."), F.col("reference")).otherwise(F.lower("reference"))
    one_way = (ways.distinct().groupBy("_way").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct("view", "measure")).alias("hit")))
    hits = F.coalesce("hits", F.lit(0))
    single = hits == 1
    return (references.select("reference").distinct().withColumn("_way", way).join(one_way, "_way", "left")
            .select("reference", F.when(single, F.col("hit.view")).alias("view"), F.when(single, F.col("hit.measure")).alias("measure"),
                    F.when(hits == 0, "unknown").when(hits > 1, "ambiguous").alias("problem")))


def content_gaps(required: DataFrame, shown: DataFrame) -> DataFrame:
    """Required page content (page, kind, item) that no page shows."""
    return required.distinct().join(shown, ["page", "kind", "item"], "left_anti")


def page_mismatches(pages: DataFrame, shown: DataFrame) -> DataFrame:
    """page, problem: pages missing from the dashboard, extra on it, or there more than once."""
    from .diff import diff
    return diff(pages, shown, ["page"]).select("page", "problem")
