"""Metric views, tiles, reconciliation, tools and truth questions over the marts."""
from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import evaluate, metrics, tools
from ..session import written
from ..specs import Field, Join, MetricView, Parameter, Tile, Tool
from . import binding as b
from .registry import doubles, query, text_list

def field(name: str, expr: str, *columns: str, format: str | None = None, temporal: bool = False) -> Field:
    """A field described by the given columns it is made of."""
    title = name.replace("_", " ").capitalize()
    return Field(name, expr, title, f"{title}, made of {' and '.join(columns)}.", columns, format, temporal)


def month(name: str, day: str, column: str) -> Field:
    return field(name, f"CAST(trunc({day}, 'MONTH') AS DATE)", column, temporal=True)


SALES = MetricView(
    "sales_performance", "sales_daily",
    dimensions=(field("order_date", "order_date", "o_orderdate", temporal=True), month("order_month", "order_date", "o_orderdate"),
                field("region", "region_name", "r_name"), field("product", "product_name", "p_brand"), field("category", "category", "p_type")),
    measures=(field("revenue", "SUM(revenue)", "l_extendedprice", "l_discount", format="currency"),
              field("orders", "SUM(orders)", "l_orderkey", format="number"), field("units", "SUM(units)", "l_quantity", format="number"),
              field("avg_order_value", "CAST(SUM(revenue) AS DOUBLE) / SUM(orders)", "l_extendedprice", "l_discount", "l_orderkey", format="currency")),
    comment="Order lines whose o_orderstatus is not P, summed by o_orderdate, r_name, p_brand and p_type.")
FULFILMENT = MetricView(
    "fulfilment", "shipment_fill_daily",
    dimensions=(field("ship_date", "ship_date", "l_shipdate", temporal=True), month("ship_month", "ship_date", "l_shipdate"),
                field("region", "region_name", "r_name"), field("product", "product_name", "p_brand")),
    measures=(field("units_ordered", "SUM(units_ordered)", "l_quantity", format="number"),
              field("units_shipped", "SUM(units_shipped)", "l_quantity", "l_linestatus", format="number"),
              field("fill_rate", "SUM(units_shipped) / SUM(units_ordered)", "l_quantity", "l_linestatus", format="percentage")),
    comment="Quantities of order lines by l_shipdate, r_name and p_brand, those of l_linestatus F apart.")
RETURNS = MetricView(
    "returns", "returns_daily",
    dimensions=(field("return_date", "return_date", "l_shipdate", temporal=True), month("return_month", "return_date", "l_shipdate"),
                field("region", "region_name", "r_name"), field("product", "product_name", "p_brand"), field("reason", "reason", "o_orderpriority")),
    measures=(field("returns", "SUM(returns)", "l_returnflag", format="number"), field("units_returned", "SUM(units_returned)", "l_quantity", format="number"),
              field("returned_value", "SUM(returned_value)", "l_extendedprice", "l_discount", format="currency")),
    comment="Order lines of l_returnflag R, summed by l_shipdate, r_name, p_brand and o_orderpriority.")
CUSTOMERS = MetricView(
    "customer_orders", "orders", filter="status <> 'P'", joins=(Join("customer", "customer", {"customer_id": "customer_id"}),),
    dimensions=(field("segment", "customer.segment", "c_mktsegment"), field("order_date", "order_date", "o_orderdate", temporal=True),
                month("order_month", "order_date", "o_orderdate")),
    measures=(field("active_customers", "COUNT(DISTINCT customer_id)", "o_custkey", format="number"),
              field("revenue", "SUM(amount)", "o_totalprice", format="currency")),
    comment="Orders whose o_orderstatus is not P and their customers, by c_mktsegment and month.")
VIEWS = (SALES, FULFILMENT, RETURNS, CUSTOMERS)


class Sources(Mapping):
    """Marts and silver tables by name, each planned when it is first asked for."""

    MAKERS = {"sales_daily": b.sales_daily, "shipment_fill_daily": b.fill_daily, "returns_daily": b.returns_daily,
              "orders": lambda t: b.silver(t).orders, "customer": lambda t: b.silver(t).customer, "customer_360": b.customer_360}

    def __init__(self, t):
        self.t, self.made = t, {}

    def __getitem__(self, name):
        if name not in self.made:
            self.made[name] = self.MAKERS[name](self.t)
        return self.made[name]

    def __iter__(self):
        return iter(self.MAKERS)

    def __len__(self):
        return len(self.MAKERS)


def sources(t):
    return Sources(t)


def ask(t, view, dims=(), measures=(), where=None):
    return metrics.query(view, sources(t), dims, measures, where)


def between(name, start, end):
    return lambda d: d[name].between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def in_month(name, first):
    """The days of a month as a range, which reaches the scan."""
    day = F.lit(first).cast("date")
    return lambda d: (d[name] >= day) & (d[name] < F.add_months(day, 1))


_MONTH = "CAST(date_trunc('month', {}) AS DATE)"
_ORDERS = """SELECT o_custkey AS customer_id, c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS order_month,
  CAST(o_totalprice AS DECIMAL(12,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"""


# ---------------------------------------------------------------- measures
@query("metric_revenue_by_region", f"SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ({b.SALES_SQL}) GROUP BY 1")
def metric_revenue_by_region(t):
    return doubles(ask(t, SALES, ["region"], ["revenue"]), "revenue")


@query("metric_orders_by_category", f"SELECT category, CAST(SUM(orders) AS BIGINT) AS orders FROM ({b.SALES_SQL}) GROUP BY 1")
def metric_orders_by_category(t):
    return ask(t, SALES, ["category"], ["orders"])


@query("metric_units", f"SELECT CAST(SUM(units) AS BIGINT) AS units FROM ({b.SALES_SQL})")
def metric_units(t):
    return ask(t, SALES, measures=["units"])


@query("metric_avg_order_value", f"SELECT CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(orders) AS BIGINT) AS avg_order_value FROM ({b.SALES_SQL})")
def metric_avg_order_value(t):
    return ask(t, SALES, measures=["avg_order_value"])


@query("metric_fill_rate", f"SELECT region_name AS region, CAST(SUM(units_shipped) AS BIGINT) / CAST(SUM(units_ordered) AS BIGINT) AS fill_rate FROM ({b.FILL_SQL}) GROUP BY 1")
def metric_fill_rate(t):
    return ask(t, FULFILMENT, ["region"], ["fill_rate"])


@query("metric_units_shipped", f"SELECT CAST(SUM(units_ordered) AS BIGINT) AS units_ordered, CAST(SUM(units_shipped) AS BIGINT) AS units_shipped FROM ({b.FILL_SQL})")
def metric_units_shipped(t):
    return ask(t, FULFILMENT, measures=["units_ordered", "units_shipped"])


@query("metric_returns_by_reason", f"SELECT reason, CAST(SUM(returns) AS BIGINT) AS returns, CAST(SUM(units_returned) AS BIGINT) AS units_returned, CAST(SUM(returned_value) AS DOUBLE) AS returned_value FROM ({b.RETURNS_SQL}) GROUP BY 1")
def metric_returns_by_reason(t):
    return doubles(ask(t, RETURNS, ["reason"], ["returns", "units_returned", "returned_value"]), "returned_value")


@query("metric_active_customers", f"SELECT segment, COUNT(DISTINCT customer_id) AS active_customers, CAST(SUM(amount) AS DOUBLE) AS revenue FROM ({_ORDERS}) GROUP BY 1")
def metric_active_customers(t):
    return doubles(ask(t, CUSTOMERS, ["segment"], ["active_customers", "revenue"]), "revenue")


@query("metric_revenue_by_month", f"SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ({b.SALES_SQL}) GROUP BY 1")
def metric_revenue_by_month(t):
    return doubles(ask(t, SALES, ["order_month"], ["revenue"]), "revenue")


# ---------------------------------------------------------------- reconciliation
_REFERENCE = f"""SELECT r_name AS region, SUM({b.AMOUNT}) AS value
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
  JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
  WHERE o_orderstatus <> 'P' GROUP BY r_name"""


def reference(t):
    """Revenue by region in the owner's own SQL, straight from the tables."""
    names = ("lineitem", "orders", "customer", "nation", "region")
    return t.spark.sql(_REFERENCE, **{n: getattr(t, n) for n in names})


_BY_REGION = f"SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS v FROM ({b.SALES_SQL}) GROUP BY 1"


@query("reconcile_measure", f"SELECT region, v AS view_value, v AS reference_value, CAST(NULL AS VARCHAR) AS problem, CAST(0 AS DOUBLE) AS difference FROM ({_BY_REGION})")
def reconcile_measure(t):
    view = ask(t, SALES, ["region"], ["revenue"]).withColumnRenamed("revenue", "value")
    return metrics.reconcile(view, reference(t), ["region"]).drop("in_reference")


@query("reconcile_repeated_group", f"""SELECT region, CASE WHEN region = 'EUROPE' THEN 'group repeated' END AS problem FROM ({_BY_REGION})""")
def reconcile_repeated_group(t):
    """A reference with two rows for one region: reported, though one of them agrees."""
    view = ask(t, SALES, ["region"], ["revenue"]).withColumnRenamed("revenue", "value")
    ref = reference(t)
    twice = ref.unionByName(ref.where("region = 'EUROPE'").withColumn("value", F.col("value") - 1))
    return metrics.reconcile(view, twice, ["region"]).select("region", "problem")


@query("reconcile_mismatch", f"""WITH v AS ({_BY_REGION}), w AS (SELECT CASE WHEN region = 'EUROPE' THEN NULL ELSE region END AS region,
    CASE WHEN region = 'AMERICA' THEN v * 1.01 ELSE v END AS v FROM v WHERE region <> 'ASIA')
  SELECT coalesce(v.region, w.region) AS region, v.v AS view_value, w.v AS reference_value,
    CASE WHEN v.v IS NULL OR w.v IS NULL THEN 'group only on one side' WHEN v.v <> w.v THEN 'values differ' END AS problem
  FROM v FULL JOIN w ON v.region IS NOT DISTINCT FROM w.region""")
def reconcile_mismatch(t):
    """A reference that is 1% off in one region, lacks another and has a null group."""
    view = ask(t, SALES, ["region"], ["revenue"]).withColumnRenamed("revenue", "value")
    off = reference(t).where("region <> 'ASIA'").select(
        F.nullif("region", F.lit("EUROPE")).alias("region"),
        F.when(F.col("region") == "AMERICA", F.col("value").cast("double") * 1.01).otherwise(F.col("value").cast("double")).alias("value"))
    return metrics.reconcile(view, off, ["region"]).drop("in_reference", "difference")


@query("reconcile_verdict", "SELECT COUNT(*) AS groups, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS DOUBLE) AS worst_difference, TRUE AS ok FROM region")
def reconcile_verdict(t):
    view = ask(t, SALES, ["region"], ["revenue"]).withColumnRenamed("revenue", "value")
    return metrics.reconcile_verdict(metrics.reconcile(view, reference(t), ["region"]))


@query("reconcile_active_customers", f"""SELECT segment, CAST(COUNT(*) AS DOUBLE) AS view_value, CAST(COUNT(*) AS DOUBLE) AS reference_value, CAST(NULL AS VARCHAR) AS problem
  FROM ({b.CUSTOMER_SQL}) WHERE lifetime_orders > 0 GROUP BY 1""")
def reconcile_active_customers(t):
    view = ask(t, CUSTOMERS, ["segment"], ["active_customers"]).withColumnRenamed("active_customers", "value")
    ref = b.customer_360(t).where("lifetime_orders > 0").groupBy("segment").agg(F.count(F.lit(1)).alias("value"))
    return metrics.reconcile(view, ref, ["segment"]).drop("in_reference", "difference")


# ---------------------------------------------------------------- tiles
LINE = Tile("line", ("revenue",), "order_month")
SERIES = Tile("line", ("revenue",), "order_month", "region")


@query("tile_line", f"SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ({b.SALES_SQL}) GROUP BY 1")
def tile_line(t):
    return doubles(metrics.tile(LINE, SALES, sources(t)), "revenue")


@query("tile_series", f"SELECT {_MONTH.format('order_date')} AS order_month, region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM ({b.SALES_SQL}) GROUP BY 1, 2")
def tile_series(t):
    return doubles(metrics.tile(SERIES, SALES, sources(t)), "revenue")


@query("tile_rows", f"""SELECT 'total' AS tile, COUNT(*) AS rows, FALSE AS empty FROM (SELECT SUM(revenue) FROM ({b.SALES_SQL}))
  UNION ALL SELECT 'months', COUNT(DISTINCT {_MONTH.format('order_date')}), FALSE FROM ({b.SALES_SQL})
  UNION ALL SELECT 'categories', COUNT(DISTINCT category), FALSE FROM ({b.SALES_SQL})
  UNION ALL SELECT 'nowhere', 0, TRUE""")
def tile_rows(t):
    src = sources(t)
    return metrics.tile_rows({
        "total": metrics.tile(Tile("counter", ("revenue",)), SALES, src), "months": metrics.tile(LINE, SALES, src),
        "categories": metrics.tile(Tile("bar", ("revenue", "orders"), "category"), SALES, src),
        "nowhere": metrics.tile(Tile("table", ("orders",), "region"), SALES, src, lambda d: d["region"] == "ATLANTIS")})


def _kpi_measures(t):
    """Brands as metric views, part names as their measures, types as display names."""
    return t.part.select(F.concat(F.lit("main.metrics."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("view"),
                         F.replace("p_name", F.lit(" "), F.lit("_")).alias("measure"),
                         F.concat_ws(" ", "p_type", "p_name", F.col("p_size")).alias("display_name")).distinct()


_KPI = """SELECT DISTINCT 'main.metrics.' || lower(replace(p_brand, '#', '_')) AS view, replace(p_name, ' ', '_') AS measure,
  p_type || ' ' || p_name || ' ' || p_size AS display_name FROM part"""


@query("kpi_resolve", f"""WITH m AS ({_KPI}), r AS (SELECT upper(display_name) AS reference FROM m UNION SELECT measure FROM m
    UNION SELECT split_part(view, '.', 3) || '.' || measure FROM m WHERE view LIKE '%_2' UNION SELECT 'metrics.nowhere.' || measure FROM m),
  w AS (SELECT DISTINCT lower(display_name) AS way, view, measure FROM m UNION SELECT lower(measure), view, measure FROM m
    UNION SELECT split_part(view, '.', 3) || '.' || measure, view, measure FROM m),
  h AS (SELECT way, COUNT(*) AS hits, min(view) AS view, min(measure) AS measure FROM w GROUP BY 1)
  SELECT reference, CASE WHEN hits = 1 THEN view END AS view, CASE WHEN hits = 1 THEN measure END AS measure,
    CASE WHEN hits IS NULL THEN 'unknown' WHEN hits > 1 THEN 'ambiguous' END AS problem
  FROM r LEFT JOIN h ON way = CASE WHEN contains(reference, '.') THEN reference ELSE lower(reference) END""")
def kpi_resolve(t):
    m = _kpi_measures(t)
    short = F.concat_ws(".", F.substring_index("view", ".", -1), "measure")
    refs = (m.select(F.upper("display_name").alias("reference")).unionByName(m.select(F.col("measure").alias("reference")))
            .unionByName(m.where("view LIKE '%_2'").select(short.alias("reference")))
            .unionByName(m.select(F.concat(F.lit("metrics.nowhere."), "measure").alias("reference"))))
    return metrics.resolve_kpis(refs, m)


@query("field_gaps", """SELECT p_brand AS view, CASE WHEN p_size > 25 THEN 'measure' ELSE 'dimension' END AS kind, CAST(p_partkey AS VARCHAR) AS name,
    concat_ws(',', CASE WHEN p_size = 1 THEN 'display_name' END, CASE WHEN p_retailprice > 1500 THEN 'comment' END,
      CASE WHEN p_type = 'SMALL' THEN 'synonyms' END, CASE WHEN p_size = 50 THEN 'format' END) AS gaps
  FROM part WHERE p_size = 1 OR p_retailprice > 1500 OR p_type = 'SMALL' OR p_size = 50""")
def field_gaps(t):
    fields = t.part.select(
        F.col("p_brand").alias("view"), F.when(F.col("p_size") > 25, "measure").otherwise("dimension").alias("kind"),
        F.col("p_partkey").cast("string").alias("name"), F.when(F.col("p_size") != 1, F.col("p_name")).alias("display_name"),
        F.when(F.col("p_retailprice") > 1500, " ").otherwise("about it").alias("comment"),
        F.when(F.col("p_type") == "SMALL", F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("synonyms"),
        F.when(F.col("p_size") != 50, "number").alias("format"))
    return metrics.field_gaps(fields).withColumn("gaps", text_list("gaps"))


_DEFS = """SELECT 'v_' || p_partkey AS view, ['lineitem', 'orders', 'raw_orders', 'nowhere'][p_size % 4 + 1] AS source, p_size % 5 = 0 AS joined, p_size % 4 IN (1, 2) AS ord,
    replace(p_name, ' ', '_') AS measure, p_size, p_type FROM part"""


@query("definition_problems", f"""WITH d AS ({_DEFS})
  SELECT view, source AS object, 'source is ' || CASE source WHEN 'nowhere' THEN 'unknown' ELSE 'bronze' END AS problem FROM d WHERE source IN ('nowhere', 'raw_orders')
  UNION ALL SELECT view, 'c', 'join is defined twice' FROM d WHERE p_size % 10 = 0
  UNION ALL SELECT view, 'day', 'field is defined twice' FROM d WHERE p_size % 7 = 0
  UNION ALL SELECT view, 'day', 'unknown name o_orderdate' FROM d WHERE NOT ord
  UNION ALL SELECT view, measure, 'no expression' FROM d WHERE p_type = 'SMALL'
  UNION ALL SELECT view, measure, 'unknown name c.c_acctbal' FROM d WHERE p_type = 'PROMO' AND NOT joined
  UNION ALL SELECT view, measure, 'unknown name ' || unnest(['o_orderkey', 'source.o_totalprice']) FROM d WHERE p_type = 'ECONOMY' AND NOT ord
  UNION ALL SELECT view, measure, 'unknown name l_quantity' FROM d WHERE p_type NOT IN ('SMALL', 'PROMO', 'ECONOMY') AND source <> 'lineitem'
  UNION ALL SELECT view, 'other', 'reference of no measure' FROM d WHERE p_size % 6 = 0
  UNION ALL SELECT view, CASE WHEN p_size % 6 = 0 THEN 'other' ELSE measure END, unnest(['nothing is not a dimension', 'returns no column nothing']) FROM d WHERE p_size % 9 = 0
  UNION ALL SELECT view, CASE WHEN p_size % 6 = 0 THEN 'other' ELSE measure END, 'reads metrics; it must be independent' FROM d WHERE p_size % 3 = 0 AND p_size > 40""")
def definition_problems(t):
    """Every part defines a metric view: a source, perhaps a join, two fields and a reference; sizes and types make the mistakes."""
    size, kind, view = F.col("p_size"), F.col("p_type"), F.concat(F.lit("v_"), "p_partkey").alias("view")
    measure = F.replace("p_name", F.lit(" "), F.lit("_"))
    views = t.part.select(view, F.get(F.array(*map(F.lit, ("lineitem", "orders", "raw_orders", "nowhere"))), size % 4).alias("source"))
    joined = t.part.where("p_size % 5 = 0").select(view, F.lit("c").alias("name"), F.lit("customer").alias("source"), "p_size")
    joins = joined.unionByName(joined.where("p_size % 10 = 0")).drop("p_size")
    expr = (F.when(kind == "PROMO", "sum(C.`c_acctbal`)").when(kind == "SMALL", " ")
            .when(kind == "ECONOMY", "count(DISTINCT `O_ORDERKEY`) FILTER (WHERE source.o_totalprice > 'o_none') -- o_gone").otherwise("sum(CAST(l_quantity AS double)) / 2"))
    day = F.struct(F.lit("dimension").alias("kind"), F.lit("day").alias("name"), F.lit("date_trunc('day', o_orderdate)").alias("expr"))
    own = F.struct(F.lit("measure").alias("kind"), measure.alias("name"), expr.alias("expr"))
    fields = t.part.select(view, F.inline(F.when(size % 7 == 0, F.array(day, day, own)).otherwise(F.array(day, own))))
    sql = F.when(size > 40, "SELECT day, value FROM main.silver.orders, main.metrics.daily").otherwise("SELECT 1 AS value, day FROM main.silver.orders -- main.metrics.daily")
    references = t.part.where("p_size % 3 = 0").select(
        view, F.when(size % 6 == 0, "other").otherwise(measure).alias("measure"), sql.alias("sql"),
        F.when(size % 9 == 0, F.array(F.lit("day"), F.lit("nothing"))).otherwise(F.array(F.lit("day"))).alias("by"), F.array(F.lit("value"), F.lit("day")).alias("returns"))
    tables = (("lineitem", "silver", t.lineitem), ("orders", "silver", t.orders), ("customer", "silver", t.customer), ("raw_orders", "bronze", t.orders))
    columns = t.spark.createDataFrame([(n, layer, c) for n, layer, df in tables for c in df.columns], "source STRING, layer STRING, column STRING")
    return metrics.definition_problems(views, joins, fields, references, columns, "metrics")


@query("thin_comments", """SELECT doc_id AS view, CASE WHEN trim(text) = '' THEN 'no description' ELSE 'too short' END AS problem
  FROM documents WHERE length(trim(text)) < 20""")
def thin_comments(t):
    return metrics.thin_comments(t.documents.select(F.col("doc_id").alias("view"), F.col("text").alias("comment")))


def _definitions(t, second: bool):
    price = F.when((F.col("p_size") > 40) & F.lit(second), F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    gap = "  " if second else " "
    df = t.part.where("p_size <> 3") if second else t.part.where("p_size <> 4")
    return df.select(F.col("p_brand").alias("view"), F.lit("measure").alias("kind"), F.col("p_partkey").alias("name"),
                     F.concat(F.lit("SUM("), price.cast("decimal(12,2)").cast("string"), F.lit(gap), F.lit(")")).alias("expr"),
                     F.col("p_type").alias("comment"), F.when(F.col("p_size") != 5, F.col("p_name")).otherwise("" if second else None).alias("display_name"),
                     F.lit("number").alias("format"))


@query("definition_diff", """WITH p AS (SELECT *, 'SUM(' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) || ' )' AS e1,
    'SUM(' || CAST(CAST(CASE WHEN p_size > 40 THEN p_retailprice + 1 ELSE p_retailprice END AS DECIMAL(12,2)) AS VARCHAR) || ' )' AS e2,
    CASE WHEN p_size <> 5 THEN p_name END AS d FROM part)
  SELECT p_brand AS view, 'measure' AS kind, p_partkey AS name, k.property, CASE WHEN p_size <> 4 THEN k.l END AS "left", CASE WHEN p_size <> 3 THEN k.r END AS "right"
  FROM (SELECT *, unnest([{property: 'expr', l: e1, r: e2}, {property: 'comment', l: p_type, r: p_type}, {property: 'display_name', l: d, r: d},
    {property: 'format', l: 'number', r: 'number'}]) AS k FROM p)
  WHERE (CASE WHEN p_size <> 4 THEN k.l END) IS DISTINCT FROM (CASE WHEN p_size <> 3 THEN k.r END)""")
def definition_diff(t):
    return metrics.definition_diff(_definitions(t, False), _definitions(t, True))


@query("content_gaps", """SELECT DISTINCT n_name AS page, 'kpi' AS kind, c_mktsegment AS item FROM customer JOIN nation ON c_nationkey = n_nationkey
  EXCEPT SELECT n_name, 'kpi', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 8000""")
def content_gaps(t):
    content = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("page"), F.lit("kpi").alias("kind"), F.col("c_mktsegment").alias("item"), "c_acctbal")
    return metrics.content_gaps(content.drop("c_acctbal"), content.where("c_acctbal > 8000").drop("c_acctbal"))


@query("page_mismatches", """WITH w AS (SELECT DISTINCT 'p' || c_nationkey || c_mktsegment AS page FROM customer),
  h AS (SELECT 'p' || s_nationkey || CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'OTHER' END AS page, COUNT(*) AS n FROM supplier GROUP BY 1)
  SELECT coalesce(w.page, h.page) AS page, CASE WHEN h.page IS NULL THEN 'missing' WHEN w.page IS NULL THEN 'extra' ELSE 'duplicated' END AS problem
  FROM w FULL JOIN h USING (page) WHERE h.page IS NULL OR w.page IS NULL OR n > 1""")
def page_mismatches(t):
    want = t.customer.select(F.concat(F.lit("p"), "c_nationkey", "c_mktsegment").alias("page")).distinct()
    have = t.supplier.select(F.concat(F.lit("p"), "s_nationkey", F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("OTHER")).alias("page"))
    return metrics.page_mismatches(want, have)


# ---------------------------------------------------------------- truth questions
_S = f"({b.SALES_SQL})"
_Q3 = "order_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30'"
Q3 = between("order_date", "1997-07-01", "1997-09-30")
JUNE = between("order_date", "1997-06-01", "1997-06-30")


@query("q_total", f"SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE order_date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'")
def q_total(t):
    return doubles(ask(t, SALES, (), ["revenue"], JUNE), "revenue")


@query("q_by_region", f"SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE {_Q3} GROUP BY 1")
def q_by_region(t):
    return doubles(ask(t, SALES, ["region"], ["revenue"], Q3), "revenue")


@query("q_top_region", f"SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE {_Q3} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def q_top_region(t):
    return q_by_region(t).orderBy(F.desc("revenue"), "region").limit(1)


@query("q_product_trend", f"""SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S}
  WHERE product_name = 'Brand#7' AND order_date BETWEEN DATE '1997-06-01' AND DATE '1997-09-30' GROUP BY 1""")
def q_product_trend(t):
    when = between("order_date", "1997-06-01", "1997-09-30")
    return doubles(ask(t, SALES, ["order_month"], ["revenue"], lambda d: (d["product"] == "Brand#7") & when(d)), "revenue")


@query("q_quarter_by_category", f"SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE {_Q3} GROUP BY 1")
def q_quarter_by_category(t):
    return doubles(ask(t, SALES, ["category"], ["revenue"], Q3), "revenue")


@query("q_filtered_units", f"SELECT CAST(SUM(units) AS BIGINT) AS units FROM {_S} WHERE category = 'PROMO' AND {_Q3}")
def q_filtered_units(t):
    return ask(t, SALES, (), ["units"], lambda d: (d["category"] == "PROMO") & Q3(d))


@query("q_region_orders", f"SELECT CAST(SUM(orders) AS BIGINT) AS orders FROM {_S} WHERE region_name = 'EUROPE' AND {_Q3}")
def q_region_orders(t):
    return ask(t, SALES, (), ["orders"], lambda d: (d["region"] == "EUROPE") & Q3(d))


@query("q_region_aov", f"SELECT CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(orders) AS BIGINT) AS avg_order_value FROM {_S} WHERE region_name = 'ASIA' AND {_Q3}")
def q_region_aov(t):
    return ask(t, SALES, (), ["avg_order_value"], lambda d: (d["region"] == "ASIA") & Q3(d))


@query("q_top3", f"SELECT product_name AS product, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE {_Q3} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def q_top3(t):
    return doubles(ask(t, SALES, ["product"], ["revenue"], Q3), "revenue").orderBy(F.desc("revenue"), "product").limit(3)


@query("q_month_compare", f"""SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S}
  WHERE order_date BETWEEN DATE '1997-08-01' AND DATE '1997-09-30' GROUP BY 1""")
def q_month_compare(t):
    return doubles(ask(t, SALES, ["order_month"], ["revenue"], between("order_date", "1997-08-01", "1997-09-30")), "revenue")


@query("q_segment_active", f"SELECT segment, COUNT(DISTINCT customer_id) AS active_customers FROM ({_ORDERS}) WHERE order_month = DATE '1997-08-01' GROUP BY 1")
def q_segment_active(t):
    return ask(t, CUSTOMERS, ["segment"], ["active_customers"], in_month("order_date", "1997-08-01"))


@query("q_customers_per_region", f"SELECT region_name, COUNT(*) AS customers FROM ({b.CUSTOMER_SQL}) GROUP BY 1")
def q_customers_per_region(t):
    return b.customer_360(t).groupBy("region_name").agg(F.count(F.lit(1)).alias("customers"))


@query("q_lowest_fill_rate", f"""SELECT region_name AS region, CAST(SUM(units_shipped) AS BIGINT) / CAST(SUM(units_ordered) AS BIGINT) AS fill_rate FROM ({b.FILL_SQL})
  WHERE ship_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30' GROUP BY 1 ORDER BY 2, 1 LIMIT 1""")
def q_lowest_fill_rate(t):
    return (ask(t, FULFILMENT, ["region"], ["fill_rate"], between("ship_date", "1997-07-01", "1997-09-30"))
            .orderBy("fill_rate", "region").limit(1))


@query("q_top_return_reason", f"""SELECT reason, CAST(SUM(returns) AS BIGINT) AS returns FROM ({b.RETURNS_SQL}) WHERE region_name = 'AMERICA'
  AND return_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def q_top_return_reason(t):
    when = between("return_date", "1997-07-01", "1997-09-30")
    return (ask(t, RETURNS, ["reason"], ["returns"], lambda d: (d["region"] == "AMERICA") & when(d))
            .orderBy(F.desc("returns"), "reason").limit(1))


@query("q_segment_trend", f"""SELECT order_month, CAST(SUM(amount) AS DOUBLE) AS revenue FROM ({_ORDERS}) WHERE segment = 'MACHINERY'
  AND order_month BETWEEN DATE '1997-06-01' AND DATE '1997-09-01' GROUP BY 1""")
def q_segment_trend(t):
    when = between("order_month", "1997-06-01", "1997-09-01")
    return doubles(ask(t, CUSTOMERS, ["order_month"], ["revenue"], lambda d: (d["segment"] == "MACHINERY") & when(d)), "revenue")


@query("q_units_ordered_shipped", f"""SELECT CAST(SUM(units_ordered) AS BIGINT) AS units_ordered, CAST(SUM(units_shipped) AS BIGINT) AS units_shipped FROM ({b.FILL_SQL})
  WHERE ship_date BETWEEN DATE '1997-08-01' AND DATE '1997-08-31'""")
def q_units_ordered_shipped(t):
    return ask(t, FULFILMENT, (), ["units_ordered", "units_shipped"], between("ship_date", "1997-08-01", "1997-08-31"))


@query("q_fill_rate", f"""SELECT CAST(SUM(units_shipped) AS BIGINT) / CAST(SUM(units_ordered) AS BIGINT) AS fill_rate FROM ({b.FILL_SQL})
  WHERE ship_date BETWEEN DATE '1997-07-01' AND DATE '1997-09-30'""")
def q_fill_rate(t):
    return ask(t, FULFILMENT, (), ["fill_rate"], between("ship_date", "1997-07-01", "1997-09-30"))


@query("q_fill_rate_by_region", f"""SELECT region_name AS region, CAST(SUM(units_shipped) AS BIGINT) / CAST(SUM(units_ordered) AS BIGINT) AS fill_rate FROM ({b.FILL_SQL})
  WHERE ship_date BETWEEN DATE '1997-07-01' AND DATE '1997-07-31' GROUP BY 1""")
def q_fill_rate_by_region(t):
    return ask(t, FULFILMENT, ["region"], ["fill_rate"], between("ship_date", "1997-07-01", "1997-07-31"))


@query("q_returns_by_reason", f"""SELECT reason, CAST(SUM(returns) AS BIGINT) AS returns FROM ({b.RETURNS_SQL})
  WHERE return_date BETWEEN DATE '1997-08-01' AND DATE '1997-08-31' GROUP BY 1""")
def q_returns_by_reason(t):
    return ask(t, RETURNS, ["reason"], ["returns"], between("return_date", "1997-08-01", "1997-08-31"))


@query("q_returned_value", f"""SELECT CAST(SUM(returned_value) AS DOUBLE) AS returned_value FROM ({b.RETURNS_SQL})
  WHERE return_date BETWEEN DATE '1997-09-01' AND DATE '1997-09-30'""")
def q_returned_value(t):
    return doubles(ask(t, RETURNS, (), ["returned_value"], between("return_date", "1997-09-01", "1997-09-30")), "returned_value")


@query("q_units_returned", f"""SELECT CAST(SUM(units_returned) AS BIGINT) AS units_returned FROM ({b.RETURNS_SQL})
  WHERE reason = '1-URGENT' AND return_date BETWEEN DATE '1997-07-01' AND DATE '1997-07-31'""")
def q_units_returned(t):
    when = between("return_date", "1997-07-01", "1997-07-31")
    return ask(t, RETURNS, (), ["units_returned"], lambda d: (d["reason"] == "1-URGENT") & when(d))


@query("q_top_segment", f"""SELECT segment, CAST(SUM(amount) AS DOUBLE) AS revenue FROM ({_ORDERS}) WHERE order_month = DATE '1997-09-01'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def q_top_segment(t):
    month = ask(t, CUSTOMERS, ["segment"], ["revenue"], in_month("order_date", "1997-09-01"))
    return doubles(month.orderBy(F.desc("revenue"), "segment").limit(1), "revenue")


@query("q_category_in_region", f"SELECT CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE category = 'PROMO' AND region_name = 'AMERICA' AND {_Q3}")
def q_category_in_region(t):
    return doubles(ask(t, SALES, (), ["revenue"], lambda d: (d["category"] == "PROMO") & (d["region"] == "AMERICA") & Q3(d)), "revenue")


@query("q_top_category", f"SELECT category, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM {_S} WHERE {_Q3} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def q_top_category(t):
    return doubles(ask(t, SALES, ["category"], ["revenue"], Q3).orderBy(F.desc("revenue"), "category").limit(1), "revenue")


@query("q_aov_per_month", f"""SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(orders) AS BIGINT) AS avg_order_value FROM {_S}
  WHERE order_date BETWEEN DATE '1997-06-01' AND DATE '1997-09-30' GROUP BY 1""")
def q_aov_per_month(t):
    return ask(t, SALES, ["order_month"], ["avg_order_value"], between("order_date", "1997-06-01", "1997-09-30"))


@query("q_orders_in_month", f"SELECT CAST(SUM(orders) AS BIGINT) AS orders FROM {_S} WHERE order_date BETWEEN DATE '1997-07-01' AND DATE '1997-07-31'")
def q_orders_in_month(t):
    return ask(t, SALES, (), ["orders"], between("order_date", "1997-07-01", "1997-07-31"))


TRUTH = {"q_total": q_total, "q_by_region": q_by_region, "q_top_region": q_top_region, "q_product_trend": q_product_trend,
         "q_segment_active": q_segment_active, "q_top3": q_top3, "tile_series": tile_series, "q_customers_per_region": q_customers_per_region}


@query("truth_questions", f"""SELECT question, rows, CASE WHEN rows = 0 THEN 'no rows' WHEN rows > 50 THEN 'more than 50 rows' END AS problem FROM (
    SELECT 'q_total' AS question, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'q_by_region', COUNT(DISTINCT region_name) FROM {_S} WHERE {_Q3}
    UNION ALL SELECT 'q_top_region', least(1, COUNT(*)) FROM {_S} WHERE {_Q3}
    UNION ALL SELECT 'q_product_trend', COUNT(DISTINCT {_MONTH.format('order_date')}) FROM {_S} WHERE product_name = 'Brand#7' AND order_date BETWEEN DATE '1997-06-01' AND DATE '1997-09-30'
    UNION ALL SELECT 'q_segment_active', COUNT(DISTINCT segment) FROM ({_ORDERS}) WHERE order_month = DATE '1997-08-01'
    UNION ALL SELECT 'q_top3', least(3, COUNT(DISTINCT product_name)) FROM {_S} WHERE {_Q3}
    UNION ALL SELECT 'tile_series', least(51, COUNT(DISTINCT row(region_name, {_MONTH.format('order_date')}))) FROM {_S}
    UNION ALL SELECT 'q_customers_per_region', COUNT(DISTINCT region_name) FROM ({b.CUSTOMER_SQL}))""")
def truth_questions(t):
    return evaluate.truth({name: plan(t) for name, plan in TRUTH.items()})


@query("topk_revenue", f"""SELECT customer_name, CAST(lifetime_revenue AS DOUBLE) AS lifetime_revenue FROM ({b.CUSTOMER_SQL})
  ORDER BY lifetime_revenue DESC, customer_name LIMIT 5""")
def topk_revenue(t):
    top = b.customer_360(t).orderBy(F.desc("lifetime_revenue"), "customer_name").limit(5)
    return doubles(top.select("customer_name", "lifetime_revenue"), "lifetime_revenue")


@query("latest_full_month", f"""WITH s AS ({b.SALES_SQL}), last AS (SELECT date_trunc('month', MAX(order_date)) - INTERVAL 1 MONTH AS m FROM s WHERE order_date < DATE '2000-06-15')
  SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue FROM s, last WHERE date_trunc('month', order_date) = m GROUP BY 1""")
def latest_full_month(t):
    """Revenue by region in the last month that is complete before a day.

    The mart is built once and kept as a row per month and region; the date, and then the month, are read from that. All days of the
    month asked for lie before the day, so later orders are not read.
    """
    sales = b.sales_daily(t).where(F.col("order_date") < F.lit("2000-06-15").cast("date"))
    months = written(sales.groupBy(F.trunc("order_date", "MONTH").alias("month"), F.col("region_name").alias("region"))
                     .agg(F.sum("revenue").alias("revenue")), "months")
    last = months.agg(F.max("month").alias("m")).select(F.add_months("m", -1)).scalar()
    return doubles(months.where(F.col("month") == last).select("region", "revenue"), "revenue")


# ---------------------------------------------------------------- tools
SALES_BETWEEN = Tool("sales_between", (Parameter("first_day", "DATE"), Parameter("last_day", "DATE")),
                     {"region": "STRING", "revenue": "DOUBLE", "orders": "BIGINT", "avg_order_value": "DOUBLE"},
                     """SELECT region_name, CAST(SUM(revenue) AS DOUBLE), SUM(orders), CAST(SUM(revenue) AS DOUBLE) / SUM(orders) FROM {sales}
                        WHERE order_date BETWEEN sales_between.first_day AND sales_between.last_day GROUP BY region_name""")
BRAND_MONTHS = Tool("brand_months", (Parameter("brand", "STRING"),), {"order_month": "DATE", "revenue": "DOUBLE", "units": "BIGINT"},
                    """SELECT trunc(order_date, 'MONTH'), CAST(SUM(revenue) AS DOUBLE), SUM(units) FROM {sales}
                       WHERE product_name = brand_months.brand GROUP BY trunc(order_date, 'MONTH')""")
SHIPPED_SHARE = Tool("shipped_share", (Parameter("first_day", "DATE"),),
                     {"region": "STRING", "units_ordered": "BIGINT", "units_shipped": "BIGINT", "fill_rate": "DOUBLE"},
                     """SELECT region_name, SUM(units_ordered), SUM(units_shipped), SUM(units_shipped) / SUM(units_ordered) FROM {fill}
                        WHERE ship_date >= shipped_share.first_day AND ship_date < add_months(shipped_share.first_day, 1) GROUP BY region_name""")
BACK_BY_PRIORITY = Tool("back_by_priority", (Parameter("place", "STRING", "*", True),),
                        {"reason": "STRING", "returns": "BIGINT", "units_returned": "BIGINT", "returned_value": "DOUBLE"},
                        """SELECT reason, SUM(returns), SUM(units_returned), CAST(SUM(returned_value) AS DOUBLE) FROM {returns}
                           WHERE back_by_priority.place = '*' OR region_name = back_by_priority.place GROUP BY reason""")
SEGMENT_MONTH = Tool("segment_month", (Parameter("first_day", "DATE"),),
                     {"segment": "STRING", "active_customers": "BIGINT", "revenue": "DOUBLE"},
                     """SELECT segment, COUNT(DISTINCT customer_id), CAST(SUM(amount) AS DOUBLE) FROM {customer_orders}
                        WHERE order_date >= segment_month.first_day AND order_date < add_months(segment_month.first_day, 1) GROUP BY segment""")


def use_tool(t, tool, **args):
    """Calls a tool over views of this call alone, so that calls do not see each other's tables."""
    s = b.silver(t)
    frames = {"sales": b.sales_daily(t), "fill": b.fill_daily(t), "returns": b.returns_daily(t),
              "customer_orders": s.orders.where("status <> 'P'").join(s.customer.select("customer_id", "segment"), "customer_id")}
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in frames if f"{{{name}}}" in tool.body}
    for name, view in names.items():
        frames[name].createOrReplaceTempView(view)
    bound = replace(tool, body=tool.body.format(**names))
    tools.create_tool(t.spark, bound)
    return tools.call_tool(t.spark, bound, args)


_YEAR = "order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
_REGION_YEAR = f"""SELECT region_name AS region, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(orders) AS BIGINT) AS orders,
  CAST(SUM(revenue) AS DOUBLE) / CAST(SUM(orders) AS BIGINT) AS avg_order_value FROM {_S} WHERE {_YEAR} GROUP BY 1"""


@query("tool_revenue_by_region", _REGION_YEAR)
def tool_revenue_by_region(t):
    return use_tool(t, SALES_BETWEEN, first_day="1997-01-01", last_day="1997-12-31")


@query("tool_product_trend", f"""SELECT {_MONTH.format('order_date')} AS order_month, CAST(SUM(revenue) AS DOUBLE) AS revenue, CAST(SUM(units) AS BIGINT) AS units
  FROM {_S} WHERE product_name = 'Brand#7' GROUP BY 1""")
def tool_product_trend(t):
    return use_tool(t, BRAND_MONTHS, brand="Brand#7")


@query("tool_fill_rate", f"""SELECT region_name AS region, CAST(SUM(units_ordered) AS BIGINT) AS units_ordered, CAST(SUM(units_shipped) AS BIGINT) AS units_shipped,
  CAST(SUM(units_shipped) AS BIGINT) / CAST(SUM(units_ordered) AS BIGINT) AS fill_rate FROM ({b.FILL_SQL})
  WHERE date_trunc('month', ship_date) = DATE '1997-08-01' GROUP BY 1""")
def tool_fill_rate(t):
    return use_tool(t, SHIPPED_SHARE, first_day="1997-08-01")


_REASONS = f"""SELECT reason, CAST(SUM(returns) AS BIGINT) AS returns, CAST(SUM(units_returned) AS BIGINT) AS units_returned,
  CAST(SUM(returned_value) AS DOUBLE) AS returned_value FROM ({b.RETURNS_SQL})"""


@query("tool_return_reasons", f"{_REASONS} GROUP BY 1")
def tool_return_reasons(t):
    return use_tool(t, BACK_BY_PRIORITY)


@query("tool_return_reasons_one_region", f"{_REASONS} WHERE region_name = 'AMERICA' GROUP BY 1")
def tool_return_reasons_one_region(t):
    return use_tool(t, BACK_BY_PRIORITY, place="AMERICA")


@query("tool_segment_summary", f"""SELECT segment, COUNT(DISTINCT customer_id) AS active_customers, CAST(SUM(amount) AS DOUBLE) AS revenue FROM ({_ORDERS})
  WHERE order_month = DATE '1997-09-01' GROUP BY 1""")
def tool_segment_summary(t):
    return use_tool(t, SEGMENT_MONTH, first_day="1997-09-01")


@query("tool_test", f"""SELECT region, 'revenue' AS "column", 'differs' AS problem FROM ({_REGION_YEAR}) WHERE region = 'EUROPE'
  UNION ALL SELECT region, NULL, 'not in the matching rows' FROM ({_REGION_YEAR}) WHERE region = 'AFRICA'
  UNION ALL SELECT 'ATLANTIS', NULL, 'missing from the result' FROM region WHERE r_name = 'AFRICA'""")
def tool_test(t):
    """A tool against independent rows of which one is off, one is missing and one is extra."""
    want = (b.sales_daily(t).where("order_date BETWEEN DATE'1997-01-01' AND DATE'1997-12-31'").groupBy(F.col("region_name").alias("region"))
            .agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").alias("orders")))
    off = want.select(F.when(F.col("region") == "AFRICA", "ATLANTIS").otherwise(F.col("region")).alias("region"),
                      F.when(F.col("region") == "EUROPE", F.col("revenue") + F.col("revenue") / 1000).otherwise(F.col("revenue") + 0.001).alias("revenue"), "orders")
    got = tool_revenue_by_region(t)
    return metrics.compare_keyed(got, off, ["region"], ["revenue", "orders"]).drop("got", "want")


@query("tool_shape", f"""SELECT 'year' AS test, COUNT(*) AS rows, 'margin' AS lacking, FALSE AS ok FROM ({_REGION_YEAR})
  UNION ALL SELECT 'nothing', 0, '', TRUE""")
def tool_shape(t):
    year = metrics.shape_problems(tool_revenue_by_region(t), ["region", "margin"], min_rows=1)
    none = metrics.shape_problems(use_tool(t, BRAND_MONTHS, brand="Brand#0"), ["revenue"], max_rows=0)
    rows = year.select(F.lit("year").alias("test"), "*").unionByName(none.select(F.lit("nothing").alias("test"), "*"))
    return rows.withColumn("lacking", text_list("lacking"))


def query_log(t):
    """One statement per order: its customer's table is read, cancelled orders delete, high ones run two statements."""
    joined = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    place = F.replace(F.lower("r_name"), F.lit(" "), F.lit("_"))
    name = F.concat_ws(".", place, F.lower("n_name"), F.concat(F.lit("c_"), F.col("c_custkey")))
    verb = F.when(F.col("o_orderstatus") == "P", "DELETE").otherwise("SELECT * ")
    tail = F.when(F.col("o_orderpriority") == "1-URGENT", "; SELECT 1").otherwise(";")
    sql = F.concat(verb, F.lit(" FROM `"), place, F.lit("` . "), F.substring_index(name, ".", -2), F.lit(" WHERE note = 'see a.b.c'"), tail)
    return joined.select(F.col("o_orderkey").alias("query_id"), sql.alias("sql"), name.alias("full_name"), "c_acctbal")


@query("query_scan", """SELECT o_orderkey AS query_id, replace(lower(r_name), ' ', '_') || '.' || lower(n_name) || '.c_' || c_custkey AS object FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < 0
  UNION ALL SELECT o_orderkey, CASE o_shippriority % 3 WHEN 1 THEN lower(o_orderstatus) || '.totals' ELSE 'payroll' END FROM (SELECT *, o_orderkey AS o_shippriority FROM orders) WHERE o_shippriority % 3 > 0""")
def query_scan(t):
    """Statements over customer tables, and others that name a table by one or two parts; names of their own WITH are no tables."""
    log = query_log(t)
    key = F.col("o_orderkey")
    short = F.when(key % 3 == 1, F.concat(F.lower("o_orderstatus"), F.lit(".totals"))).otherwise("payroll")
    sql = F.concat(F.lit("WITH mine AS (SELECT EXTRACT(year FROM day) FROM "), short, F.lit(") SELECT * FROM mine JOIN mine m ON m.a IS NOT DISTINCT FROM b"))
    other = t.orders.where(key % 3 > 0).select(key.alias("query_id"), sql.alias("sql"))
    return tools.outside_reads(log.select("query_id", "sql").unionByName(other), log.where("c_acctbal >= 0").select("full_name"))


@query("query_scan_relations", """SELECT o_orderkey AS query_id, unnest(['payroll', 'hr.' || lower(o_orderstatus), 'deep']) AS object FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, unnest(['t' || o_custkey, 'c.d.e', 'x']) FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT o_orderkey, 'a.b.z' FROM orders WHERE o_orderkey % 3 = 2""")
def query_scan_relations(t):
    """Statements with lists of relations, comments, quoted names, subqueries and functions that have a FROM of their own."""
    key, third = F.col("o_orderkey"), F.col("o_orderkey") % 3
    listed = F.concat(F.lit("SELECT a FROM a.b.c x, payroll /* , hidden */, hr."), F.lower("o_orderstatus"),
                      F.lit(" -- , gone\n WHERE k IN (SELECT k FROM (SELECT 'FROM quoted, names' AS k FROM deep), a.b.c) AND n IN (1, 2)"))
    nested = F.concat(F.lit("WITH mine AS (SELECT EXTRACT(day FROM d) AS d FROM (a.b.c JOIN `t"), F.col("o_custkey").cast("string"),
                      F.lit("` ON f(p, q) = 1), c.d.e), yours AS (SELECT * FROM mine) SELECT TRIM(both FROM s), row FROM yours, mine m, x LATERAL VIEW explode(l) v ORDER BY a, b"))
    called = F.lit("SELECT a, z FROM range(3) r, a.b.c TABLESAMPLE (10 PERCENT) JOIN a . `b` . z USING (k, l) WHERE p IS NOT DISTINCT FROM q UNION SELECT 1, 2")
    log = t.orders.select(key.alias("query_id"), F.when(third == 0, listed).when(third == 1, nested).otherwise(called).alias("sql"))
    return tools.outside_reads(log, t.spark.createDataFrame([("a.b.c",)], "full_name STRING"))


@query("statement_problems", """SELECT o_orderkey AS query_id, 'not a SELECT' AS problem FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'writes' FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'more than one statement' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def statement_problems(t):
    return tools.statement_problems(query_log(t).select("query_id", "sql"))


@query("measure_coverage", """WITH m AS (SELECT DISTINCT p_brand AS view, p_name AS measure FROM part),
  q AS (SELECT CASE WHEN p_size > 48 AND p_type = 'PROMO' THEN 'select measure(' || upper(p_name) || ') from ' || p_brand ELSE 'select p_size from part where p_partkey = ' || p_partkey END AS sql FROM part)
  SELECT view, measure FROM m WHERE NOT EXISTS (SELECT 1 FROM q WHERE contains(lower(sql), lower(view)))
    OR NOT EXISTS (SELECT 1 FROM q WHERE contains(lower(sql), lower(measure)))""")
def measure_coverage(t):
    """A question per part; those of few parts ask for a measure, the others for a column."""
    measures = t.part.select(F.col("p_brand").alias("view"), F.col("p_name").alias("measure")).distinct()
    named = F.concat(F.lit("select measure("), F.upper("p_name"), F.lit(") from "), F.col("p_brand"))
    plain = F.concat(F.lit("select p_size from part where p_partkey = "), F.col("p_partkey").cast("string"))
    asked = t.part.select(F.when(F.expr("p_size > 48 AND p_type = 'PROMO'"), named).otherwise(plain).alias("sql"))
    return evaluate.measure_coverage(measures, asked)
