"""The given tables seen as the silver tables and marts the operators work on, and the same in SQL for the checks."""
from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import medallion
from ..sources.tables import Tables

AMOUNT = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
CANCELLED = "P"
NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def silver(t: Tables) -> SimpleNamespace:
    """Region, product, customer, order headers (with region), order lines, shipments and returns."""
    region = t.region.select(F.col("r_regionkey").alias("region_code"), F.col("r_name").alias("region_name"))
    product = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("product_name"),
                            F.col("p_type").alias("category"))
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").alias("region_code"))
    customer = (t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                        F.col("c_mktsegment").alias("segment"), "region_code"))
    orders = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                             F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
                             F.col("o_orderpriority").alias("reason"),
                             F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    headers = orders.drop("amount").join(customer.select("customer_id", "region_code"), "customer_id")
    line = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                             F.col("l_quantity").cast("bigint").alias("quantity"), F.expr(AMOUNT).alias("amount"),
                             F.to_date("l_shipdate").alias("ship_date"), F.col("l_linestatus").alias("line_status"),
                             F.col("l_returnflag").alias("return_flag"))
    lines = line.join(headers, "order_id")
    shipment = line.select("order_id", "product_id", "ship_date", F.col("quantity").alias("units_ordered"),
                           F.when(F.col("line_status") == "F", F.col("quantity")).otherwise(0).alias("units_shipped"))
    returns = line.where(F.col("return_flag") == "R").select(
        "order_id", "product_id", F.col("ship_date").alias("return_date"), F.col("quantity").alias("units_returned"), "amount")
    return SimpleNamespace(region=region, product=product, customer=customer, orders=orders, headers=headers, lines=lines,
                           shipment=shipment, returns=returns)


def sales_daily(t: Tables) -> DataFrame:
    s = silver(t)
    return medallion.sales_mart(s.lines, s.product, s.region, "amount", CANCELLED)


def fill_daily(t: Tables) -> DataFrame:
    s = silver(t)
    return medallion.fill_mart(s.shipment, s.headers, s.product, s.region)


def returns_daily(t: Tables) -> DataFrame:
    s = silver(t)
    return medallion.returns_mart(s.returns, s.headers, s.product, s.region, "amount")


def customer_360(t: Tables) -> DataFrame:
    s = silver(t)
    return medallion.customer_view(s.customer, s.region, s.orders, "amount", CANCELLED)


# The same in SQL, written apart from the plans above.
_FACT = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey"""
SALES_SQL = f"""SELECT CAST(o_orderdate AS DATE) AS order_date, r_name AS region_name, p_brand AS product_name,
  p_type AS category, COUNT(*) AS orders, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, SUM({AMOUNT}) AS revenue
  FROM {_FACT} WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4"""
FILL_SQL = f"""SELECT CAST(l_shipdate AS DATE) AS ship_date, r_name AS region_name, p_brand AS product_name,
  CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_ordered,
  CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS units_shipped
  FROM {_FACT} GROUP BY 1, 2, 3"""
RETURNS_SQL = f"""SELECT CAST(l_shipdate AS DATE) AS return_date, r_name AS region_name, p_brand AS product_name,
  o_orderpriority AS reason, COUNT(*) AS returns, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units_returned,
  SUM({AMOUNT}) AS returned_value FROM {_FACT} WHERE l_returnflag = 'R' GROUP BY 1, 2, 3, 4"""
CUSTOMER_SQL = """SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, r_name AS region_name,
  COUNT(o_orderkey) AS lifetime_orders, COALESCE(SUM(CAST(o_totalprice AS DECIMAL(12,2))), 0) AS lifetime_revenue,
  CAST(MAX(o_orderdate) AS DATE) AS last_order_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4"""
