"""Bronze to silver to gold: typed rows, latest per key, upsert, and the four marts."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Silver entities, their raw source, key and typed columns (name: (expression, type)).
SILVER = {
    "region": ("regions", "region_code", {
        "region_code": ("region_code", "string"), "region_name": ("region_name", "string"),
        "country": ("country", "string")}),
    "product": ("products", "product_id", {
        "product_id": ("product_id", "bigint"), "product_name": ("product_name", "string"),
        "category": ("category", "string"), "list_price": ("list_price", "decimal(10,2)")}),
    "customer": ("customers", "customer_id", {
        "customer_id": ("customer_id", "bigint"), "customer_name": ("customer_name", "string"),
        "email": ("lower(email)", "string"), "phone": ("phone", "string"), "segment": ("segment", "string"),
        "region_code": ("region_code", "string"), "created_date": ("created_date", "date")}),
    "orders": ("orders", "order_id", {
        "order_id": ("order_id", "bigint"), "customer_id": ("customer_id", "bigint"),
        "product_id": ("product_id", "bigint"), "order_date": ("order_date", "date"), "quantity": ("quantity", "int"),
        "unit_price": ("unit_price", "decimal(10,2)"), "region_code": ("region_code", "string"),
        "status": ("status", "string")}),
    "shipment": ("shipments", "shipment_id", {
        "shipment_id": ("shipment_id", "bigint"), "order_id": ("order_id", "bigint"), "ship_date": ("ship_date", "date"),
        "units_ordered": ("units_ordered", "int"), "units_shipped": ("units_shipped", "int"),
        "carrier": ("carrier", "string")}),
    "returns": ("returns", "return_id", {
        "return_id": ("return_id", "bigint"), "order_id": ("order_id", "bigint"), "return_date": ("return_date", "date"),
        "units_returned": ("units_returned", "int"), "reason": ("reason", "string"),
        "resolution": ("resolution", "string")}),
}
CANCELLED = "cancelled"


def _typed(expr: str, dtype: str) -> Column:
    value = F.expr(expr)
    return value if dtype == "string" else value.try_cast(dtype)


def typed(df: DataFrame, columns: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Cast strings to their declared types; what cannot be read becomes null instead of ending the job."""
    return df.select(*[_typed(e, t).alias(name) for name, (e, t) in columns.items()], *keep)


def cast_failures(df: DataFrame, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """column_name, failures: values that are present but not readable as the declared type, counted in one scan."""
    lost = {n: F.count_if(F.expr(e).isNotNull() & _typed(e, t).isNull()) for n, (e, t) in columns.items()}
    one = df.agg(*[c.alias(n) for n, c in lost.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("failures")) for n in lost])
    return one.select(F.inline(pairs))


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: str, ties: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``newest`` per key, ``ties`` deciding among equals.

    An aggregate rather than a ranking window: map tasks keep one candidate per key, so a key that holds a large part
    of the table is never sorted in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(newest, *ties))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c)
                                                              for c in df.columns])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], stamp: Column | None = None,
           stamp_column: str = "_updated_at", newest: str | None = None) -> DataFrame:
    """Source rows replace target rows with the same key; the rest of both stays, and so do columns only one side has.

    A source that repeats a key is folded to its row with the greatest ``newest``; without that order the merge fails when it
    runs. A null key meets a null key, so a repeated merge changes nothing; without ``newest`` all source rows with a null in
    their key stay. Only the source is stamped. The target is joined on its keys as they are, so a target that is bucketed by
    them is not shuffled; its rows with a null in their key meet the distinct such keys of the source apart.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if newest is not None:
        source = latest_per_key(source, keys, newest, [c for c in source.columns if c not in (*keys, newest)])
    else:
        repeated = source.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")).scalar()
        source = source.where(F.when(repeated > 0, F.raise_error(F.lit("the source of a merge repeats a key")).cast("boolean")).otherwise(True))
    untouched = target.where(whole).join(source.where(whole).select(*keys), list(keys), "left_anti")
    nulls = source.where(~whole).select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    untouched = untouched.unionByName(target.where(~whole).join(nulls, same, "left_anti"))
    incoming = source if stamp is None else source.withColumn(stamp_column, stamp)
    return untouched.unionByName(incoming, allowMissingColumns=True)


def silver_rows(raw: DataFrame, entity: str) -> DataFrame:
    """Typed rows of one declared entity, the newest per key; the source file breaks ties in ingest time."""
    _, key, columns = SILVER[entity]
    rows = typed(raw, columns, keep=["_ingest_ts", "_source_file"])
    return latest_per_key(rows, [key], "_ingest_ts", ["_source_file", *[c for c in columns if c != key]]).drop("_ingest_ts", "_source_file")


# ---------------------------------------------------------------- gold
def sales_mart(orders: DataFrame, product: DataFrame, region: DataFrame, amount: str = "quantity * unit_price",
               cancelled: str = CANCELLED) -> DataFrame:
    """Orders, units and revenue per day, region and product, without cancelled orders."""
    lines = orders.where(F.col("status") != cancelled)
    return (lines.join(region.select("region_code", "region_name"), "region_code")
            .join(product.select("product_id", "product_name", "category"), "product_id")
            .groupBy("order_date", "region_name", "product_name", "category")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("quantity").cast("bigint")).alias("units"),
                 F.sum(F.expr(amount)).alias("revenue")))


def fill_mart(shipment: DataFrame, orders: DataFrame, product: DataFrame, region: DataFrame) -> DataFrame:
    """Units ordered and shipped, and their ratio of sums, per ship day, region and product."""
    return (shipment.join(orders, "order_id")
            .join(region.select("region_code", "region_name"), "region_code")
            .join(product.select("product_id", "product_name"), "product_id")
            .groupBy("ship_date", "region_name", "product_name")
            .agg(F.sum(F.col("units_ordered").cast("bigint")).alias("units_ordered"),
                 F.sum(F.col("units_shipped").cast("bigint")).alias("units_shipped"))
            .withColumn("fill_rate", F.try_divide("units_shipped", "units_ordered")))


def customer_view(customer: DataFrame, region: DataFrame, orders: DataFrame, amount: str = "quantity * unit_price",
                  cancelled: str = CANCELLED) -> DataFrame:
    """Every customer with lifetime orders, revenue (0 when none) and last order, cancelled orders apart.

    Orders are summed per customer before they meet the customer table.
    """
    totals = (orders.where(F.col("status") != cancelled).groupBy("customer_id")
              .agg(F.count("order_id").alias("lifetime_orders"), F.sum(F.expr(amount)).alias("lifetime_revenue"),
                   F.max("order_date").alias("last_order_date")))
    return (customer.join(region.select("region_code", "region_name"), "region_code")
            .join(totals, "customer_id", "left")
            .select("customer_id", "customer_name", "segment", "region_name",
                    F.coalesce("lifetime_orders", F.lit(0).cast("bigint")).alias("lifetime_orders"),
                    F.coalesce("lifetime_revenue", F.lit(0)).alias("lifetime_revenue"), "last_order_date"))


def returns_mart(returns: DataFrame, orders: DataFrame, product: DataFrame, region: DataFrame,
                 amount: str = "units_returned * unit_price") -> DataFrame:
    """Returns, units and value at the original price per day, region, product and reason."""
    return (returns.join(orders, "order_id")
            .join(region.select("region_code", "region_name"), "region_code")
            .join(product.select("product_id", "product_name"), "product_id")
            .groupBy("return_date", "region_name", "product_name", "reason")
            .agg(F.count(F.lit(1)).alias("returns"), F.sum(F.col("units_returned").cast("bigint")).alias("units_returned"),
                 F.sum(F.expr(amount)).alias("returned_value")))
