"""Landed files to gold, twice: typed, deduplicated, merged, and the marts of the declared schema."""
import datetime as dt
from decimal import Decimal

from plumbline.plans import build
from plumbline.session import scratch

FIRST = {
    "regions": ("region_code,region_name,country", ["EN,Europe North,SE", "LA,Latin America,BR"]),
    "products": ("product_id,product_name,category,list_price", ["1,Edge,Compute,10.50", "2,Wall,Security,20"]),
    "customers": ("customer_id,customer_name,email,phone,segment,region_code,created_date",
                  ["1,Ann,ANN@X.COM,1,Enterprise,EN,2026-01-01", "1,Ann,ANN@X.COM,1,Enterprise,EN,2026-01-01", "2,Bo,bo@x.com,2,SMB,LA,2026-01-02"]),
    "orders": ("order_id,customer_id,product_id,order_date,quantity,unit_price,region_code,status",
               ["1,1,1,2026-06-01,2,10.50,EN,shipped", "2,1,2,2026-06-01,1,20.00,EN,cancelled", "3,1,1,2026-06-01,x,10.50,EN,open"]),
    "shipments": ("shipment_id,order_id,ship_date,units_ordered,units_shipped,carrier", ["1,1,2026-06-02,3,2,DHL"]),
    "returns": ("return_id,order_id,return_date,units_returned,reason,resolution", ["1,1,2026-06-09,1,damaged,refund"]),
}
SECOND = {**FIRST, "customers": (FIRST["customers"][0], ["2,Bo Berg,BO@x.com,2,SMB,LA,2026-01-02", "3,Cy,cy@x.com,3,SMB,EN,2026-02-01"]),
          "orders": (FIRST["orders"][0], ["3,1,1,2026-06-01,4,10.50,EN,open"])}


def land(spark, root, files, only=None):
    for name, (header, lines) in files.items():
        if only is None or name in only:
            data = spark.createDataFrame([(line,) for line in [header, *lines]], "value STRING").coalesce(1)
            data.write.mode("append").text(f"{root}/landing/{name}")


def test_two_loads(spark, rows):
    root = scratch(spark, "product")
    land(spark, root, FIRST)
    build.load_bronze(spark, f"{root}/landing", root, "one")
    build.build_silver(spark, root, buckets=3)
    gold = build.build_gold(spark, root)
    assert rows(gold["sales_daily"], "region_name", "product_name", "orders", "units", "revenue") == [("Europe North", "Edge", 2, 2, Decimal("21.00"))]
    land(spark, root, SECOND, only=("customers", "orders"))
    build.load_bronze(spark, f"{root}/landing", root, "two")
    for run in ("two", "two", None):  # what the run loaded, the same again, and all of bronze
        build.build_silver(spark, root, run, buckets=3)
    gold = build.build_gold(spark, root)
    assert rows(spark.read.parquet(f"{root}/silver/customer"), "customer_id", "customer_name", "email") == [
        (1, "Ann", "ann@x.com"), (2, "Bo Berg", "bo@x.com"), (3, "Cy", "cy@x.com")]
    assert rows(gold["sales_daily"], "orders", "units", "revenue") == [(2, 6, Decimal("63.00"))]
    assert rows(gold["shipment_fill_daily"], "units_ordered", "units_shipped", "fill_rate") == [(3, 2, Decimal("0.6667"))]
    assert rows(gold["returns_daily"], "reason", "returns", "returned_value") == [("damaged", 1, Decimal("10.50"))]
    assert rows(gold["customer_360"], "customer_id", "lifetime_orders", "lifetime_revenue", "last_order_date") == [
        (1, 2, Decimal("63.00"), dt.date(2026, 6, 1)), (2, 0, Decimal("0.00"), None), (3, 0, Decimal("0.00"), None)]
