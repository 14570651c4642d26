"""Stores built from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store

EVENT_LABELS = ["user_id", "event_type"]
BUCKETS = (10, 20, 30, 40, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Whole milliseconds, rounded down; a timestamp without zone is read in the session's, which must be UTC."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


def _stamp(rows: DataFrame, name: str) -> str | None:
    """``name`` if it holds timestamps without zone, by whose bounds files can be pruned."""
    return name if rows.schema[name].dataType.typeName() == "timestamp_ntz" else None


def event_value(spark: SparkSession, sf_dir: str) -> Store:
    """Gauge ``event_value{user_id,event_type}``."""
    rows = table(spark, sf_dir, "events").select("ts", "value", *EVENT_LABELS)
    return Store.of_columns(rows, "event_value", EVENT_LABELS, millis(F.col("ts")), F.col("value"), raw=_stamp(rows, "ts"))


def events_total(spark: SparkSession, sf_dir: str) -> Store:
    """Counter ``events_total{user_id,event_type}``: events of the series so far."""
    rows = table(spark, sf_dir, "events").select("ts", "event_id", *EVENT_LABELS)
    so_far = F.row_number().over(Window.partitionBy(*EVENT_LABELS).orderBy("ts", "event_id")).cast("double")
    return Store.of_columns(rows.withColumn("n", so_far), "events_total", EVENT_LABELS, millis(F.col("ts")), F.col("n"))


def quantity_buckets(spark: SparkSession, sf_dir: str) -> Store:
    """Histogram ``lineitem_quantity_bucket{l_returnflag,le}``: lines shipped on a day, by quantity."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_quantity")
    le = F.array(*[F.when(F.col("l_quantity") <= b, F.lit(str(b))) for b in BUCKETS], F.lit("+Inf"))
    counted = rows.select("l_returnflag", "l_shipdate", F.explode(F.array_compact(le)).alias("le")).groupBy("l_returnflag", "l_shipdate", "le").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return Store.of_columns(counted, "lineitem_quantity_bucket", ["l_returnflag", "le"], millis(F.col("l_shipdate")), F.col("n"))


def order_price(spark: SparkSession, sf_dir: str) -> Store:
    """Gauge ``order_price{o_orderpriority,o_orderstatus}``: the total price of a day's orders."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus", "o_orderdate").agg(F.sum("o_totalprice").alias("price"))
    return Store.of_columns(rows, "order_price", ["o_orderpriority", "o_orderstatus"], millis(F.col("o_orderdate")), F.col("price"))
