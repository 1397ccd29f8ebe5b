"""The engine's input tables as views over the star-schema Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.functions.encode import epoch_seconds
from tastemill.functions.vectors import unit
from tastemill.operators.skew import lookup

# The categories of the star schema.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SEGMENTS = {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 4}
VECTOR_SIZE = 64


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def order_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Customers rate parts: 1..5 from the largest quantity bought, at the last order."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", epoch_seconds("o_orderdate").alias("ts"))
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"))
        .agg(
            F.ceil(F.max("l_quantity") / 10).cast("double").alias("rating"),
            F.max("ts").alias("ts"),
        )
    )


def event_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Users rate topics: the largest event value, at the last event, over all event types."""
    events = load(spark, folder, "events")
    return (
        events.select(
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            "value",
            epoch_seconds("ts").alias("ts"),
        )
        .groupBy("user_id", "item_id")
        .agg(F.max("value").alias("rating"), F.max("ts").alias("ts"))
    )


def topic_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, vec): how a topic's mean value per event type differs from the mean of all events."""
    events = load(spark, folder, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item_id"), "event_type", "value")
    overall = events.agg(F.avg("value")).scalar()
    means = events.groupBy("item_id", "event_type").agg((F.avg("value") - overall).alias("_m"))
    cells = [F.coalesce(F.max(F.when(F.col("event_type") == t, F.col("_m"))), F.lit(0.0)) for t in EVENT_TYPES]
    return means.groupBy("item_id").agg(F.array(*cells).alias("_raw")).select("item_id", unit(F.col("_raw")).alias("vec"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("genres"),
    )


def tag_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("tags")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation"),
    )


def _brand_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    brand = F.substring("p_brand", 7, 20).cast("long").alias("item_id")
    part = load(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), brand)
    # a part in very many lines is spread over several tasks
    return lookup(lines, part, "l_partkey", ["l_orderkey"])


def brand_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Customers rate brands (by number), as in ``order_ratings``."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey", epoch_seconds("o_orderdate").alias("ts"))
    return (
        _brand_lines(spark, folder)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), "item_id")
        .agg(F.ceil(F.max("l_quantity") / 10).cast("double").alias("rating"), F.max("ts").alias("ts"))
    )


def brand_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Brands per order, as (basket_id, item_id) rows."""
    orders = load(spark, folder, "orders").select("o_orderkey")
    return (
        _brand_lines(spark, folder)
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        .select(F.col("l_orderkey").alias("basket_id"), "item_id")
        .distinct()
    )
