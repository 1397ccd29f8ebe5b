"""Prepared tables of one input folder, staged once and shared by all models."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastemill.functions.encode import category_code, multi_hot_array, with_min_max
from tastemill.functions.vectors import unit
from tastemill.operators import baskets, features, mean_shift, split
from tastemill.session import stage, tune
from tastemill.sources import tables

_OPEN: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, folder: str) -> "Workspace":
    """The folder's workspace in this application; a new one once its files have changed."""
    key, state = (tune(spark).sparkContext.applicationId, folder), _state(spark, folder)
    if key not in _OPEN or _OPEN[key].state != state:
        _OPEN[key] = Workspace(spark, folder)
        _OPEN[key].state = state
    return _OPEN[key]


def forget() -> None:
    """Drop all workspaces, so that the next query prepares its tables anew."""
    _OPEN.clear()


def _state(spark: SparkSession, folder: str) -> list:
    """Names, sizes and times of the tables in the folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(path))


class RatingSet:
    """A ratings table with its time split and what follows from it."""

    def __init__(self, name: str, ratings: DataFrame):
        self.name, self.source = name, ratings

    def _stage(self, df: DataFrame, label: str) -> DataFrame:
        return stage(df, f"{self.name}-{label}")

    @cached_property
    def ratings(self) -> DataFrame:
        return self._stage(self.source, "ratings")

    @cached_property
    def cut(self) -> DataFrame:
        return self._stage(split.with_cut(self.ratings), "cut")

    @property
    def old(self) -> DataFrame:
        return split.old_part(self.cut)

    @property
    def new(self) -> DataFrame:
        return split.new_part(self.cut)

    @cached_property
    def centred(self) -> DataFrame:
        return self._stage(split.centred(self.old), "centred")

    @cached_property
    def means(self) -> DataFrame:
        return self._stage(split.user_means(self.old), "means")

    @cached_property
    def recent(self) -> DataFrame:
        return self._stage(split.recent_items(self.old), "recent")

    @cached_property
    def users(self) -> DataFrame:
        return self._stage(self.ratings.select("user_id").distinct(), "users")

    @cached_property
    def items(self) -> DataFrame:
        return self._stage(self.ratings.select("item_id").distinct(), "items")


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return tables.load(self.spark, self.folder, name)

    @cached_property
    def orders(self) -> RatingSet:
        return RatingSet("orders", tables.order_ratings(self.spark, self.folder))

    @cached_property
    def events(self) -> RatingSet:
        return RatingSet("events", tables.event_ratings(self.spark, self.folder))

    @cached_property
    def brands(self) -> RatingSet:
        return RatingSet("brands", tables.brand_ratings(self.spark, self.folder))

    @cached_property
    def gap_baskets(self) -> DataFrame:
        return stage(baskets.gap_baskets(self.orders.old, 25), "gap-baskets")

    @cached_property
    def shift_baskets(self) -> DataFrame:
        return stage(mean_shift.mean_shift_baskets(self.orders.old, 25), "shift-baskets")

    @cached_property
    def shift_brands(self) -> DataFrame:
        return stage(mean_shift.mean_shift_baskets(self.brands.old, 25), "shift-brands")

    @cached_property
    def topic_vectors(self) -> DataFrame:
        return stage(tables.topic_vectors(self.spark, self.folder), "topic-vectors")

    @cached_property
    def brand_baskets(self) -> DataFrame:
        return stage(tables.brand_baskets(self.spark, self.folder), "brand-baskets")

    @property
    def items(self) -> DataFrame:
        return tables.items(self.spark, self.folder)

    @property
    def users(self) -> DataFrame:
        return tables.users(self.spark, self.folder)

    @cached_property
    def imputed(self) -> DataFrame:
        genres = multi_hot_array(F.col("genres"), tables.PART_TYPES)
        typed = self.items.select("item_id", genres.alias("genre_vec"))
        return stage(features.impute(typed, tables.tag_vectors(self.spark, self.folder)), "imputed")

    @cached_property
    def item_vectors(self) -> DataFrame:
        return stage(features.unit_vectors(self.imputed), "item-vectors")

    @property
    def scaled_users(self) -> DataFrame:
        coded = self.users.withColumn("segment", category_code(F.col("segment"), tables.SEGMENTS))
        return with_min_max(coded, ["balance", "nation"])

    @cached_property
    def user_vectors(self) -> DataFrame:
        raw = F.array(F.col("segment").cast("double"), "balance", "nation")
        return stage(self.scaled_users.select("user_id", unit(raw).alias("vec")), "user-vectors")

    @property
    def vector_size(self) -> int:
        return len(tables.PART_TYPES) + tables.VECTOR_SIZE
