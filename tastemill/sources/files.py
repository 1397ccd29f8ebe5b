"""Readers for the file formats of the input data and of exported matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tastemill import schema as S
from tastemill.operators.skew import lookup


def read_dat(
    spark: SparkSession, path: str, layout: T.StructType, sep: str = "::", encoding: str = "UTF-8"
) -> DataFrame:
    """Headerless text with a multi-character separator; quotes are ordinary characters."""
    return (
        spark.read.schema(layout)
        .option("sep", sep)
        .option("header", False)
        .option("quote", "")
        .option("encoding", encoding)
        .csv(path)
    )


def read_csv(spark: SparkSession, path: str, layout: T.StructType) -> DataFrame:
    """CSV with a header line, read with a fixed layout."""
    return spark.read.schema(layout).option("header", True).csv(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return read_dat(spark, path, S.USERS)


def read_items(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    return read_dat(spark, path, S.ITEMS, encoding=encoding)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_dat(spark, path, S.RATINGS)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    raw = T.StructType([T.StructField("tagId", T.LongType()), T.StructField("tag", T.StringType())])
    return read_csv(spark, path, raw).withColumnsRenamed({"tagId": "tag_id"})


def read_tag_scores(spark: SparkSession, path: str) -> DataFrame:
    raw = T.StructType(
        [
            T.StructField("movieId", T.LongType()),
            T.StructField("tagId", T.LongType()),
            T.StructField("relevance", T.DoubleType()),
        ]
    )
    return read_csv(spark, path, raw).withColumnsRenamed({"movieId": "item_id", "tagId": "tag_id"})


def matrix_to_long(wide: DataFrame, row: str, column: str, value: str, kind: str = "double") -> DataFrame:
    """Labelled matrix (one column per column label) to long rows without the empty cells."""
    labels = {c: str(int(float(c))) for c in wide.columns if c != row}
    cells = wide.select(
        F.col(row).cast("long").alias(row), *[F.col(f"`{c}`").cast("double").cast(kind).alias(label) for c, label in labels.items()]
    )
    return (
        cells.unpivot(row, list(labels.values()), column, value)
        .where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .withColumn(column, F.col(column).cast("long"))
    )


def read_matrix(spark: SparkSession, path: str, row: str, column: str, value: str, kind: str = "double") -> DataFrame:
    """Wide CSV export, first column = row label, header = column labels."""
    wide = spark.read.option("header", True).csv(path)
    return matrix_to_long(wide.withColumnRenamed(wide.columns[0], row), row, column, value, kind)


def read_matrix_blocks(spark: SparkSession, path: str, row: str, column: str, value: str, kind: str = "double") -> DataFrame:
    """A matrix that was written in blocks of columns, as long rows; all blocks are read by one job.

    Each file has its block's header, a line whose first cell is no number.
    """
    if spark.read.parquet(f"{path}/labels").isEmpty():
        return spark.createDataFrame([], f"{row} long, {column} long, {value} {kind}")
    lines = spark.read.text(f"{path}/blocks").select("block", "value", F.split("value", ",").alias("_cells"))
    header = (F.col("_cells")[0] != "") & F.col("_cells")[0].try_cast("double").isNull()
    label = lambda c: F.coalesce(c.try_cast("long"), c.try_cast("double").cast("long"))
    labels = lines.where(header).groupBy("block").agg(F.first("_cells").alias("_labels"))
    labels = labels.select("block", F.transform("_labels", label).alias("_labels"))
    both = lookup(lines.where(~header), labels, "block", ["value"])
    number = F.when(F.col("_cells")[0] != "", F.col("_cells")[0]).cast("long")
    cells = both.select(number.alias(row), F.explode(F.arrays_zip("_labels", "_cells")).alias("_c"))
    cells = cells.where(F.col("_c._labels").isNotNull() & (F.col("_c._cells") != ""))
    cells = cells.select(row, F.col("_c._labels").alias(column), F.col("_c._cells").cast("double").alias("_x"))
    return cells.where(~F.isnan("_x")).select(row, column, F.col("_x").cast(kind).alias(value))


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
