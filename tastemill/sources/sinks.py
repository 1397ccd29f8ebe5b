"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tastemill.operators.index import dense_index
from tastemill.operators.skew import lookup, sizes_of
from tastemill.session import stage


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_dat(df: DataFrame, path: str, sep: str = "::") -> None:
    """Headerless text with a multi-character separator."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).write.mode("overwrite").text(path)


# Column labels of one block of an exported matrix, and cells that one of its files is meant to hold.
BLOCK_LABELS = 1000
PART_CELLS = 1_000_000


def long_to_matrix(df: DataFrame, row: str, column: str, value: str, labels: list | None = None) -> DataFrame:
    """Long rows to a labelled matrix with one column per label.

    For one block of columns; ``write_matrix`` cuts wider matrices into blocks.
    """
    return df.groupBy(row).pivot(column, labels).agg(F.first(value))


def write_matrix(
    df: DataFrame, path: str, row: str, column: str, value: str, labels: list | None = None, block: int = BLOCK_LABELS
) -> None:
    """Labelled matrix as CSV, in blocks of at most ``block`` columns.

    With ``labels`` (no more than ``block``) it is one set of files at ``path``. Otherwise the
    labels are numbered, each block goes to ``path/blocks/block=<number>/part=<number>`` with its own
    rows, each file under the block's header, and ``path/labels`` holds the numbers of the blocks.
    All blocks are written by one job, as the number of blocks grows with the columns.
    """
    if labels is not None and len(labels) <= block:
        return write_table(long_to_matrix(df, row, column, value, labels), path, "csv")
    inside = Window.partitionBy("_block").orderBy(column)
    places = dense_index(df, column, name="_at").select(column, F.floor(F.col("_at") / block).alias("_block"))
    places = stage(places.withColumn("_at", F.row_number().over(inside) - 1), "labels")
    write_table(places.select(column, F.col("_block").alias("block")), f"{path}/labels")
    cells = stage(lookup(df.select(row, column, value), places, column, [row]), "matrix-cells")
    blocks = sizes_of(cells, "_block").select("_block", F.ceil(F.col("n") / PART_CELLS).cast("int").alias("_parts"))
    blocks = stage(blocks.join(sizes_of(places, "_block").withColumnRenamed("n", "_width"), "_block"), "matrix-blocks")

    part = F.pmod(F.xxhash64(row), F.col("_parts")).cast("int")  # of the lines of a block
    lines = lookup(cells, blocks, "_block", [row]).select(
        "_block", part.alias("_part"), F.lit(1).alias("_line"), row, "_width", "_at", F.col(value).cast("string").alias("_text")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    headers = places.join(blocks, "_block").select(
        "_block", every.alias("_part"), F.lit(0).alias("_line"), F.lit(None).alias(row), "_width", "_at", F.col(column).cast("string").alias("_text")
    )
    line = ["_block", "_part", "_line", row, "_width"]
    # a part is dealt to a task once, which then forms its lines and sorts them below the header
    dealt = lines.unionByName(headers).repartition("_block", "_part")
    dealt = dealt.groupBy(*line, "_at").agg(F.first("_text").alias("_text"))
    dealt = dealt.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_cells"))
    last = lambda i: F.when(i > 0, F.col("_cells")[i - 1]["_at"]).otherwise(F.lit(-1))
    filled = F.transform("_cells", lambda c, i: F.concat(F.repeat(F.lit(","), c["_at"] - last(i)), F.coalesce(c["_text"], F.lit(""))))
    rest = F.repeat(F.lit(","), (F.col("_width") - 1 - F.element_at("_cells", -1)["_at"]).cast("int"))
    name = F.when(F.col("_line") == 0, F.lit(row)).otherwise(F.coalesce(F.col(row).cast("string"), F.lit("")))
    text = dealt.sortWithinPartitions("_block", "_part", "_line", row).select(
        F.col("_block").alias("block"), F.col("_part").alias("part"), F.concat(name, F.array_join(filled, ""), rest).alias("value")
    )
    text.write.mode("overwrite").partitionBy("block", "part").text(f"{path}/blocks")


def copy_table(source: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(source, path, fmt)
