"""Sharding: contiguous shards of near equal bytes from global prefix sums.

Rows are laid out in ranges of (id, checksum, size); each range's total gives the bytes before
it, a running sum gives the bytes before each row, and the shard is where the row's middle falls
among equal targets. Ranges are cut by sampled quantiles over all three columns, so a repeated id or
many small rows make no large range. Only one row per range meets in one task.

Defined cases: a null text has no bytes and checksum 0; a null id comes first. Equal rows have
an arbitrary but fixed order. An empty table gives no rows. Columns beyond id and text are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlog.session import shared_folder

SHARDS = 16


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every document."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    # texts are read once; the rest works on three numbers a row
    slim = _written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{folder}/sizes",
    )
    order = ["doc_id", "text_crc32", "size", "row"]
    # written, so that totals and rows see the same ranges
    ranged = _written(
        slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id()),
        f"{folder}/ranges",
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "range",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("all_bytes"),
        )
    )
    within = Window.partitionBy("range").orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bytes_before") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    # one row per range: as few as there are shuffle partitions
    placed = ranged.join(F.broadcast(ranges), "range").select(
        "doc_id",
        "size",
        "text_crc32",
        start.alias("start"),
        "all_bytes",
        (F.col("rows_before") + F.row_number().over(within) - 1).alias("place"),
    )
    cut = placed.withColumn(
        "shard", F.expr(f"cast(((2 * start + size) * {shards}) div (2 * all_bytes) as int)")
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))
    # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot")
    )


def sharded_documents(docs: DataFrame) -> DataFrame:
    return assign(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
