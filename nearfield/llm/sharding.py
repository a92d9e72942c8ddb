"""Contiguous shards of near-equal byte size, with DataFrame operations alone.

Rows are range-partitioned by key once and stored with their partition's
number. Each partition's totals (one row each) are summed up in order, which
gives every partition the bytes and rows before it; a window inside the
partition adds the rest. A document goes to the shard in whose equal share of
all bytes its middle byte lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_frame, stored


def byte_shards(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for every row.

    size is the text's UTF-8 bytes plus 1 (null text: 1). Shards are contiguous
    in ascending key (null first; equal keys by checksum, then size), so their
    sizes differ from the target by less than the largest document. slot counts
    a shard's rows from 0 without gaps. grown_shard is null: this law does not
    promise that rows stay when shards are added. Equal texts are not held
    together: copies may hold a third of all bytes, and the sizes come first.
    An empty table gives an empty result; extra columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = key_frame(df, key, text).select(
        F.col(key).alias("k"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("crc"),
    )
    rows = rows.repartitionByRange("k", "crc", "size").sortWithinPartitions("k", "crc", "size")
    rows = stored(rows.withColumn("part", F.spark_partition_id()), "shards")

    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    every = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(every).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("k", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("size_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rows_inside", F.row_number().over(Window.partitionBy("part").orderBy("k", "crc", "size")) - 1)
        .join(F.broadcast(offsets), "part")  # as many rows as shuffle partitions
        .withColumn("row", F.col("rows_before") + F.col("rows_inside"))
        .withColumn("twice_middle", 2 * (F.col("size_before") + F.col("size_inside")) + F.col("size"))
        .withColumn("shard", F.expr(f"least({shards - 1}, (twice_middle * {shards}) div (2 * total))").cast("int"))
    )
    placed = stored(placed.select("k", "size", "crc", "shard", "row"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
