"""Sharding: contiguous shards of near-equal bytes from global prefix sums.

Rows are ordered by (id, size, checksum); each range partition gives its totals, the totals' prefix sums
give every row its global byte offset, and equal byte targets cut the order into contiguous shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, staged, table, unsigned_crc

OVERHEAD = 8
SHARDS = 24


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size (UTF-8 bytes plus the record's overhead; null text: none) and checksum: no text travels further."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        unsigned_crc(text).alias("text_crc32"),
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: every row of ``docs`` in one of ``n_shards`` shards.

    A row goes to the shard in which the middle of its byte span falls, so shards differ by one row's size at
    most around their targets, and a row larger than a target has a shard for itself or shares one; then others
    may be empty. Null ids come first; repeated rows keep their copies and are told apart by position alone;
    an empty table gives no rows. A middle that falls on a border belongs to the later shard. Of texts only sizes and
    checksums are read, however long. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    order = ["doc_id", "size", "text_crc32"]
    n = partitions(spark)
    ranged = sized(docs, id_col, text_col).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "shard-order")
    # One row for each partition: bounded by the number of partitions, whatever the input.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("r")).collect()
    bases, at_byte, at_row = [], 0, 0
    for t in sorted(totals, key=lambda t: t["part"]):
        bases.append((t["part"], at_byte, at_row))
        at_byte, at_row = at_byte + t["b"], at_row + t["r"]
    base = spark.createDataFrame(bases, "part int, base_byte long, base_row long")
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(within))
        .withColumn("nth", F.count("*").over(within))
        .join(F.broadcast(base), "part")
        .withColumn("row", F.col("base_row") + F.col("nth") - 1)
    )
    middle = F.expr("2 * (base_byte + upto) - size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(2 * max(at_byte, 1)))).cast("int")
    placed = placed.withColumn("shard", shard)
    # At most one row for each shard and partition reaches the shuffle; n_shards rows are broadcast.
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
