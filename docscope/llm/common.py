"""Shared plumbing of the training-data operators: tables, the shared folder, staged results and skewed joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docscope.plans.shipping import ship_package

#: Rows of one Arrow batch: whole texts travel in batches, so this bounds a worker's memory.
BATCH_ROWS = 1000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A broadcast table of a few numbers a row has so many rows at most.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that one task takes before the key is dealt to several.
SPREAD = 512


def ready(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the rows of an Arrow batch in this session."""
    ship_package(spark)
    if int(spark.conf.get(BATCH_KEY, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a default on local masters."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (got or "file:///tmp/checkpoints/docscope").rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, name: str, done: tuple[DataFrame, ...] = (), batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: cuts lineage and survives lost executors.

    ``done``: staged tables that nothing reads after this one; their folders are deleted. ``batch_rows``: rows of an
    Arrow batch while this is written, fewer where rows are wide.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if batch_rows < BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows < BATCH_ROWS:
            spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    for old in done:
        drop(old)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes the folder of a staged table that nothing reads any more."""
    path = df.__dict__.get("staged_path")
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, by: list[str], how: str = "inner") -> DataFrame:
    """Joins ``left`` with ``right``, which has one row for each key and in ``count`` the number of rows that ``left`` has with it.

    A key with more than SPREAD rows is dealt to one task for each SPREAD rows, by a hash of the columns ``by``, and
    its row of ``right`` goes to each. The keys dealt like this are broadcast as numbers: with ``rows`` rows in
    ``left`` they are at most BROADCAST_ROWS. ``right`` grows by a row for each SPREAD rows of ``left`` at most.
    Null keys (which a left join keeps) are dealt as well.
    """
    most = max(SPREAD, rows // BROADCAST_ROWS + 1)
    salts = F.ceil(F.col(count) / F.lit(most)).cast("int")
    hot = right.where(F.col(count) > most).select(*(F.col(k).alias(f"__hot_{k}") for k in keys), salts.alias("__salts"))
    same = [F.col(k) == F.col(f"__hot_{k}") for k in keys]
    held = left.join(F.broadcast(hot), same, "left").drop(*(f"__hot_{k}" for k in keys))
    null = F.col(keys[0]).isNull()
    for k in keys[1:]:
        null = null | F.col(k).isNull()
    deal = F.when(null, F.lit(64)).otherwise(F.coalesce("__salts", F.lit(1)))
    held = held.withColumn("__salt", F.pmod(F.xxhash64(*by), deal).cast("int")).drop("__salts")
    each = F.sequence(F.lit(0), F.when(F.col(count) > most, salts - 1).otherwise(F.lit(0)))
    return held.join(right.withColumn("__salt", F.explode(each)), [*keys, "__salt"], how).drop("__salt")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs an active session


def unsigned_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
