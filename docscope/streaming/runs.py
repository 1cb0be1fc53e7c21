"""Streaming forms of the run reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docscope.operators.runs import throughput


def stream_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tasks as a stream of Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def stream_throughput(tasks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts with a watermark: late tasks are counted until their window is closed."""
    return throughput(tasks.withWatermark("ts", late), width)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and gives its result: each micro-batch writes a dataset under ``path``.

    A complete stream's last dataset is its result, an append stream's are all of it; nothing is held in the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    found = df.sparkSession.read.option("basePath", path).parquet(path)
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        found = found.where(F.col("batch") == last)
    return found.select(*df.columns)


def stream_stalls(tasks: DataFrame, minutes: int = 15, late: str = "2 hours") -> DataFrame:
    """task_id, claimed: one warning for each claim that is still open after so many minutes of event time.

    The last event of a task in a batch counts, a repeated claim keeps its first time, and any other state closes it.
    A warning comes when the watermark passes the limit; the state of a task is dropped when it is closed or warned about.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        claimed = state.get[0] if state.exists else None
        if not state.hasTimedOut:
            last = max(((r.ts, r.state) for f in frames for r in f.itertuples()), default=(None, None))
            if last[1] != "in_progress":
                if state.exists:
                    state.remove()
                return
            claimed = claimed if claimed is not None else int(last[0].value // 1_000_000)
            due = claimed + minutes * 60_000
            if due > state.getCurrentWatermarkMs():
                state.update((claimed,))
                state.setTimeoutTimestamp(due)
                return
        if state.exists:
            state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "claimed": [pd.Timestamp(claimed, unit="ms")]})

    known = tasks.where("task_id is not null and ts is not null").withWatermark("ts", late).select("task_id", "state", "ts")
    return known.groupBy("task_id").applyInPandasWithState(
        run, "task_id long, claimed timestamp", "claimed long", "append", GroupStateTimeout.EventTimeTimeout
    )
