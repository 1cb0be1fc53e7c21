"""The stream gives what the batch gives; stalls are told once."""

from datetime import datetime

from docscope.operators.runs import throughput
from docscope.plans import views
from docscope.streaming.runs import run_available, stream_stalls, stream_tasks, stream_throughput


def test_throughput(spark, small, tmp_path):
    tasks = views.tasks(spark, small)
    tasks.write.parquet(str(tmp_path / "in"))
    stream = stream_throughput(stream_tasks(spark, str(tmp_path / "in"), "task_id long, publisher string, state string, stage_failed string, ts timestamp, seconds double"))
    got = run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, throughput(tasks).collect()))


def test_stalls(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(1, "in_progress", at(8)), (1, "done", at(8, 5)), (2, "in_progress", at(8)), (3, "in_progress", at(11, 59)), (4, "pending", at(12)), (None, "done", at(9))]
    folder = str(tmp_path / "in")
    schema = "task_id long, state string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    out = str(tmp_path / "out")

    def warned():
        stream = stream_stalls(stream_tasks(spark, folder, schema)).writeStream.format("parquet")
        stream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
        return [tuple(r) for r in spark.read.parquet(out).collect()]

    assert warned() == [(2, at(8))]
    spark.createDataFrame([(5, "pending", at(12, 1))], schema).coalesce(1).write.mode("append").parquet(folder)
    assert warned() == [(2, at(8))]
