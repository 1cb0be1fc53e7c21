"""Reports on processing runs: the queue, failures, publishers and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def queue_status(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("state").agg(F.count("*").alias("n"))


def failures_by_stage(tasks: DataFrame) -> DataFrame:
    failed = tasks.where("state = 'failed'")
    return failed.groupBy(F.coalesce(F.nullif("stage_failed", F.lit("")), F.lit("_unspecified")).alias("stage")).agg(F.count("*").alias("n"))


def publisher_counts(tasks: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.trim("publisher"), F.lit("")), F.lit("_unknown")).alias("publisher")
    kinds = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed")]
    return tasks.groupBy(name).agg(F.count("*").alias("total"), *kinds)


def recent_failures(tasks: DataFrame, n: int = 20) -> DataFrame:
    """The last failures: a report of n rows."""
    return tasks.where("state = 'failed'").orderBy(F.desc("ts"), F.desc("task_id")).limit(n).select("task_id", "stage_failed", "ts")


def run_summary(tasks: DataFrame) -> DataFrame:
    """Counts, rates and times by publisher."""
    done = F.col("state") == "done"
    n = F.count("*")
    return tasks.groupBy("publisher").agg(
        n.alias("n"), F.count_if(done).alias("n_done"), F.round(100.0 * F.count_if(done) / n, 2).alias("success_pct"),
        F.round(F.avg(F.when(done, F.col("seconds"))), 4).alias("mean_seconds"), F.round(F.median(F.when(done, F.col("seconds"))), 4).alias("median_seconds"),
    )


def throughput(tasks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Finished and failed tasks by tumbling window; the same function serves a stream with a watermark."""
    w = F.window("ts", width)
    kinds = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed")]
    return tasks.groupBy(w).agg(F.count("*").alias("n"), *kinds).select(F.col("window.start").alias("start"), "n", "done", "failed")


def latest_state(tasks: DataFrame, key: str) -> DataFrame:
    """The last state of each key: a queue read as a log of transitions. Partial maxima, so no key has a task of its own."""
    last = F.max(F.struct("ts", "task_id", "state")).alias("x")
    return tasks.groupBy(key).agg(last).select(key, "x.state", "x.ts")


def stalled(tasks: DataFrame, minutes: int = 15) -> DataFrame:
    """Tasks that were still in progress so many minutes before the last event; none of an empty table."""
    end = tasks.agg(F.max("ts")).first()[0]
    limit = F.lit(end).cast("timestamp") - F.expr(f"interval {int(minutes)} minutes")
    return tasks.where((F.col("state") == "in_progress") & (F.col("ts") < limit)).select("task_id", F.col("ts").alias("claimed"))


def queue_report(tasks: DataFrame) -> DataFrame:
    """One row: tasks by state, and complete papers among those done (imrad_complete)."""
    kinds = [F.count_if(F.col("state") == s).alias(s) for s in ("pending", "in_progress", "done", "failed")]
    return tasks.agg(F.count("*").alias("total"), *kinds, F.count_if((F.col("state") == "done") & F.col("imrad_complete")).alias("complete"))


def run_report(results: DataFrame, *by: str) -> DataFrame:
    """Of a run's results (status, inference_time, tokens_per_second, input_tokens, output_tokens, component_count): counts, rates, times, tokens.

    Skipped rows count as selected only; times and tokens are of successes. ``error_breakdown`` maps each other status to
    its number. Medians are exact.
    """
    ok, skipped = F.col("status") == "success", F.col("status") == "skipped"
    n, done, good = F.count("*"), F.count_if(~skipped), F.count_if(ok)
    rate = lambda a, b: F.when(b > 0, F.bround(100.0 * a / b, 2)).otherwise(0.0)
    of = lambda c, f=F.avg: F.coalesce(F.bround(f(F.when(ok, F.col(c))), 2), F.lit(0.0))
    speed = F.coalesce(F.bround(F.avg(F.when(ok & (F.col("tokens_per_second") > 0), F.col("tokens_per_second"))), 2), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))
    main = results.groupBy(*by).agg(
        n.alias("selected"), F.count_if(skipped).alias("skipped"), done.alias("processed"), good.alias("success"), (done - good).alias("failed"),
        rate(good, done).alias("success_rate_processed"), rate(good, n).alias("success_rate_selected"), of("inference_time").alias("avg_time"),
        of("inference_time", F.median).alias("median_time"), speed.alias("avg_tokens_per_second"), total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"), of("component_count").alias("avg_components"),
    )
    errors = results.where(~ok & ~skipped).groupBy(*by, "status").agg(F.count("*").alias("n"))
    errors = errors.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("error_breakdown"))
    none = F.create_map().cast("map<string,bigint>")
    joined = main.join(errors, list(by), "left") if by else main.withColumn("one", F.lit(1)).join(errors.withColumn("one", F.lit(1)), "one", "left").drop("one")
    return joined.withColumn("error_breakdown", F.coalesce("error_breakdown", none))


def outcomes(tasks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Tasks with the fields of their results put over their own: a result's field counts where the result has one."""
    new = [c for c in results.columns if c != key]
    named = results.withColumnsRenamed({c: f"__{c}" for c in new}).withColumn("__there", F.lit(True))
    d = tasks.join(named, key, "left")
    merged = [F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c) if c in tasks.columns else F.lit(None)).alias(c) for c in new]
    return d.select(*(c for c in tasks.columns if c not in new), *merged)


def reset_orphans(tasks: DataFrame) -> DataFrame:
    """Tasks that were in progress are pending again, without their claim."""
    orphan = F.col("state") == "in_progress"
    claims = {c: F.when(~orphan, F.col(c)) for c in ("claimed_by", "claimed_at") if c in tasks.columns}
    return tasks.withColumns({"state": F.when(orphan, "pending").otherwise(F.col("state")), **claims})


def milestones(tasks: DataFrame, every: int = 100) -> DataFrame:
    """nth, ts: when the processed tasks crossed each multiple of ``every``, from counts by second and their running sum.

    Counts by second are as many rows as the run has seconds, whatever its tasks.
    """
    seconds = tasks.where(F.col("state").isin("done", "failed")).groupBy(F.date_trunc("second", "ts").alias("ts")).agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.orderBy("ts"))
    d = seconds.withColumn("upto", run).withColumn("before", F.col("upto") - F.col("n"))
    steps = F.sequence(F.floor(F.col("before") / every) + 1, F.floor(F.col("upto") / every))
    crossed = F.floor(F.col("upto") / every) > F.floor(F.col("before") / every)
    return d.where(crossed).select(F.explode(steps).alias("k"), "ts").select((F.col("k") * every).alias("nth"), "ts")
