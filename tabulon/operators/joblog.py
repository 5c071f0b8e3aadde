"""Metrics over a job log and health of the entities that wrote it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col


def job_metrics(jobs: DataFrame, by: Sequence[str] = (), status: str = "status", started: str = "started_at", completed: str = "completed_at") -> DataFrame:
    """OP-01: jobs, success rate over finished jobs (percent), mean duration of finished jobs in seconds."""
    done = col(completed).isNotNull()
    ok = col(status) == "completed"
    seconds = F.timestamp_diff("MICROSECOND", col(started), col(completed)) / F.lit(1e6)
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(done).alias("finished_jobs"), F.count_if(done & ok).alias("completed_jobs"),
        (F.count_if(done & ok) / F.greatest(F.count_if(done), F.lit(1)) * 100.0).alias("success_rate"),
        F.coalesce(F.avg(F.when(done & col(started).isNotNull(), seconds)), F.lit(0.0)).alias("average_duration"))


def progress(steps: DataFrame, job: str, done: Column) -> DataFrame:
    """OP-01: completed steps over all steps, per job."""
    return steps.groupBy(col(job)).agg(F.count(F.lit(1)).alias("steps"), F.count_if(done).alias("completed_steps")).withColumn(
        "progress", F.col("completed_steps") / F.col("steps"))


def success_ratio(tasks: DataFrame, ok: Column, empty: float = 0.95) -> DataFrame:
    """OP-01: successes over all tasks; `empty` if there are none."""
    n = F.count(F.lit(1))
    return tasks.agg(F.when(n > 0, F.count_if(ok) / n).otherwise(F.lit(empty)).alias("success_ratio"))


def health_score(errors: Column, status: Column) -> Column:
    """100, less 10 per error (50 at most), less 30 if offline or 20 in error; not below 0."""
    state = F.when(status == "offline", 30).when(status == "error", 20).otherwise(0)
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.least(errors * 10, F.lit(50)) - state)


def entity_health(entities: DataFrame, errors: str = "errors", status: str = "status") -> DataFrame:
    """OP-02: score per entity."""
    return entities.withColumn("health_score", health_score(col(errors), col(status)))


def overall_health(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """OP-02: mean score and its label."""
    h = F.coalesce(F.avg("health_score"), F.lit(0.0))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), h.alias("health_score"),
        F.when(h > 80, F.lit("healthy")).when(h > 50, F.lit("degraded")).otherwise(F.lit("unhealthy")).alias("overall_health"))
