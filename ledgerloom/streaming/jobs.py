"""Jobs as streams of events: duplicates within a watermark, and the state each job has reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order in which a job passes its states; a later one wins at the same time.
STATES = ("uploaded", "processing", "completed", "failed")


def without_repeats(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop events met before within the delay; state is bounded by the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def job_states(events: DataFrame, job: str, time: str, state: str) -> DataFrame:
    """The latest state of each job and the number of its attempts; works on a stream in update mode."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col(state))
    return events.groupBy(job).agg(F.max_by(state, F.struct(F.col(time), rank)).alias("state"), F.sum(F.when(F.col(state) == "processing", 1).otherwise(0)).alias("attempts"), F.count("*").alias("events"))


def next_attempts(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Failed jobs as they go on: back in the queue with one attempt more, or failed for good."""
    again = F.col("attempts") + 1 < F.least(F.coalesce("max_attempts", F.lit(most)), F.lit(most))
    return jobs.filter("state = 'failed'").withColumn("state", F.when(again, "uploaded").otherwise("failed")).withColumn("attempts", F.col("attempts") + 1)


def fresh(states: DataFrame, time: str, now, seconds: int = 3600) -> DataFrame:
    """States that were updated within the time they live."""
    return states.filter(F.col(time) > now - F.expr(f"interval {seconds} seconds"))


def write_states(events: DataFrame, job: str, time: str, state: str, path: str, checkpoint: str):
    """Keep the table of job states at ``path`` up to date from a stream of events; returns the running query.

    A micro-batch is written beside the others under its own number, so a repeated batch replaces itself;
    ``latest_states`` reads the newest row of each job.
    """
    counts = job_states(events, job, time, state)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def latest_states(spark, path: str, job: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(job).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (job, "batch"))), "batch").alias("s")).select(job, "s.*")
