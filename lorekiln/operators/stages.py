"""Stages that are observed while they run, and the table of what they did."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

JOBS = "job string, stage string, status string, rows long, faults long, seconds double, message string"


def observed(job: str, stage: str, rows: DataFrame, write: Callable[[DataFrame], None], jobs: str, fault: Column | None = None) -> dict:
    """Write rows and append one row on it to the table of jobs in the folder `jobs`: its number of rows and of faulty ones, counted by the write itself, its seconds and how it ended.

    A stage that fails is noted as failed and raises. Nothing is read twice: the counts are metrics of the plan that writes.
    """
    spark, seen, began = rows.sparkSession, Observation(), time.perf_counter()
    wrong = F.coalesce(F.sum(fault.cast("long")), F.lit(0)) if fault is not None else F.lit(0).cast("long")
    try:
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), (wrong if fault is not None else F.sum(F.lit(0))).alias("faults")))
        counts = seen.get
        note = {"status": "success", "rows": counts["rows"], "faults": counts["faults"] or 0, "message": None}
    except Exception as e:
        note = {"status": "failed", "rows": None, "faults": None, "message": f"{type(e).__name__}: {str(e)[:500]}"}
        raise
    finally:
        note |= {"job": job, "stage": stage, "seconds": round(time.perf_counter() - began, 3)}
        spark.createDataFrame([tuple(note[c.split()[0]] for c in JOBS.split(", "))], JOBS).coalesce(1).write.mode("append").parquet(jobs)
    return note


def job_summary(spark: SparkSession, jobs: str) -> DataFrame:
    """Each job's stages by their last run: how many succeeded and failed, rows of the last stage's output, seconds in all."""
    runs = spark.read.schema(JOBS).parquet(jobs)
    return runs.groupBy("job").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("rows").alias("rows"), F.sum("faults").alias("faults"), F.sum("seconds").alias("seconds"),
    )
