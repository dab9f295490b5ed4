"""Chunk outcomes, failure gates and job rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.functions.columns import round_binary
from lexiframe.operators.skew import hot_join, previous_value, running_index, running_sum

# Gates and reporting step.
MAX_FAILED_SHARE = 0.5
MIN_ATTEMPTS = 5
PROGRESS_STEP = 5
SUCCESS = "success"
TOO_MANY_FAILED = "TooManyFailedChunks"
NO_VALID = "NoValidChunks"
AGGREGATION_FAILED = "Aggregation_Failed"

# Statuses after which a stage leaves a job alone.
TERMINAL = {
    "conversion": (
        "Invalid_file", "Excel_parquet_conversion_failed", "job_not_found", "columns_extracted", "no_columns_found",
    ),
    "extraction": (
        "Invalid_file", "Column_extraction_failed", "columns_extracted", "no_columns_found",
        "job_not_found",
    ),
    "distribution": (
        "nlp_processing_failed_upload_errors", "nlp_processing_failed_stream_errors", "system_failed",
    ),
    "aggregation": ("aggregation_process(map_reduce)_completed", "aggregation_process_failed"),
    "export": ("Zipping_failed", "final_zip_file_uploaded_Azure"),
}


def chunk_summary(ledger: DataFrame, job: str = "job_id") -> DataFrame:
    """Per job: successes, failures (everything else) and the failure rate."""
    ok = F.coalesce(F.col("status") == SUCCESS, F.lit(False)).cast("int")
    return (
        ledger.groupBy(job)
        .agg(F.sum(ok).alias("succeeded"), F.count("*").alias("total"))
        .select(
            job,
            "succeeded",
            (F.col("total") - F.col("succeeded")).alias("failed"),
            "total",
            ((F.col("total") - F.col("succeeded")) / F.col("total")).alias("failure_rate"),
        )
    )


def gate_error(limit: float = MAX_FAILED_SHARE) -> Column:
    return F.when(F.col("failure_rate") > limit, TOO_MANY_FAILED).when(
        F.coalesce(F.col("succeeded"), F.lit(0)) == 0, NO_VALID
    )


def failure_gate(
    ledger: DataFrame, limit: float = MAX_FAILED_SHARE, job: str = "job_id", jobs: DataFrame | None = None
) -> DataFrame:
    """Per job the gate's error or null, and the status it leads to.

    ``jobs`` adds jobs that have no chunk at all.
    """
    summary = chunk_summary(ledger, job)
    if jobs is not None:
        summary = jobs.select(job).join(summary, job, "left")
    error = gate_error(limit)
    return summary.select(
        job, error.alias("error"), F.when(error.isNotNull(), AGGREGATION_FAILED).alias("status")
    )


def passing_rows(df: DataFrame, gate: DataFrame, order: str, job: str = "job_id") -> DataFrame:
    """The rows of jobs that passed the gate."""
    passed = gate.filter("error is null").select(job)
    return hot_join(df, passed, [job], [order], "inner")


def running_error_gate(
    log: DataFrame,
    min_attempts: int = MIN_ATTEMPTS,
    limit: float = MAX_FAILED_SHARE,
    job: str = "job_id",
    order: str = "seq",
    **blocks,
) -> DataFrame:
    """Per job the first attempt at which it must stop, null if never.

    Tested at each failure: enough attempts so far and too many of them failed.
    ``log`` has a boolean ``failed``.
    """
    counted = running_sum(
        log, [job], [order], {"attempts": F.lit(1), "errors": F.col("failed").cast("int")}, **blocks
    )
    stop = (
        F.col("failed")
        & (F.col("attempts") >= min_attempts)
        & (F.col("errors") / F.col("attempts") > limit)
    )
    return counted.groupBy(job).agg(F.min(F.when(stop, F.col(order))).alias("stopped_at"))


def file_error_gate(
    log: DataFrame, limit: float = MAX_FAILED_SHARE, file: str = "file", order: str = "seq", **blocks
) -> DataFrame:
    """Per file: groups, where reading stops, and how many groups were written.

    The share of failed groups in the whole file is tested only after a group
    that could be read; that group is still written.
    """
    counted = running_sum(log, [file], [order], {"errors": F.col("failed").cast("int")}, **blocks)
    totals = log.groupBy(file).agg(F.count("*").alias("groups"))
    joined = hot_join(counted, totals, [file], [order], "inner")
    stop = ~F.col("failed") & (F.col("errors") / F.col("groups") > limit)
    stops = joined.groupBy(file, "groups").agg(F.min(F.when(stop, F.col(order))).alias("stopped_at"))
    marked = hot_join(log, stops, [file], [order], "inner")
    written = ~F.col("failed") & (F.col("stopped_at").isNull() | (F.col(order) <= F.col("stopped_at")))
    return marked.groupBy(file, "groups", "stopped_at").agg(
        F.sum(written.cast("int")).alias("written")
    )


def latest_status(job_events: DataFrame, job: str = "job_id", order: Sequence[str] = ("ts",)) -> DataFrame:
    return job_events.groupBy(job).agg(
        F.max_by("status", F.struct(*order)).alias("status")
    )


def eligible(jobs: DataFrame, stage: str) -> DataFrame:
    """Jobs a stage may still work on."""
    return jobs.filter(~F.coalesce(F.col("status").isin(*TERMINAL[stage]), F.lit(False)))


def stages_open(jobs: DataFrame, job: str = "job_id") -> DataFrame:
    """``(job, stage, open)``: for every job and stage whether the stage may still work on it."""
    status = F.col("status")
    states = [
        F.struct(F.lit(stage).alias("stage"), (~F.coalesce(status.isin(*ends), F.lit(False))).alias("open"))
        for stage, ends in TERMINAL.items()
    ]
    return jobs.select(job, F.inline(F.array(*states)))


def apply_status_updates(jobs: DataFrame, updates: DataFrame, job: str = "job_id") -> DataFrame:
    """Jobs with their new status and whether it changed. ``updates`` has one row per job."""
    new = updates.select(job, F.col("status").alias("__new"))
    status = F.coalesce("__new", "status")
    return (
        jobs.join(new, job, "left")
        .withColumn("changed", ~status.eqNullSafe(F.col("status")))
        .withColumn("status", status)
        .drop("__new")
    )


def status_changes(
    job_events: DataFrame, job: str = "job_id", order: Sequence[str] = ("ts",), **blocks
) -> DataFrame:
    """Only the events that change a job's status."""
    followed = previous_value(job_events, [job], order, "status", "previous", **blocks)
    return followed.filter(~F.col("status").eqNullSafe(F.col("previous")))


def job_duration(jobs: DataFrame, name: str = "total_time_taken") -> DataFrame:
    """Minutes from creation to completion, two digits."""
    micros = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("completed_at"))
    return jobs.withColumn(name, round_binary(micros / 1_000_000 / 60, 2))


def dedupe_idempotent(
    requests: DataFrame, key: str = "idempotency_key", order: Sequence[str] = ("ts", "id")
) -> DataFrame:
    """The first request of each key; requests without a key all stay."""
    rest = [c for c in requests.columns if c != key]
    keyed = requests.filter(F.col(key).isNotNull())
    first = keyed.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    kept = first.select(key, "__row.*").select(*requests.columns)
    return kept.unionByName(requests.filter(F.col(key).isNull()))


def result_state(requested: DataFrame, jobs: DataFrame, results: DataFrame, job: str = "job_id") -> DataFrame:
    """What a caller is told about each requested job."""
    known = jobs.select(job, F.col("status").alias("__status"), F.lit(True).alias("__known"))
    ready = results.select(job, F.lit(True).alias("__ready"))
    state = (
        F.when(F.col("__known").isNull(), "not_found")
        .when(F.col("__status") == "Text_processing_failed", "failed")
        .when((F.col("__status") == "Text_processing_completed") & F.col("__ready"), "completed")
        .otherwise("processing")
    )
    return requested.select(job).join(known, job, "left").join(ready, job, "left").select(
        job, state.alias("state")
    )


def live_results(results: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Results not yet expired at ``now``."""
    age = F.timestamp_diff("MICROSECOND", F.col("written_at"), now)
    return results.filter((age >= 0) & (age < ttl_seconds * 1_000_000))


def processed_keys(ledger: DataFrame, job: str = "job_id") -> DataFrame:
    """Distinct processed keys per job with the place each was first seen."""
    return (
        ledger.filter(F.col("status") == SUCCESS)
        .groupBy(job, "key")
        .agg(F.min("seq").alias("seq"))
    )


def progress(ledger: DataFrame, every: int = PROGRESS_STEP, job: str = "job_id", **blocks) -> DataFrame:
    """A progress row per job each time ``every`` more distinct keys are done."""
    numbered = running_index(processed_keys(ledger, job), [job], ["seq"], "processed", **blocks)
    return numbered.filter(F.col("processed") % every == 0).select(job, "processed", "seq")
