"""Streams: enrichment, deduplication, rate limits, chunk gates, error ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexiframe.functions.normalize import normalize_columns
from lexiframe.operators import ledger
from lexiframe.operators.ratelimit import LIMIT, TTL_SECONDS
from lexiframe.sources.sinks import append_new


def run_to_end(stream, checkpoint: str) -> StreamingQuery:
    """Start a prepared writer, work through what is there, and wait."""
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def stream_enrich(
    src: DataFrame,
    cols: Sequence[str],
    out: str,
    checkpoint: str,
    annotate: Callable[[DataFrame], DataFrame] | None = None,
    keep_nulls: bool = False,
) -> StreamingQuery:
    """Normalise (and annotate) each row of a file stream and append it to Parquet.

    Every step works on one row, so the stream keeps no state. ``annotate`` may
    use joins and aggregates; it then runs per micro-batch. A null text becomes
    empty, or stays null with ``keep_nulls``.
    """
    if annotate is None:
        writer = normalize_columns(src, cols, keep_nulls).writeStream.format("parquet").option("path", out)
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            # one folder per batch: a replayed batch replaces its own output
            done = annotate(normalize_columns(batch, cols, keep_nulls))
            done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        writer = src.writeStream.foreachBatch(write)
    return run_to_end(writer.outputMode("append"), checkpoint)


def stream_dedupe(df: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """First request per key within the delay; requests without a key pass."""
    marked = df.withWatermark(ts, delay)
    keyed = marked.filter(F.col(key).isNotNull()).dropDuplicatesWithinWatermark([key])
    return keyed.unionByName(marked.filter(F.col(key).isNull()))


def limiter(limit: int, ttl_ms: int, client: str, id_col: str):
    """The counter of one client over its requests of one micro-batch."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, until = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames)).sort_values(["at", id_col], kind="stable")
        accepted = []
        for at in batch["at"].tolist():
            used = count if at < until else 0
            ok = used < limit
            if ok:
                count, until = used + 1, at + ttl_ms * 1000
            accepted.append(ok)
        state.update((count, until))
        # state is dropped once the watermark says the counter has expired
        state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: key[0], id_col: batch[id_col], "accepted": accepted})

    return decide


def stream_rate_limit(
    df: DataFrame,
    client: str = "client",
    ts: str = "ts",
    id_col: str = "id",
    limit: int = LIMIT,
    ttl_seconds: int = TTL_SECONDS,
    delay: str = "0 seconds",
) -> DataFrame:
    """``(client, id, accepted)``; one counter per client lives in the state store.

    Requests must arrive in time order across micro-batches; inside one they are sorted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    slim = df.withWatermark(ts, delay).select(
        client, F.col(ts), F.unix_micros(ts).alias("at"), id_col
    )
    return slim.groupBy(client).applyInPandasWithState(
        limiter(limit, ttl_seconds * 1000, client, id_col),
        f"{client} {kinds[client]}, {id_col} {kinds[id_col]}, accepted boolean",
        "count long, until long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_chunk_counts(src: DataFrame, job: str = "job_id") -> DataFrame:
    """Running outcome counts per job, for update or complete mode."""
    return ledger.chunk_summary(src, job)


def stream_chunk_gate(src: DataFrame, out: str, checkpoint: str, job: str = "job_id") -> StreamingQuery:
    """Keep the latest gate decision per job, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        error = ledger.gate_error()
        decided = batch.select(
            job, "succeeded", "failed", "total", error.alias("error"), F.lit(batch_id).alias("batch_id")
        )
        decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream_chunk_counts(src, job).writeStream.outputMode("update").foreachBatch(write)
    return run_to_end(writer, checkpoint)


def latest_gate(decisions: DataFrame, job: str = "job_id") -> DataFrame:
    """The last decision of each job among those the micro-batches wrote."""
    rest = F.struct("succeeded", "failed", "total", "error")
    return decisions.groupBy(job).agg(F.max_by(rest, "batch_id").alias("d")).select(job, "d.*")


def once_sink(src: DataFrame, out: str, keys: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Append each key once, also when a micro-batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, out, keys)

    return run_to_end(src.writeStream.foreachBatch(write), checkpoint)


def stream_error_ratio(
    df: DataFrame, ts: str, failed: str, window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Failure share per tumbling window; rows behind the watermark are left out."""
    return (
        df.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("attempts"), F.sum(F.col(failed).cast("int")).alias("errors"))
        .select(
            F.col("w.start").alias("window_start"),
            "attempts",
            "errors",
            (F.col("errors") / F.col("attempts")).alias("error_ratio"),
        )
    )
