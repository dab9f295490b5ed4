"""Queries on chunk ledgers, job rows and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiframe.operators import ledger as J
from lexiframe.operators import ratelimit as R
from lexiframe.operators.skew import previous_value, running_index, running_sum
from lexiframe.plans.registry import query, table

# Events as a ledger: users are jobs, events are chunks.
LEDGER = """ledger AS (
  SELECT user_id AS job_id, event_id AS seq, 'chunk_' || event_id AS chunk_id, event_type IN ('error', 'view') AS failed,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'failed' WHEN 'signup' THEN 'empty' ELSE 'success' END AS status,
    'key_' || event_id % 700 AS key
  FROM events)"""


def ledger(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind.isin("error", "view"), "failed").when(kind == "signup", "empty").otherwise("success")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("chunk_"), F.col("event_id").cast("string")).alias("chunk_id"),
        kind.isin("error", "view").alias("failed"),
        status.alias("status"),
        F.concat(F.lit("key_"), (F.col("event_id") % 700).cast("string")).alias("key"),
    )


SUMMARY = """summary AS (
  SELECT job_id, count(*) FILTER (status = 'success') AS succeeded, count(*) AS total FROM ledger GROUP BY 1)"""


@query(
    "chunk_summary",
    f"""WITH {LEDGER}, {SUMMARY}
    SELECT job_id, succeeded, total - succeeded AS failed, total, round((total - succeeded) / total, 6) AS failure_rate
    FROM summary""",
)
def _(spark, sf):
    found = J.chunk_summary(ledger(spark, sf))
    return found.withColumn("failure_rate", F.round("failure_rate", 6))


GATE = f"""{LEDGER}, {SUMMARY}, gate AS (
  SELECT c.c_custkey AS job_id, CASE WHEN (total - succeeded) / total > 0.5 THEN 'TooManyFailedChunks'
      WHEN coalesce(succeeded, 0) = 0 THEN 'NoValidChunks' END AS error
  FROM customer c LEFT JOIN summary s ON s.job_id = c.c_custkey)"""


def gate(spark, sf) -> DataFrame:
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return J.failure_gate(ledger(spark, sf), jobs=jobs)


@query(
    "failure_gate",
    f"WITH {GATE} SELECT job_id, error, CASE WHEN error IS NOT NULL THEN 'Aggregation_Failed' END AS status FROM gate",
)
def _(spark, sf):
    return gate(spark, sf)


@query(
    "passing_rows",
    f"WITH {GATE} SELECT l.job_id, l.seq FROM ledger l JOIN gate USING (job_id) WHERE error IS NULL",
)
def _(spark, sf):
    return J.passing_rows(ledger(spark, sf), gate(spark, sf), "seq").select("job_id", "seq")


@query(
    "running_error_gate",
    f"""WITH {LEDGER}, r AS (
      SELECT *, sum(CAST(failed AS INTEGER)) OVER w AS errors, count(*) OVER w AS attempts FROM ledger
      WINDOW w AS (PARTITION BY job_id ORDER BY seq))
    SELECT job_id, min(seq) FILTER (failed AND attempts >= 5 AND errors / attempts > 0.5) AS stopped_at FROM r GROUP BY 1""",
)
def _(spark, sf):
    return J.running_error_gate(ledger(spark, sf), rows_per_block=500)


@query(
    "file_error_gate",
    f"""WITH {LEDGER}, f AS (SELECT job_id AS file, seq, failed OR status = 'empty' AS failed FROM ledger),
    r AS (
      SELECT *, sum(CAST(failed AS INTEGER)) OVER (PARTITION BY file ORDER BY seq) AS errors,
        count(*) OVER (PARTITION BY file) AS groups FROM f),
    s AS (SELECT file, groups, min(seq) FILTER (NOT failed AND errors / groups > 0.5) AS stopped_at FROM r GROUP BY 1, 2)
    SELECT s.file, s.groups, s.stopped_at,
      count(*) FILTER (NOT failed AND (stopped_at IS NULL OR seq <= stopped_at)) AS written
    FROM s JOIN f USING (file) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    log = ledger(spark, sf).select(
        F.col("job_id").alias("file"), "seq", (F.col("failed") | (F.col("status") == "empty")).alias("failed")
    )
    return J.file_error_gate(log, rows_per_block=500)


# Events as status changes of jobs.
STATUSES = """job_events AS (
  SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'error' THEN 'Column_extraction_failed'
    WHEN 'purchase' THEN 'columns_extracted' WHEN 'signup' THEN 'job_created_DB' ELSE 'Text_processing' END AS status
  FROM events)"""


def job_events(spark, sf) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "Column_extraction_failed")
        .when(kind == "purchase", "columns_extracted")
        .when(kind == "signup", "job_created_DB")
        .otherwise("Text_processing")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", status.alias("status")
    )


LATEST = f"""{STATUSES}, latest AS (
  SELECT job_id, arg_max(status, (ts, event_id)) AS status FROM job_events GROUP BY 1)"""


def latest(spark, sf) -> DataFrame:
    return J.latest_status(job_events(spark, sf), order=("ts", "event_id"))


@query("latest_status", f"WITH {LATEST} SELECT * FROM latest")
def _(spark, sf):
    return latest(spark, sf)


@query(
    "eligible_jobs",
    f"""WITH {LATEST} SELECT * FROM latest WHERE status NOT IN
      ('Invalid_file', 'Column_extraction_failed', 'columns_extracted', 'no_columns_found', 'job_not_found')""",
)
def _(spark, sf):
    return J.eligible(latest(spark, sf), "extraction")


@query(
    "stages_open",
    f"""WITH {LATEST}, stages(stage, ends) AS (VALUES
      ('conversion', ['Invalid_file', 'Excel_parquet_conversion_failed', 'job_not_found', 'columns_extracted', 'no_columns_found']),
      ('extraction', ['Invalid_file', 'Column_extraction_failed', 'columns_extracted', 'no_columns_found', 'job_not_found']),
      ('distribution', ['nlp_processing_failed_upload_errors', 'nlp_processing_failed_stream_errors', 'system_failed']),
      ('aggregation', ['aggregation_process(map_reduce)_completed', 'aggregation_process_failed']),
      ('export', ['Zipping_failed', 'final_zip_file_uploaded_Azure']))
    SELECT job_id, stage, NOT list_contains(ends, status) AS open FROM latest, stages""",
)
def _(spark, sf):
    return J.stages_open(latest(spark, sf))


# A fifth of the events without a job, a seventh without a time; both belong to the result.
GAPPED = """gapped AS (
  SELECT CASE WHEN event_id % 5 <> 0 THEN user_id END AS job_id, CASE WHEN event_id % 7 <> 0 THEN event_id // 3 END AS moment,
    event_id FROM events)"""


def gapped(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("job_id"),
        F.when(F.col("event_id") % 7 != 0, F.expr("event_id div 3")).alias("moment"),
        "event_id",
    )


@query(
    "running_sum_with_nulls",
    f"""WITH {GAPPED}, cuts(cut) AS (VALUES (200), (2000), (1000000000))
    SELECT cut, event_id, sum(event_id) OVER w::BIGINT AS upto, count(*) OVER w AS row_no FROM gapped, cuts
    WINDOW w AS (PARTITION BY cut, job_id ORDER BY moment NULLS FIRST, event_id)""",
)
def _(spark, sf):
    parts = []
    for cut in (200, 2000, 1_000_000_000):
        sums = {"upto": F.col("event_id"), "row_no": F.lit(1)}
        found = running_sum(gapped(spark, sf), ["job_id"], ["moment", "event_id"], sums, rows_per_block=cut)
        parts.append(found.select(F.lit(cut).alias("cut"), "event_id", "upto", F.col("row_no").cast("long")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "previous_value_with_nulls",
    f"""WITH {GAPPED} SELECT event_id, lag(event_id) OVER (PARTITION BY job_id ORDER BY moment NULLS FIRST, event_id) AS previous
    FROM gapped""",
)
def _(spark, sf):
    return previous_value(gapped(spark, sf), ["job_id"], ["moment", "event_id"], "event_id", "previous", rows_per_block=50).select(
        "event_id", "previous"
    )


@query(
    "apply_status_updates",
    f"""WITH {LATEST}, jobs AS (SELECT c_custkey AS job_id, 'Text_processing' AS status FROM customer)
    SELECT j.job_id, coalesce(l.status, j.status) AS status, coalesce(l.status, j.status) <> j.status AS changed
    FROM jobs j LEFT JOIN latest l USING (job_id)""",
)
def _(spark, sf):
    jobs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.lit("Text_processing").alias("status")
    )
    return J.apply_status_updates(jobs, latest(spark, sf))


@query(
    "status_changes",
    f"""WITH {STATUSES}, p AS (
      SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous FROM job_events)
    SELECT job_id, event_id, status, previous FROM p WHERE previous IS NULL OR previous <> status""",
)
def _(spark, sf):
    found = J.status_changes(job_events(spark, sf), order=("ts", "event_id"), rows_per_block=500)
    return found.select("job_id", "event_id", "status", "previous")


@query(
    "job_duration",
    """SELECT event_id, CAST(format('{:.2f}', (event_id * 7919 % 100000) / 1000.0::DOUBLE / 60) AS DOUBLE) AS total_time_taken
    FROM events""",
)
def _(spark, sf):
    jobs = table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.expr("ts + make_dt_interval(0, 0, 0, (event_id * 7919 % 100000) / 1000)").alias("completed_at"),
    )
    return J.job_duration(jobs).select("event_id", "total_time_taken")


@query(
    "dedupe_idempotent",
    """WITH r AS (SELECT event_id AS id, ts, CASE WHEN event_id % 4 <> 0 THEN user_id || event_type END AS k FROM events)
    SELECT id, k AS idempotency_key FROM r
    QUALIFY k IS NULL OR row_number() OVER (PARTITION BY k ORDER BY ts, id) = 1""",
)
def _(spark, sf):
    key = F.when(F.col("event_id") % 4 != 0, F.concat(F.col("user_id").cast("string"), "event_type"))
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "ts", key.alias("idempotency_key")
    )
    return J.dedupe_idempotent(requests).select("id", "idempotency_key")


JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'Text_processing_completed'
    WHEN 'O' THEN 'Text_processing' ELSE 'Text_processing_failed' END AS status FROM orders WHERE o_orderkey % 10 <> 3),
results AS (
  SELECT o_orderkey AS job_id, o_orderdate AS written_at FROM orders WHERE o_orderkey % 4 <> 1)"""


def jobs(spark, sf) -> DataFrame:
    state = F.col("o_orderstatus")
    status = (
        F.when(state == "F", "Text_processing_completed")
        .when(state == "O", "Text_processing")
        .otherwise("Text_processing_failed")
    )
    return table(spark, sf, "orders").filter("o_orderkey % 10 <> 3").select(
        F.col("o_orderkey").alias("job_id"), status.alias("status")
    )


def results(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").filter("o_orderkey % 4 <> 1").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("written_at")
    )


STATE = """CASE WHEN j.job_id IS NULL THEN 'not_found' WHEN j.status = 'Text_processing_failed' THEN 'failed'
      WHEN j.status = 'Text_processing_completed' AND r.job_id IS NOT NULL THEN 'completed' ELSE 'processing' END AS state"""


@query(
    "result_state",
    f"""WITH {JOBS} SELECT o.o_orderkey AS job_id, {STATE} FROM orders o
    LEFT JOIN jobs j ON j.job_id = o.o_orderkey LEFT JOIN results r ON r.job_id = o.o_orderkey""",
)
def _(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    return J.result_state(asked, jobs(spark, sf), results(spark, sf))


@query(
    "live_results",
    f"""WITH {JOBS}, latest AS (SELECT max(written_at) AS now FROM results),
    live AS (SELECT job_id FROM results, latest WHERE written_at + INTERVAL 300 DAY > now)
    SELECT o.o_orderkey AS job_id, {STATE} FROM orders o
    LEFT JOIN jobs j ON j.job_id = o.o_orderkey LEFT JOIN live r ON r.job_id = o.o_orderkey""",
)
def _(spark, sf):
    written = results(spark, sf)
    now = F.lit(written.agg(F.max("written_at")).first()[0])
    live = J.live_results(written, now, 300 * 86400)
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    return J.result_state(asked, jobs(spark, sf), live)


@query(
    "progress",
    f"""WITH {LEDGER}, k AS (SELECT job_id, key, min(seq) AS seq FROM ledger WHERE status = 'success' GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS processed FROM k)
    SELECT job_id, processed, seq FROM n WHERE processed % 5 = 0""",
)
def _(spark, sf):
    return J.progress(ledger(spark, sf), rows_per_block=500)


PERIOD = 12 * 3600
LIMITED = f"""WITH RECURSIVE r AS (
  SELECT user_id AS client, event_id AS id, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (
  SELECT client, id, rn, 1 AS n, t + {PERIOD}000000 AS until, true AS accepted FROM r WHERE rn = 1
  UNION ALL
  SELECT r.client, r.id, r.rn,
    CASE WHEN r.t >= w.until THEN 1 WHEN w.n < 2 THEN w.n + 1 ELSE w.n END,
    CASE WHEN r.t >= w.until OR w.n < 2 THEN r.t + {PERIOD}000000 ELSE w.until END,
    r.t >= w.until OR w.n < 2
  FROM walk w JOIN r ON r.client = w.client AND r.rn = w.rn + 1)
SELECT client, id, accepted FROM walk"""


def requests(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("client"), "ts", F.col("event_id").alias("id")
    )


@query("rate_limit", LIMITED)
def _(spark, sf):
    return R.rate_limit(requests(spark, sf), limit=2, ttl_seconds=PERIOD)


# one client with all events, in the order of their numbers, one each second: no pause anywhere
DENSE = """WITH RECURSIVE numbered AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events),
  total AS (SELECT count(*) AS total FROM events)
  SELECT 'all' AS client, event_id AS id, n % (10 + 59) < 10 AS accepted FROM numbered"""


@query("rate_limit_busy_clients", DENSE)
def _(spark, sf):
    numbered = running_index(table(spark, sf, "events").withColumn("client", F.lit("all")), ["client"], ["event_id"], "n", rows_per_block=2000)
    dense = numbered.select("client", F.timestamp_seconds("n").alias("ts"), F.col("event_id").alias("id"))
    return R.rate_limit(dense)
