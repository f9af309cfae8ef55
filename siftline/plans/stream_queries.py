"""Streaming queries, drained over the event table, with their batch twins as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.streaming import log


def t_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: windows of event time over the log, which otherwise goes by sequence alone."""
    return log.drain(log.windowed(log.read_log(spark, sf_dir)), "complete")


def t_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.drain(log.job_states(log.read_log(spark, sf_dir)), "complete")


def t5_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress lines of each job, thinned out; the kind of an entry is its message."""
    return log.drain(log.coalesced(log.read_log(spark, sf_dir, in_order=True).withColumn("message", F.col("kind"))))


def t5_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an end mark at every sign-up: what is held then goes out."""
    return log.drain(log.coalesced(log.read_log(spark, sf_dir, in_order=True).withColumns({"message": F.col("kind"), "ends": F.col("kind") == "signup"})))


QUERIES = {f.__name__: f for f in (t_windowed_counts, t_job_states, t5_coalesce, t5_flushed)}

ORACLES = {
    "t_windowed_counts": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMPTZ) AS start, event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "t_job_states": "SELECT user_id AS job_id, count(*) AS entries, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
    "t5_coalesce": """
        WITH RECURSIVE s AS (SELECT user_id AS job_id, event_id, event_type AS msg, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (
            SELECT job_id, n, event_id, 0 AS since, ms AS last, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS held_id, CAST(NULL AS BIGINT) AS late,
                   CASE WHEN msg = 'error' THEN 'forced' ELSE 'first' END AS why
            FROM s WHERE n = 1
            UNION ALL
            SELECT job_id, n, event_id, CASE WHEN why IS NULL THEN since + 1 ELSE 0 END, CASE WHEN why IS NULL THEN last ELSE ms END,
                   CASE WHEN why IS NULL THEN msg END, CASE WHEN why IS NULL THEN event_id END, CASE WHEN why = 'forced' AND held <> msg THEN held_id END, why
            FROM (SELECT s.*, r.since, r.last, r.held, r.held_id,
                         CASE WHEN msg = 'error' THEN 'forced' WHEN ms - last >= 750 THEN 'time' WHEN since + 1 >= 8 THEN 'count' END AS why
                  FROM r JOIN s ON s.job_id = r.job_id AND s.n = r.n + 1)
        )
        SELECT job_id, event_id, n AS seen, why FROM r WHERE why IS NOT NULL
        UNION ALL SELECT job_id, late, n, 'held' FROM r WHERE late IS NOT NULL
    """,
}
ORACLES["t5_flushed"] = ORACLES["t5_coalesce"].replace("WHEN since + 1 >= 8 THEN 'count' END", "WHEN since + 1 >= 8 THEN 'count' WHEN msg = 'signup' THEN 'end' END")
