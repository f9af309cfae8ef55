"""The event log as a stream: windowed counts, job states, and coalesced progress.

Every operator takes a streaming or a static DataFrame of the log.  ``drain``
runs a query to the end of what its source holds (availableNow) and returns the
rows it wrote, so that a stream's result can be compared with its batch twin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.storage import new_path


def read_log(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """The events table as a stream, with the log's columns; one file a batch.

    Files are met by age and may cut a job's rows anywhere: with `in_order`, for
    operators that go by the order of the log, all that is there comes as one batch.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    raw = (source if in_order else source.option("maxFilesPerTrigger", 1)).parquet(f"{sf_dir}/events*")
    # a time without a zone stays one where order counts: some are none, or two, in the session's zone
    ts = F.col("ts") if in_order else F.col("ts").cast("timestamp")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    return raw.select("event_id", F.col("user_id").alias("job_id"), ts.alias("ts"), level.alias("level"), F.col("event_type").alias("kind"), "value")


def windowed(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums per kind and window of event time."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    out = log.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "kind", "n", "total")


def job_states(log: DataFrame) -> DataFrame:
    """Entries and errors of each job so far."""
    return log.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("level") == "error").alias("errors"))


#: Messages that are passed on at once.
FORCED = r"\b(leads? found|lazy loading complete|blocked|failed|error|cancelled|complete[d]?|exhausted|starting\b)"


def coalesced(log: DataFrame, every: int = 8, millis: int = 750, idle: str | None = None) -> DataFrame:
    """Progress of each job, thinned out: what is passed on, how many came so far, and why.

    A message is passed on if it is the first, if `millis` have gone by or `every`
    messages have come since the last one passed on, or at once if its words force
    it; then a different message held back goes out before it.  What is held when a
    job ends goes out too: at a row whose `ends` is true, if the log has that column,
    and, with `idle`, once the watermark is that far behind the job's last row.

    Input: job_id, ts, event_id, message, and ends if there is one.  A job's rows of
    a micro-batch are put in order all together, however they were cut into frames, so
    a trigger's size bounds what is held; triggers must follow the order of the log.
    Rows without a time come last, and no time goes by at them.  The session's time zone
    plays no part.  State is one row per job.
    """
    import re

    wait = pd.Timedelta(idle).value // 1_000_000 if idle else None
    ending = "ends" in log.columns

    forced = re.compile(FORCED, re.IGNORECASE)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, since, last, held, held_id = state.get if state.exists else (0, 0, None, None, None)
        out, latest = [], None
        if state.hasTimedOut:
            if held is not None:
                out.append((key[0], held_id, seen, "idle"))
            since, held, held_id, rows = 0, None, None, ()
        else:
            frames = list(frames)
            stamps, events, messages, marks = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("__at", "event_id", "message", "ends" if ending else "event_id"))
            missing = pd.isna(stamps)
            micros = np.where(missing, np.zeros_like(stamps), stamps).astype("datetime64[us]").astype("int64")
            order = np.lexsort((events, micros, missing))
            times = [None if gone else at // 1000 for at, gone in zip(micros[order].tolist(), missing[order].tolist())]
            rows = zip(times, events[order].tolist(), messages[order], marks[order] if ending else [False] * len(order))
        for at, event, message, ends in rows:
            event, seen, since = int(event), seen + 1, since + 1
            latest, message = latest if at is None else at, (message or "").strip()
            first, late = last is None, at is not None and last is not None and at - last >= millis
            passed_at = at if at is not None else last or 0
            if message and forced.search(message):
                if held is not None and held != message:
                    out.append((key[0], held_id, seen, "held"))
                out.append((key[0], event, seen, "forced"))
                since, last, held, held_id = 0, passed_at, None, None
            elif message:
                held, held_id = message, event
                if first or late or since >= every:
                    out.append((key[0], event, seen, "first" if first else "time" if late else "count"))
                    since, last, held, held_id = 0, passed_at, None, None
            if ends and held is not None:
                out.append((key[0], held_id, seen, "end"))
                since, last, held, held_id = 0, passed_at, None, None
        state.update((seen, since, last, held, held_id))
        if wait is not None and held is not None and latest is not None:
            state.setTimeoutTimestamp(max(latest + wait, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["job_id", "event_id", "seen", "why"])

    # an instant is grouped as a number: pandas would get it in local time, which repeats an hour
    log = log.withColumn("__at", F.unix_micros("ts") if dict(log.dtypes)["ts"] == "timestamp" else F.col("ts"))
    return log.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, event_id long, seen long, why string", "seen long, since long, last long, held string, held_id long", "append",
        GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout,
    )


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows, from the shared folder."""
    spark = stream.sparkSession
    base = new_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        # complete mode repeats the whole result: only the last batch counts
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/b{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def limited(log: DataFrame, seconds: int, limit: int = 1) -> DataFrame:
    """Per job the entries that a limiter lets through: `limit` in a window that opens with the first hit after the last one closed.

    The rule is sequential, so a job's entries stream through one task in order; the
    state is the window's end and its count, whatever the length of the log.
    """

    def walk(batches):
        import pyarrow as pa

        job, until, count = None, 0, 0
        for batch in batches:
            jobs, events = [], []
            for j, at, event in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if j != job:
                    job, until, count = j, None, 0
                if until is None or at >= until:
                    until, count = at + seconds * 1_000_000, 1
                elif count < limit:
                    count += 1
                else:
                    continue
                jobs.append(j), events.append(event)
            yield pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(events, pa.int64())], ["job_id", "event_id"])

    times = log.select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return times.repartition("job_id").sortWithinPartitions("job_id", "at", "event_id").mapInArrow(walk, "job_id long, event_id long")
