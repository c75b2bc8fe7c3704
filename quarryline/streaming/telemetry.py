"""Telemetry: batch forms over an event table, and the same as streams with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str):
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def rolling_counts(events: DataFrame, ts: str, seconds: int = 300) -> DataFrame:
    """second (since 1970), n, rolling: events in each second that has any, and in the last `seconds` seconds."""
    b = events.groupBy(F.floor(micros(ts) / 1000000).alias("second")).agg(F.count("*").alias("n"))
    b = b.withColumn("_s", F.col("second")).withColumn("_day", F.floor(F.col("_s") / 86400))
    # A day also gets the end of the day before, so that a window needs the seconds of a day only.
    copies = b.withColumn("_at", F.explode(F.array(F.col("_day"), F.floor((F.col("_s") + seconds) / 86400)))).distinct()
    w = Window.partitionBy("_at").orderBy("_s").rangeBetween(-(seconds - 1), 0)
    return copies.withColumn("rolling", F.sum("n").over(w)).where("_at = _day").select("second", "n", "rolling")


def gaps(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Adds gap_ms: since the key's event before."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    e = events.withColumn("_us", micros(ts))
    return e.withColumn("gap_ms", F.round((F.col("_us") - F.lag("_us").over(w)) / 1000.0, 3)).drop("_us")


def last_n_percentiles(events: DataFrame, key: str, ts: str, tie: str, value: str, n: int = 500) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    last = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return last.groupBy(key).agg(F.count(value).alias("n"), F.round(F.percentile(value, 0.5), 6).alias("p50"), F.round(F.percentile(value, 0.95), 6).alias("p95"))


def quotas(events: DataFrame, key: str, ts: str, tie: str, hourly: int, daily: int) -> DataFrame:
    """Adds in_hour, in_day (this event and those before it) and allowed."""
    over = lambda sec: Window.partitionBy(key).orderBy("_us").rangeBetween(-sec * 1_000_000 + 1, 0)
    e = events.withColumn("_us", micros(ts)).withColumn("in_hour", F.count("*").over(over(3600))).withColumn("in_day", F.count("*").over(over(86400)))
    return e.withColumn("allowed", (F.col("in_hour") <= hourly) & (F.col("in_day") <= daily)).drop("_us")


def windowed_stream(stream: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums by key in event-time windows; works on a stream and on a table alike."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return s.groupBy(F.window("_ts", width), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what is there to parquet, exactly once, and stops; the checkpoint lets a later run go on."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def totals_stream(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Running totals by key: each micro-batch's complete totals replace the table."""
    counts = stream.groupBy(*keys).count()
    return counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sse_frames(lines: DataFrame, stream: str, seq: str, line: str) -> DataFrame:
    """stream, frame, event, data from the lines of event streams: a blank line ends a frame, lines with a leading colon
    are comments, data lines are joined, the last event line counts (else message); frames without data are none."""
    before = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace(line, "[\\r\\n]+\\z", "")
    f = lines.withColumn("_l", text).withColumn("_f", F.coalesce(F.sum((F.col("_l") == "").cast("int")).over(before), F.lit(0)))
    f = f.where("_l <> '' and not startswith(_l, ':')").withColumn("_k", F.regexp_extract("_l", "^([^:]*)", 1)).withColumn("_v", F.regexp_replace(F.regexp_replace("_l", "^[^:]*:?", ""), "^ ", ""))
    g = f.groupBy(stream, "_f").agg(F.max_by(F.when(F.col("_k") == "event", F.col("_v")), F.when(F.col("_k") == "event", F.col(seq))).alias("event"), F.array_sort(F.collect_list(F.when(F.col("_k") == "data", F.struct(seq, "_v")))).alias("d")).where(F.size("d") > 0)
    place = F.row_number().over(Window.partitionBy(stream).orderBy("_f"))
    return g.select(stream, place.alias("frame"), F.coalesce("event", F.lit("message")).alias("event"), F.array_join(F.transform("d", lambda x: x["_v"]), "\n").alias("data"))


def stream_records(events: DataFrame, key: str, ts: str, kind: str, answer: str, done: str) -> DataFrame:
    """key, first_ms to the first answer, total_ms to the last end, p50_gap_ms between answers, since the key's first event."""
    e = events.withColumn("_us", micros(ts))
    e = e.withColumn("_gap", F.when(F.col(kind) == answer, F.col("_us") - F.lag("_us").over(Window.partitionBy(key, kind).orderBy("_us"))))
    ms = lambda c: F.round((c - F.min("_us")) / 1000.0, 3)
    return e.groupBy(key).agg(ms(F.min(F.when(F.col(kind) == answer, F.col("_us")))).alias("first_ms"), ms(F.max(F.when(F.col(kind) == done, F.col("_us")))).alias("total_ms"), F.round(F.percentile("_gap", 0.5) / 1000.0, 3).alias("p50_gap_ms"))


def staleness(events: DataFrame, key: str, ts: str, now, seconds: int = 15) -> DataFrame:
    """key, age_s, stale: the age of the key's last event at `now` (a timestamp column or literal)."""
    last = events.groupBy(key).agg(F.max(micros(ts)).alias("_us"))
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    return last.select(key, F.round((at - F.col("_us")) / 1e6, 3).alias("age_s"), (at - F.col("_us") > seconds * 1_000_000).alias("stale"))


def deduplicated_stream(stream: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state of keys is kept as long as the watermark lets copies come. Works on a table too."""
    s = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    return (s.withWatermark("_ts", late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else s.dropDuplicates(keys)).drop("_ts")


def staged_progress(events: DataFrame, run: str, stage: str, kind: str, ts: str) -> DataFrame:
    """run, stage, state, active_ms: the last event's kind, and the time between each start and the next event of the stage."""
    w = Window.partitionBy(run, stage).orderBy("_us")
    e = events.withColumn("_us", micros(ts)).withColumn("_next", F.lead("_us").over(w))
    spent = F.sum(F.when((F.col(kind) == "started") & F.col("_next").isNotNull(), F.col("_next") - F.col("_us")).otherwise(0))
    return e.groupBy(run, stage).agg(F.max_by(kind, "_us").alias("state"), F.round(spent / 1000.0, 3).alias("active_ms"))
