"""Leases that are acquired, kept by heartbeats, and released or expired: as tables and as a stream with timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .telemetry import micros

DAY = 86_400_000_000


def lease_intervals(events: DataFrame, key: str, ts: str, tie: str, released: Column, ttl: float) -> DataFrame:
    """key, start_us, end_us, beats, reason: what each key held. An event acquires the lease if none is live, and else keeps
    it; the lease ends with the event that releases it, or `ttl` seconds after its last one. A release of what isn't live
    does nothing. Only a key's own events meet."""
    us = int(ttl * 1_000_000)
    w = Window.partitionBy(key).orderBy("_us", tie)
    e = events.where(F.col(key).isNotNull()).select(key, micros(ts).alias("_us"), tie, F.coalesce(released, F.lit(False)).alias("_end"))
    e = e.withColumns({"_before": F.lag("_us").over(w), "_ended": F.lag("_end").over(w)})
    fresh = F.col("_before").isNull() | F.col("_ended") | (F.col("_us") - F.col("_before") >= us)
    e = e.withColumn("_new", fresh).withColumn("_n", F.sum(F.col("_new").cast("int")).over(w))
    one = e.groupBy(key, "_n").agg(F.min("_us").alias("start_us"), F.max("_us").alias("_last"), F.count("*").alias("beats"), F.max("_end").alias("_out"))
    # an event that releases what is not live is alone in its interval
    one = one.where(~(F.col("_out") & (F.col("beats") == 1)))
    end = F.when(F.col("_out"), F.col("_last")).otherwise(F.col("_last") + us)
    return one.select(key, "start_us", end.alias("end_us"), "beats", F.when(F.col("_out"), "released").otherwise("expired").alias("reason"))


def in_flight(intervals: DataFrame) -> DataFrame:
    """at_us, live: how many intervals (start_us, end_us) are live from each moment on at which that changes; an interval
    is live from its start to before its end. Days are summed apart, so a task has the moments of a day."""
    ends = intervals.select(F.explode(F.array(F.struct(F.col("start_us").alias("at_us"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("at_us"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    steps = ends.groupBy("at_us").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("_day", F.floor(F.col("at_us") / DAY))
    days = steps.groupBy("_day").agg(F.sum("d").alias("_d"))
    days = days.select("_day", (F.sum("_d").over(Window.orderBy("_day")) - F.col("_d")).alias("_base"))  # a row a day
    within = F.sum("d").over(Window.partitionBy("_day").orderBy("at_us"))
    return steps.join(days, "_day").select("at_us", (within + F.col("_base")).cast("long").alias("live"))


def lease_stream(stream: DataFrame, key: str, ts: str, released: Column, ttl: float, late: str = "1 minute") -> DataFrame:
    """lease_intervals of a stream whose events come in order within a key: an interval is sent when it is released, when a
    later event finds it expired, or when the watermark passes its end."""
    us = int(ttl * 1_000_000)
    rows = stream.where(F.col(key).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("_ts"), micros(ts).alias("_us"), F.coalesce(released, F.lit(False)).alias("_end"))
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "start_us", "end_us", "beats", "reason"]

    def run(k, batches, state):
        import pandas as pd

        out = []
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((k[0], held[0], held[1] + us, held[2], "expired"))
            state.remove()
            yield pd.DataFrame(out, columns=names)
            return
        b = pd.concat(list(batches)).sort_values("_us", kind="stable")
        for at, end in zip(b["_us"], b["_end"], strict=True):
            if held and at - held[1] >= us:
                out.append((k[0], held[0], held[1] + us, held[2], "expired"))
                held = None
            if held and end:
                out.append((k[0], held[0], int(at), held[2] + 1, "released"))
                held = None
            elif not end:
                held = (held[0], int(at), held[2] + 1) if held else (int(at), int(at), 1)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max((held[1] + us) // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    schema = f"{key} {kind}, start_us long, end_us long, beats long, reason string"
    held = "start long, last long, beats long"
    return rows.withWatermark("_ts", late).groupBy(key).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
