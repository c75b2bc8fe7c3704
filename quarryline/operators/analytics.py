"""Experiment and telemetry analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(value: str, prefix: str = "") -> list[Column]:
    """count, mean, population deviation and linear percentiles of finite values."""
    v = F.when(~F.isnan(F.col(value)) & (F.abs(value) != float("inf")), F.col(value))
    out = {"n": F.count(v), "mean": F.round(F.avg(v), 6), "std": F.round(F.stddev_pop(v), 6)}
    out |= {f"p{p}": F.round(F.percentile(v, p / 100), 6) for p in (50, 95, 99)}
    return [c.alias(prefix + k) for k, c in out.items()]


def win_tie_loss(cells: DataFrame, key: str, who: str, metric: str, higher: bool = True) -> DataFrame:
    """a, b, wins, ties, losses, mean_delta of every pair of experiments over the keys that both have."""
    a = cells.select(key, F.col(who).alias("a"), F.col(metric).alias("x"))
    b = cells.select(key, F.col(who).alias("b"), F.col(metric).alias("y"))
    d = (F.col("y") - F.col("x")) * (1 if higher else -1)
    p = a.join(b, key).where("a < b")
    return p.groupBy("a", "b").agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("mean_delta"))


def all_or_null(c: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def percent_difference(value: Column, ref: Column) -> Column:
    return F.when(ref > 0, F.round(100.0 * (value - ref) / ref, 6))


def largest_remainder(df: DataFrame, name: str, weight: str, limit: int) -> DataFrame:
    """Whole quotas that add up to limit: floors, then one more by the largest fraction, ties by name. A row a group."""
    whole = Window.partitionBy()
    exact = F.col(weight) * F.lit(limit) / F.sum(weight).over(whole)
    q = df.withColumn("_e", exact).withColumn("_f", F.floor("_e")).withColumn("_left", F.lit(limit) - F.sum("_f").over(whole))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), name))
    return q.withColumn("quota", (F.col("_f") + (place <= F.col("_left")).cast("int")).cast("long")).drop("_e", "_f", "_left")


def phase_summary(df: DataFrame, phase: str, value: str, phases: list[str]) -> DataFrame:
    """The distribution of each of the fixed phases, also of those without a row."""
    fixed = df.sparkSession.createDataFrame([(p,) for p in phases], f"{phase} string")
    d = df.groupBy(phase).agg(*distribution(value))
    return fixed.join(F.broadcast(d.where(F.col(phase).isin(phases))), phase, "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a row a phase


def run_deltas(candidate: DataFrame, reference: DataFrame, key: str, metrics: list[str], comparable: Column, review: str, apart: float = 20.0) -> DataFrame:
    """key, metric, delta, percent of a candidate run against a reference, null where the two are not comparable, and
    review: whether the metric of that name differs by more than `apart` percent."""
    side = lambda d, n: d.unpivot([key], metrics, "metric", n)
    j = side(candidate, "x").join(side(reference, "y"), [key, "metric"])
    percent = percent_difference(F.col("x"), F.col("y"))
    return j.select(
        key, "metric", F.when(comparable, F.round(F.col("x") - F.col("y"), 6)).alias("delta"), F.when(comparable, percent).alias("percent"),
        ((F.col("metric") == review) & F.coalesce(F.abs(percent) > apart, F.lit(False))).alias("review"),
    )


def compared_points(a: DataFrame, b: DataFrame, key: str, vector: str, rel: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """key, state: same, different, missing (only in a) or unexpected (only in b), vectors being equal within tolerance."""
    j = a.select(key, F.col(vector).alias("x"), F.lit(True).alias("in_a")).join(b.select(key, F.col(vector).alias("y"), F.lit(True).alias("in_b")), key, "full")
    near = lambda p, q: F.abs(p - q) <= F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.abs(p), F.abs(q)))
    same = (F.size("x") == F.size("y")) & F.forall(F.zip_with("x", "y", lambda p, q: F.coalesce(near(p.cast("double"), q.cast("double")), F.lit(False))), lambda t: t)
    state = F.when(F.col("in_a").isNull(), "unexpected").when(F.col("in_b").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "same").otherwise("different")
    return j.select(key, state.alias("state"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, value, n: how often each value of each column occurs; null is a value."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "field", "value")
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


def snapshot(cells: DataFrame, key: str, who: str, value: str, names: list[str]) -> DataFrame:
    """A row a key with a column for each named experiment; null where it has no cell."""
    return cells.groupBy(key).pivot(who, names).agg(F.first(value))


def paired_metrics(cells: DataFrame, key: str, who: str, metrics: dict[str, bool]) -> DataFrame:
    """metric, a, b, wins, ties, losses, n, mean_delta for every metric and pair of experiments over the keys where both
    have it; metrics: whether higher is better, so that a win of a lower latency counts as one. One join for all."""
    side = lambda n, v: cells.unpivot([key, who], list(metrics), "metric", v).where(F.col(v).isNotNull()).withColumnRenamed(who, n)
    sign = F.create_map(*[F.lit(x) for m, up in metrics.items() for x in (m, 1 if up else -1)])[F.col("metric")]
    p = side("a", "x").join(side("b", "y"), [key, "metric"]).where("a < b").withColumn("_d", (F.col("y") - F.col("x")) * sign)
    return p.groupBy("metric", "a", "b").agg(
        F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") == 0).alias("ties"), F.count_if(F.col("_d") < 0).alias("losses"),
        F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("x")), 6).alias("mean_delta"),
    )


def phase_rates(df: DataFrame, phase: str, ok: Column, tokens: str, seconds: dict[str, float | None]) -> DataFrame:
    """phase, n, succeeded, success_rate, error_rate, requests_per_second and tokens_per_second of each of the phases named
    in seconds (wall time, or None), also of those without a row; tokens only where every success has them."""
    d = df.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = F.when(F.col("_ok"), F.col(tokens))
    g = d.groupBy(phase).agg(F.count("*").alias("n"), F.count_if("_ok").alias("succeeded"), F.sum(good).alias("_t"), F.count(good).alias("_known"))
    fixed = df.sparkSession.createDataFrame(list(seconds.items()), f"{phase} string, _s double")
    j = fixed.join(F.broadcast(g.where(F.col(phase).isin(list(seconds)))), phase, "left").fillna(0, ["n", "succeeded", "_known"])  # a row a phase
    share = lambda c: F.when(F.col("n") > 0, F.round(c / F.col("n"), 6))
    rate = lambda c: F.when(F.col("_s") > 0, F.round(c / F.col("_s"), 6))
    known = F.when(F.col("_known") == F.col("succeeded"), F.coalesce("_t", F.lit(0)))
    return j.select(
        phase, "n", "succeeded", share(F.col("succeeded")).alias("success_rate"), share(F.col("n") - F.col("succeeded")).alias("error_rate"),
        rate(F.col("succeeded")).alias("requests_per_second"), rate(known).alias("tokens_per_second"),
    )


def histogram(df: DataFrame, by: str, value: str, width: float, buckets: int) -> DataFrame:
    """by, bucket, n: values in buckets of a width, the last one open; every bucket of a group has a row."""
    b = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(F.col(value) / width)))
    n = df.where(F.col(value).isNotNull()).groupBy(by).agg(*[F.count_if(b == i).alias(str(i)) for i in range(buckets)])
    return n.unpivot([by], [str(i) for i in range(buckets)], "bucket", "n").withColumn("bucket", F.col("bucket").cast("int"))
