"""Observability: request, call and product metrics, call traces, lifecycle states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_retryable

MOST_MS = 600_000
#: Accuracy of percentile sketches: ranks are off by one in so many at most.
ACCURACY = 10_000


def _percentiles(column: str, exact: bool) -> list[Column]:
    """p50 and p95: exact ones hold all distinct values of a group; the others are mergeable sketches of a bounded size."""
    at = (lambda p: F.percentile(column, p)) if exact else (lambda p: F.percentile_approx(column, p, ACCURACY))
    return [at(0.5).alias(f"p50_{column}"), at(0.95).alias(f"p95_{column}")]


def red_metrics(requests: DataFrame, *more: Column, exact: bool = False) -> DataFrame:
    """requests(route, method, status_class, ms, failed) -> counts, errors, mean, median and 95th percentile of duration; `more` are further group columns."""
    counts = F.count(F.lit(1)).alias("request_count"), F.count_if("failed").alias("error_count"), F.avg("ms").alias("avg_ms")
    return requests.groupBy(*more, "route", "method", "status_class").agg(*counts, *_percentiles("ms", exact))


def call_metrics(calls: DataFrame, *more: Column, exact: bool = False) -> DataFrame:
    """calls(op, ok, status, latency_ms, input_tokens, output_tokens) by op; transient errors are those that a retry can mend."""
    return calls.groupBy(*more, "op").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.count_if(~F.col("ok") & F.coalesce(is_retryable(F.col("status")), F.lit(False))).alias("transient_errors"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        *_percentiles("latency_ms", exact),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def validate_time_to_file(df: DataFrame) -> DataFrame:
    return df.where(F.col("ms").between(0, MOST_MS))


def time_to_file_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per source: count, median and 95th percentile of valid times; exact percentiles hold all distinct values of a group."""
    return validate_time_to_file(df).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("avg_ms"), *_percentiles("ms", exact))


def recent_calls(calls: DataFrame, n: int) -> DataFrame:
    """The newest calls first; n is clamped to 1 to 50."""
    return calls.orderBy(F.col("created_at").desc(), F.col("sk").desc()).limit(50 if n <= 0 else min(n, 50))


def expire_calls(calls: DataFrame, as_of: str) -> DataFrame:
    """Calls whose 30 days are not over."""
    return calls.where(F.col("created_at") + F.expr("INTERVAL 30 DAYS") > F.lit(as_of).cast("timestamp"))


def latest_state(updates: DataFrame, key: str = "id", terminal: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """updates(key, seq, status): the first terminal update of each key, else the latest."""
    final = F.col("status").isin(*terminal)
    order = Window.partitionBy(key).orderBy(final.desc(), F.when(final, F.col("seq")).asc(), F.col("seq").desc())
    return updates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def metric_lines(points: DataFrame) -> DataFrame:
    """points(ts_ms, namespace, dims map, metrics map) -> value: one JSON line per record; dimension keys sorted; none without metrics."""
    some = points.where(F.size("metrics") > 0)
    keys = F.array_sort(F.map_keys("dims"))
    dims = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at("dims", k))))
    names = F.array_sort(F.map_keys("metrics"))
    values = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.element_at("metrics", k))))
    return some.select(F.to_json(F.struct(F.col("ts_ms").alias("timestamp"), "namespace", keys.alias("dimensions"), dims.alias("labels"), values.alias("metrics"))).alias("value"))
