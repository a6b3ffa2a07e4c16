"""Usage logs, collection logs, feed fetches and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import percent


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a total order."""
    return last_per_key(df, keys, order, 1)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).where(f"_rank <= {most}").drop("_rank")


def user_usage(users: DataFrame, log: DataFrame, entries: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Every user with calls, recent calls, mean time, errors in percent and entries: one aggregate a table, then joins."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    calls = log.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("ts") >= since).alias("recent"), F.round(F.avg("execution_time_ms"), 6).alias("avg_ms"), F.count_if("is_error").alias("errors"))
    stored = entries.groupBy("user_id").agg(F.count("*").alias("entries"))
    out = users.select("user_id").join(calls, "user_id", "left").join(stored, "user_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("user_id", zero("calls"), zero("recent"), zero("entries"), F.coalesce("avg_ms", F.lit(0.0)).alias("avg_ms"), percent(F.coalesce("errors", F.lit(0)), F.col("calls")).alias("error_pct"))


def daily_usage(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.count_distinct("user_id").alias("users"), F.round(F.avg("execution_time_ms"), 6).alias("avg_ms"))


def system_summary(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    return log.agg(F.count("*").alias("calls"), F.count_if(recent).alias("recent"), F.count_distinct(F.when(recent, F.col("user_id"))).alias("active_users"), F.count_if("is_error").alias("errors"), F.round(F.avg("execution_time_ms"), 6).alias("avg_ms"))


def quality(df: DataFrame, columns: Sequence[str], ts: str, as_of: str, days: int = 7) -> DataFrame:
    """completeness (mean share of values), uniqueness (share of rows that repeat none before) and timeliness (1 - age / days, 0 to 1)."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / (days * 86_400e6)
    values = sum(F.col(c).isNotNull().cast("double") for c in columns) / len(columns)
    fresh = 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), age))
    rows = df.groupBy(*columns).agg(F.count("*").alias("n"), F.sum(fresh).alias("fresh")).withColumn("filled", values * F.col("n"))
    return rows.agg(F.round(F.sum("filled") / F.sum("n"), 6).alias("completeness"), F.round(F.count("*") / F.sum("n"), 6).alias("uniqueness"), F.round(F.sum("fresh") / F.sum("n"), 6).alias("timeliness"))


def consistency(df: DataFrame, columns: Sequence[str], components: int) -> DataFrame:
    """n, and consistency, 1 / (1 + e), e the mean squared error of standardised columns rebuilt from their leading components.

    A fitted pipeline (assembler, scaler, principal components) is applied to the rows; as components are orthonormal, a row's error is
    its squared length less that of its projection.  Rows with a null are left out; without rows the result is null.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = df.select(*[F.col(c).cast("double") for c in columns]).na.drop()
    if rows.isEmpty():
        return rows.agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("consistency"))
    stages = [VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_z", withMean=True), PCA(k=components, inputCol="_z", outputCol="_p")]
    applied = Pipeline(stages=stages).fit(rows).transform(rows)
    squared = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
    error = F.greatest(F.avg(squared("_z") - squared("_p")), F.lit(0.0)) / len(columns)
    return applied.agg(F.count("*").alias("n"), F.round(1 / (1 + error), 6).alias("consistency"))


def hourly_success(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("is_error")).cast("double")), 6).alias("success"))


def recent_success(log: DataFrame, key: str, order: Sequence[str], most: int = 50) -> DataFrame:
    return last_per_key(log, [key], order, most).groupBy(key).agg(F.round(F.avg((~F.col("is_error")).cast("double")), 6).alias("success"), F.count("*").alias("n"))


def next_interval(rates: DataFrame, base: float = 30) -> DataFrame:
    """Collection interval in minutes: longer where it often fails (120 at most), shorter where it hardly does (15 at least)."""
    value = F.when(F.col("success") < 0.5, F.least(F.lit(base * 1.5), F.lit(120.0))).when(F.col("success") > 0.9, F.greatest(F.lit(base * 0.8), F.lit(15.0))).otherwise(F.lit(float(base)))
    return rates.withColumn("interval_minutes", value.cast("int"))


def action_scores(log: DataFrame, key: str) -> DataFrame:
    """Mean score of a key's actions: 0 for failures, else 0.7 and 0.3 times how near the duration is to the median of successes."""
    expected = log.where("not is_error").groupBy(key).agg(F.percentile("execution_time_ms", F.lit(0.5)).alias("expected"))
    late = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.greatest(F.col("execution_time_ms") - F.col("expected"), F.lit(0.0)), F.col("expected")), F.lit(0.0)))
    score = F.when(F.col("is_error"), 0.0).otherwise(0.7 + 0.3 * (1 - late))
    return log.join(expected, key, "left").groupBy(key).agg(F.round(F.avg(score), 6).alias("score"), F.round(F.max("expected"), 6).alias("expected_ms"))


def patterns(log: DataFrame, key: str, least: int = 5) -> DataFrame:
    counts = log.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg((~F.col("is_error")).cast("double")), 6).alias("avg_success"))
    return counts.withColumn("frequency", F.round(F.col("n") / counts.agg(F.sum("n")).scalar(), 6)).where(F.col("n") >= least)


def feed_health(fetches: DataFrame, as_of: str) -> DataFrame:
    """feed, attempts, score: success rate, times 0.8 after a failure in the last day, less 0.2 each for more TLS errors or
    time-outs than successes and 0.1 for more XML errors, 0 at least; 1 without attempts."""
    recent = F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 24 hours")
    errors = {k: F.count_if(F.col("error_class") == k).alias(k) for k in ("ssl", "timeout", "xml")}
    out = fetches.groupBy("feed").agg(F.count("success").alias("attempts"), F.count_if("success").alias("ok"), *errors.values(), F.max(F.when(~F.col("success"), F.col("ts"))).alias("failed"))
    rate = F.col("ok") / F.col("attempts") * F.when(F.col("failed") > recent, 0.8).otherwise(1.0)
    lost = sum((F.when(F.col(k) > F.col("ok"), p).otherwise(0.0) for k, p in (("ssl", 0.2), ("timeout", 0.2), ("xml", 0.1))), F.lit(0.0))
    score = F.when(F.col("attempts") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), rate - lost))
    return out.select("feed", "attempts", F.round(score, 6).alias("score"))


def health_bands(health: DataFrame) -> DataFrame:
    s = F.col("score")
    band = F.when(s >= 0.9, "excellent").when(s >= 0.7, "good").when(s >= 0.5, "fair").when(s >= 0.3, "poor").otherwise("critical")
    return health.groupBy(band.alias("band")).agg(F.count("*").alias("feeds"))


def recent_latency(fetches: DataFrame, most: int = 10) -> DataFrame:
    return last_per_key(fetches, ["feed"], ["ts", "event_id"], most).groupBy("feed").agg(F.round(F.avg("response_time"), 6).alias("latency"), F.count("*").alias("n"))


def healthy_feeds(health: DataFrame, least: float = 0.5) -> DataFrame:
    return health.where(F.col("score") >= least)


def feed_union(healthy: DataFrame, reliable: DataFrame, feed: str = "feed") -> DataFrame:
    """Healthy feeds, then configured ones not among them: feed, origin."""
    both = healthy.select(feed).withColumn("origin", F.lit(0)).unionByName(reliable.select(feed).withColumn("origin", F.lit(1)))
    return both.groupBy(feed).agg(F.min("origin").alias("origin"))


def feed_validation(entries: DataFrame, slow: float = 5.0) -> DataFrame:
    """A feed is valid if half of its entries or more have a title and a link."""
    out = entries.groupBy("feed").agg(F.count("*").alias("entries"), F.count_if(F.col("has_title") & F.col("has_link")).alias("whole"), F.round(F.avg("response_time"), 6).alias("latency"))
    return out.withColumns({"valid": F.col("whole") * 2 >= F.col("entries"), "slow": F.col("latency") > slow})


def collection_stats(log: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    latest = latest_per_key(log, keys, ["ts", "event_id"])
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600e6
    return latest.select(*keys, "ts", F.round(hours, 6).alias("hours_since"), F.round("value", 6).alias("records"), (~F.col("is_error")).alias("ok"))


def run_summary(log: DataFrame, source: str) -> DataFrame:
    return log.agg(
        F.count("*").alias("runs"), F.round(F.avg((~F.col("is_error")).cast("double")), 6).alias("success"), F.count_distinct(source).alias("sources"),
        F.count_distinct(F.when(~F.col("is_error"), F.col(source))).alias("active_sources"), F.round(F.sum("value"), 3).alias("records"),
    )
