"""Structured Streaming jobs: continuous ingest, late-data dedup, windows, upserts, running registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text
from .store import MentionStore


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """New files of a folder, some at a time; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup_late(stream: DataFrame, keys: list[str], ts: str = "ts", overlap: str = "2 hours") -> DataFrame:
    """Rows that an overlap of collections repeats pass once; state lasts as long as the overlap."""
    return timed(stream, ts, overlap).dropDuplicatesWithinWatermark(keys)


def dedup_texts(stream: DataFrame, ts: str = "ts", overlap: str = "2 hours") -> DataFrame:
    return dedup_late(stream.withColumn("_key", F.sha2(normalize_text(F.col("text")), 256)), ["_key"], ts, overlap).drop("_key")


def windowed(stream: DataFrame, size: str, by: list[str], slide: str | None = None, ts: str = "ts", value: str = "value", delay: str = "2 hours") -> DataFrame:
    """start, by, n, total of tumbling or sliding windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = timed(stream, ts, delay).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding_sentiment(stream: DataFrame, size: str = "7 days", slide: str = "1 day", ts: str = "published_at") -> DataFrame:
    w = F.window(ts, size, slide)
    labels = [F.count_if(F.col("sentiment_label") == x).alias(x) for x in ("positive", "negative", "neutral")]
    return timed(stream, ts, "1 day").groupBy(w).agg(F.count("*").alias("total"), *labels).select(F.col("window.start").alias("start"), "total", "positive", "negative", "neutral")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Merges each batch into a MentionStore: deduplicated against the stored texts, known keys updated, one version a batch."""
    store = MentionStore(path, keys, buckets=buckets)
    return stream.writeStream.foreachBatch(lambda batch, epoch: store.merge(batch, epoch, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_alerts(stream: DataFrame, checkpoint: str, emit: Callable[[DataFrame], None], size: str = "1 day", threshold: float = 0.1, ts: str = "published_at") -> StreamingQuery:
    """Hands to emit() the periods whose mean score differs from the period before by the threshold or more.

    A period is compared once, when the watermark has closed it, with the means of closed periods, which are kept beside the
    checkpoint, a row a period; a batch that is replayed writes its own again.
    """
    w = timed(stream, ts, "1 hour").groupBy(F.window(ts, size)).agg(F.avg("sentiment_score").alias("mean")).select(F.col("window.start").alias("start"), "mean")
    means = f"{checkpoint.rstrip('/')}-means"

    def compare(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{means}/epoch={epoch}")
        closed = batch.sparkSession.read.schema("start timestamp, mean double, epoch long").option("basePath", means).parquet(means)
        before = closed.where(F.col("epoch") <= epoch).select((F.col("start") + F.expr(f"interval {size}")).alias("start"), F.col("mean").alias("previous"))
        found = closed.where(F.col("epoch") == epoch).join(before, "start").withColumn("change", F.col("mean") - F.col("previous"))
        emit(found.where(F.abs("change") >= threshold).drop("epoch"))

    return w.writeStream.outputMode("append").foreachBatch(compare).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
