"""Queries that run the streaming jobs over the given tables, landed as files, to their end, and return what they have written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.stored import scratch_path
from ..streaming import jobs, stateful
from ..streaming.store import MentionStore
from . import tables as t
from .catalog import HEALTH, ROSTER, TS, M, query


def landed(df: DataFrame, files: int = 4, per_trigger: int = 100) -> DataFrame:
    """The rows as a stream of files: ``files`` of them, of which a batch takes ``per_trigger``, each split for as many tasks as shuffles have."""
    path = scratch_path(df.sparkSession)
    split = -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // files)
    df.repartition(files * split).write.parquet(path)
    return jobs.read_stream(df.sparkSession, path, df.schema, per_trigger * split)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that a stream emits until its input is used up, with the number of their batch."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark), scratch_path(spark)
    writer = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).outputMode(mode)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").option("basePath", path).parquet(path)


@query("r1_ingest", M + "SELECT entry_id, text, likes FROM mentions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in several batches, each once."""
    return drained(landed(t.mentions(spark, sf_dir).select("entry_id", "text", "likes"), per_trigger=1)).drop("batch")


@query("r2_late_dedup", M + "SELECT entry_id FROM mentions")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections that overlap by all they have, the second half an hour on."""
    once = t.mentions(spark, sf_dir).select("entry_id", F.col("published_at").alias("ts"))
    both = once.unionByName(once.withColumn("ts", F.col("ts") + F.expr("interval 30 minutes")))
    return drained(jobs.dedup_late(landed(both), ["entry_id"])).select("entry_id")


@query("r3_upsert_stream", M + f""", r AS (SELECT entry_id, entry_id % 3 AS user_id, text, {t.NORM.format('text')} AS norm FROM mentions),
    one AS (SELECT * FROM r WHERE entry_id % 2 = 0 QUALIFY norm = '' OR row_number() OVER (PARTITION BY user_id, norm ORDER BY entry_id) = 1),
    two AS (SELECT * FROM r WHERE entry_id % 2 = 1 AND (norm = '' OR NOT EXISTS (FROM one WHERE one.user_id = r.user_id AND one.norm = r.norm)) QUALIFY norm = '' OR row_number() OVER (PARTITION BY user_id, norm ORDER BY entry_id) = 1)
    SELECT entry_id, user_id, CASE WHEN entry_id % 10 = 0 THEN 'corrected' ELSE text END AS text FROM (FROM one UNION ALL FROM two)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one checkpoint: even ids; then odd ones, of which stored texts stay out, and corrections of some even ones."""
    rows = t.mentions(spark, sf_dir).select("entry_id", (F.col("entry_id") % 3).alias("user_id"), "text")
    path, out, checkpoint = (scratch_path(spark) for _ in range(3))
    rows.where("entry_id % 2 = 0").write.parquet(path)
    run = lambda: jobs.upsert_stream(jobs.read_stream(spark, path, rows.schema), out, checkpoint, ["entry_id"], ["entry_id"], buckets=16).awaitTermination()
    run()
    store = MentionStore(out, ["entry_id"])
    known = store.read(spark).where("entry_id % 10 = 0").withColumn("text", F.lit("corrected"))
    rows.where("entry_id % 2 = 1").unionByName(known.select(*rows.columns)).write.mode("append").parquet(path)
    run()
    return store.read(spark)


@query("r4_registry_stream", ROSTER + """, n AS (SELECT ministry_hint, count(*) AS total FROM mentions WHERE ministry_hint IS NOT NULL AND issue_slug IS NOT NULL GROUP BY 1)
    SELECT ministry_hint, issue_slug, mention_count, rank::INTEGER AS rank, (mention_count + CASE WHEN rank = 1 THEN total - sum(mention_count) OVER (PARTITION BY ministry_hint) ELSE 0 END)::BIGINT AS consolidated FROM r JOIN n USING (ministry_hint)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters after all batches."""
    emitted = drained(stateful.issue_registry(landed(t.mentions(spark, sf_dir).select("entry_id", "ministry_hint", "issue_slug"), per_trigger=2)), "update")
    last = F.max("version").over(Window.partitionBy("ministry_hint"))
    return emitted.withColumn("last", last).where("version = last").drop("last", "version", "batch")


@query("r7_change_alerts", M + """, d AS (SELECT date_trunc('day', published_at) AS start, avg(sentiment_score) AS mean FROM mentions GROUP BY 1),
    c AS (SELECT * FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(published_at) FROM mentions) - INTERVAL 1 HOUR)
    SELECT c.start, round(c.mean, 6) AS mean, round(c.mean - p.mean, 6) AS change FROM c JOIN c p ON p.start + INTERVAL 1 DAY = c.start WHERE abs(c.mean - p.mean) >= 0.1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on days that the watermark has closed."""
    path = scratch_path(spark)
    stream = landed(t.mentions(spark, sf_dir).select("published_at", "sentiment_score"))
    jobs.change_alerts(stream, scratch_path(spark), lambda df: df.write.mode("append").parquet(path)).awaitTermination()
    found = spark.read.schema("start timestamp, mean double, previous double, change double").parquet(path)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.round("mean", 6).alias("mean"), F.round("change", 6).alias("change"))


@query("r8_feed_health_stream", HEALTH.replace(TS, "(SELECT max(ts) - INTERVAL 1 HOUR FROM fetches)") + "SELECT * FROM h")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at the watermark; penalties of failures that are a day old by then have lapsed by timers."""
    emitted = drained(stateful.feed_health(landed(t.feed_fetches(spark, sf_dir).select("feed", "ts", "success", "error_class"))), "update")
    last = F.max_by(F.struct("attempts", "score"), F.struct("at", "attempts")).alias("last")
    return emitted.groupBy("feed").agg(last).select("feed", "last.attempts", "last.score")
