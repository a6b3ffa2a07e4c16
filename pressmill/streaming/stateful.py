"""Running registries on keyed state: issue rosters of ministries, health of feeds.

A task adds up its rows by key before they travel, so a key with a third of all rows costs some rows a task and batch.  State is a
map in the store, of which a batch reads and writes the entries that it touches alone.  Sessions need the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``), which ``use_keyed_state`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 24 * 3_600_000


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def added_up(batches: Iterator[pd.DataFrame], keys: list[str], how: dict[str, str]) -> Iterator[pd.DataFrame]:
    """One row for each value of the keys of all batches of a task: sums and maxima."""
    held = None
    for batch in batches:
        both = batch if held is None else pd.concat([held, batch])
        held = both.groupby(keys, sort=False, as_index=False).agg(how)
    if held is not None and len(held):
        yield held


class Roster(StatefulProcessor):
    """Counts of all issues of a ministry, and its leading ones.

    Counts only grow, so the leaders after a batch are among the leaders before it and the issues that the batch names.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "issue_slug string", "n long")
        self.leaders = handle.getValueState("leaders", "slugs array<string>, counts array<long>, total long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, int] = {}
        for pdf in rows:
            for slug, n in pdf.groupby("issue_slug")["n"].sum().items():
                new[slug] = new.get(slug, 0) + int(n)
        slugs, counts, total, version = self.leaders.get() if self.leaders.exists() else ([], [], 0, 0)
        leading = dict(zip(slugs, counts, strict=True))
        for slug, n in new.items():
            own = (slug,)
            leading[slug] = (self.counts.getValue(own)[0] if self.counts.containsKey(own) else 0) + n
            self.counts.updateValue(own, (leading[slug],))
        top = sorted(leading.items(), key=lambda x: (-x[1], x[0]))[: self.most]
        total, version = total + sum(new.values()), version + 1
        self.leaders.update(([s for s, _ in top], [n for _, n in top], total, version))
        rest = total - sum(n for _, n in top)  # mentions of other issues count for the first
        out = pd.DataFrame(top, columns=["issue_slug", "mention_count"])
        out.insert(0, "ministry_hint", key[0])
        out["rank"] = range(1, len(out) + 1)
        out["consolidated"] = out["mention_count"] + [rest, *[0] * (len(out) - 1)]
        out["version"] = version
        yield out

    def close(self) -> None:
        pass


def issue_registry(stream: DataFrame, most: int = 20) -> DataFrame:
    """ministry_hint, issue_slug, mention_count, rank, consolidated, version: the whole roster of each ministry that a batch touches.

    Of a ministry's rows those of its highest version hold.  Then mention_count is that of topics.roster() and consolidated the
    number of mentions that topics.consolidated() gives the issue, over all rows so far, whatever their order and batches.
    A row without ministry or issue counts nothing.
    """
    use_keyed_state(stream.sparkSession)
    named = stream.where("ministry_hint is not null and issue_slug is not null").select("ministry_hint", "issue_slug", F.lit(1).cast("long").alias("n"))
    partial = named.mapInPandas(lambda batches: added_up(batches, ["ministry_hint", "issue_slug"], {"n": "sum"}), "ministry_hint string, issue_slug string, n long")
    schema = "ministry_hint string, issue_slug string, mention_count long, rank int, consolidated long, version long"
    return partial.groupBy("ministry_hint").transformWithStateInPandas(Roster(most), schema, "Update", "None")


ERRORS = {"ssl": 0.2, "timeout": 0.2, "xml": 0.1}


class Health(StatefulProcessor):
    """Counters of a feed, its last failure, and a timer for the time at which that failure stops to weigh."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("feed", "attempts long, ok long, ssl long, timeout long, xml long, failed long")

    def _row(self, key, now: int) -> pd.DataFrame:
        attempts, ok, *errors, failed = self.state.get()
        score = 1.0
        if attempts:
            score = ok / attempts * (0.8 if failed is not None and failed > now - DAY_MS else 1.0)
            score = max(0.0, score - sum(lost for n, lost in zip(errors, ERRORS.values(), strict=True) if n > ok))
        return pd.DataFrame({"feed": [key[0]], "attempts": [attempts], "score": [round(score, 6)], "at": [pd.Timestamp(now, unit="ms")]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, None)
        counts, failed = list(old[:5]), old[5]
        for pdf in rows:
            counts = [a + int(b) for a, b in zip(counts, pdf[["attempts", "ok", *ERRORS]].sum(), strict=True)]
            last = pdf["failed"].max()
            failed = int(last) if pd.notna(last) and (failed is None or last > failed) else failed
        now = timerValues.getCurrentWatermarkInMs()
        if failed != old[5]:
            if old[5] is not None:
                self.handle.deleteTimer(old[5] + DAY_MS)
            if failed + DAY_MS > now:
                self.handle.registerTimer(failed + DAY_MS)
        self.state.update((*counts, failed))
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def feed_health(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """feed, attempts, score, at: a feed's health as of the watermark, when a batch has fetches of it and when its last failure
    has become a day old, which takes no fetch.

    ``stream``: feed, ts, success, error_class, as for usage.feed_health(), whose score it is: for each feed the row of the
    latest ``at`` (of equal ones the most attempts) holds up to the watermark.  Rows later than the watermark's delay are dropped by Spark.
    """
    use_keyed_state(stream.sparkSession)
    known = F.col("success").isNotNull().cast("long")
    failed = F.when(~F.col("success"), F.unix_millis(F.col("ts").cast("timestamp")))
    counts = {"attempts": known, "ok": F.coalesce(F.col("success"), F.lit(False)).cast("long")} | {k: F.coalesce(F.col("error_class") == k, F.lit(False)).cast("long") for k in ERRORS}
    rows = stream.select("feed", F.col("ts").cast("timestamp").alias("ts"), *[c.alias(k) for k, c in counts.items()], failed.cast("double").alias("failed"))
    how = {"ts": "max"} | dict.fromkeys(counts, "sum") | {"failed": "max"}
    partial = rows.mapInPandas(lambda batches: added_up(batches, ["feed"], how), rows.schema).withWatermark("ts", delay)
    return partial.groupBy("feed").transformWithStateInPandas(Health(), f"feed {rows.schema['feed'].dataType.simpleString()}, attempts long, score double, at timestamp", "Update", "EventTime")
