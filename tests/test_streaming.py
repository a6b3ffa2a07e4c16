import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressmill.operators import topics, usage
from pressmill.streaming import jobs, stateful, store

START = datetime(2024, 1, 1)


def drained(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def events(spark, path, n=48):
    rows = [(i, START + timedelta(hours=i), "a" if i % 2 else "b", float(i)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, value double").coalesce(1).write.parquet(str(path))
    return jobs.read_stream(spark, str(path), "event_id long, ts timestamp_ntz, kind string, value double")


def test_windows_equal_batch(spark, tmp_path):
    stream = events(spark, tmp_path / "e")
    drained(jobs.windowed(stream, "1 day", ["kind"]), "windows", "complete")
    batch = spark.read.parquet(str(tmp_path / "e")).groupBy(F.date_trunc("day", "ts").alias("start"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    key = lambda r: (str(r.start), r.kind, r.n, r.total)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, batch.collect()))


def test_dedup_late(spark, tmp_path):
    rows = [(1, START, "x"), (2, START, "X "), (3, START, "y")]
    spark.createDataFrame(rows, "id long, ts timestamp_ntz, text string").write.parquet(str(tmp_path / "d"))
    stream = jobs.read_stream(spark, str(tmp_path / "d"), "id long, ts timestamp_ntz, text string")
    drained(jobs.dedup_texts(stream), "texts", "append")
    assert spark.table("texts").count() == 2


def latest(rows, key, version):
    """The rows of the highest version of each key."""
    top = {}
    for r in rows:
        top[r[key]] = max(top.get(r[key], r[version]), r[version])
    return [r for r in rows if r[version] == top[r[key]]]


def test_registry_equals_the_batch_twin(spark, tmp_path):
    """In files of any order, read in several runs of one checkpoint, with one ministry in most rows and issues beyond the cap."""
    rng = random.Random(5)
    rows = [(i, rng.choice("mmmmmmno"), f"s{int(rng.paretovariate(1.1)) % 40}") for i in range(1500)] + [(-1, None, "s1"), (-2, "m", None)]
    schema = "entry_id long, ministry_hint string, issue_slug string"
    out = []
    for order in (1, -1):
        path, seen = str(tmp_path / f"r{order}"), []
        files = [rows[i::6] for i in range(6)][::order]
        for part in (files[:4], files[4:]):
            for rows_of in part:
                spark.createDataFrame(rows_of, schema).coalesce(2).write.mode("append").parquet(path)
            stream = stateful.issue_registry(jobs.read_stream(spark, path, schema, files_per_trigger=3), most=4)
            stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{path}-c").trigger(availableNow=True).start().awaitTermination()
        out.append({(r.ministry_hint, r.issue_slug): (r.mention_count, r.rank, r.consolidated) for r in latest(seen, "ministry_hint", "version")})
    df = spark.createDataFrame(rows, schema)
    given = {(r.ministry_hint, r.issue): r["count"] for r in topics.consolidated(df, most=4).groupBy("ministry_hint", "issue").count().collect()}
    want = {(r.ministry_hint, r.issue_slug): (r.mention_count, r["rank"], given[r.ministry_hint, r.issue_slug]) for r in topics.roster(df, most=4).collect()}
    assert out == [want, want] and len(want) == 12


def test_feed_health_equals_the_batch_at_the_watermark(spark, tmp_path):
    """Also where a failure grows a day old without a further fetch of the feed."""
    rng = random.Random(7)
    schema = "feed string, ts timestamp_ntz, success boolean, error_class string"
    rows = [("early", START, False, "ssl"), ("early", START + timedelta(minutes=1), True, None), ("none", START, None, None)]
    for h in range(60):
        for feed in "abc":
            ok = rng.random() < (0.9 if feed == "a" else 0.4)
            rows.append((feed, START + timedelta(hours=h, minutes=rng.randrange(50)), ok, None if ok else rng.choice(["ssl", "timeout", "xml", "network"])))
    rows.append(("calm", START + timedelta(hours=50), True, None))
    path, seen = str(tmp_path / "f"), []
    for i in range(0, len(rows), 50):  # in the order of time, so that nothing is late
        part = sorted(rows, key=lambda r: r[1])[i : i + 50]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        stream = stateful.feed_health(jobs.read_stream(spark, path, schema), "1 hour")
        stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    watermark = max(r[1] for r in rows) - timedelta(hours=1)
    got = {}
    for r in sorted(seen, key=lambda r: (r["at"], r.attempts)):
        got[r.feed] = (r.attempts, r.score)
    batch = usage.feed_health(spark.createDataFrame(rows, schema), str(watermark))
    assert got == {r.feed: (r.attempts, r.score) for r in batch.collect()}
    scores = [r.score for r in sorted(seen, key=lambda r: r["at"]) if r.feed == "early"]
    assert scores[0] == 0.4 and scores[-1] == 0.5  # the penalty has lapsed


def test_upsert_stream(spark, tmp_path):
    schema = "entry_id long, user_id long, text string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: jobs.upsert_stream(jobs.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "c"), ["entry_id"], ["entry_id"]).awaitTermination()
    run()
    spark.createDataFrame([(3, 1, "A"), (4, 1, "c"), (2, 1, "b2")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.entry_id: r.text for r in store.MentionStore(str(tmp_path / "out"), ["entry_id"]).read(spark).collect()} == {1: "a", 2: "b2", 4: "c"}


def merged(rows, batch):
    """The plain rule: known keys update, other rows enter unless their tenant has the text."""
    known = set(rows)
    texts = {(u, t.lower()) for u, t in rows.values() if t}
    for i, u, t in sorted(batch):
        if i in known:
            rows[i] = (u, t if t is not None else rows[i][1])
        elif not t or (u, t.lower()) not in texts:
            rows[i] = (u, t)
            texts |= {(u, t.lower())} if t else set()


def test_store_survives_a_loss_between_writing_and_switching(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    own, rows = store.MentionStore(str(tmp_path / "s"), ["entry_id"], buckets=5), {}
    for n in range(5):
        batch = list({i: (i, i % 2, rng.choice(["a", "B", "b", "c", "d", "", None, f"t{i}", "e", "f"])) for i in (rng.randrange(40) for _ in range(12))}.values())
        df = spark.createDataFrame(batch, "entry_id long, user_id long, text string")
        before = dict(rows)
        if n in (1, 3):
            with monkeypatch.context() as m, pytest.raises(RuntimeError):
                m.setattr(store.MentionStore, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
                own.merge(df, n, ["entry_id"])
            assert {r.entry_id: (r.user_id, r.text) for r in own.read(spark).collect()} == before  # the version before holds
        merged(rows, batch)
        own.merge(df, n, ["entry_id"])
        if n == 3:
            own.merge(df, n, ["entry_id"])  # replayed after its switch
        assert {r.entry_id: (r.user_id, r.text) for r in own.read(spark).collect()} == rows
    assert len(rows) > 12


def test_a_batch_reads_the_buckets_that_it_touches(spark, tmp_path, monkeypatch):
    own, asked = store.MentionStore(str(tmp_path / "s"), ["entry_id"], buckets=50), []
    df = lambda ids: spark.createDataFrame([(i, 1, f"text {i}") for i in ids], "entry_id long, user_id long, text string")
    own.merge(df(range(300)), 0, ["entry_id"])
    read = own._read
    monkeypatch.setattr(own, "_read", lambda s, m, kind, schema, only=None: asked.append((kind, len(only))) or read(s, m, kind, schema, only))
    own.merge(df([7, 1000]), 1, ["entry_id"])
    assert [k for k, n in asked] == ["rows", "index"] and all(n <= 3 for _, n in asked) and own.manifest(spark)["rows", 0] in (0, 1)


def test_change_alerts(spark, tmp_path):
    rows = [(START + timedelta(days=d), s) for d, s in ((0, 0.5), (1, 0.55), (2, -0.2), (9, 0.0))]  # the last one closes the others
    spark.createDataFrame(rows, "published_at timestamp_ntz, sentiment_score double").write.parquet(str(tmp_path / "s"))
    seen = []
    stream = jobs.read_stream(spark, str(tmp_path / "s"), "published_at timestamp_ntz, sentiment_score double")
    jobs.change_alerts(stream, str(tmp_path / "c"), lambda df: seen.extend(df.collect())).awaitTermination()
    assert [round(r.change, 2) for r in seen] == [-0.75]


def test_landed_files_are_as_many_as_shuffles_have_tasks(spark):
    from pressmill.plans import streams

    stream = streams.landed(spark.range(100).toDF("id"), files=2, per_trigger=1)  # the session has 4 partitions
    rows = streams.drained(stream.withColumn("file", F.col("_metadata.file_name"))).collect()
    assert sorted(r.id for r in rows) == list(range(100))
    assert len({r.file for r in rows}) == 4 and len({r.batch for r in rows}) == 2


def test_a_merge_chooses_rows_without_their_texts(spark, tmp_path, monkeypatch):
    chosen_from, plain = [], store.keep_first
    monkeypatch.setattr(store, "keep_first", lambda df, keys, order: chosen_from.append(df.columns) or plain(df, keys, order))
    batch = spark.createDataFrame([(1, 1, "one"), (2, 1, "One "), (None, 1, "no key"), (3, 2, "one")], "entry_id long, user_id long, text string")
    kept = store.MentionStore(str(tmp_path / "s"), ["entry_id"], buckets=4)
    kept.merge(batch, 0, ["entry_id"])
    assert sorted((r.entry_id or 0, r.text) for r in kept.read(spark).collect()) == [(0, "no key"), (1, "one"), (3, "one")]
    assert "text" in chosen_from[0] and "text" not in chosen_from[1]
