import random
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from pressmill.operators import dedup, enrich, filters, metrics, similar_sets, topics, usage


def test_dedup_split_adds_up_and_repeats(spark):
    new = spark.createDataFrame([(1, 1, "Hello"), (2, 1, "hello "), (3, 1, "stored"), (4, 1, ""), (5, 1, None), (6, 2, "stored")], "entry_id long, user_id long, text string")
    old = spark.createDataFrame([(9, 1, "Stored")], "entry_id long, user_id long, text string")
    judged = dedup.dedup_split(new, old, ["entry_id"])
    assert {r.entry_id: r.fate for r in judged.collect()} == {1: "unique", 2: "internal", 3: "external", 4: "empty", 5: "empty", 6: "unique"}
    stats = dedup.dedup_stats(judged).first()
    assert stats.total == stats.unique_rows + stats.external_duplicates + stats.internal_duplicates + stats.empty_rows


def test_upsert_keeps_values(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, t string, n long")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "k long, t string, n long")
    assert sorted(map(tuple, dedup.upsert(old, new, ["k"]).collect())) == [(1, "a", 5), (2, "b", 7), (3, "c", 8)]
    assert (2, None, 7) in [tuple(r) for r in dedup.upsert(old, new, ["k"], overwrite_with_null=True).collect()]


def test_near_dups_seq_against_brute_force(spark):
    texts = ["the quick brown fox jumps", "the quick brown fox jumped", "something else entirely", "quick", "quick", "the quick brown fox jumps over"]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id long, text string")
    got = {(r.a, r.b) for r in dedup.near_dups_seq(df, window=4, block=2).collect()}
    want = set()
    for i, a in enumerate(texts):
        for j in range(i + 1, min(len(texts), i + 4)):
            b = texts[j]
            if (a == b) if min(len(a), len(b)) < 10 else SequenceMatcher(None, a, b).ratio() >= 0.85:
                want.add((i, j))
    assert got == want and want


def test_alike_texts_against_the_plain_matcher():
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        base = "".join(rng.choices("abcde ", weights=[5, 4, 3, 2, 1, 3], k=rng.randint(5, 160)))
        for _ in range(4):  # characters dropped, put in, and moved to the end, about as many as the threshold allows
            x = list(base)
            for _ in range(int(len(x) * rng.choice([0, 0.05, 0.1, 0.15, 0.2]))):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a"])
            cut = rng.choice([0, 0, len(x) // 8])
            texts.append("".join(x[cut:] + x[:cut]) or "x")
    rng.shuffle(texts)
    for window, first in ((48, 48), (10, 30)):
        want = {(i, j): SequenceMatcher(None, texts[i], texts[j]).ratio() for i in range(first) for j in range(i + 1, min(48, i + window))}
        want = {k: r for k, r in want.items() if r >= 0.85 and (texts[k[0]] == texts[k[1]] or min(len(texts[k[0]]), len(texts[k[1]])) >= 10)}
        got = {(i, j): r for i, j, r in dedup._alike(texts, first, window, 0.85)}
        assert got == want and len(want) > 5


def test_corroborate_against_brute_force(spark):
    """words are given once for all rows of a text, and rows meet by marks before they meet with words."""
    rng = random.Random(9)
    draw = lambda n, of: [f"w{i}" for i in rng.sample(range(of), n)]
    base = [draw(rng.choice([0, 1, 2, 13, 40, 3000]), 9000) for _ in range(30)]
    said = [(i, b) for i, b in enumerate(base)] + [(3, draw(20, 60)), (None, draw(5, 9))]
    proof = [(i, None if rng.random() < 0.1 else f"u{rng.randint(0, 3)}", base[i][: int(len(base[i]) * rng.choice([0.2, 0.3, 0.31, 0.5, 1]))] + [f"x{k}" for k in range(rng.randint(0, 3))]) for i in rng.choices(range(30), k=120)]
    proof += [(None, "u1", draw(5, 9)), (99, "u2", draw(5, 9)), (0, "u1", [])]
    want = {i: set() for i, _ in said}
    for i, a in said:
        want[i] |= {u for j, u, b in proof if i is not None and i == j and u is not None and (a or b) and len(set(a) & set(b)) / len(set(a) | set(b)) > 0.3}
    one = spark.createDataFrame(said, "entry_id long, words array<string>")
    two = spark.createDataFrame(proof, "entry_id long, url string, words array<string>")
    as_text = lambda df: df.withColumn("text", F.array_join("words", " ")).drop("words")
    for a, b in ((one, two), (as_text(one), as_text(two)), (one, as_text(two))):
        got = {r.entry_id: (r.sources, r.verified) for r in dedup.corroborate(a, b).collect()}
        assert got == {i: (len(u), len(u) >= 2) for i, u in want.items()}
    assert {len(u) >= 2 for u in want.values()} == {True, False}


def test_corroborate_query_takes_a_text_apart_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["j15_corroborate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan  # before: for each side of each row of evidence


def test_unlike_texts_of_the_same_letters_meet_no_matcher(monkeypatch):
    """texts of one language have like counts of characters, so that counts alone left every pair to the matcher."""
    rng, met = random.Random(8), []
    syllables = ["the", "tion", "and", "er", "in", "sh", "on", "es", "ou", "ble", "wh", "ly", "ke", "va", "qu", "fo"]
    rest = ["", " "] * 25 + list("jzx.,")
    texts = ["".join(rng.choice(syllables) + rng.choice(rest) for _ in range(n)) for n in [400] * 40 + [2500] * 6]
    texts += [texts[3][:700] + "x" + texts[3][701:], texts[42][:3000] + "x" + texts[42][3001:]]
    plain = dedup._Bounded.reaches
    monkeypatch.setattr(dedup._Bounded, "reaches", lambda self, threshold: met.append(1) or plain(self, threshold))
    got = {(i, j) for i, j, _ in dedup._alike(texts, len(texts), 1000, 0.85)}
    assert got == {(3, 46), (42, 47)} and len(met) < 10  # before: 841


def test_matches_from_arrays_are_the_matchers(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choices("etaoinshr dlcqjxz.,", [12, 9, 8, 7.5, 7, 6.7, 6.3, 6, 6, 18, 4.2, 4, 2.7, 0.1, 0.1, 0.1, 0.5, 1, 1], k=rng.choice([5, 120, 199, 200, 600])))
        x = list(a)
        for _ in range(int(len(a) * rng.choice([0, 0.05, 0.2]))):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 4)] = rng.choice(["", "e", "zq"])
        b = "".join(x[len(a) // 6 :] + x[: len(a) // 6] if rng.random() < 0.3 else x)
        for most in (dedup.MET, 0):  # with none, the matcher's own search
            with monkeypatch.context() as m:
                m.setattr(dedup, "MET", most)
                matcher = dedup._Bounded(None, "", b)
                matcher.set_seq1(a)
                assert matcher.ratio_from(0.0) == SequenceMatcher(None, a, b).ratio()


def test_near_dups_seq_query_reads_whole_texts(spark, tmp_path):
    import __spark_entry__ as entry

    body = "these words of the body are the same in both texts and there are enough of them to outweigh an opening " * 3
    opening = "an opening that is longer than any title"
    texts = ["one start\n" + body, "another beginning\n" + body, opening + "\nfirst tale of the sea", opening + "\n" + "quite other words " * 9]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [(r.a, r.b, r.drop_id) for r in entry.queries()["j13_near_dups_seq"](spark, str(tmp_path)).collect()] == [(0, 1, 0)]


def test_bounded_matcher_has_the_ratio():
    rng = random.Random(4)
    alike = 0
    for _ in range(300):
        a = "".join(rng.choices("abcdefg ,.", [9, 9, 9, 5, 4, 3, 2, 20, 1, 0.3], k=rng.randint(10, 500)))
        b = "".join(c for c in a if rng.random() > 0.15) + a[: rng.randint(0, 40)]
        want, matcher = SequenceMatcher(None, a, b).ratio(), dedup._Bounded(None, a, b)
        got = matcher.ratio_from(0.85) if matcher.reaches(0.85) else -1
        assert got == want if want >= 0.85 else got < 0.85
        alike += want >= 0.85
    assert 0 < alike < 300


def test_near_dup_classes_pair_no_copies(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words)] * 3000 + [" ".join(words) + " more"] * 2 + ["other text", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id long, text string")
    members, pairs = dedup.near_dup_classes(df)
    assert [tuple(r) for r in pairs.collect()] == [(0, 3000, 20, 21)]
    assert {r.entry_id: (r.class_id, r.dropped) for r in members.collect()} == {**{i: (0, True) for i in range(3000)}, 3000: (3000, False), 3001: (3000, True), 3002: (3002, False)}


def test_near_dups_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(24)]
    texts = [" ".join(rng.sample(base, 24 - rng.randint(0, 3))) + " " * rng.randint(0, 3) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "entry_id long, text string")
    sets = [frozenset(t.split()) for t in texts]
    pairs = {(a, b) for b in range(60) for a in range(b) if 100 * len(sets[a] & sets[b]) > 85 * len(sets[a] | sets[b])}
    drop = {(a, b): a if len(texts[a]) < len(texts[b]) else b for a, b in pairs}
    assert pairs and set(drop.values()) == {r.entry_id for r in dedup.near_dup_classes(df)[0].where("dropped").collect()}
    first = [sets.index(x) for x in sets]
    wanted = {(a, b) for a, b in pairs if first[a] == a and first[b] in (a, b)}
    assert {(r.a, r.b): r.drop_id for r in dedup.near_dups_jaccard(df).collect()} == {x: drop[x] for x in wanted}


def test_a_row_that_fails_costs_few_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def scorer(batch):
        calls.add(1)
        if (batch["text"] == "bad").any():
            raise ValueError("bad")
        return batch[["entry_id"]].assign(label="positive", score=1.0)

    df = spark.range(1000, numPartitions=1).selectExpr("id as entry_id", "if(id = 700, 'bad', 'good') as text")
    assert {r.entry_id for r in enrich.enrich(df, scorer).where("label = 'neutral'").collect()} == {700}
    assert calls.value < 50


def test_similar_sets_lose_no_pair_and_propose_few(spark, monkeypatch):
    rng = random.Random(8)
    common, sets = [f"c{i}" for i in range(40)], []
    for size in (3, 6, 7, 9, 14, 30, 60, 150, 400):
        for _ in range(12):
            one = rng.sample(common, min(size, 12) // 2) + [f"r{rng.randrange(5000)}" for _ in range(size - min(size, 12) // 2)]
            sets += [one, *([w for w in one if rng.random() > gone] + [f"n{rng.randrange(10**6)}" for _ in range(rng.randint(0, size // 12))] for gone in (0.02, 0.06, 0.1))]
    sets = [list(x) for x in {tuple(sorted(set(x))) for x in sets if x}]
    want = {(a, b): (i, u) for b in range(len(sets)) for a in range(b) if 100 * (i := len({*sets[a]} & {*sets[b]})) > 85 * (u := len({*sets[a]} | {*sets[b]}))}
    df = spark.createDataFrame(list(enumerate(sets)), "no long, w array<string>")
    monkeypatch.setattr(similar_sets, "TILE", 3)  # hubs of several tiles
    assert {(r.na, r.nb): (r.intersection, r.union) for r in similar_sets.similar_sets(df, (85, 100)).collect()} == want
    assert len(want) > 100
    # many texts of the same common words, no two alike, which met on every single word before
    unlike = spark.createDataFrame([(i, rng.sample([f"v{j}" for j in range(300)], 60)) for i in range(800)], "no long, w array<string>")
    assert similar_sets._proposed(unlike, 85, 100).count() < 100


def test_location_backlog_is_whole(spark):
    df = spark.range(30_000).selectExpr("id as entry_id", "if(id % 2 = 0, null, 'x') as location_label", "1.0D as location_confidence")
    assert filters.location_backlog(df).count() == 15_000


def test_numbered_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = dedup.numbered(df, "k").orderBy("k").collect()
    assert [r.seq for r in rows] == list(range(1000))


def test_numbered_is_dense_whatever_is_read_of_it(spark, tmp_path):
    """Wide rows of many ranges, whose bounds are sampled: the numbers don't depend on the columns that a use reads."""
    wide = spark.range(0, 400_000, 1, 8).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(7).alias("_part"))
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    got = dedup.numbered(df, "k", parts=40)
    assert got.columns == ["k", "text", "_part", "seq"]
    assert tuple(got.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()) == (400_000, 400_000, 0, 399_999)
    assert got.where("seq >= 123456 and seq < 123460").orderBy("seq").select("k").collect() == df.orderBy("k").select("k").offset(123456).limit(4).collect()
    sizes = {r.batch: r.n for r in enrich.numbered_batches(df.select("k", "text"), 150, "k").groupBy("batch").agg(F.count("*").alias("n")).collect()}
    assert sizes.pop(400_000 // 150) == 400_000 % 150 and set(sizes.values()) == {150}
    assert dedup.numbered(df.limit(0), "k").count() == 0
    tied = dedup.numbered(spark.createDataFrame([(1, i) for i in range(50)] + [(None, -1)], "k long, v long"), "k")
    assert sorted(r.seq for r in tied.collect()) == list(range(51)) and tied.where("seq = 0").first().v == -1


def test_enrich_survives_failures(spark):
    def scorer(pdf):
        if "bad" in " ".join(pdf.text):
            raise ValueError
        return pdf.assign(label="positive", score=1.0, justification="ok")[["entry_id", "label", "score", "justification"]]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "entry_id long, text string").coalesce(1)
    assert {r.entry_id: r.label for r in enrich.enrich(df, scorer).collect()} == {1: "positive", 2: "neutral", 3: "positive"}


def test_roster_and_consolidation(spark):
    rows = [(i, "m", f"s{i % 3}") for i in range(9)] + [(100, "m", "rare")]
    df = spark.createDataFrame(rows, "entry_id long, ministry_hint string, issue_slug string")
    assert {r.issue_slug for r in topics.roster(df, most=3).collect()} == {"s0", "s1", "s2"}
    assert {r.entry_id: r.issue for r in topics.consolidated(df, most=3).collect()}[100] == "s0"


def test_feed_health_without_attempts(spark):
    f = spark.createDataFrame([("a", None, None, None)], "feed string, ts timestamp_ntz, success boolean, error_class string")
    assert usage.feed_health(f, "2024-01-31").first().score == 1.0


def test_plans(spark):
    df = spark.createDataFrame([(1, "a")], "entry_id long, text string")
    plan = filters.top_per_group(df, ["text"], ["entry_id"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_dictionary_is_a_table_in_blocks_of_any_size(spark):
    m = spark.createDataFrame([(1, "Ushers and this"), (2, None), (3, "abc")], "entry_id long, text string")
    rules = spark.createDataFrame([("p", "he", 1.0), ("p", "she", 2.0), ("q", "this", 4.0), ("q", "this", 8.0), ("r", "abc", -1.0), (None, "a", 1.0), ("s", None, 1.0)], "name string, term string, weight double")
    want = {(1, "p", 2, 3.0), (1, "q", 2, 12.0), (3, "r", 1, -1.0)}
    for size in (1 << 20, 40, 1):
        assert {tuple(r) for r in topics.keyword_hits(m, rules, block_bytes=size).collect()} == want
    assert topics.keyword_hits(m, rules.drop("weight")).where("name = 'q'").first().weight == 2.0
    assert topics.keyword_hits(m, rules.limit(0)).count() == 0


def test_topics_by_matrix_products(spark):
    rng = np.random.default_rng(1)
    table = {f"t{i:03}": rng.normal(size=8).tolist() for i in range(60)}
    rows = [(i, "about t001" if i % 2 else "", rng.normal(size=8).tolist()) for i in range(20)] + [(20, "t001", None), (21, "t001", [0.0] * 8), (22, None, [1.0] * 3)]
    m = spark.createDataFrame(rows, "entry_id long, text string, embedding array<double>")
    vectors = spark.createDataFrame(list(table.items()), "topic string, vector array<double>")
    near = lambda v, w: float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
    want = {(i, n, round(near(v, w), 4)) for i, _, v in rows[:20] for n, w in sorted(table.items(), key=lambda x: (-round(near(v, x[1]), 4), x[0]))[:3]}
    for block in (4096, 7):
        assert {tuple(r) for r in topics.nearest_topics(m, vectors, block=block).collect()} == want
    assert topics.nearest_topics(m, vectors.limit(0)).count() == 0
    keywords = {"t001": ["t001"], "t002": ["absent"], "none": ["about"]}
    got = {(r.entry_id, r.topic): (r.keyword_score, r.embedding_score, r.confidence) for r in topics.classify_topics(m, keywords, vectors, least=-1.0).collect()}
    assert len(got) == 3 * 23 and got[20, "t001"] == (1.0, None, 1.0) and got[1, "none"][1] is None
    assert got[1, "t001"][2] == round(0.3 + 0.7 * near(rows[1][2], table["t001"]), 3) and got[0, "t002"][2] == round(0.7 * near(rows[0][2], table["t002"]), 3)


def test_consistency_is_what_the_other_components_hold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) * [1, 10, 100, 1000]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    for k in (1, 2, 4):
        got = usage.consistency(df, ["a", "b", "c", "d"], k).first()
        assert got.n == 200 and abs(got.consistency - 1 / (1 + values[k:].sum() / 4 * 199 / 200)) < 2e-6
    assert usage.consistency(df.limit(0), ["a", "b"], 1).first().consistency is None


def test_places_of_sorted_values_by_digits(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(x), float(y)) for g, n in (("a", 400), ("b", 1), (None, 7)) for x, y in zip(rng.integers(-5, 1 << 45, n) >> rng.integers(0, 44, n), rng.lognormal(0, 30, n))]
    rows += [("a", 5, 1e-300)] * 9 + [("c", 0, -1.0), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, n long, d double")
    places = {"median": "n div 2", "low": "0", "high": "n - 1", "p90": "n div 10"}
    for column, i in (("n", 1), ("d", 2)):
        for descending in (False, True):
            got = {r.g: tuple(r[p] for p in places) for r in metrics.positional(df, column, ["g"], places, descending).collect()}
            want = {}
            for g in ("a", "b", None):
                own = sorted((r[i] for r in rows if r[0] == g and r[i] is not None and r[i] > 0), reverse=descending)
                want[g] = (own[len(own) // 2], own[0], own[-1], own[len(own) // 10])
            assert got == want
    whole = metrics.positional(df, "n", [], {"median": "n div 2"}).first().median
    assert whole == (own := sorted(r[1] for r in rows if r[1] is not None and r[1] > 0))[len(own) // 2]
