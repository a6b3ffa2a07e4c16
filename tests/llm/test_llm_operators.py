import functools
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, substring_bytes, substring_words, token_counts, toxicity

BLANK = "[\x20\x09-\x0d]+"


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect() if r.doc_id is not None}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    more = ["  two  spaces ", " lead", "trail ", "▁mark ▁▁ x", "<s> </s>", "a\x00b\r\n", "字 x  字"]
    got = token_counts.token_counts(docs)
    assert got.count() == docs.count()
    assert by_id(got, "n_tokens") == {i: (len(sp.encode(t or "")),) for i, t in rows}
    spark = docs.sparkSession
    odd = token_counts.token_counts(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string"), limit=3)
    assert by_id(odd, "n_tokens", "n_bytes", "over_limit") == {i: (n := len(sp.encode(t)), len(t.encode()), n > 3) for i, t in enumerate(more)}
    assert token_counts.token_counts(empty).count() == 0


def test_bpe_round_trip(docs, rows, empty):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: np.array(library.encode_ordinary(t or ""), "<u4").tobytes() for i, t in rows}
    encoded = bpe.bpe_encode(docs)
    assert by_id(encoded, "ids") == {i: (bytearray(x),) for i, x in want.items()}
    assert by_id(bpe.bpe_decode(encoded), "decoded") == {i: (bytearray((t or "").encode()),) for i, t in rows}
    assert by_id(bpe.bpe_round_trip(docs), "n_tokens", "ids_sha256", "decoded_sha256") == {i: (len(want[i]) // 4, sha(want[i]), sha(t or "")) for i, t in rows}
    assert bpe.bpe_round_trip(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = [str(i * i).encode() for i in range(2000)]
    table = bpe.PerfectHash(keys, list(range(2000)))
    assert [table.get(k) for k in keys] == list(range(2000)) and None not in table.slots
    assert table.get(b"absent") is None


def removed(seqs, window):
    """For each sequence, which symbols a window that a smaller key has as well covers."""
    first = {}
    for i, x in sorted(seqs.items()):
        for j in range(len(x) - window + 1):
            first.setdefault(x[j : j + window], i)
    for i, x in seqs.items():
        mask = np.zeros(len(x), bool)
        for j in range(len(x) - window + 1):
            if first[x[j : j + window]] < i:
                mask[j : j + window] = True
        yield i, mask


@pytest.mark.parametrize("window", [50, 20])
def test_remove_repeated_bytes(docs, rows, empty, window):
    seqs = {i: (t or "").encode() for i, t in rows}
    want = {i: (len(seqs[i]), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), sha(np.frombuffer(seqs[i], np.uint8)[~m].tobytes())) for i, m in removed(seqs, window)}
    got = substring_bytes.removed_bytes_digest(docs, window)
    assert got.count() == docs.count()
    assert by_id(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(w[1] for w in want.values()) > 0
    assert substring_bytes.removed_bytes_digest(empty).count() == 0


@pytest.mark.parametrize("window", [13, 5])
def test_remove_repeated_words(docs, rows, empty, window):
    seqs = {i: tuple((t or "").encode().split()) for i, t in rows}
    want = {i: (len(seqs[i]), int(m.sum()), sha(b" ".join(w for w, gone in zip(seqs[i], m) if not gone))) for i, m in removed(seqs, window)}
    got = substring_words.removed_words_digest(docs, window)
    assert got.count() == docs.count()
    assert by_id(got, "n_words", "n_removed", "kept_sha256") == want
    assert sum(w[1] for w in want.values()) > 0
    assert substring_words.removed_words_digest(empty).count() == 0


def test_wavelet_tree_counts():
    values = np.random.default_rng(1).integers(0, 37, 1000)
    tree = substring_words.WaveletTree(values)
    symbol, at = np.repeat(np.arange(37), 3), np.tile([0, 500, 1000], 37)
    assert tree.rank(symbol, at).tolist() == [int((values[:a] == s).sum()) for s, a in zip(symbol, at)]


def test_lines_left_split_a_text_once(spark):
    """op5_line_dedup: the split stood in the inner function, so that a text was split again for each of its lines."""
    texts = [("a\n\nb\r\n c", [0, 3]), ("a", [0]), ("", []), ("x\ny\nx", [1]), (None, [0])]
    df = spark.createDataFrame(texts, "text string, removed array<int>").select(line_dedup.lines_left(F.col("text"), F.col("removed")).alias("left"))
    assert [r.left for r in df.collect()] == ["\nb\r", "", "", "x\nx", None]
    assert df.select("left")._jdf.queryExecution().analyzed().toString().count("split(text") == 1  # before: 2


def test_line_tokens_are_hashed_once(docs):
    """op5_line_dedup: a token was hashed for its level and again for its number, equal tokens of a line each time."""
    assert line_dedup._sets(docs)._jdf.queryExecution().analyzed().toString().count("xxhash64(lambda") == 1  # before: 2


def test_line_candidates_are_shuffled_once(spark):
    """op5_line_dedup: candidates with all their tokens were shuffled for each side of the join that confirms them."""
    words = " ".join("abcdefghi")
    texts = spark.createDataFrame([(1, f"{words}\n{words} j"), (2, f"x\n{words} k\r"), (3, "x y z")], "doc_id long, text string")
    spots = spark.createDataFrame([(7, 1, 0), (8, 1, 0), (7, 1, 1), (8, 1, 1), (7, 2, 1), (9, 3, 0)], "token int, doc long, line int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = line_dedup._confirmed(line_dedup._with_tokens(texts, spots))
        assert {(r.doc, r.line) for r in found.collect()} == {(1, 1), (2, 1)}
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()  # before: two exchanges
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_line_rarity_counts_every_slot(spark):
    """op5_line_dedup: slots are counted side by side, and each has the level of its own count."""
    texts = [("a b\nB c", 1), ("a  d", 2), (" ".join(f"w{i % 700}" for i in range(3000)), 3)]
    df = spark.createDataFrame(texts, "text string, doc_id long")
    tokens = [t for text, _ in texts for t in text.lower().replace("\n", " ").split(" ")]
    slot = {r.t: r.slot for r in spark.createDataFrame([(t,) for t in set(tokens)], "t string").selectExpr("t", f"cast(xxhash64(t) & {line_dedup.SLOTS - 1} as int) slot").collect()}
    counts = np.bincount([slot[t] for t in tokens], minlength=line_dedup.SLOTS)
    levels = spark.range(1).select(line_dedup._rarity(df).alias("r")).first().r
    assert levels == np.minimum(120, (4 * np.log2(counts + 1)).astype(int)).tolist()


def test_line_dedup(docs, rows, empty):
    lines = [(i, j, frozenset(t for t in x.rstrip("\r").lower().split(" ") if t), x) for i, text in rows if text is not None for j, x in enumerate(text.split("\n"))]
    gone = set()
    for k, (i, j, own, _) in enumerate(lines):
        if own and any(5 * len(own & other) >= 4 * len(own | other) for _, _, other, _ in lines[:k]):
            gone.add((i, j))
    want = {i: ("\n".join(x for j, x in enumerate(text.split("\n")) if (i, j) not in gone),) if text is not None else (None,) for i, text in rows}
    got = line_dedup.line_dedup(docs)
    assert got.count() == docs.count()
    assert by_id(got, "kept") == want and gone
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(docs, rows, empty, shingle):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets[i] = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(docs, shingle)
    assert got.count() == docs.count()
    assert by_id(got, "n_shingles", "component_id", "kept") == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in near_dedup.components(links).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_exact_dedup(docs, rows, empty, monkeypatch):
    norm = {i: re.sub(BLANK, " ", t or "") for i, t in rows} | {"none": "no id here"}
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == docs.count()
    ids = [i for i in norm if i != "none"]
    copies = ids + [rows[-1][0]]
    for i, (keep, size, kept, digest) in by_id(got, "keep_id", "group_size", "kept", "text_sha256").items():
        same = [j for j in copies if norm[j] == norm[i]]
        assert (keep, size, kept, digest) == (min(same), len(same), i == min(same), sha(norm[i]))
    assert exact_dedup.exact_dedup(empty).count() == 0
    monkeypatch.setattr(exact_dedup, "ROW_BITS", 0)  # one block for all rows
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 64)  # in which nearly every bit is set twice
    monkeypatch.setattr(exact_dedup, "join_checked", functools.partial(exact_dedup.join_checked, limit=0))
    every = lambda df: sorted(str(r) for r in df.collect())
    assert every(exact_dedup.exact_dedup(docs)) == every(got)


WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def test_contamination(docs, rows, empty, monkeypatch):
    spark = docs.sparkSession
    split = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = dict(rows)
    items = [(1, " ".join((texts[20] or "").split()[:20])), (2, texts[30]), (3, "word"), (4, None), (5, ""), (6, texts[30]), (7, "a b"), (None, "c d e"), (10, "absent entirely here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, t in items:
        w = split(t)
        if item is not None:
            for j in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[j : j + 13]), set()).add(str(item))
    want = {}
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for j in range(len(w)):
            for n in {len(x) for x in windows}:
                if j + n <= len(w) and tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        want[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.contamination_digest(docs, bench), *columns) == want
    assert any(w[1] for w in want.values())
    every = lambda found: sorted((str(r) for r in found.select("doc_id", *columns).collect()))
    assert len(every(decontaminate.contamination_digest(docs, bench))) == docs.count()  # repeated rows and rows without doc_id too
    twice = docs.unionByName(docs)
    assert every(decontaminate.contamination_digest(twice, bench)) == sorted(2 * every(decontaminate.contamination_digest(docs, bench)))
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)  # a bitmap that lets nearly everything through
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "PREFIX_BITS", 1)
    assert by_id(decontaminate.contamination_digest(docs, bench), *columns) == want
    assert decontaminate.contamination_digest(empty, bench).count() == 0
    assert by_id(decontaminate.contamination_digest(docs, bench.limit(0)), "n_hit") == {i: (0,) for i, _ in rows}


def test_language_mixture(spark, empty):
    import random

    rng = random.Random(1)
    letters = {"aa": "abcdeou", "bb": "mnopqri", "cc": "rstuvwe"}
    make = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=rng.randint(2, 7))) for _ in range(n))
    train = [(i, make(lang, 60), lang) for i, lang in enumerate(letters) for _ in range(20)]
    train = [(i, t, lang) for i, (_, t, lang) in enumerate(train)] + [(None, "no id", "aa"), (900, None, "aa"), (901, "text", None)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    test = [(i, make(lang, rng.randint(5, 80)), lang) for i, lang in enumerate(list(letters) * 30)]
    odd = [(1000, None), (1001, ""), (1002, "123 !! 456"), (1003, make("aa", 60) + " " + make("bb", 40)), (1004, "字" * 3000)]
    got = by_id(language_id.language_mixture(spark.createDataFrame([(i, t) for i, t, _ in test] + odd, "doc_id long, text string"), model), "lang_pred", "score", "shares")
    assert sum(got[i][0] == lang for i, _, lang in test) >= 0.97 * len(test)
    assert [got[i][:2] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003][0] == "aa" and set(got[1003][2]) == {"aa", "bb"} and 0.5 < got[1003][1] < 0.75
    assert got[1004][0] in letters
    none = language_id.train(empty)
    assert by_id(language_id.language_mixture(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none), "lang_pred") == {1: ("und",)}


def test_language_of_long_documents_only(spark):
    long = "wort haus baum licht " * 3000
    docs = spark.createDataFrame([(1, "mesa casa libro ", "es"), (2, long, "de"), (3, long + "licht", "de")], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["de", "es"]
    assert by_id(language_id.language_mixture(docs, model), "lang_pred") == {1: ("es",), 2: ("de",), 3: ("de",)}


def test_decontamination_returns_each_row_whatever_the_bounds(spark, monkeypatch):
    item = " ".join(f"w{j}" for j in range(20))
    data = [(1, item), (1, item), (2, "clean"), (2, "clean"), (None, "clean"), (None, "clean"), (None, item), (None, item), (3, None), (3, item.replace("w5 ", "x ") + " " + item[:-4])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, item if i % 2 else f"{item[4:]} a{i}") for i in range(12)], "item_id long, text string")
    plain = lambda df: sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())
    one = plain(decontaminate.contamination_digest(docs, benchmark))
    for name, value in (("MOST_BITS", 1 << 15), ("LEAST_BITS", 1 << 15), ("PREFIX_BITS", 1), ("BROADCAST_BYTES", 0)):  # a full bitmap, joins by shuffle
        monkeypatch.setattr(decontaminate, name, value)
    several = decontaminate.contamination_digest(docs, benchmark)
    assert several.count() == len(data) and plain(several) == one


def test_toxicity_sample_is_the_least_by_hash(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "'some text' as text")
    labels = spark.range(500).selectExpr("id as doc_id", "int(id % 3 = 0) as toxic")
    chosen = toxicity._chosen(docs, labels, 20)
    hashed = sorted((r.h % 2**64, r.doc_id) for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").collect())
    want = {(i, int(i % 3 == 0)) for y in (0, 1) for i in [i for _, i in hashed if (i % 3 == 0) == y][:20]}
    assert sorted(map(tuple, chosen.collect())) == sorted(want)


def test_toxicity(spark, empty):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7)))
    bad = ["wretch", "vermin", "wretchz", "verminn", "wwretch"]

    def text(toxic):
        words = [word() for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(max(1, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    data = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "x"), (7000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (7000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id % 5 != 0 or doc_id is null"), labels)
    scores = by_id(toxicity.toxicity(docs, model), "score", "predicted")
    held = [(y, scores[i]) for i, _, y in data if i % 5 == 0]
    assert sum(y == s[1] for y, s in held) >= 0.9 * len(held)
    assert scores[7000] == (0.0, 0)
    unseen = toxicity.toxicity(spark.createDataFrame([(1, "abc def wretchy gab verminy cab")], "doc_id long, text string"), model).first()
    assert unseen.predicted == 1  # misspellings it never saw
    assert toxicity.toxicity(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    vectors, weights, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    bag, y, class_weight = (np.array([0, 0, 1, 2, 2]), np.array([0, 3, 3, 5, 1]), np.array([0.5, 1.0, 2.0, 0.3, 0.7])), np.array([0, 1, 1]), np.array([0.7, 1.9])

    def loss():
        total = 0.0
        for d in range(3):
            mean = sum((v * vectors[r] for k, r, v in zip(*bag) if k == d), np.zeros(3))
            z = mean @ weights + bias
            total -= class_weight[y[d]] * (z[y[d]] - np.log(np.exp(z).sum())) / 3
        return total

    for parameter, gradient in zip((vectors, weights, bias), toxicity.gradients(vectors, weights, bias, bag, y, class_weight)):
        for at in np.ndindex(parameter.shape):
            parameter[at] += 1e-6
            up = loss()
            parameter[at] -= 2e-6
            assert abs((up - loss()) / 2e-6 - gradient[at]) < 1e-6
            parameter[at] += 1e-6


def test_mixture_is_that_of_a_plain_em():
    rng = np.random.default_rng(5)
    sizes = [7, 30, 12]
    scores = rng.normal(-5, 2, (sum(sizes), 3))
    first = np.concatenate([[0], np.cumsum(sizes)])
    got, _ = language_id.infer(scores, first)
    for d, n in enumerate(sizes):
        own = scores[first[d] : first[d + 1]]

        def em(allowed, share):
            share = [share[k] if k in allowed else 0 for k in range(3)]
            share = [x / sum(share) for x in share]
            for _ in range(language_id.STEPS):
                posts = [[share[k] * np.exp(row[k]) for k in range(3)] for row in own]
                share = [sum(p[k] / sum(p) for p in posts) / n for k in range(3)]
            return np.array(share), sum(np.log(sum(share[k] * np.exp(row[k]) for k in range(3))) for row in own)

        lead = int(own.sum(0).argmax())
        full, _ = em({0, 1, 2}, [1 / 3] * 3)
        order = sorted(range(3), key=lambda k: -(full[k] + (k == lead)))
        best, value = np.eye(3)[lead], own.sum(0)[lead]
        full[lead] += 1
        for k in (2, 3):
            share, likelihood = em(set(order[:k]), full)
            if likelihood - (k - 1) * 0.5 * np.log(max(n, 2)) <= value:
                break
            best, value = share, likelihood - (k - 1) * 0.5 * np.log(max(n, 2))
        assert np.allclose(got[d], best, atol=1e-6)


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_structured_texts_do_not_collide(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    tail = [f"w{i}" for i in range(12)]
    texts = [(1, " ".join([one, *tail])), (2, " ".join([two, *tail])), (3, " ".join(thue_morse(2048, "x", "y"))), (4, " ".join(thue_morse(2048, "y", "x")))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = {i: tuple(t.encode().split()) for i, t in texts}
    want = {i: (len(words[i]), int(m.sum())) for i, m in removed(words, 13)}
    assert by_id(substring_words.removed_words_digest(docs), "n_words", "n_removed") == want
    raw = {i: t.encode() for i, t in texts}
    assert by_id(substring_bytes.removed_bytes_digest(docs), "n_removed") == {i: (int(m.sum()),) for i, m in removed(raw, 50)}
    found = by_id(near_dedup.near_duplicates(docs.where("doc_id < 3"), 20), "component_id")
    assert found == {1: (1,), 2: (2,)}
    benchmark = spark.createDataFrame([("i", " ".join([one, *tail]))], "item_id string, text string")
    assert by_id(decontaminate.contamination(docs, benchmark), "n_hit") == {1: (13,), 2: (0,), 3: (0,), 4: (0,)}


def test_near_duplicates_find_planted_copies(spark, monkeypatch):
    import random

    rng = random.Random(8)
    monkeypatch.setattr(near_dedup, "TILE", 16)  # several tiles a bucket, several parts a hub
    monkeypatch.setattr(near_dedup, "HUB_PART", 8)
    texts = []
    for _ in range(60):
        base = [f"{rng.randrange(10**6)}" for _ in range(120)]
        texts.append(" ".join(base))
        for changes in (1, 2, 4, 6):
            own = list(base)
            for at in rng.sample(range(120), changes):
                own[at] = f"{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[j : j + 2]) for j in range(len(w) - 1)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i // 5 * 5, i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2), "component_id")
    assert len(links) > 300 and all(found[i] == found[j] for i, j in links)
    assert all(found[i][0] // 5 == i // 5 for i in found)


def test_long_texts_cross_chunks(spark, monkeypatch):
    from pressmill.llm import common, segments

    monkeypatch.setattr(common, "CHUNK_BYTES", 1000)  # in this process: the windows of items; tasks take their own
    monkeypatch.setattr(segments, "FLUSH_BYTES", 4000)
    words = [f"word{i}" for i in range(6000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, "x " + long + " y"), (3, " ".join(words[5000:5040]))], "doc_id long, text string")
    assert by_id(substring_words.removed_words_digest(docs), "n_words", "n_removed") == {1: (6000, 0), 2: (6002, 6000), 3: (40, 40)}
    raw = {i: t.encode() for i, t in ((1, long), (2, "x " + long + " y"), (3, " ".join(words[5000:5040])))}
    assert by_id(substring_bytes.removed_bytes_digest(docs), "n_removed") == {i: (int(m.sum()),) for i, m in removed(raw, 50)}
    assert by_id(near_dedup.near_duplicates(docs), "component_id") == {1: (1,), 2: (1,), 3: (3,)}
    benchmark = spark.createDataFrame([("i", " ".join(words[5990:]))], "item_id string, text string")
    assert by_id(decontaminate.contamination(docs, benchmark), "n_hit") == {1: (10,), 2: (10,), 3: (0,)}


CLASH = "doc_id long, text string, lang string, score double, toxic int, n long, size long, removed string, k string"


def test_models_and_lines_with_odd_tables(spark):
    rows = [(1, "alpha beta gamma delta\r\nalpha beta gamma delta\none", "aa"), (1, "alpha beta gamma delta\r\nalpha beta gamma delta\none", "aa"), (2, None, "aa"), (3, "", None), (4, "alpha beta gamma delta\n\n", "bb"), (None, "alpha", "aa")]
    docs = spark.createDataFrame([(*r, 0.0, 1, 5, 6, "x", "y") for r in rows], CLASH)
    model = language_id.train(docs)
    assert model.languages == ["aa", "bb"]
    found = language_id.language_mixture(docs, model).collect()
    assert len(found) == len(rows) and len({(r.lang_pred, r.score) for r in found if r.doc_id == 1}) == 1
    assert language_id.language_mixture(docs.limit(0), model).count() == 0
    toxic = toxicity.train(docs, spark.createDataFrame([(1, 1, None), (1, 1, None), (4, 0, None)], "doc_id long, toxic int, text string"))
    scored = toxicity.toxicity(docs, toxic).collect()
    assert len(scored) == len(rows) and len({r.score for r in scored if r.doc_id == 1}) == 1 and toxicity.toxicity(docs.limit(0), toxic).count() == 0
    lines = {(r.doc_id, r.n_lines, tuple(r.removed), r.kept) for r in line_dedup.line_dedup(docs).collect()}
    assert lines == {(1, 3, (1,), "alpha beta gamma delta\r\none"), (2, 0, (), None), (3, 1, (), ""), (4, 3, (0,), "\n"), (None, 1, (), "alpha")}
    digests = {(r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.line_dedup_digest(docs).collect()}
    assert digests == {(i, n, len(gone), sha(kept or "")) for i, n, gone, kept in lines}


def test_near_lines_of_one_group_need_no_chain(spark):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)]
    lines = []
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(30), rng.randint(0, 4)):
            own[at] = f"v{rng.randrange(10**6)}"
        lines.append(" ".join(own))
    docs = spark.createDataFrame([(i, "\n".join(lines[i * 3 : i * 3 + 3])) for i in range(50)], "doc_id long, text string").repartition(4)
    sets = [frozenset(x.split()) for x in lines]
    want = {(k // 3, k % 3) for k in range(150) if any(5 * len(sets[k] & sets[j]) >= 4 * len(sets[k] | sets[j]) for j in range(k))}
    got = {(r.doc_id, j) for r in line_dedup.line_dedup(docs).collect() for j in r.removed}
    assert got == want and len(want) > 100
