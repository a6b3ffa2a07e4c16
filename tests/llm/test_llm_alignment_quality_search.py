"""Token alignment, quality rules and lexical search against brute force, and words whose hashes collide."""

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pressmill.llm import alignment, common, lexical_search, near_dedup, quality, segments, substring_words

MORE = ["  two  spaces ", " lead", "trail ", "▁mark x", "<s> </s> <|endoftext|>", "a\x00b\r\n", "字 x  字", "a\n b\n  c \t d", "x y z " * 40, "don't we'll  I'M", " ", "\x1c d \x85 e", "## $$ %% || " * 30]


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bytes_a = alignment.vocabularies("byte_bpe_50k.tiktoken", "piece_bpe_32k.model").bytes_a
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        raw_a = [bytes_a[i] for i in a]
        raw_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if {b"".join(raw_a), b"".join(raw_b)} != {(" " + text).encode()}:
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        common_ends = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in common_ends]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            for i, e in zip(ids, ends):
                groups[bisect.bisect_left(common_ends, e)][side].append(str(i))
        spans = [[(i, e - len(x), e) for i, x, e in zip(ids, raw, ends)] for ids, raw, ends in ((a, raw_a, ends_a), (b, raw_b, ends_b))]
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        written = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    count = Counter(x for r in rows if r for x in r[3])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(*r[:3], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) if r else (0, 0, 0, 0, 0, 0, "") for r in rows]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect() if r.doc_id is not None}


@pytest.fixture(scope="module")
def odd_docs(spark, rows):
    """Odd texts, a repeated row, a row without doc_id, and columns whose names clash."""
    texts = [t for _, t in rows[:40]] + MORE
    data = [(i, t, "en" if i % 3 else None, f"s{i % 2}", "x", 1) for i, t in enumerate(texts)]
    extra = [(*data[-1],), (None, "no id here", None, None, None, None)]
    return texts, spark.createDataFrame(data + extra, "doc_id long, text string, lang string, source string, block string, n_words int").repartition(4)


def test_alignment(odd_docs, empty):
    texts, docs = odd_docs
    want = brute_alignment([*texts, texts[-1], "no id here"])  # repeated rows count, and so does one without doc_id
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    for block in (alignment.BLOCK_BYTES, 500):
        got = alignment.token_alignment(docs, block_bytes=block)
        assert got.count() == docs.count()
        assert by_id(got, *columns) == dict(enumerate(want[: len(texts)]))
    assert alignment.token_alignment(empty).count() == 0


def test_alignment_of_long_texts_in_pieces(monkeypatch):
    v = alignment.vocabularies("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    texts = [" ".join(f"word{i}x  {i}\n" for i in range(300)), "x" * 3000, *MORE]
    whole = alignment.align_texts(v, texts)
    monkeypatch.setattr(alignment, "PIECE_CHARS", 50)
    monkeypatch.setattr(alignment, "CACHE_SIZE", 20)
    v.forget()
    for x, y, text, z in zip(whole, alignment.align_texts(v, texts), texts, brute_alignment(texts)):
        assert x.counts == y.counts == list(z[:4]) and (x.digest.hexdigest() if x.digest else "") == (y.digest.hexdigest() if y.digest else "") == z[6], text[:40]
        assert [c.tolist() for c in x.distinct()] == [c.tolist() for c in y.distinct()]


def test_align_skips_diagonals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 400):
        a, b = (np.unique(np.append(rng.integers(1, 2 * n + 2, n), 2 * n + 2)).tolist() for _ in range(2))
        both = set(a) & set(b)
        assert alignment.align(a, b) == ([i for i, x in enumerate(a) if x not in both], [i for i, x in enumerate(b) if x not in both])


def test_ranks_are_the_vocabulary_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    v = alignment.vocabularies("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32000, 3)]]
    texts = [f" a{c}b 1{c}2 {c}!{c} {c}  {c}\n{c} 's{c}" for c in chars]
    assert all(x.ids == v.a(t) for x, t in zip(library.encode_batch(texts, add_special_tokens=False), texts))


def counts_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd_docs, empty):
    texts, docs = odd_docs
    got = quality.quality_rules(docs)
    assert got.count() == docs.count()
    rows = by_id(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level", "failed")
    for i, text in enumerate(texts):
        own = counts_of(text)
        assert rows[i][:5] == own
        assert rows[i][5] == (own[0] < 50 or 2 * own[4] > own[0])
        assert rows[i][6] == (not rows[i][5] and not rows[i][8])
    assert quality.quality_rules(empty).count() == 0
    assert quality.quality_rules(docs.select("doc_id", "text")).count() == docs.count()  # without lang and source


def test_quality_fences_follow_the_group(spark):
    """In one source long words are usual, in the other not: one text is kept there and dropped here; clean ones all stay."""
    rng = np.random.default_rng(4)
    words = lambda n, size: " ".join("".join(rng.choice(list("abcdefgh"), size + rng.integers(0, 2))) for _ in range(n))
    rows = [(i, words(60, 12 if i % 2 else 4), "en", f"s{i % 2}") for i in range(600)]
    rows += [(1000, words(60, 12), "en", "s0"), (1001, words(60, 12), "en", "s1"), (1002, words(60, 12), None, None), (1003, words(60, 40), "xx", "s9")]
    got = by_id(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "kept", "level", "failed")
    assert all(got[i][0] and got[i][1] == 0 for i in range(600))
    assert got[1000] == (False, 0, ["word_length"]) and got[1001] == (True, 0, []) and got[1002][:2] == (True, 3) and got[1003] == (False, 3, ["word_length"])


def test_quantile_sketches_merge_to_one_result(spark):
    values = [int(x) for x in np.random.default_rng(3).pareto(1.2, 3000) * 900]
    rows = spark.createDataFrame([(v, "a" if i % 3 else None, f"s{i % 2}", 1, 1, 0, 0, 0, False) for i, v in enumerate(values)], "word_chars long, lang string, source string, n_words long, n_lines long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    found = {(r.level, r.lang, r.source): r for r in quality.quantiles(quality.merged(quality.sketches(rows)), [5, 50, 95]).where("signal = 'word_length'").collect()}
    for key, own in (((3, None, None), values), ((1, None, None), values[::3]), ((2, None, "s1"), values[1::2])):
        for p in (5, 50, 95):
            exact = 1000 * sorted(own)[-(-p * len(own) // 100) - 1]
            assert found[key][f"low_{p}"] <= exact <= found[key][f"high_{p}"] <= found[key][f"low_{p}"] * 33 / 32 + 1


def brute_search(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t]), i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0 and x[1] is not None)[:k])]
    return sorted(out)


def test_lexical_search(odd_docs, rows, empty, spark, monkeypatch):
    texts, docs = odd_docs
    every = [*enumerate(texts), (len(texts) - 1, texts[-1]), (None, "no id here")]
    items = [(1, rows[20][1]), (2, rows[33][1]), (3, None), (4, "..."), (5, "absent"), (6, "id ID here A x"), (6, "字 don"), (7, rows[30][1])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    for k in (3, 50):
        got = lexical_search.search(docs, asked, k)
        assert sorted(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(every, items, k)
    monkeypatch.setattr(lexical_search, "QUERY_ITEMS", 3)  # several passes
    monkeypatch.setattr(lexical_search, "SEED_SHARE", 2)
    assert sorted(tuple(r) for r in lexical_search.search(docs, asked, 4).select("item_id", "rank", "doc_id", "score").collect()) == brute_search(every, items, 4)
    assert lexical_search.search(empty, asked).count() == 0 and lexical_search.search(docs, asked.limit(0)).count() == 0


def test_blocks_are_skipped_by_exact_bounds_alone():
    rng = np.random.default_rng(8)
    impacts = (rng.integers(1, 900, (500, 40)) * (rng.random((500, 40)) < 0.3)).astype(np.int32)
    impacts[:40] = impacts[100:140] * 2  # some stand out
    shard = lexical_search.Shard(np.arange(500) * 7 % 501, impacts, 8)
    for t in range(40):
        lists = [shard.members[shard.starts[b] : shard.stops[b]] for b in range(shard.first[t], shard.first[t + 1])]
        assert sorted(np.concatenate(lists).tolist()) == np.flatnonzero(impacts[:, t]).tolist()
        assert all((shard.summaries[shard.first[t] + i] == impacts[x].max(0)).all() and len(x) <= 8 for i, x in enumerate(lists))
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(30):
        terms = np.sort(rng.choice(40, 5, replace=False))
        weights = rng.integers(1, 9, 5)
        scores, ids = shard.search(terms, weights, none, 0, 10)
        every = impacts[:, terms] @ weights
        best = np.lexsort((shard.doc_ids, -every))[:10]
        assert scores.tolist() == every[best].tolist() and ids.tolist() == shard.doc_ids[best].tolist()


#: Pairs of words with equal hashes under a hash that is one-to-one within each length alone.
PAIRS = [(b"G1>9DU#", bytes.fromhex("5CF3B189834AC8BA")), (b"/0'.w}9", bytes.fromhex("34F2A89EB062D2BA"))]


def laid_out(words):
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.frombuffer(b" ".join(words), np.uint8), ends - [len(w) for w in words], ends


def test_words_are_compared_by_bytes_whatever_their_hashes():
    words = [w for p in PAIRS for w in p] + [b"x" * n + b"%d" % i for n in range(12) for i in range(2)] * 2
    hashes = common.word_hashes(*laid_out(words))
    assert len(set(hashes.tolist())) == len(set(words))
    for bad in (hashes, hashes % np.uint64(5), np.zeros(len(words), np.uint64)):
        number = common.same_words(bad, *laid_out(words))
        assert all((x == y) == (words[i] == words[j]) for i, x in enumerate(number) for j, y in enumerate(number))


def test_windows_with_colliding_words_are_no_repeats():
    """A bucket's windows are told apart by bytes even under a hash that gives all words of a kind one value."""

    def parse(buf, offsets):
        values, h, first, starts, ends, content = segments.parse_words(buf, offsets)
        return values % np.uint64(2), np.zeros(len(h), np.uint64), first, starts, ends, content

    symbols = segments.Symbols(parse, 4, common.same_words)
    texts = [b"a b c d e f g h", b"a b c d e f g i", b"z b c d e f g h", b"q a b c d e f g h"]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    cut = segments.cut(symbols, 7, buf, offsets, np.arange(4), np.arange(4))
    block = segments.zstandard.ZstdDecompressor().decompress(segments.pack(cut, segments.collapse(cut)[2]))
    found = np.concatenate([segments.solve(symbols, 7, [block], p, substring_words.fm_repeats) for p in range(segments.PARTS)], 1)
    covered = {(int(d), int(i)) for d, _, s, n in found.T for i in range(s, s + n)}
    assert covered == {(1, i) for i in range(7)} | {(2, i) for i in range(1, 8)} | {(3, i) for i in range(1, 9)}


@pytest.mark.parametrize("pair", PAIRS)
def test_colliding_words_make_no_repeat_and_no_link(spark, pair):
    shared = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"{shared} {w.decode()}") for i, w in enumerate(pair, 1)], "doc_id long, text string")
    assert by_id(substring_words.removed_words_digest(docs), "n_removed") == {1: (0,), 2: (0,)}
    single = spark.createDataFrame([(i, w.decode()) for i, w in enumerate(pair, 1)], "doc_id long, text string")
    assert by_id(near_dedup.near_duplicates(single, 2), "component_id", "kept") == {1: (1, True), 2: (2, True)}
