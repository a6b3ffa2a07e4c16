import hashlib
import os
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    odd = [(1, None), (2, ""), (3, "123"), (4, "the same words stand here again and again in this text"), (5, "the same words stand here again and again in this text"), (None, "no id"), (6, "other words\nthat make\nsome lines of text")]
    clash = ["_doc_id", "doc_id_found", "rejected", "_rejected", "_removed", "_dropped", "row_key", "hits"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, removed string, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, None, "x", *clash) for i, t in odd], schema)
    spark.createDataFrame([(1, "absent words of an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == (docs.schema.names if stage is not pipeline.encoded else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        assert out.count() <= len(odd)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    left = pipeline.language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {4, 5, 6, None}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs.where("doc_id > 2"), str(tmp_path)).collect()} == {3, 4, 6}


def test_language_without_labels_keeps_clean_documents(spark):
    docs = spark.createDataFrame([(1, "clean words"), (2, None), (3, "12 34"), (4, "more words"), (None, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in pipeline.language(spark, docs, "").collect()} == {1, 4, None}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_run(spark):
    out = pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() <= spark.read.parquet(f"{DATA}/documents.parquet").count()


def brute_run(rows, items, languages):
    """What run() has to return for rows (doc_id, text), given the language stage's (lang_pred, score): plain loops and sets."""
    import base64

    import public_tokenizers
    import tiktoken

    kept = [(i, t) for i, t in rows if i is None or (languages[i][0] != "und" and languages[i][1] >= pipeline.LEAST_SCORE)]
    text_of = {}
    for i, t in kept:
        text_of.setdefault(i, t)
    tokens = lambda line: frozenset(x for x in line.rstrip("\r").lower().split(" ") if x)
    seen, left = [], {}
    for i in sorted(x for x in text_of if x is not None):
        lines, own = text_of[i].split("\n"), []
        for line in lines:
            s = tokens(line)
            if not s or not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                own.append(line)
            seen.append(s)
        left[i] = "\n".join(own)
        if not left[i].strip():
            del left[i]
    kept = [(i, left[i] if i is not None else t) for i, t in kept if i is None or i in left]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for i, t in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(root)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = [(i, t) for i, t in kept if i is None or find(i) == i]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = [w for x in items for own in [words(x)] if own for w in ([tuple(own[k : k + 13]) for k in range(len(own) - 12)] or [tuple(own)])]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in kept:
        own, hit = words(t), set()
        for w in set(windows):
            hit |= {k + d for k in range(len(own) - len(w) + 1) if own[k] == w[0] and tuple(own[k : k + len(w)]) == w for d in range(len(w))}
        if i is None or not (hit and 20 * len(hit) >= len(own)):
            found = np.array(library.encode_ordinary(t), "<u4")
            out.append((i, len(found), hashlib.sha256(found.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_run_against_plain_loops(spark, tmp_path):
    """All five stages over 200 documents with copies, near copies, repeated lines and ids, nulls, and a text of 5 MB."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    item = " ".join(rng.choices(words, k=15))
    shared = [" ".join(rng.choices(words, k=9)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "12 34"), (3, "\n\n"), (None, "no id at all"), (None, "no id at all")]
    for i in range(4, 200):
        lines = [" ".join(rng.choices(words, k=rng.randint(4, 14))) for _ in range(rng.randint(1, 8))]
        if i % 6 == 0:
            lines.insert(1, rng.choice(shared))
        if i % 9 == 0:
            lines[0] = f"{lines[0]} {item.upper()}"
        text = "\n".join(lines)
        if i % 10 == 0:
            near = rng.choice(rows[6:])[1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near).replace("\n", " ")
        rows.append((i, text))
    rows += [(300, " ".join(rng.choices(words, k=900_000))), (51, rows[53][1]), (51, rows[53][1])]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else "fr", "s", 0) for i, t in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "never there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = pipeline.language_id.train(docs.where(pipeline.crc_mod("doc_id", 4) != 2))
    languages = {r.doc_id: (r.lang_pred, r.score) for r in pipeline.language_id.language_mixture(docs, model).collect()}
    want = brute_run(rows, [item, "", "never there"], languages)
    got = [tuple(r) for r in pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert not set(got) ^ set(want)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert 100 < len(want) < 195 and {300, 51, None} <= {r[0] for r in want}
