"""Token counts of a sentencepiece vocabulary by two map-side tiers.

No piece of the vocabulary has a word character before its space mark, so a text can be cut before each run of spaces
and the parts tokenised alone.  Tier one is a broadcast table, of bounded size, of the token counts of frequent parts;
tier two is a cache in each worker, filled by the library.  Parts are never shuffled.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Tier one comes from the first scan tasks: documents read in each, parts that it reports, reports read in all; and tier
#: one's entries, and entries of a worker's cache. They bear on speed alone.
TASK_DOCS, TASK_PARTS, REPORTS = 1000, 8192, 65536
TIER_ONE_SIZE, CACHE_SIZE = 32768, 250_000
#: Parts longer than this are encoded each time and not kept.
CACHE_KEY_CHARS = 64


class _Lengths(dict):
    """Token count of a part: the characters from one space up to the next, without the leading space."""

    def __init__(self, model: str, seed: dict[str, int]):
        import sentencepiece

        self.encode = sentencepiece.SentencePieceProcessor(model_file=model).encode
        self.seed = seed
        super().__init__(seed)
        self[""] = 1  # a space by itself

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part, num_threads=1))
        if len(part) <= CACHE_KEY_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
                self.update(self.seed)
                self[""] = 1
            self[part] = n
        return n


def parts(text: str) -> list[str]:
    """Cuts before each run of spaces; the dummy space that the library puts before a text opens the first part.

    Splitting at single spaces is enough for a run of one; texts with longer runs or with the mark itself go the slow way.
    """
    import re

    if "  " not in text and "▁" not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [x[1:] for x in re.findall("[ ▁]+[^ ▁]*", " " + text)]


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs`` (doc_id, text), whole texts.

    Counts are those of the library without begin, end or added tokens.  Null and empty texts have none.  Rows are
    independent: repeated rows repeat their counts, and a null doc_id stays null.
    """
    spark = docs.sparkSession

    def frequent(batches):
        seen, docs = Counter(), 0
        for batch in batches:
            for text in batch.column("text"):
                seen.update(x for x in parts(text.as_py() or "") if len(x) <= CACHE_KEY_CHARS)
                docs += 1
                if docs == TASK_DOCS:
                    break
            if docs == TASK_DOCS:
                break
        lengths = _Lengths(_tokenizer_file(model), {})
        top = seen.most_common(TASK_PARTS)
        columns = [pa.array([x for x, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array([lengths[x] for x, _ in top], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "seen", "n"])

    # a limit that is collected runs the first tasks alone, until they have reported enough
    reports = docs.select("text").mapInArrow(frequent, "part string, seen long, n long").limit(REPORTS).collect()
    seen, length = Counter(), {r.part: r.n for r in reports}
    for r in reports:
        seen[r.part] += r.seen
    tier_one = spark.sparkContext.broadcast({x: length[x] for x, _ in seen.most_common(TIER_ONE_SIZE)})

    def count(batches):
        lengths = _Lengths(_tokenizer_file(model), tier_one.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [sum(map(lengths.__getitem__, parts(x))) if x else 0 for x in texts]
            size = [len(x.encode()) if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(released(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
