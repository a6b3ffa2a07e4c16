"""The registered query of each operator: production parameters, whole tables, digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, exact_dedup, language_id, lexical_search, line_dedup, near_dedup, quality, substring_bytes, substring_words, token_counts, toxicity
from .common import crc_mod, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    predicted = language_id.language_mixture(docs, language_id.train(docs.where(~held_out)))
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.removed_bytes_digest(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.removed_words_digest(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    scored = toxicity.toxicity(docs, toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.token_alignment(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_bpe, op4_suffix_array_dedup, op5_line_dedup, op6_substring_dedup,
        op7_near_dedup, op8_exact_dedup, op9_decontamination, op10_toxicity, op11_token_alignment, op12_quality_rules, op13_lexical_search, pipeline,
    )
}

#: Windows of whole texts exhaust the memory of a SQL engine on one machine, so the others are tested against brute force.
ORACLE_SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op12_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
        triples AS (SELECT r, i, word, lead(word) OVER s AS w2, lead(word, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY r ORDER BY i)),
        twice AS (SELECT r, i FROM triples WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, w2, w3) > 1),
        repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS t(k) GROUP BY r),
        lines AS (
            SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        counts AS (
            SELECT d.r, doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
            FROM d LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
        based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
        signals AS (
            SELECT r, lang, source, unnest(['word_length', 'symbol_share', 'dup_line_share', 'repeat_share']) AS signal,
                   unnest([1000 * word_chars // greatest(n_words, 1), 10000 * n_symbols // greatest(n_words, 1),
                           10000 * n_dup_lines // greatest(n_lines, 1), 10000 * n_repeat_words // greatest(n_words, 1)]) AS v
            FROM based WHERE NOT base_failed),
        leveled AS (
            SELECT level, CASE WHEN level IN (0, 1) THEN lang END AS lang, CASE WHEN level IN (0, 2) THEN source END AS source, signal,
                   CASE WHEN v < 32 THEN v ELSE v >> (length(bin(v)) - 6) << (length(bin(v)) - 6) END AS low,
                   CASE WHEN v < 32 THEN v ELSE ((v >> (length(bin(v)) - 6)) + 1 << (length(bin(v)) - 6)) - 1 END AS high
            FROM signals, range(4) AS t(level)),
        buckets AS (SELECT level, lang, source, signal, low, high, count(*) AS n FROM leveled GROUP BY ALL),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal) AS size, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY low) AS upto
            FROM buckets),
        quantiles AS (
            SELECT level, lang, source, signal, max(size) AS size, min(low) FILTER (upto >= (5 * size + 99) // 100) AS low_5,
                   min(low) FILTER (upto >= (50 * size + 99) // 100) AS low_50, min(high) FILTER (upto >= (50 * size + 99) // 100) AS high_50,
                   min(high) FILTER (upto >= (95 * size + 99) // 100) AS high_95
            FROM ranked GROUP BY level, lang, source, signal),
        fences AS (
            SELECT level, lang, source, signal, CASE WHEN signal = 'word_length' THEN low_50 - 3 * (low_50 - low_5) - 1000 ELSE 0 END AS low,
                   high_50 + 3 * (high_95 - high_50) + CASE signal WHEN 'word_length' THEN 1000 WHEN 'symbol_share' THEN 500 WHEN 'dup_line_share' THEN 3000 ELSE 1000 END AS high
            FROM quantiles WHERE level = 3 OR (size >= 200 AND 4096 * size >= (SELECT max(size) FROM quantiles WHERE level = 3))),
        chosen AS (
            SELECT r, min(level) AS level FROM counts JOIN fences f ON (level NOT IN (0, 1) OR counts.lang IS NOT DISTINCT FROM f.lang)
                   AND (level NOT IN (0, 2) OR counts.source IS NOT DISTINCT FROM f.source) GROUP BY r),
        failing AS (
            SELECT s.r, string_agg(s.signal, ',' ORDER BY list_position(['word_length', 'symbol_share', 'dup_line_share', 'repeat_share'], s.signal)) AS failed
            FROM signals s JOIN chosen USING (r) JOIN fences f ON f.level = chosen.level AND f.signal = s.signal AND (f.level NOT IN (0, 1) OR s.lang IS NOT DISTINCT FROM f.lang)
                 AND (f.level NOT IN (0, 2) OR s.source IS NOT DISTINCT FROM f.source)
            WHERE v < low OR v > high GROUP BY s.r)
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
               n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, level::INTEGER AS level, coalesce(failed, '') AS failed
        FROM based LEFT JOIN chosen USING (r) LEFT JOIN failing USING (r)""",
    "op13_lexical_search": r"""
        WITH words AS (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
        tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        docs AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
        total AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM docs),
        asked AS (
            SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
        weights AS (SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, documents),
        scores AS (
            SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (r), total GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
