"""A corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of docs.  Null texts, empty tables and further columns are allowed; a row without doc_id
passes the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import bpe, decontaminate, language_id, line_dedup, near_dedup
from pressmill.llm.common import crc_mod, table, unused, written


#: Least score of the leading language of a document that stays: its share of the text, weighed against the other languages
#: alone. A text in which no language leads is none; single words of a learned language have 0.5 and more.
LEAST_SCORE = 0.3


def _joined(docs: DataFrame, found: DataFrame, bytes_: int) -> DataFrame:
    """docs with the column of found (doc_id and one that docs lacks), null where it has none; broadcast up to 32 MB."""
    key = unused(docs, "doc_id_found")
    hint = "broadcast" if bytes_ <= 32 << 20 else "shuffle_hash"
    return docs.join(found.withColumnRenamed("doc_id", key).hint(hint), F.col("doc_id") == F.col(key), "left").drop(key)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but for the rows with a doc_id of rejected; rows without doc_id stay."""
    mark = unused(docs, "rejected")
    rejected = written(rejected.select("doc_id").distinct().withColumn(mark, F.lit(True)))
    return _joined(docs, rejected, 16 * rejected.count()).where(F.col(mark).isNull()).drop(mark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those whose mixture has no leading language (LEAST_SCORE).

    Learns from the same fold as the query; where no language was learned, letters alone decide.
    """
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2))
    if not model.languages:  # then all predictions are und
        lettered = F.pandas_udf(lambda text: text.map(language_id.has_letters).astype(bool), "boolean")
        return docs.where(F.col("doc_id").isNull() | lettered("text"))
    predicted = language_id.language_mixture(docs.where("doc_id is not null"), model)
    return _without(docs, predicted.where(f"lang_pred = 'und' or score < {LEAST_SCORE}"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines near to earlier ones; a document that loses all its lines goes.

    Null and empty texts stay; rows that repeat a doc_id count as one document; a row without doc_id stays as it is.
    """
    found = line_dedup.repeated_lines(docs)
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("removed")).alias("lines")).first()
    gone = unused(docs, "removed")
    joined = _joined(docs, found.withColumnRenamed("removed", gone), 8 * (4 * size.n + (size.lines or 0)))
    untouched = F.col(gone).isNull()
    out = joined.withColumn("text", F.when(untouched, F.col("text")).otherwise(line_dedup.lines_left(F.col("text"), F.col(gone)))).where(untouched | (F.trim("text") != ""))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(untouched, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop(gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id.

    Null and wordless texts, and rows without doc_id, stay; rows that repeat a doc_id stay or go together.
    """
    return _without(docs, near_dedup.near_duplicates(docs, shingle=5).where("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates; null and wordless texts, and rows without doc_id, stay.

    Of rows that repeat a doc_id all go if one is contaminated.
    """
    return _without(docs, decontaminate.contamination(docs.where("doc_id is not null"), table(spark, sf_dir, "benchmark")).where("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row left; null and empty texts have no tokens."""
    return bpe.bpe_round_trip(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", decontaminated), ("byte-level BPE", encoded)]

#: Language identification is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
