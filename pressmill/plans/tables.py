"""Logical tables of a monitoring team, derived from the given tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import label_from_score
from ..functions.text import slug

AS_OF = "2024-01-31 00:00:00"
#: Stands in for the shipped dictionaries, which the invented words of the test texts hardly hit.
SAMPLE_RULES = {"works": ["oil", "data", "road"], "education": ["ation", "ting "], "health": ["ment", "eau"], "power": ["keit", "zu "], "security": ["ción", "ado"]}
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = ["and ", "ement", "lich"], ["idiot", "scum", "ver", "ca "]
COUNTERS = ["likes", "retweets", "comments", "direct_reach"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    score = F.when(F.col("toxic") == 1, -0.8).when(F.col("quality") == 1, 0.5).when(F.col("quality") == 0, -0.3).otherwise(0.0)
    ids = F.col("doc_id")
    place = F.when(ids % 5 == 0, "Lagos, Nigeria").when(ids % 5 == 1, "London, UK").when(ids % 5 == 2, "Doha").when(ids % 5 == 4, "worldwide")
    issue = F.when(ids % 7 != 0, F.concat(F.lit("Issue "), F.left("text", F.lit(2))))
    rows = docs.join(labels, "doc_id", "left").select(
        ids.alias("entry_id"), (ids % 10).alias("user_id"), "text", F.col("lang").alias("language"), F.col("source").alias("platform"), "n_chars",
        F.left(F.split("text", "\n")[0], F.lit(40)).alias("title"), score.alias("sentiment_score"), place.alias("user_location"),
        F.concat(F.lit("user"), (ids % 13).cast("string")).alias("user_name"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval((ids % 400).cast("int"))).alias("published_at"),
        (F.col("n_chars") % 101).alias("likes"), (ids % 53).alias("retweets"), (ids % 7).alias("comments"), F.col("n_chars").alias("direct_reach"),
        F.when(ids % 6 != 0, F.element_at(F.array(*map(F.lit, SAMPLE_RULES)), (ids % 5 + 1).cast("int"))).alias("ministry_hint"), issue.alias("issue_label"), slug(issue).alias("issue_slug"),
        F.when(ids % 3 == 0, F.lit("Recommended action: none")).when(ids % 3 == 1, F.lit("seen")).alias("sentiment_justification"),
        (ids % 100 / 100.0).alias("location_confidence"), F.when(ids % 4 != 0, F.lit("nigeria")).alias("location_label"),
    )
    return rows.withColumn("sentiment_label", label_from_score(F.col("sentiment_score")))


MENTIONS = """mentions AS (
    SELECT *, CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM (
    SELECT doc_id AS entry_id, doc_id % 10 AS user_id, text, lang AS language, source AS platform, n_chars, left(string_split(text, chr(10))[1], 40) AS title,
    CASE WHEN toxic = 1 THEN -0.8::DOUBLE WHEN quality = 1 THEN 0.5::DOUBLE WHEN quality = 0 THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END AS sentiment_score,
    CASE doc_id % 5 WHEN 0 THEN 'Lagos, Nigeria' WHEN 1 THEN 'London, UK' WHEN 2 THEN 'Doha' WHEN 4 THEN 'worldwide' END AS user_location,
    'user' || (doc_id % 13) AS user_name, TIMESTAMP '2024-01-31 00:00:00' - to_days((doc_id % 400)::INTEGER) AS published_at,
    n_chars % 101 AS likes, doc_id % 53 AS retweets, doc_id % 7 AS comments, n_chars AS direct_reach,
    CASE WHEN doc_id % 6 != 0 THEN ['works', 'education', 'health', 'power', 'security'][doc_id % 5 + 1] END AS ministry_hint,
    CASE WHEN doc_id % 7 != 0 THEN 'Issue ' || left(text, 2) END AS issue_label,
    CASE WHEN doc_id % 7 != 0 THEN regexp_replace(trim(regexp_replace(lower('Issue ' || left(text, 2)), '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+', '-', 'g') END AS issue_slug,
    CASE doc_id % 3 WHEN 0 THEN 'Recommended action: none' WHEN 1 THEN 'seen' END AS sentiment_justification,
    (doc_id % 100)::DOUBLE / 100.0 AS location_confidence, CASE WHEN doc_id % 4 != 0 THEN 'nigeria' END AS location_label
    FROM documents LEFT JOIN labels USING (doc_id)))"""


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("endpoint"), F.col("value").alias("execution_time_ms"), "value",
        (F.col("event_type") == "error").alias("is_error"), F.get_json_object("props", "$.k").cast("bigint").alias("reach"),
    )


USAGE = """usage_log AS (SELECT event_id, ts, user_id, event_type AS endpoint, value AS execution_time_ms, value, event_type = 'error' AS is_error,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS reach FROM events)"""


def feed_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["ssl", "timeout", "xml", "network"])), (F.col("event_id") % 4 + 1).cast("int"))
    return usage_log(spark, sf_dir).select(F.col("user_id").alias("feed"), "event_id", "ts", (~F.col("is_error")).alias("success"), F.col("value").alias("response_time"), F.when(F.col("is_error"), kind).alias("error_class"))


FETCHES = f"""{USAGE}, fetches AS (SELECT user_id AS feed, event_id, ts, NOT is_error AS success, value AS response_time,
    CASE WHEN is_error THEN ['ssl', 'timeout', 'xml', 'network'][event_id % 4 + 1] END AS error_class FROM usage_log)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(incoming, existing) mentions: odd and even ids."""
    rows = mentions(spark, sf_dir)
    return rows.where("entry_id % 2 = 1"), rows.where("entry_id % 2 = 0")


NORM = r"regexp_replace(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g')), 'https?://\S+', '', 'g'), '[^\p{{L}}\p{{N}}_\s.,?!-]', '', 'g')"
WORDS = r"list_filter(list_distinct(string_split_regex(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')), ' +')), lambda w: w != '')"
LABEL = "CASE WHEN lower({0}) IN ('positive', 'negative') THEN lower({0}) ELSE 'neutral' END"


def sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def sql_hits(text: str, terms, weight="1") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quote(t)}) THEN {weight} ELSE 0 END" for t in terms) + ")"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.topics import classify_topics

    return classify_topics(mentions(spark, sf_dir), SAMPLE_RULES, least=0.3)


def sql_topic_scores() -> str:
    """scores: entry_id, topic, keyword_score by the sample rules."""
    parts = []
    for topic, terms in SAMPLE_RULES.items():
        n = sql_hits("lower(text)", terms)
        parts.append(f"SELECT entry_id, '{topic}' AS topic, CASE WHEN {n} > 0 THEN least(1.0::DOUBLE, least(1.0::DOUBLE, {n}::DOUBLE / {len(terms)}) * (1 + ln({n} + 1.0::DOUBLE) / 10)) ELSE 0.0::DOUBLE END AS keyword_score FROM mentions")
    return "scores AS (" + " UNION ALL ".join(parts) + ")"


BRIDGE = f"""{MENTIONS}, {sql_topic_scores()}, bridge AS (SELECT * FROM (SELECT entry_id, topic, round(keyword_score, 3) AS keyword_score, NULL::DOUBLE AS embedding_score, round(keyword_score, 3) AS confidence,
    row_number() OVER (PARTITION BY entry_id ORDER BY round(keyword_score, 3) DESC, topic) AS r FROM scores WHERE round(keyword_score, 3) >= 0.3) WHERE r <= 3)"""
TOPICS = "topics AS (SELECT unnest(['works', 'education', 'health', 'power', 'security', 'unseen']) AS topic)"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the bridge's dictionary and one without mentions: a dimension."""
    return spark.createDataFrame([(t,) for t in (*SAMPLE_RULES, "unseen")], "topic string")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = list(SAMPLE_RULES)
    nation = read(spark, sf_dir, "nation")
    return nation.select(F.col("n_name").alias("owner"), F.array(F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % 5 + 1).cast("int")), F.element_at(F.array(*map(F.lit, names)), ((F.col("n_nationkey") + 2) % 5 + 1).cast("int"))).alias("topics"))


OWNERS = "owners AS (SELECT n_name AS owner, unnest([['works', 'education', 'health', 'power', 'security'][n_nationkey % 5 + 1], ['works', 'education', 'health', 'power', 'security'][(n_nationkey + 2) % 5 + 1]]) AS topic FROM nation)"
