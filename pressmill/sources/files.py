"""Reading raw collector files and writing mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, values
from ..operators.dedup import keep_first

#: Old name -> name, for each kind of file; used where the name is absent.
ALIASES = {
    "twitter": {"full_text": "text", "created_at": "date", "screen_name": "user_name"},
    "news": {"content": "text", "published_date": "date", "source_name": "user_name"},
}
#: Columns of mentions by what is read of them; the rest have rules of their own.
STRINGS = [
    "platform", "text", "content", "title", "description", "url", "source", "source_url", "query", "language", "file_source", "source_type", "country", "tone",
    "source_name", "parent_url", "parent_id", "tags", "alert_name", "type", "post_id", "user_handle", "user_avatar",
]
OPEN_STRINGS = ["favorite", "sentiment_label", "sentiment_justification", "location_label", "issue_label", "issue_slug", "ministry_hint"]
COUNTS = ["alert_id", "children", "direct_reach", "cumulative_reach", "domain_reach", "retweets", "likes", "comments"]
SCORES = ["score", "sentiment_score", "location_confidence", "issue_confidence"]
TIMES = ["published_date", "date", "published_at"]


def with_file_source(df: DataFrame) -> DataFrame:
    """file_source: the file's name up to the first _, without @ and ending."""
    name = F.replace(F.col("_metadata.file_name"), F.lit("@"), F.lit(""))
    return df.withColumn("file_source", F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), "^([^_]*)", 1))


def read_raw_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """CSV files of different columns, one path or glob a schema, all columns text, malformed lines dropped; united by name."""
    out = None
    for path in paths:
        rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("multiLine", True).csv(path)
        rows = ensure_required(with_file_source(rows))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def ensure_required(df: DataFrame) -> DataFrame:
    """source and platform from the file's name, date null and text empty, where a file has no such column."""
    default = {"source": F.col("file_source"), "platform": F.col("file_source"), "date": F.lit(None).cast("string"), "text": F.lit("")}
    return df.withColumns({c: v for c, v in default.items() if c not in df.columns})


def alias_columns(df: DataFrame, kind: str) -> DataFrame:
    names = {old: new for old, new in ALIASES.get(kind, {}).items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(names)


def user_name_by_source(df: DataFrame) -> DataFrame:
    """user_name from the column that each kind of source keeps it in."""
    kind = F.lower("file_source")
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    place = col("user_location")
    social = F.when(place != "", F.when(place.contains("https://") | place.contains("www."), geo.url_domain(place)).otherwise(place)).otherwise(col("platform"))
    name = F.when(kind == "social", social).when(kind == "rss", col("source")).when(kind == "news", F.when(col("url").isNotNull(), geo.url_domain(col("url")))).when(kind == "mention", col("source_name"))
    return df.withColumn("user_name", F.coalesce(name, col("user_name")))


def conform_mentions(df: DataFrame, run_timestamp: Column | None = None, user_id: Column | None = None) -> DataFrame:
    """One projection to all columns of mentions.

    Absent texts are empty, absent labels, counts, scores and times null.  The place may stand in ``location``, the user's name
    in ``username`` or else ``user_display_name``; keywords of an issue are an array or its JSON.
    """
    has = dict(df.dtypes)

    def text(name: str) -> Column:
        return F.col(f"`{name}`").cast("string") if name in has else F.lit(None).cast("string")

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.when(text(n) != "", text(n)) for n in names], F.lit(""))

    keywords = F.lit(None).cast("array<string>")
    if "issue_keywords" in has:
        keywords = F.col("issue_keywords") if has["issue_keywords"].startswith("array") else F.from_json("issue_keywords", "array<string>")
    columns = {"run_timestamp": F.current_timestamp() if run_timestamp is None else run_timestamp, "user_id": text("user_id") if user_id is None else user_id}
    columns |= {c: F.coalesce(text(c), F.lit("")) for c in STRINGS} | {c: text(c) for c in OPEN_STRINGS} | {"original_id": F.coalesce(text("id"), F.lit(""))}
    columns |= {c: values.safe_long(text(c)) for c in COUNTS} | {c: values.safe_double(text(c)) for c in SCORES} | {c: dates.parse_date(text(c)) for c in TIMES}
    columns |= {"user_location": geo.clean_location(filled("user_location", "location")), "user_name": filled("user_name", "username", "user_display_name"), "issue_keywords": keywords}
    return df.select(*[v.alias(c) for c, v in columns.items()])


def read_issue_registry(spark: SparkSession, path: str) -> DataFrame:
    """ministry, slug, label, mention_count, created_at, last_updated from a folder of JSON documents."""
    schema = "ministry string, issue_count long, max_issues long, issues array<struct<slug:string,label:string,mention_count:long,created_at:string,last_updated:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select("ministry", F.explode("issues").alias("i")).select("ministry", "i.*")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def append_mentions(df: DataFrame, path: str, partitions: Sequence[str] = ("user_id",)) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def append_dedup(new: DataFrame, old: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Old rows, then new ones, deduplicated by each key in turn; a row without a key's value is kept."""
    out = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    for key in keys:
        out = keep_first(out.where(F.col(key).isNotNull()), [key], ["_new", *order]).unionByName(out.where(F.col(key).isNull()))
    return out.drop("_new")


def export_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Fixed columns, N/A where a column or value is missing."""
    df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in df.columns else F.lit("N/A")).alias(c) for c in columns]).write.option("header", True).csv(path)


def to_public_record(df: DataFrame) -> DataFrame:
    """Doubles without NaN or infinity, times as ISO 8601 text, the rest as it is."""

    def public(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return c

    return df.select(*[public(n, k) for n, k in df.dtypes])
