"""Predicates that users of the mention table filter by. Each takes a DataFrame and returns its rows that pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.automaton import counted
from ..functions.terms import any_of


def _text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def tenant(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    return df.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def trailing(df: DataFrame, column: str, days: int, as_of: str) -> DataFrame:
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(column) >= end - F.expr(f"interval {days} days")) & (F.col(column) <= end))


def target_words(df: DataFrame, names: Sequence[str], columns=("text", "title", "content")) -> DataFrame:
    """Any word of three or more letters of the names is part of the texts."""
    terms = list(dict.fromkeys(w for n in names for w in n.lower().split() if len(w) >= 3))
    return df.where(any_of(_text(*columns), terms))


def target_phrases(df: DataFrame, phrases: Sequence[str], columns=("text", "title", "content")) -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | any_of(F.lower(F.coalesce(c, F.lit(""))), [p.lower() for p in phrases])
    return df.where(out)


def source_keywords(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """By keywords in source name, source and platform, written together."""
    where = F.lower(F.concat(*[F.coalesce(c, F.lit("")) for c in ("source_name", "source", "platform")]))
    keep = any_of(where, include) if include else F.lit(True)
    return df.where(keep & ~any_of(where, exclude))


def relevant(df: DataFrame, keywords: Sequence[str], must: Sequence[str] = (), exclude: Sequence[str] = (), columns=("text",)) -> DataFrame:
    """A keyword, and one of the required terms if any are given, and none of the excluded ones."""
    text = _text(*columns)
    keep = any_of(text, keywords) & ~any_of(text, exclude)
    return df.where(keep & any_of(text, must) if must else keep)


def screened(df: DataFrame, skip: Sequence[str], exclude: Sequence[str], keywords: Sequence[str], columns=("text",)) -> DataFrame:
    """First a skip list, then excluded terms, then keywords; all of them are looked for in one pass."""
    lists = {"skip": skip, "exclude": exclude, "keywords": keywords}
    return df.where(counted(_text(*columns), lists, lambda n: (n["skip"] == 0) & (n["exclude"] == 0) & (n["keywords"] > 0)))


def feed_relevant(df: DataFrame, query: str, custom: Sequence[str] | None, columns=("text",)) -> DataFrame:
    """Any custom query or else the query itself; everything where there are no custom queries."""
    if not custom:
        return df
    return df.where(any_of(_text(*columns), [q.lower() for q in (*custom, query)]))


def enriched(df: DataFrame) -> DataFrame:
    return df.where(~_blank("sentiment_justification"))


def needs_analysis(df: DataFrame) -> DataFrame:
    """No label, or a justification without a recommended action."""
    return df.where(F.col("sentiment_label").isNull() | ~F.lower(F.coalesce("sentiment_justification", F.lit(""))).contains("recommended action"))


def issue_backlog(df: DataFrame, columns=("issue_label", "issue_slug", "ministry_hint", "sentiment_label")) -> DataFrame:
    missing = F.col("issue_label") == "General Issue"
    for c in columns:
        missing = F.coalesce(missing, F.lit(False)) | _blank(c)
    return df.where(missing)


def location_backlog(df: DataFrame, below: float = 0.7) -> DataFrame:
    return df.where(F.col("location_label").isNull() | (F.col("location_confidence") < below))


def viral_negative(df: DataFrame, platforms: Sequence[str], below: float = -0.7) -> DataFrame:
    return df.where(F.lower("sentiment_label").startswith("negative") & (F.col("sentiment_score") < below) & any_of(F.lower("platform"), platforms))


def by_reference(df: DataFrame, part: str, columns=("url", "original_id", "post_id"), key: str = "entry_id") -> DataFrame:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).contains(part), F.lit(False))
    return df.where(out).dropDuplicates([key])


def by_ids(df: DataFrame, ids: DataFrame, key: str = "entry_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def valid_hashtag(column: Column) -> Column:
    return column.rlike(r"^[A-Za-z0-9_]+$")


def hashtag(query: Column) -> Column:
    """The first word of a query, without # and signs."""
    return F.regexp_replace(F.lower(F.split(F.trim(F.translate(query, "#", "")), r"\s+")[0]), "[^a-z0-9_]", "")


def facebook_page(url: Column) -> Column:
    """Whether a URL names a Facebook page: its host, and a first path part that is no section of the site."""
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    first = F.lower(F.get(path, F.lit(0)))
    sections = ["watch", "events", "groups", "marketplace", "hashtag", "search", "photo.php", "story.php", "sharer", "login", "help", "policies"]
    own = F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike(r"(^|\.)(facebook|fb)\.com$")
    return F.coalesce(own & first.isNotNull() & ~first.isin(sections), F.lit(False))


def with_text(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("text", F.lit("")) != "")


def widening(df: DataFrame, column: str, as_of: str, hours: Sequence[int] = (24, 48), most: int = 50, key: str = "entry_id") -> DataFrame:
    """The newest rows of the smallest trailing window that has any.

    The newest row tells which window that is; a window that has rows has the newest one, so the rows left are limited alike.
    """
    end = F.lit(as_of).cast("timestamp_ntz")
    starts = [end - F.expr(f"interval {h} hours") for h in hours]
    inside = df.where((F.col(column) >= starts[-1]) & (F.col(column) <= end))
    newest = inside.agg(F.max(column).alias("_newest"))  # one row
    start = F.coalesce(*[F.when(F.col("_newest") >= s, s) for s in starts])
    return inside.join(F.broadcast(newest), F.col(column) >= start).drop("_newest").orderBy(F.desc(column), F.desc(key)).limit(most)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, most: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"_rank <= {most}").drop("_rank")
