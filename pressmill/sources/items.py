"""Nested items of collectors, one JSON document a row in column ``item``, made flat. Keys that items lack are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.dedup import keep_first


def _get(*paths: str) -> Column:
    """The first of some JSON paths that has a value."""
    return F.coalesce(*[F.get_json_object("item", f"$.{p}") for p in paths])


def _long(*paths: str) -> Column:
    return F.coalesce(_get(*paths).try_cast("double").cast("long"), F.lit(0).cast("long"))


def _id(*paths: str) -> Column:
    """An item's id, else a digest of the item, so that it is the same in every run."""
    return F.coalesce(_get(*paths), F.md5("item"))


def _post(source: str, **columns: Column) -> list[Column]:
    return [F.lit(source).alias("source"), *[c.alias(n) for n, c in columns.items()]]


def flatten_tweets(df: DataFrame) -> DataFrame:
    return df.select(
        *_post(
            "x", post_id=_id("id"), date=_get("createdAt"), text=_get("text", "fullText"), user_name=_get("author.userName"), user_display_name=_get("author.name"),
            user_avatar=_get("author.profilePicture"), user_location=_get("author.location"), retweets=_long("retweetCount"), likes=_long("likeCount"), comments=_long("replyCount"),
            quote_count=_long("quoteCount"), view_count=_long("viewCount"), url=_get("url", "twitterUrl"), is_reply=_get("isReply") == "true", is_retweet=_get("isRetweet") == "true",
        )
    )


def flatten_facebook(df: DataFrame, most: int = 10) -> DataFrame:
    """Pages, groups and profiles give a row for each of their first posts, else one row of their own; a post gives itself."""
    posts = F.from_json(F.get_json_object("item", "$.posts"), "array<string>")
    whole = df.withColumn("holder", F.col("item")).withColumn("post", F.explode_outer(F.slice(F.coalesce(posts, F.array().cast("array<string>")), 1, most)))
    rows = whole.withColumn("item", F.coalesce("post", "item"))
    page = F.coalesce(F.get_json_object("holder", "$.pageName"), F.get_json_object("holder", "$.title"), F.get_json_object("holder", "$.name"))
    return rows.select(
        *_post(
            "facebook", type=F.when(F.col("post").isNotNull() | _get("postId", "text").isNotNull(), "post").otherwise("page"), post_id=_id("postId", "id"), date=_get("time", "date"), text=_get("text", "message"),
            url=_get("url", "postUrl"), image_url=_get("media[0].thumbnail", "media[0].image.uri"), page_name=page, user_name=F.coalesce(_get("user.name", "author.name"), page), likes=_long("likes"),
            comments=_long("comments"), shares=_long("shares"), reactions=_get("reactions"),
        )
    )


def flatten_tiktok(df: DataFrame) -> DataFrame:
    """With the best subtitle: English recognised, else English translated, else the first."""
    subtitle = "array<struct<language:string,source:string,downloadLink:string>>"
    subs = F.from_json(F.coalesce(_get("videoMeta.subtitleLinks"), F.lit("[]")), subtitle)
    english = lambda kind: F.get(F.filter(subs, lambda s: s["language"].startswith("eng") & (s["source"] == kind)), F.lit(0))
    best = F.coalesce(english("ASR"), english("MT"), F.get(subs, F.lit(0)))
    tags = F.transform(F.from_json(F.coalesce(_get("hashtags"), F.lit("[]")), "array<struct<name:string>>"), lambda t: t["name"])
    return df.select(
        *_post(
            "tiktok", post_id=_id("id"), date=_get("createTimeISO", "createTime"), text=_get("text", "desc"), url=_get("webVideoUrl", "url"), user_name=_get("authorMeta.name", "author.uniqueId"),
            user_display_name=_get("authorMeta.nickName", "author.nickname"), likes=_long("diggCount", "stats.diggCount"), comments=_long("commentCount", "stats.commentCount"),
            shares=_long("shareCount", "stats.shareCount"), view_count=_long("playCount", "stats.playCount"), hashtags=F.array_join(tags, ", "), subtitle_url=best["downloadLink"],
        )
    )


def flatten_instagram(df: DataFrame, query: str | None = None) -> DataFrame:
    place, name = _get("locationName", "location.name"), _get("ownerUsername", "owner.username")
    known = lambda c: F.when(c != "unknown", c)
    country = F.coalesce(known(geo.country_from_location(place)), known(geo.country_from_username(name)), known(geo.country_from_location(F.lit(query))), F.lit("unknown"))
    return df.select(
        *_post(
            "instagram", post_id=_id("id", "shortCode"), date=_get("timestamp", "takenAt"), text=_get("caption", "caption.text"), url=_get("url"), image_url=_get("displayUrl"), user_name=name,
            user_display_name=_get("ownerFullName", "owner.fullName"), user_location=place, likes=_long("likesCount", "likes"), comments=_long("commentsCount", "comments"), country=country,
        )
    )


def flatten_news(df: DataFrame) -> DataFrame:
    """Items map a query to its articles."""
    kind = "map<string,struct<googleNews:array<struct<title:string,link:string,source:string,publishedAt:string,snippet:string,image:string>>>>"
    rows = df.select(F.explode(F.from_json("item", kind)).alias("query", "v")).select("query", F.explode("v.googleNews").alias("a"))
    domain = geo.url_host(F.col("a.link"))
    return rows.select(
        F.lit("news").alias("source"), F.md5(F.concat_ws("|", "a.link", "a.title")).alias("post_id"), F.col("a.publishedAt").alias("date"), F.coalesce("a.snippet", "a.title").alias("text"), F.col("a.title").alias("title"),
        F.col("a.link").alias("url"), F.col("a.image").alias("image_url"), domain.alias("domain"), geo.country_from_domain(domain).alias("country"), "query",
    )


def flatten_social_search(df: DataFrame) -> DataFrame:
    kind = "array<struct<postid:string,network:string,posted:string,text:string,url:string,sentiment:string,user:struct<name:string,url:string>>>"
    rows = df.select(F.explode(F.from_json(F.get_json_object("item", "$.posts"), kind)).alias("p"))
    return rows.select(
        F.when(F.col("p.network") == "web", "News").otherwise("Social Media").alias("source"), F.col("p.network").alias("platform"), F.coalesce("p.postid", F.md5(F.concat_ws("|", "p.url", "p.text"))).alias("post_id"),
        F.col("p.posted").alias("date"), F.col("p.text").alias("text"), F.col("p.url").alias("url"), F.col("p.user.name").alias("user_name"), F.col("p.sentiment").alias("tone"),
    )


def flatten_youtube(df: DataFrame) -> DataFrame:
    """One row a video: of repeated items the one with most likes and comments."""
    rows = df.select(
        *_post(
            "youtube", post_id=_id("id.videoId", "id"), date=_get("snippet.publishedAt"), title=_get("snippet.title"), text=_get("snippet.description"), user_name=_get("snippet.channelTitle"),
            image_url=_get("snippet.thumbnails.high.url", "snippet.thumbnails.default.url"), likes=_long("statistics.likeCount"), comments=_long("statistics.commentCount"), view_count=_long("statistics.viewCount"),
        )
    )
    return keep_first(rows, ["post_id"], [F.desc_nulls_last("likes"), F.desc_nulls_last("comments"), "date", "title", "text"])
