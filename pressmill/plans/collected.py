"""Queries over what collectors write: nested items, cue files, CSV and JSON files, all made of the given tables within the plan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as words_of
from ..functions import text
from ..operators import enrich, topics
from ..sources import files, items
from ..sources.stored import scratch_path
from . import tables as t
from .catalog import M, query

def even() -> Column:
    return F.col("entry_id") % 2 == 0


def own_id() -> Column:
    return F.col("entry_id").cast("string")


def plain() -> Column:
    """A text's words of plain letters, whatever quotes and lines it has."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))


PLAIN_SQL = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g'))"


def made(spark: SparkSession, sf_dir: str, **parts: Column) -> DataFrame:
    """An item for each mention."""
    return t.mentions(spark, sf_dir).select(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("item"))


@query("s5_tweets", M + """SELECT entry_id::VARCHAR AS post_id, text, user_name, CASE WHEN entry_id % 5 != 3 THEN user_location END AS user_location, likes::BIGINT AS likes, CASE WHEN entry_id % 2 = 0 THEN retweets ELSE 0 END::BIGINT AS retweets, comments::BIGINT AS comments,
    'https://x.com/' || entry_id AS url, entry_id % 3 = 0 AS is_reply FROM mentions""")
def _(spark, sf_dir):
    """Alternative keys, counts as text, absent counts."""
    found = made(
        spark, sf_dir, id=own_id(), text=F.when(even(), F.col("text")), fullText=F.when(~even(), F.col("text")), author=F.struct(F.col("user_name").alias("userName"), F.col("user_location").alias("location")),
        likeCount=F.concat(F.col("likes").cast("string"), F.lit(".0")), retweetCount=F.when(even(), F.col("retweets")), replyCount=F.col("comments"),
        url=F.when(even(), F.concat(F.lit("https://x.com/"), own_id())), twitterUrl=F.when(~even(), F.concat(F.lit("https://x.com/"), own_id())), isReply=F.col("entry_id") % 3 == 0,
    )
    return items.flatten_tweets(found).select("post_id", "text", "user_name", "user_location", "likes", "retweets", "comments", "url", "is_reply")


@query("s6_facebook", M + """, p AS (SELECT *, entry_id // 12 AS page, row_number() OVER (PARTITION BY entry_id // 12 ORDER BY entry_id) AS r FROM mentions)
    SELECT 'post' AS type, entry_id::VARCHAR AS post_id, text, 'page ' || page AS page_name, CASE WHEN entry_id % 2 = 0 THEN user_name ELSE 'page ' || page END AS user_name, likes::BIGINT AS likes, retweets::BIGINT AS shares FROM p WHERE page % 5 != 0 AND r <= 10
    UNION ALL SELECT DISTINCT 'page', 'p' || page, NULL, 'page ' || page, 'page ' || page, 0, 0 FROM p WHERE page % 5 = 0""")
def _(spark, sf_dir):
    """Pages of a dozen posts, of which ten count, and pages without posts."""
    post = F.struct(own_id().alias("postId"), F.col("text").alias("message"), F.when(even(), F.struct(F.col("user_name").alias("name"))).alias("user"), F.col("likes"), F.col("retweets").alias("shares"))
    page = F.expr("entry_id div 12")
    whole = t.mentions(spark, sf_dir).groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("entry_id", post.alias("post")))).alias("posts"))
    name = F.concat(F.lit("page "), F.col("page").cast("string"))
    item = F.struct(F.concat(F.lit("p"), F.col("page").cast("string")).alias("id"), F.when(F.col("page") % 2 == 0, name).alias("title"), F.when(F.col("page") % 2 == 1, name).alias("pageName"), F.when(F.col("page") % 5 != 0, F.transform("posts", lambda x: x["post"])).alias("posts"))
    return items.flatten_facebook(whole.select(F.to_json(item).alias("item"))).select("type", "post_id", "text", "page_name", "user_name", "likes", "shares")


@query("s7_tiktok", M + """SELECT entry_id::VARCHAR AS post_id, text, user_name, likes::BIGINT AS likes, direct_reach::BIGINT AS view_count, 'tag' || entry_id % 3 || ', news' AS hashtags,
    CASE entry_id % 4 WHEN 0 THEN 'asr' WHEN 1 THEN 'mt' WHEN 2 THEN 'first' END AS subtitle_url FROM mentions""")
def _(spark, sf_dir):
    """The best subtitle of several, old and new keys."""
    def link(language: str, source: str, address: str) -> Column:
        return F.struct(F.lit(language).alias("language"), F.lit(source).alias("source"), F.lit(address).alias("downloadLink"))

    other, mt, asr, k = link("fra-FR", "ASR", "first"), link("eng-US", "MT", "mt"), link("eng-US", "ASR", "asr"), F.col("entry_id") % 4
    links = F.when(k == 0, F.array(other, mt, asr)).when(k == 1, F.array(other, mt)).when(k == 2, F.array(other, link("deu-DE", "MT", "second")))
    tags = F.array(F.struct(F.concat(F.lit("tag"), (F.col("entry_id") % 3).cast("string")).alias("name")), F.struct(F.lit("news").alias("name")))
    found = made(
        spark, sf_dir, id=own_id(), text=F.when(even(), F.col("text")), desc=F.when(~even(), F.col("text")), authorMeta=F.when(even(), F.struct(F.col("user_name").alias("name"))), author=F.when(~even(), F.struct(F.col("user_name").alias("uniqueId"))),
        diggCount=F.when(even(), F.col("likes")), stats=F.struct(F.when(~even(), F.col("likes")).alias("diggCount"), F.col("direct_reach").alias("playCount")), hashtags=tags, videoMeta=F.struct(links.alias("subtitleLinks")),
    )
    return items.flatten_tiktok(found).select("post_id", "text", "user_name", "likes", "view_count", "hashtags", "subtitle_url")


def _country(column: str, rules: dict) -> str:
    return "CASE " + " ".join(f"WHEN {t.sql_any(f'lower({column})', x)} THEN '{c}'" for c, x in rules.items()) + " END"


@query("s8_instagram", M + f"""SELECT entry_id::VARCHAR AS post_id, text, user_name, user_location, likes::BIGINT AS likes, comments::BIGINT AS comments,
    coalesce({_country("user_location", words_of.COUNTRY_BY_LOCATION)}, {_country("user_name", words_of.COUNTRY_BY_USERNAME)}, 'qatar') AS country FROM mentions""")
def _(spark, sf_dir):
    """The country by location, else by name, else by the query."""
    found = made(
        spark, sf_dir, shortCode=own_id(), caption=F.col("text"), ownerUsername=F.when(even(), F.col("user_name")), owner=F.struct(F.when(~even(), F.col("user_name")).alias("username")),
        location=F.struct(F.col("user_location").alias("name")), likesCount=F.col("likes"), commentsCount=F.col("comments"),
    )
    return items.flatten_instagram(found, "doha qatar").select("post_id", "text", "user_name", "user_location", "likes", "comments", "country")


@query("s9_news", M + """SELECT 'about ' || coalesce(language, 'all') AS query, coalesce(title, '') AS title, CASE WHEN entry_id % 3 = 0 THEN coalesce(title, '') ELSE text END AS text, 'https://site' || entry_id % 7 || '.com' || CASE WHEN entry_id % 2 = 0 THEN '.ng' ELSE '' END || '/a/' || entry_id AS url,
    'site' || entry_id % 7 || '.com' || CASE WHEN entry_id % 2 = 0 THEN '.ng' ELSE '' END AS domain, CASE WHEN entry_id % 2 = 0 THEN 'nigeria' ELSE 'us/intl' END AS country FROM mentions""")
def _(spark, sf_dir):
    """A map of queries to articles."""
    link = F.concat(F.lit("https://site"), (F.col("entry_id") % 7).cast("string"), F.lit(".com"), F.when(even(), ".ng").otherwise(""), F.lit("/a/"), own_id())
    article = F.struct(F.coalesce("title", F.lit("")).alias("title"), link.alias("link"), F.when(F.col("entry_id") % 3 != 0, F.col("text")).alias("snippet"))
    found = F.to_json(F.create_map(F.concat(F.lit("about "), F.coalesce("language", F.lit("all"))), F.struct(F.array(article).alias("googleNews"))))
    return items.flatten_news(t.mentions(spark, sf_dir).select(found.alias("item"))).select("query", "title", "text", "url", "domain", "country")


@query("s10_social_search", M + """SELECT entry_id::VARCHAR AS post_id, CASE WHEN entry_id % 3 = 0 THEN 'News' ELSE 'Social Media' END AS source, CASE WHEN entry_id % 3 = 0 THEN 'web' ELSE 'reddit' END AS platform, text, user_name, sentiment_label AS tone FROM mentions""")
def _(spark, sf_dir):
    """Several posts an item."""
    post = F.struct(own_id().alias("postid"), F.when(F.col("entry_id") % 3 == 0, "web").otherwise("reddit").alias("network"), "text", F.col("sentiment_label").alias("sentiment"), F.struct(F.col("user_name").alias("name")).alias("user"))
    found = t.mentions(spark, sf_dir).groupBy(F.expr("entry_id div 7")).agg(F.to_json(F.struct(F.collect_list(post).alias("posts"))).alias("item"))
    return items.flatten_social_search(found).select("post_id", "source", "platform", "text", "user_name", "tone")


@query("s18_youtube", M + "SELECT entry_id::VARCHAR AS post_id, title, text, user_name, (likes + 1)::BIGINT AS likes, comments::BIGINT AS comments, CASE WHEN entry_id % 2 = 0 THEN 'high' ELSE 'default' END AS image_url FROM mentions")
def _(spark, sf_dir):
    """Each video twice, with fewer and with more likes."""
    def videos(more: int) -> DataFrame:
        picture = F.struct(F.when(even(), F.struct(F.lit("high").alias("url"))).alias("high"), F.struct(F.lit("default").alias("url")).alias("default"))
        snippet = F.struct("title", F.col("text").alias("description"), F.col("user_name").alias("channelTitle"), picture.alias("thumbnails"))
        return made(spark, sf_dir, id=F.struct(own_id().alias("videoId")), snippet=snippet, statistics=F.struct((F.col("likes") + more).cast("string").alias("likeCount"), F.col("comments").alias("commentCount")))

    return items.flatten_youtube(videos(0).unionByName(videos(1))).select("post_id", "title", "text", "user_name", "likes", "comments", "image_url")


@query("x5_webvtt", M + f"SELECT entry_id, trim(regexp_replace('first cue ' || {PLAIN_SQL} || ' last', ' +', ' ', 'g')) AS v FROM mentions")
def _(spark, sf_dir):
    """Cues with numbers, times and settings around the words."""
    time = "00:00:01.000 --> 00:01:02.500 align:start position:0%\n"
    cues = F.concat(F.lit(f"WEBVTT\nKind: captions\nLanguage: en\n\n1\n{time}first cue\n\n2\n{time}"), F.regexp_replace(plain(), "( [a-z]+ [a-z]+) ", f"$1\n\n33\n{time}"), F.lit(f"\n\n4\n{time}last"))
    return t.mentions(spark, sf_dir).select("entry_id", text.webvtt_text(cues).alias("v"))


@query("s1_csv_files", M + f"""SELECT entry_id::VARCHAR AS entry_id, {PLAIN_SQL} AS text, CASE WHEN entry_id % 2 = 0 THEN 'N/A' END AS extra, TRUE AS named, CASE WHEN entry_id % 2 = 0 THEN 'N/A' ELSE 'kept' END AS platform FROM mentions WHERE {PLAIN_SQL} != ''""")
def _(spark, sf_dir):
    """CSV files of two schemas (S15 writes them), read as one table with the names of their files (S1, S2)."""
    rows, path = t.mentions(spark, sf_dir).select("entry_id", plain().alias("text"), F.lit("kept").alias("platform")).where("text != ''"), scratch_path(spark)
    files.export_csv(rows.where("entry_id % 2 = 0").drop("platform"), f"{path}/a", ["entry_id", "text", "extra", "platform"])
    files.export_csv(rows.where("entry_id % 2 = 1"), f"{path}/b", ["entry_id", "text", "platform"])
    read = files.read_raw_csv(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"])
    return read.select("entry_id", "text", "extra", F.col("file_source").startswith("part-").alias("named"), "platform")


@query("s11_issue_registry", M + """, c AS (SELECT ministry_hint AS ministry, issue_slug AS slug, count(*) AS mention_count FROM mentions WHERE ministry_hint IS NOT NULL AND issue_slug IS NOT NULL GROUP BY 1, 2)
    SELECT ministry, slug, mention_count FROM c QUALIFY row_number() OVER (PARTITION BY ministry ORDER BY mention_count DESC, slug) <= 20""")
def _(spark, sf_dir):
    """Rosters written as a JSON document a ministry and read back."""
    own = topics.roster(t.mentions(spark, sf_dir)).select("ministry_hint", F.struct(F.col("issue_slug").alias("slug"), "mention_count").alias("issue"))
    documents = own.groupBy(F.col("ministry_hint").alias("ministry")).agg(F.collect_list("issue").alias("issues"))  # twenty at most
    documents.withColumn("folder", F.col("ministry")).write.partitionBy("folder").json(path := scratch_path(spark))
    return files.read_issue_registry(spark, path).select("ministry", "slug", "mention_count")


@query("s12_taxonomy", "SELECT r_name AS ministry_key, n_name AS subcategory_key, n_nationkey::VARCHAR AS subcategory_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    """A taxonomy of two levels as CSV."""
    rows = t.read(spark, sf_dir, "nation").join(t.read(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    rows.select(F.col("r_name").alias("ministry_key"), F.col("n_name").alias("subcategory_key"), F.col("n_nationkey").alias("subcategory_name")).write.option("header", True).csv(path := scratch_path(spark))
    return files.read_taxonomy(spark, path)


@query("s13_appended", M + "SELECT entry_id, user_id, text FROM mentions WHERE text IS NOT NULL")
def _(spark, sf_dir):
    """Two appends to one table, partitioned by tenant."""
    rows, path = t.mentions(spark, sf_dir).select("entry_id", "user_id", "text").where("text is not null"), scratch_path(spark)
    for half in (0, 1):
        files.append_mentions(rows.where(F.col("entry_id") % 2 == half), path)
    return spark.read.schema(rows.schema).parquet(path)


_SIGN = f"{t.sql_hits('lower(coalesce(text, \'\'))', t.SAMPLE_POSITIVE)} - {t.sql_hits('lower(coalesce(text, \'\'))', t.SAMPLE_NEGATIVE)}"


def sign_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A scorer for enrich(): the sign of positive less negative terms; it refuses batches with a text of one word."""
    if (~batch["text"].str.contains(" ")).any():
        raise ValueError("a text of one word")
    low = batch["text"].str.lower()
    count = lambda terms: sum(low.str.contains(x, regex=False).astype(int) for x in terms)
    score = (count(t.SAMPLE_POSITIVE) - count(t.SAMPLE_NEGATIVE)).astype(float)
    label = score.map(lambda s: "positive" if s > 0 else "negative" if s < 0 else "neutral")
    return pd.DataFrame({"entry_id": batch["entry_id"], "label": label, "score": score})


@query("v1_batch_scorer", M + f"""SELECT entry_id, CASE WHEN NOT contains(coalesce(text, ''), ' ') THEN 'neutral' WHEN {_SIGN} > 0 THEN 'positive' WHEN {_SIGN} < 0 THEN 'negative' ELSE 'neutral' END AS label,
    CASE WHEN contains(coalesce(text, ''), ' ') THEN ({_SIGN})::DOUBLE ELSE 0.0::DOUBLE END AS score FROM mentions""")
def _(spark, sf_dir):
    """A scorer that fails on some rows, which are neutral; whole texts."""
    return enrich.enrich(t.mentions(spark, sf_dir), sign_scorer, limit=1 << 30).select("entry_id", "label", "score")


@query("v1_rule_scorer", M + f"""SELECT entry_id, CASE WHEN {_SIGN} > 0 THEN 'positive' WHEN {_SIGN} < 0 THEN 'negative' ELSE 'neutral' END AS label, CASE WHEN {_SIGN} > 0 THEN 0.5::DOUBLE WHEN {_SIGN} < 0 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS score,
    concat_ws(',', {", ".join(f"CASE WHEN {t.sql_any('lower(text)', x)} THEN '{n}' END" for n, x in t.SAMPLE_RULES.items())}) AS topics, CASE WHEN {_SIGN} > 0 THEN 'positive_coverage' ELSE 'issues' END AS page_type FROM mentions""")
def _(spark, sf_dir):
    """The shipped scorer."""
    out = enrich.rule_enrich(t.mentions(spark, sf_dir), t.SAMPLE_POSITIVE, t.SAMPLE_NEGATIVE, t.SAMPLE_RULES)
    return out.select("entry_id", "label", "score", F.array_join("topics", ",").alias("topics"), "page_type")
