"""Registered queries of the rules and of the projections at the edges, each with the SQL that checks it.

The invented texts of the tables hold hardly a word of the shipped dictionaries, so each query plants one of a dozen phrases
into every row's text, place or name, by the row's number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, countries, dates, geo, scoring, text
from ..functions import dictionaries as words_of
from ..operators import enrich, filters
from ..sources import files, pages
from ..streaming import jobs
from . import tables as t
from .catalog import TS, M, query

PLACES = ["Lagos, Nigeria", "New York, USA ", "London", "Doha, Qatar", "Dubai", "Mumbai, India", "earth", "", "Manchester, England", "www.bbc.co.uk", "https://aljazeera.com/x", "timesofindia.com"]
NAMES = ["sam_us", "the indian express", "doha life", "abdul al-thani", "british girl", "anna", "uk news", "dubai_ae", "نادر", "मोहन", "qa_desk", "la story"]
OUTLETS = ["twitter", "news", "Facebook", "blog", "news", "instagram", "rss"]
PLATFORMS = ["x", "BBC News", "facebook", "cnn", "al jazeera", "bbc", "the hindu", "src"]
PHRASES = [
    "the colour of the centre", "favorite color of a center", "fuel subsidy removal hurts", "the sheikh of qatar", "cricket in mumbai", "Police brutality and the SARS abuse", "visited the hospital with",
    "a terrible school strike by ASUU lecturers", "White House and Congress", "new railway track and train to Abuja", "الدوحة", "दिल्ली", "not great but not bad", "bank loan and debt repayment", "latest football match report",
]
SUGGESTIONS = ["Education policy", "economic finance", "Oil and gas", "UNKNOWN", "", "women affairs", "Rural roads", "mining", "airport", "capital city", "heart", "something else", "job"]
TITLES = ["Fuel price hike", "Fuel subsidy removal and petrol", "the budget", "ASUU strike of lecturers", "A very general remark", "of the and", "", "Corruption scandal", "new railway train", "President speaks in Abuja today"]
MINISTRIES = ["works", "energy", "unknown_key", "health", "education", "power"]


def sql_pick(values: Sequence[str], number: str = "entry_id") -> str:
    return "[" + ", ".join(map(t.quote, values)) + f"][{number} % {len(values)} + 1]"


def pick(values: Sequence[str], number: str = "entry_id") -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def planted(m: DataFrame) -> DataFrame:
    return m.withColumns({
        "text": F.concat("text", F.lit(" "), pick(PHRASES)), "user_location": pick(PLACES), "user_name": pick(NAMES), "user_handle": F.element_at(F.array(*map(F.lit, NAMES)), (F.expr("entry_id div 3") % len(NAMES) + 1).cast("int")),
        "source": pick(OUTLETS), "platform": F.element_at(F.array(*map(F.lit, PLATFORMS)), (F.expr("entry_id div 5") % len(PLATFORMS) + 1).cast("int")), "suggestion": pick(SUGGESTIONS), "issue": pick(TITLES),
    })


P = M + f""", p AS (SELECT * REPLACE (text || ' ' || {sql_pick(PHRASES)} AS text, {sql_pick(PLACES)} AS user_location, {sql_pick(NAMES)} AS user_name, {sql_pick(PLATFORMS, '(entry_id // 5)')} AS platform),
    {sql_pick(NAMES, '(entry_id // 3)')} AS user_handle, {sql_pick(OUTLETS)} AS source, {sql_pick(SUGGESTIONS)} AS suggestion, {sql_pick(TITLES)} AS issue FROM mentions) """


def column(name: str, make, sql: str):
    """A projection of the planted mentions: entry_id and v."""
    query(name, P + f"SELECT entry_id, {sql} AS v FROM p")(lambda spark, sf_dir: planted(t.mentions(spark, sf_dir)).select("entry_id", make().alias("v")))


# --- countries ----------------------------------------------------------------------------------------------------------
ARABIC, INDIC = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]", "[\\x{0900}-\\x{0D7F}]"


def _first_sql(conditions: dict[str, str], country: str, weight: int) -> str:
    """The weight if the country's condition is the first of all to hold."""
    before = list(conditions)[: list(conditions).index(country)]
    return f"CASE WHEN {conditions[country]}" + "".join(f" AND NOT {conditions[b]}" for b in before) + f" THEN {weight} ELSE 0 END"


def _country_sql() -> str:
    rules = words_of.COUNTRY_VOTES
    any_ = lambda c, terms: t.sql_any(c, terms) if terms else "false"
    sum_ = lambda c, terms, w="1": t.sql_hits(c, terms, w) if terms else "0"
    parts = {c: {"post": [], "news": []} for c in rules}
    script = lambda c, col: {"Qatar": f"CASE WHEN regexp_matches({col}, '{ARABIC}') THEN 3 ELSE 0 END", "India": f"CASE WHEN regexp_matches({col}, '{INDIC}') THEN 3 ELSE 0 END"}.get(c, "0")
    for c, rule in rules.items():
        post, news = parts[c]["post"], parts[c]["news"]
        post += [_first_sql({k: any_("place", r["names"]) for k, r in rules.items()}, c, 3), sum_("place", rule["cities"], "2")]
        for who in ("name", "handle"):
            codes = {k: f"(regexp_matches({who}, '\\b({'|'.join(r['codes'])})\\b') OR " + " OR ".join(f"suffix({who}, '_{e}')" for e in r["endings"]) + ")" for k, r in rules.items()}
            post += [_first_sql(codes, c, 2), _first_sql({k: any_(who, r["handles"]) for k, r in rules.items()}, c, 1), _first_sql({k: f"contains({who}, '{r['people']}')" for k, r in rules.items()}, c, 1)]
            post += [f"CASE WHEN {any_(who, words_of.ARABIC_NAMES)} THEN 2 ELSE 0 END" if c == "Qatar" else "0", script(c, who)]
        news += [sum_("platform", rule["outlets"], "4"), f"CASE WHEN {any_('place', words_of.NEWS_ENDINGS)} THEN {sum_('place', rule['domains'], '3')} ELSE 0 END"]
        for kind, own in (("social", post), ("news", news)):
            own += [sum_("text", rule[kind]), sum_("text", rule["spelling"]), script(c, "text")]
    scores = ", ".join(f"{' + '.join(v)} AS {k}_{c.lower()}" for c, x in parts.items() for k, v in x.items())

    def top(kind: str) -> str:
        names = [f"{kind}_{c.lower()}" for c in rules]
        most = f"greatest({', '.join(names)})"
        return f"CASE WHEN {most} < 2 THEN 'unknown' " + " ".join(f"WHEN {n} = {most} THEN '{n.split('_')[1]}'" for n in names) + " END"

    social = "(source IN {0} OR platform IN {0})".format("('" + "', '".join(words_of.SOCIAL) + "')")
    news = "(source = 'news' OR platform IN ('" + "', '".join(words_of.NEWS_PLATFORMS) + "'))"
    low = "SELECT entry_id, CASE WHEN entry_id % 11 = 0 THEN 'Ghana' WHEN entry_id % 11 = 1 THEN 'unknown' END AS known, lower(text) AS text, lower(platform) AS platform, lower(source) AS source, lower(user_location) AS place, lower(user_name) AS name, lower(user_handle) AS handle FROM p"
    return P + f", l AS ({low}), s AS (SELECT entry_id, known, source, platform, {scores} FROM l) SELECT entry_id, CASE WHEN known = 'Ghana' THEN 'ghana' WHEN {social} THEN {top('post')} WHEN {news} THEN {top('news')} ELSE 'unknown' END AS country FROM s"


@query("x15_detect_country", _country_sql())
def _(spark, sf_dir):
    known = F.when(F.col("entry_id") % 11 == 0, "Ghana").when(F.col("entry_id") % 11 == 1, "unknown")
    found = countries.detect_country(known, *map(F.col, ("text", "platform", "source", "user_location", "user_name", "user_handle")))
    return planted(t.mentions(spark, sf_dir)).select("entry_id", found.alias("country"))


column("x17_scripts", lambda: F.concat_ws(",", F.when(geo.has_arabic(F.col("text")), "arabic"), F.when(geo.has_indic(F.col("user_name")), "indic")), f"concat_ws(',', CASE WHEN regexp_matches(text, '{ARABIC}') THEN 'arabic' END, CASE WHEN regexp_matches(user_name, '{INDIC}') THEN 'indic' END)")
column("x18_spelling_votes", lambda: F.concat_ws(",", *[v.cast("string") for v in countries.spelling_votes(F.lower("text")).values()]), "concat_ws(',', " + ", ".join(t.sql_hits("lower(text)", r["spelling"]) if r["spelling"] else "0" for r in words_of.COUNTRY_VOTES.values()) + ")")
column("x12_country_from_username", lambda: geo.country_from_username(F.col("user_name")), "CASE " + " ".join(f"WHEN {t.sql_any('lower(user_name)', x)} THEN '{c}'" for c, x in words_of.COUNTRY_BY_USERNAME.items()) + " ELSE 'unknown' END")

# --- categories, ministries, issues -------------------------------------------------------------------------------------
column("x19_closest_category", lambda: categories.closest_category(F.col("suggestion")), "CASE WHEN suggestion = '' OR lower(suggestion) IN ('non_governance', 'unknown', 'irrelevant') THEN 'non_governance' " + " ".join(f"WHEN {t.sql_any('lower(suggestion)', x)} THEN '{c}'" for c, x in words_of.CATEGORY_TERMS) + " ELSE 'non_governance' END")
_MOST = "greatest(" + ", ".join(t.sql_hits("lower(text)", x) for x in words_of.MINISTRY_KEYWORDS.values()) + ")"
column("x20_shipped_ministry", lambda: scoring.ministry(F.col("text")), f"CASE WHEN {_MOST} = 0 THEN 'non_governance' " + " ".join(f"WHEN {t.sql_hits('lower(text)', x)} = {_MOST} THEN '{c}'" for c, x in words_of.MINISTRY_KEYWORDS.items()) + " END")
column("x21_shipped_topics", lambda: F.array_join(scoring.topics(F.col("text")), ","), "concat_ws(',', " + ", ".join(f"CASE WHEN {t.sql_any('lower(text)', x)} THEN '{c}' END" for c, x in words_of.TOPIC_KEYWORDS.items()) + ")")
_BY_TOPIC = "CASE " + " ".join(f"WHEN {t.sql_any('lower(text)', x)} THEN '{words_of.TOPIC_MINISTRY[c]}'" for c, x in words_of.TOPIC_KEYWORDS.items()) + " END"
_BY_WORD = "CASE " + " ".join(f"WHEN {t.sql_any('lower(text)', x)} THEN '{c}'" for c, x in words_of.INFERRED_MINISTRY.items()) + " ELSE 'general' END"
column("x22_shipped_inference", lambda: scoring.inferred_ministry(F.col("text"), F.when(F.col("entry_id") % 2 == 0, scoring.topics(F.col("text"))).otherwise(F.array().cast("array<string>"))), f"CASE WHEN entry_id % 2 = 0 THEN coalesce({_BY_TOPIC}, {_BY_WORD}) ELSE {_BY_WORD} END")
_OWN = " || ".join(f"CASE WHEN {t.sql_any('lower(text)', x)} THEN [{', '.join(map(t.quote, x))}] ELSE []::VARCHAR[] END" for x in words_of.TOPIC_KEYWORDS.values())
_CIVIC = f"list_filter([{', '.join(map(t.quote, words_of.CIVIC_WORDS))}], lambda w: contains(lower(text), w))"
column("x23_shipped_keywords", lambda: F.array_join(scoring.keywords(F.col("text"), scoring.topics(F.col("text"))), ","), f"array_to_string(list_transform(list_sort(list_transform(list_distinct({_OWN} || {_CIVIC}), lambda w: {{'at': list_position({_OWN} || {_CIVIC}, w), 'w': w}}))[1:10], lambda x: x.w), ',')")
_LOW = "lower(issue)"
_TOP = "greatest(" + ", ".join(t.sql_hits(_LOW, x) for x in words_of.ISSUE_KEYWORDS.values()) + ")"
_KNOWN = f"CASE WHEN {_TOP} >= 2 THEN CASE " + " ".join(f"WHEN {t.sql_hits(_LOW, x)} = {_TOP} THEN '{c}'" for c, x in words_of.ISSUE_KEYWORDS.items()) + " END END"
_SLUG = f"array_to_string(list_filter(string_split_regex(trim({_LOW}), '\\s+'), lambda w: length(w) > 3 AND w NOT IN ('the', 'a', 'an', 'in', 'on', 'at', 'for', 'to', 'of', 'and', 'or'))[1:3], '-')"
_TITLE = f"array_to_string(list_transform(string_split(({_KNOWN}), '-'), lambda w: upper(w[1]) || w[2:]), ' ')"


@query("x26_issue_title", P + f"SELECT entry_id, CASE WHEN issue = '' OR (({_KNOWN}) IS NULL AND {_SLUG} = '') THEN 'general-issue' ELSE coalesce(({_KNOWN}), {_SLUG}) END AS slug, CASE WHEN issue = '' THEN 'General Issue' WHEN ({_KNOWN}) IS NOT NULL THEN {_TITLE} ELSE issue END AS label FROM p")
def _(spark, sf_dir):
    return planted(t.mentions(spark, sf_dir)).select("entry_id", categories.issue_title(F.col("issue")).alias("i")).select("entry_id", "i.slug", "i.label")


def taxonomy(spark, sf_dir: str) -> DataFrame:
    """Regions as ministries, their nations as subcategories."""
    region, nation = t.read(spark, sf_dir, "region"), t.read(spark, sf_dir, "nation")
    met = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    return met.select(F.lower("r_name").alias("ministry_key"), F.initcap("r_name").alias("ministry_name"), F.lower("n_name").alias("subcategory_key"), F.col("n_name").alias("subcategory_name"))


@query("x32_subcategories", "SELECT lower(r_name) AS ministry_key, string_agg(lower(n_name) || '=' || n_name, ',' ORDER BY lower(n_name)) AS subcategories FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf_dir):
    pairs = F.transform(F.map_entries("subcategories"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return categories.subcategories(taxonomy(spark, sf_dir)).select("ministry_key", F.array_join(pairs, ",").alias("subcategories"))


@query("x32_key_by_name", "SELECT c_custkey, CASE WHEN c_custkey % 4 != 0 THEN lower(r_name) END AS ministry_key, CASE WHEN c_custkey % 4 = 0 OR r_name NOT IN ('AFRICA', 'ASIA') THEN 'non_governance' WHEN r_name = 'AFRICA' THEN 'issues' ELSE 'positive' END AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf_dir):
    named = t.read(spark, sf_dir, "customer").join(F.broadcast(t.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    named = named.join(F.broadcast(t.read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    found = categories.key_by_name(named.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.upper("r_name")).otherwise("nowhere").alias("name")), taxonomy(spark, sf_dir), "name")
    return found.select("c_custkey", "ministry_key", F.coalesce(categories.category_type(F.col("ministry_key"), ["africa"], ["asia"]), F.lit("non_governance")).alias("kind"))


@query("x43_valid_category", f"WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown_key' WHEN c_custkey % 3 = 1 THEN lower(r_name) END AS key, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN key ELSE 'non_governance' END AS key, CASE WHEN c_custkey % 3 = 1 THEN {'array_to_string(list_transform(string_split(lower(r_name), chr(32)), lambda w: upper(w[1]) || w[2:]), chr(32))'} ELSE 'Non-Governance Content' END AS category_label FROM k")
def _(spark, sf_dir):
    named = t.read(spark, sf_dir, "customer").join(F.broadcast(t.read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    named = named.join(F.broadcast(t.read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = named.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "unknown_key").when(F.col("c_custkey") % 3 == 1, F.lower("r_name")).alias("key"))
    return categories.valid_categories(rows, taxonomy(spark, sf_dir), "key")


# --- scores and responses -----------------------------------------------------------------------------------------------
_SCORES = "[{'label': 'Positive', 'score': entry_id % 101 / 100.0::DOUBLE}, {'label': 'negative', 'score': entry_id % 13 / 100.0::DOUBLE}, {'label': 'neutral', 'score': entry_id % 7 / 10.0::DOUBLE}]"
_FACT, _BAD, _OPEN = (t.sql_any("lower(text)", x) for x in (words_of.FACTUAL_PHRASES, words_of.NEGATIVE_WORDS, words_of.UNDECIDED_PHRASES))


@query("x30_settled_scores", P + f""", r AS (SELECT entry_id, text, {_SCORES} AS s FROM p), o AS (SELECT entry_id, text, x.label AS name, x.score AS score, i, row_number() OVER (PARTITION BY entry_id ORDER BY x.score DESC, i) AS pos
    FROM (SELECT entry_id, text, unnest(s) AS x, unnest([1, 2, 3]) AS i FROM r)), w AS (SELECT entry_id, any_value(text) AS text, lower(max(name) FILTER (pos = 1)) AS label, max(score) FILTER (pos = 1) AS score, max(score) FILTER (pos = 2) AS second, max(score) FILTER (name = 'neutral') AS neutral FROM o GROUP BY entry_id),
    k AS (SELECT *, CASE WHEN {_FACT} THEN 1 WHEN {_BAD} AND label = 'negative' THEN 2 WHEN {_OPEN} OR score BETWEEN 0.25::DOUBLE AND 0.75::DOUBLE OR (label = 'positive' AND score <= 0.95::DOUBLE) OR (label = 'negative' AND score >= 0.1::DOUBLE) THEN 3
    WHEN score - second < CASE WHEN label = 'negative' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END THEN 1 ELSE 2 END AS c FROM w)
    SELECT entry_id, CASE WHEN c = 2 THEN label ELSE 'neutral' END AS label, CASE WHEN c = 1 THEN neutral ELSE score END AS score FROM k""")
def _(spark, sf_dir):
    n = F.col("entry_id")
    each = [("Positive", n % 101 / 100.0), ("negative", n % 13 / 100.0), ("neutral", n % 7 / 10.0)]
    scores = F.array(*[F.struct(F.lit(name).alias("label"), value.alias("score")) for name, value in each])
    return planted(t.mentions(spark, sf_dir)).select("entry_id", scoring.settled_scores(scores, F.col("text")).alias("x")).select("entry_id", "x.label", "x.score")


column("x30_confident_label", lambda: scoring.confident_label(F.concat((F.col("entry_id") % 6).cast("string"), F.lit(" stars")), F.col("location_confidence")), "CASE WHEN location_confidence < 0.45::DOUBLE OR entry_id % 6 IN (0, 3) THEN 'neutral' WHEN entry_id % 6 >= 4 THEN 'positive' ELSE 'negative' END")


@query("x31_scorer_json", M + f"SELECT entry_id, CASE WHEN entry_id % 3 = 2 OR {sql_pick(MINISTRIES)} NOT IN ('works', 'health', 'education', 'power') THEN 'non_governance' ELSE {sql_pick(MINISTRIES)} END AS category, CASE WHEN entry_id % 3 = 2 THEN 0.0::DOUBLE ELSE (entry_id % 10)::DOUBLE / 10 END AS relevance, CASE WHEN entry_id % 3 = 2 THEN '' ELSE 'a,b' END AS keywords, entry_id % 3 != 2 AND entry_id % 10 >= 3 AS is_governance FROM mentions")
def _(spark, sf_dir):
    body = F.concat(F.lit('{"ministry_category": "'), pick(MINISTRIES), F.lit('", "governance_relevance": 0.'), (F.col("entry_id") % 10).cast("string"), F.lit(', "keywords": ["a", "b"]}'))
    response = F.when(F.col("entry_id") % 3 == 0, body).when(F.col("entry_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).otherwise("no JSON at all")
    found = scoring.scorer_json(response, ["works", "health", "education", "power"])
    return t.mentions(spark, sf_dir).select("entry_id", found.alias("x")).select("entry_id", "x.category", "x.relevance", F.array_join("x.keywords", ",").alias("keywords"), "x.is_governance")


@query("x31_scorer_lines", M + "SELECT entry_id, CASE WHEN entry_id % 4 = 0 THEN 'neutral' ELSE sentiment_label END AS label, sentiment_score AS score, 'because ' || user_name AS justification, 'a|b' AS topics FROM mentions")
def _(spark, sf_dir):
    first = F.when(F.col("entry_id") % 4 != 0, F.concat(F.lit("Sentiment: "), F.initcap("sentiment_label"), F.lit("\n"))).otherwise("")
    response = F.concat(first, F.lit("Sentiment Score: "), F.col("sentiment_score").cast("string"), F.lit("\nJustification: because "), F.col("user_name"), F.lit(" \nTopics: a, b,"))
    found = scoring.scorer_lines(response)
    return t.mentions(spark, sf_dir).select("entry_id", found.alias("x")).select("entry_id", "x.label", "x.score", "x.justification", F.array_join("x.topics", "|").alias("topics"))


# --- filters ------------------------------------------------------------------------------------------------------------
def rows(name: str, make, where: str):
    query(name, P + f"SELECT entry_id FROM p WHERE {where}")(lambda spark, sf_dir: make(planted(t.mentions(spark, sf_dir))).select("entry_id"))


rows("f7_shipped_screen", lambda m: filters.screened(m, words_of.SKIP_TERMS, ["scum"], ["the", "de"], columns=("issue", "user_name")), "NOT " + t.sql_any("lower(issue || ' ' || user_name)", [*words_of.SKIP_TERMS, "scum"]) + " AND " + t.sql_any("lower(issue || ' ' || user_name)", ["the", "de"]))
rows("f17_hashtags", lambda m: m.where(filters.valid_hashtag(F.col("user_name"))), "regexp_full_match(user_name, '[A-Za-z0-9_]+')")
_NEWS = t.sql_any("lower(issue)", words_of.NEWS_TERMS) + " OR " + t.sql_any("lower(user_location)", [*words_of.NEWS_TERMS, *words_of.NEWS_ADDRESSES])
rows("x8_news_like", lambda m: m.where(categories.news_like(F.col("issue"), F.col("user_location"))), f"length(issue) > 15 AND ({_NEWS}) AND NOT {t.sql_any('lower(issue)', words_of.SKIP_TERMS)} AND NOT {t.sql_any('lower(user_location)', words_of.SKIP_TERMS)}")
ADDRESSES = ["https://www.facebook.com/", "https://facebook.com/some.page", "https://m.facebook.com/groups/12", "http://fb.com/page2/posts/3", "https://facebook.com.evil.org/page", "https://www.facebook.com/watch/?v=1", "page", "https://facebook.com/events/9"]


@query("f16_page_addresses", f"SELECT page_id, page_id % {len(ADDRESSES)} IN (1, 3) AS is_page FROM pages")
def _(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", filters.facebook_page(pick(ADDRESSES, "page_id")).alias("is_page"))


# --- texts and dates ----------------------------------------------------------------------------------------------------
@query("x10_url_host", r"SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host FROM pages")
def _(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", geo.url_host(F.col("url")).alias("host"))


query("x41_first_number", M + "SELECT entry_id, CASE WHEN entry_id % 3 != 0 THEN likes + 0.5::DOUBLE END AS v FROM mentions")(
    lambda spark, sf_dir: t.mentions(spark, sf_dir).select("entry_id", text.first_number(F.concat(F.lit("rank 7\n"), F.when(F.col("entry_id") % 3 == 0, "nothing ").otherwise("Page Likes: "), F.col("likes").cast("string"), F.lit(".5 of 9\nlikes: 3"), ), "page likes").alias("v"))
)
DATE_PATTERNS = ["EEE MMM d HH:mm:ss '+0000' yyyy", "yyyy-MM-dd HH:mm:ss '+00000'", "yyyy-MM-dd'T'HH:mm:ss'.000Z'", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'+05:00'", "MMMM d, yyyy", "dd/MM/yyyy, hh:mm a', +0000 UTC'", "HH:mm dd MMM yyyy", "yyyy/MM/dd HH:mm:ss", "'not a date'", "d MMMM yyyy"]


#: Ways to write a time that no fixed format reads, and what is left of it (by SQL), with 29 February 2024 for what is missing.
GENERAL_DATES = {
    "MMMM d, yyyy 'at' h:mm a": "date_trunc('minute', ts)", "EEEE, d 'of' MMMM yy HH:mm:ss": "date_trunc('second', ts)", "d MMMM": "date_trunc('day', ts)",
    "MMMM yyyy": "TIMESTAMP '2024-01-29 00:00:00'", "h a": "TIMESTAMP '2024-02-29 00:00:00' + to_hours(hour(ts)::INTEGER)", "yyyyMMddHHmmss": "date_trunc('second', ts)",
    "dd.MM.yyyy": "CASE WHEN day(ts) > 12 THEN date_trunc('day', ts) ELSE make_timestamp(2024, day(ts), 1, 0, 0, 0) END", "'on' EEE d-MMM-yy": "date_trunc('day', ts)",
    "'some time in' MMMM": "NULL", "HH:mm 'UTC'": "TIMESTAMP '2024-02-29 00:00:00' + (date_trunc('minute', ts) - date_trunc('day', ts))",
}


@query("x14_general_dates", f"SELECT event_id, CASE event_id % {len(GENERAL_DATES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(GENERAL_DATES.values())) + " END AS v FROM events")
def _(spark, sf_dir):
    kind = F.col("event_id") % len(GENERAL_DATES)
    written = F.coalesce(*[F.when(kind == i, F.date_format("ts", p)) for i, p in enumerate(GENERAL_DATES)])
    return t.read(spark, sf_dir, "events").select("event_id", dates.parse_date(written, default="2024-02-29").alias("v"))


@query("x14_all_formats", f"SELECT event_id, CASE event_id % {len(DATE_PATTERNS)} WHEN 10 THEN NULL WHEN 6 THEN date_trunc('day', ts) WHEN 11 THEN date_trunc('day', ts) WHEN 7 THEN date_trunc('minute', ts) WHEN 8 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS v FROM events")
def _(spark, sf_dir):
    """The same instants in every format, with their own weekdays; zones are dropped."""
    ts, written = F.col("ts").cast("timestamp"), None
    for i, pattern in enumerate(DATE_PATTERNS):
        here = F.col("event_id") % len(DATE_PATTERNS) == i
        written = F.when(here, F.date_format(ts, pattern)) if written is None else written.when(here, F.date_format(ts, pattern))
    return t.read(spark, sf_dir, "events").select("event_id", dates.parse_date(written).alias("v"))


# --- projections at the edges -------------------------------------------------------------------------------------------
@query("s3_missing_columns", M + "SELECT entry_id, 'feed' AS source, 'feed' AS platform, NULL::VARCHAR AS date, text FROM mentions")
def _(spark, sf_dir):
    raw = t.mentions(spark, sf_dir).select("entry_id", "text", F.lit("feed").alias("file_source"))
    return files.ensure_required(raw).select("entry_id", "source", "platform", "date", "text")


@query("s4_aliases", M + "SELECT entry_id, text, title AS date, user_name FROM mentions")
def _(spark, sf_dir):
    raw = t.mentions(spark, sf_dir).select("entry_id", F.col("text").alias("full_text"), F.col("title").alias("created_at"), F.col("user_name").alias("screen_name"))
    return files.alias_columns(raw, "twitter").select("entry_id", "text", "date", "user_name")


@query("s16_public_record", M + "SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN NULL ELSE sentiment_score END AS sentiment_score, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at FROM mentions")
def _(spark, sf_dir):
    odd = F.when(F.col("entry_id") % 6 == 0, float("nan")).when(F.col("entry_id") % 6 == 3, float("-inf")).otherwise(F.col("sentiment_score"))
    return files.to_public_record(t.mentions(spark, sf_dir).select("entry_id", odd.alias("sentiment_score"), "published_at"))


@query("p4_conform", M + """SELECT entry_id, CASE WHEN user_location = 'worldwide' THEN NULL ELSE user_location END AS user_location, CASE WHEN entry_id % 2 = 0 THEN user_name ELSE 'Shown' END AS user_name, likes::BIGINT AS likes, NULL::BIGINT AS retweets,
    sentiment_score, date_trunc('second', published_at) AS published_at, '' AS tone, entry_id::VARCHAR AS original_id, 'a,b' AS keywords, NULL::VARCHAR AS ministry_hint, 51 AS n_columns FROM mentions""")
def _(spark, sf_dir):
    raw = t.mentions(spark, sf_dir).select(
        F.col("entry_id").cast("string").alias("id"), F.col("user_location").alias("location"), F.when(F.col("entry_id") % 2 == 0, F.col("user_name")).otherwise("").alias("username"), F.lit("Shown").alias("user_display_name"),
        F.concat(F.col("likes").cast("string"), F.lit(".9")).alias("likes"), F.lit("none").alias("retweets"), F.col("sentiment_score").cast("string").alias("sentiment_score"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.lit('["a", "b"]').alias("issue_keywords"),
    )
    out = files.conform_mentions(raw)
    return out.select(F.col("original_id").cast("long").alias("entry_id"), "user_location", "user_name", "likes", "retweets", "sentiment_score", "published_at", "tone", "original_id", F.array_join("issue_keywords", ",").alias("keywords"), "ministry_hint", F.lit(len(out.columns)).alias("n_columns"))


@query("p6_user_name_by_source", M + r"""SELECT entry_id, CASE entry_id % 4 WHEN 0 THEN coalesce(user_location, platform) WHEN 1 THEN title WHEN 2 THEN 'a.b' ELSE user_name END AS user_name FROM mentions""")
def _(spark, sf_dir):
    raw = t.mentions(spark, sf_dir).withColumns({"file_source": pick(["Social", "rss", "news", "x"]), "source": F.col("title"), "url": F.lit("https://www.a.b/c")})
    return files.user_name_by_source(raw).select("entry_id", "user_name")


@query("x38_input_order", M + "SELECT entry_id, 'scored ' || title AS note, row_number() OVER (ORDER BY entry_id) - 1 AS place FROM mentions")
def _(spark, sf_dir):
    m = t.mentions(spark, sf_dir).select("entry_id", "title")
    scattered = m.repartition("title").select("entry_id", F.concat(F.lit("scored "), "title").alias("note"))
    numbered = enrich.numbered_batches(enrich.in_input_order(scattered, m), 1)
    return numbered.select("entry_id", "note", F.col("batch").alias("place"))


@query("t5_batches", M + "SELECT entry_id, (row_number() OVER (ORDER BY entry_id) - 1) // 150 AS batch, (row_number() OVER (ORDER BY entry_id) - 1) % 150 AS place FROM mentions")
def _(spark, sf_dir):
    return enrich.numbered_batches(t.mentions(spark, sf_dir).select("entry_id"), 150)


@query("r6_sliding_sentiment", M + f""", w AS (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6]) AS back FROM mentions WHERE published_at <= {TS})
    SELECT date_trunc('day', published_at) - to_days(back::INTEGER) AS start, count(*) AS total, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'negative') AS negative, count(*) FILTER (sentiment_label = 'neutral') AS neutral FROM w GROUP BY 1""")
def _(spark, sf_dir):
    out = jobs.sliding_sentiment(t.mentions(spark, sf_dir).withColumn("published_at", F.col("published_at").cast("timestamp")))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


#: A page of three documents' stories: cards inside an article, whose own first heading is the first card's.
_PLAIN = "trim(regexp_replace({0}, '[^a-z]+', ' ', 'g'))"


@query("x6_several_articles", f"""
    WITH d AS (SELECT doc_id // 3 AS page_id, doc_id, {_PLAIN.format("lower(coalesce(text, ''))")} AS body FROM documents),
    c AS (SELECT page_id, doc_id, count(*) OVER (PARTITION BY page_id) + row_number() OVER (PARTITION BY page_id ORDER BY doc_id) AS place, 'story ' || doc_id || ' of a page' AS title, 'story ' || doc_id || ' of a page ' || body || ' more 2024-02-' || (10 + doc_id % 9) AS body,
        'http://p' || page_id || '.example.com/s/' || doc_id AS link, '2024-02-' || (10 + doc_id % 9) AS date_text, FALSE AS whole FROM d),
    p AS (SELECT page_id, 0 AS place, 'article' AS kind, first(title ORDER BY doc_id) AS title, string_agg(body, ' ' ORDER BY doc_id) AS body, first(link ORDER BY doc_id) AS link, first(date_text ORDER BY doc_id) AS date_text FROM c GROUP BY page_id)
    SELECT page_id, place::INTEGER AS place, kind, title, regexp_replace(body, ' +', ' ', 'g') AS body, link, date_text
    FROM (SELECT * FROM p UNION ALL SELECT page_id, place, 'div' AS kind, title, body, link, date_text FROM c) WHERE NOT {t.sql_any("body", words_of.SKIP_TERMS)}""")
def _(spark, sf_dir):
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))
    ids = F.col("doc_id").cast("string")
    card = F.concat(F.lit('<div class="x card"><h3>story <b>'), ids, F.lit("</b> of a page</h3><p>"), plain, F.lit('<br><script>var a = "</p>";</script><a href="/s/'), ids, F.lit('">more</a> <i>2024-02-'), (10 + F.col("doc_id") % 9).cast("string"), F.lit("</i></div>"))
    rows = t.read(spark, sf_dir, "documents").select(F.expr("doc_id div 3").alias("page_id"), "doc_id", card.alias("card"))
    three = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "card"))).alias("cards"))  # three to a page
    html = F.concat(F.lit("<html><title>t</title><nav><a href='/'>home</a></nav><article>"), F.array_join(F.transform("cards", lambda c: c["card"]), ""), F.lit("</article>"))
    return pages.segment_articles(three.select("page_id", F.concat(F.lit("http://p"), F.col("page_id").cast("string"), F.lit(".example.com/x")).alias("url"), html.alias("html")))


@query("x6_articles")
def _(spark, sf_dir):
    return pages.extract_articles(t.read(spark, sf_dir, "pages"))
