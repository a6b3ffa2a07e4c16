"""Topics, owners and issues: the bridge between mentions and topics, joins over it, and issue rosters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.automaton import name_hits
from ..functions.scoring import cosines, keyword_score
from ..functions.terms import hits, let

#: What one automaton's dictionary holds at most.
DICTIONARY_BYTES = 16 << 20


def classify_topics(mentions: DataFrame, keywords: Mapping[str, Sequence[str]], vectors: DataFrame | None = None, vector: str = "embedding", least: float = 0.5, most: int = 3, key: str = "entry_id") -> DataFrame:
    """key, topic, keyword_score, embedding_score, confidence: 0.3 of the keyword score and 0.7 of the cosine, where there is a
    vector, else the keyword score; the best topics of at least ``least``.

    Topics are a dictionary; their vectors (topic, vector) are a matrix that a batch of mentions is multiplied with.  A mention's
    topics are ranked within its row.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    near = F.lit(None).cast("array<double>")
    if vectors is not None:
        known = {r.topic: r.vector for r in vectors.where(F.col("topic").isin(*keywords)).select("topic", "vector").collect()}  # no more than the dictionary
        size = max(map(len, known.values()), default=0)
        near = cosines(F.col(vector), [known.get(topic) or [0.0] * size for topic in keywords]) if size else near

    def scored(x: Column) -> Column:
        def one(i: int, topic: str, terms: Sequence[str]) -> Column:
            return F.struct(F.lit(topic).alias("topic"), keyword_score(hits(x["text"], terms), len(terms)).alias("k"), F.get(x["near"], F.lit(i)).alias("e"))

        return F.array(*[one(i, topic, terms) for i, (topic, terms) in enumerate(keywords.items())])

    def judged(x: Column) -> Column:
        confidence = F.round(F.when(x["e"].isNull(), x["k"]).otherwise(0.3 * x["k"] + 0.7 * x["e"]), 3)
        return F.struct((-confidence).alias("order"), x["topic"].alias("topic"), F.round(x["k"], 3).alias("keyword_score"), F.round(x["e"], 3).alias("embedding_score"), confidence.alias("confidence"))

    kept = F.filter(F.transform(let(F.struct(low.alias("text"), near.alias("near")), scored), judged), lambda x: x["confidence"] >= least)
    return mentions.select(key, F.inline(F.slice(F.array_sort(kept), 1, most))).drop("order")


def nearest_topics(rows: DataFrame, vectors: DataFrame, key: str = "entry_id", vector: str = "embedding", most: int = 3, digits: int = 4, block: int = 4096) -> DataFrame:
    """key, topic, similarity: the ``most`` topics of vectors (topic, vector) with the highest cosine to a row's vector, equal ones
    (to so many digits) by name.

    Topics are taken in blocks of so many, each a matrix; of each block the best of a row are kept, and then the best of those.
    Null and zero vectors, and vectors of another length, have no topics.
    """
    names = sorted(r.topic for r in vectors.select("topic").distinct().collect())
    best = None
    for i in range(0, len(names), block):
        own = names[i : i + block]
        table = {r.topic: r.vector for r in vectors.where(F.col("topic").between(own[0], own[-1])).select("topic", "vector").collect()}
        near = F.transform(cosines(F.col(vector), [table[n] for n in own]), lambda c, at: F.struct(F.round(-c, digits).alias("away"), F.get(F.array(*map(F.lit, own)), at).alias("topic")))
        part = F.slice(F.array_sort(F.filter(near, lambda x: x["away"].isNotNull())), 1, most)
        best = part if best is None else F.slice(F.array_sort(F.concat(best, part)), 1, most)
    if best is None:
        return rows.select(key, F.lit("").alias("topic"), F.lit(0.0).alias("similarity")).limit(0)
    return rows.select(key, F.explode(best).alias("x")).select(key, "x.topic", (-F.col("x.away")).alias("similarity"))


def mentions_for_owner(mentions: DataFrame, bridge: DataFrame, owners: DataFrame) -> DataFrame:
    """owner, entry_id: mentions with a topic of the owner (owners: owner, topics array), each once."""
    wanted = owners.select("owner", F.explode("topics").alias("topic")).distinct()
    return bridge.join(wanted, "topic").select("owner", "entry_id").distinct().join(mentions.select("entry_id"), "entry_id", "left_semi")


def mentions_for_topic(mentions: DataFrame, bridge: DataFrame, topic: str) -> DataFrame:
    return bridge.where(F.col("topic") == topic).join(mentions.select("entry_id"), "entry_id").select("entry_id", "confidence").orderBy(F.desc("confidence"), "entry_id")


def topic_stats(topics: DataFrame, bridge: DataFrame) -> DataFrame:
    counts = bridge.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return topics.select("topic").join(counts, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"), "avg_confidence")


def multi_topic(bridge: DataFrame) -> DataFrame:
    out = bridge.groupBy("entry_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("topic")), ",").alias("topics"))
    return out.where("n > 1")


def with_any_topic(rows: DataFrame, topics: Sequence[str], column: str = "topics") -> DataFrame:
    """Rows whose array of structs has one of the topics."""
    return rows.where(F.exists(column, lambda t: t["topic"].isin(*topics)))


def bridge_from_hint(mentions: DataFrame, topics: DataFrame) -> DataFrame:
    """A bridge row for each mention whose old hint is a known topic."""
    hints = mentions.where("ministry_hint is not null").select("entry_id", F.col("ministry_hint").alias("topic"))
    return hints.join(topics.select("topic"), "topic", "left_semi").select("entry_id", "topic", F.lit(1.0).alias("confidence"))


def top_issues(issues: DataFrame, topics: DataFrame, most: int = 20) -> DataFrame:
    return issues.join(topics.select("topic"), "topic").orderBy(F.desc("mention_count"), "topic", "issue_slug").limit(most)


def issue_stats(topics: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.groupBy("topic").agg(F.count("*").alias("issues"), F.sum("mention_count").alias("mentions"), F.round(F.avg("mention_count"), 6).alias("avg_mentions"))
    return topics.select("topic").join(counts, "topic", "left").select("topic", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("mentions", F.lit(0)).alias("mentions"), "avg_mentions")


def roster(mentions: DataFrame, group: str = "ministry_hint", slug: str = "issue_slug", most: int = 20) -> DataFrame:
    """The leading issues of each group with their counts and the number of issues kept."""
    counts = mentions.where(F.col(slug).isNotNull() & F.col(group).isNotNull()).groupBy(group, slug).agg(F.count("*").alias("mention_count"))
    w = Window.partitionBy(group)
    ranked = counts.withColumn("rank", F.row_number().over(w.orderBy(F.desc("mention_count"), slug))).where(f"rank <= {most}")
    return ranked.withColumn("issue_count", F.count("*").over(w))


def consolidated(mentions: DataFrame, group: str = "ministry_hint", slug: str = "issue_slug", most: int = 20, key: str = "entry_id") -> DataFrame:
    """Each mention with its issue if that is in its group's roster, else the roster's first."""
    own = roster(mentions, group, slug, most)
    first = own.where("rank = 1").select(group, F.col(slug).alias("_first"))
    kept = own.select(group, slug, F.lit(True).alias("_kept"))
    out = mentions.where(F.col(group).isNotNull() & F.col(slug).isNotNull()).select(key, group, slug).join(kept, [group, slug], "left").join(first, group)
    return out.select(key, group, F.when(F.col("_kept"), F.col(slug)).otherwise(F.col("_first")).alias("issue"))


def resolve_target(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """query, target: by equal name, else by a shared keyword, else by a part of the name; of equals the first target.

    targets: position, name, keywords (array). Targets are a watch list and are broadcast.
    """
    q = F.lower("query")
    stage = F.when(q == F.lower("name"), 1).when(F.exists("keywords", lambda k: F.contains(q, F.lower(k))), 2).when(F.exists(F.split(F.lower("name"), r"\s+"), lambda w: (F.length(w) >= 3) & F.contains(q, w)), 3)
    met = queries.join(F.broadcast(targets), stage.isNotNull(), "left").withColumn("stage", stage)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("stage").asc_nulls_last(), "position"))
    return met.withColumn("_r", rank).where("_r = 1").select("query", F.col("name").alias("target"), "stage")


def dictionary(spark: SparkSession, rules: Mapping[str, Sequence[str]], weight: float = 1.0) -> DataFrame:
    """Rules as a table: name, term, weight, position."""
    rows = [(name, term, float(weight)) for name, terms in rules.items() for term in terms]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, term string, weight double, position long")


def keyword_hits(mentions: DataFrame, terms: DataFrame, text: Column | None = None, key: str = "entry_id", block_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """key, name, n, weight: how many terms of each name of a dictionary a text contains, where any, and their weights' sum.

    The dictionary (name, term, and weight, 1 without that column) is a table, read when the query is built, so another one takes effect with the next
    run or batch.  A row with a null name or term is left out; equal rows count each.  The terms are an automaton over the text.  A dictionary of more than
    ``block_bytes`` is taken in blocks, an automaton each, so none that a task holds is larger.
    """
    low = F.lower(F.coalesce("text", F.lit(""))) if text is None else text
    weight = F.col("weight").cast("double") if "weight" in terms.columns else F.lit(1.0)
    terms = terms.where("name is not null and term is not null").select("name", "term", weight.alias("weight"))
    blocks = max(1, -(-(terms.agg(F.sum(F.octet_length("term") + F.octet_length("name") + 16)).first()[0] or 0) // block_bytes))
    out = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("name", "term"), F.lit(blocks)) == b) if blocks > 1 else terms
        entries = [tuple(r) for r in own.orderBy("name", "term", "weight").collect()]  # of a checked size
        part = mentions.select(key, F.explode(name_hits(low, entries)).alias("x")).select(key, "x.name", "x.n", "x.weight")
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy(key, "name").agg(F.sum("n").cast("int").alias("n"), F.sum("weight").alias("weight"))
    return out
