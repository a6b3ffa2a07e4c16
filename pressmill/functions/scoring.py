"""Scores and labels of mentions by rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import counted
from .dictionaries import CIVIC_WORDS, FACTUAL_PHRASES, INFERRED_MINISTRY, MINISTRY_KEYWORDS, NEGATIVE_WORDS, TOPIC_KEYWORDS, TOPIC_MINISTRY, UNDECIDED_PHRASES
from .terms import any_of, best_name, first_counted, hits, names


def label_from_score(score: Column, edge: float = 0.2) -> Column:
    return F.when(score > edge, "positive").when(score < -edge, "negative").otherwise("neutral")


def settled_label(label: Column) -> Column:
    """positive, negative, or else neutral."""
    low = F.lower(label)
    return F.when(low.isin("positive", "negative"), low).otherwise("neutral")


def ministry(text: Column, keywords: Mapping[str, Sequence[str]] = MINISTRY_KEYWORDS) -> Column:
    """The ministry with most keywords in the text, the first of equals; non_governance without any."""
    return counted(F.lower(text), keywords, lambda counts: best_name(counts, 1, "non_governance"))


def governance(ministry_column: Column) -> Column:
    """struct(relevance, confidence, is_governance)."""
    relevance = F.when(ministry_column == "non_governance", 0.1).otherwise(0.5)
    return F.struct(relevance.alias("relevance"), F.lit(0.6).alias("confidence"), (relevance >= 0.3).alias("is_governance"))


def topics(text: Column, keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS) -> Column:
    return counted(F.lower(text), keywords, names)


def inferred_ministry(text: Column, topic_list: Column, by_topic: Mapping[str, str] = TOPIC_MINISTRY, by_word: Mapping[str, Sequence[str]] = INFERRED_MINISTRY) -> Column:
    known = F.create_map(*[F.lit(x) for pair in by_topic.items() for x in pair])
    first = F.get(F.filter(F.transform(topic_list, lambda t: F.try_element_at(known, t)), lambda m: m.isNotNull()), F.lit(0))
    return F.coalesce(first, counted(F.lower(text), by_word, lambda counts: first_counted(counts, "general")))


def keywords(text: Column, topic_list: Column, by_topic: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS, civic: Sequence[str] = tuple(CIVIC_WORDS)) -> Column:
    """Up to ten: those of the topics, then civic words in the text, each once."""
    known = F.create_map(*[x for name, terms in by_topic.items() for x in (F.lit(name), F.array(*map(F.lit, terms)))])
    own = F.flatten(F.filter(F.transform(topic_list, lambda t: F.try_element_at(known, t)), lambda a: a.isNotNull()))
    found = F.array_compact(F.array(*[F.when(F.lower(text).contains(w), w) for w in civic]))
    return F.slice(F.array_distinct(F.concat(own, found)), 1, 10)


def issue_confidence(text: Column, label: Column, score: Column) -> Column:
    size = F.least(F.length(text) / 1000, F.lit(1.0))
    value = F.abs(score) * size * F.when(label == "neutral", 0.7).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def recommended_action(label: Column, score: Column) -> Column:
    """The action by label and score; the sentences are fixed values."""
    return (
        F.when((label == "positive") & (score > 0.6), "Amplify and share this content through official channels")
        .when(label == "positive", "Monitor and potentially acknowledge this positive coverage")
        .when((label == "negative") & (score < -0.6), "Prepare immediate response and counter-narrative")
        .when(label == "negative", "Monitor closely and prepare contingency response")
        .otherwise("Monitor for potential developments")
    )


def page_type(label: Column) -> Column:
    return F.when(label == "positive", "positive_coverage").otherwise("issues")


def keyword_label(text: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """The sign of positive less negative hits."""
    low = F.lower(text)
    difference = hits(low, positive) - hits(low, negative)
    return F.when(difference > 0, "positive").when(difference < 0, "negative").otherwise("neutral")


def keyword_score(matches: Column, total: int) -> Column:
    """Share of a topic's keywords, raised a little by their number, 1 at most."""
    share = F.least(F.lit(1.0), matches / total)
    return F.when(matches > 0, F.least(F.lit(1.0), share * (1 + F.log(matches + 1.0) / 10))).otherwise(0.0)


def stars_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("5 stars") | low.contains("4 stars"), "positive").when(low.contains("2 stars") | low.contains("1 star"), "negative").otherwise("neutral")


def confident_label(label: Column, score: Column, least: float = 0.45) -> Column:
    """The label of a star rating; neutral where its score is below ``least``."""
    return F.when(score < least, "neutral").otherwise(stars_label(label))


def settled_scores(scores: Column, text: Column) -> Column:
    """struct(label, score) from a model's array of struct(label, score) and the text that it scored.

    Factual phrases make a text neutral, strongly negative words keep a negative label, undecided phrases make it neutral;
    then scores from 0.25 to 0.75, positive ones up to 0.95 and negative ones from 0.1 on are neutral; last, a top score too
    close to the second one.  An array without scores is null.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def settle(ranked: Column) -> Column:
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        label, score = F.lower(top["label"]), top["score"]
        neutral = F.coalesce(F.get(F.filter(ranked, lambda x: F.lower(x["label"]) == "neutral"), F.lit(0))["score"], F.lit(0.5))
        close = score - second["score"] < F.when(label == "negative", 0.1).otherwise(0.2)
        weak = score.between(0.25, 0.75) | ((label == "positive") & (score <= 0.95)) | ((label == "negative") & (score >= 0.1))

        def pair(name: Column | str, value: Column) -> Column:
            return F.struct((F.lit(name) if isinstance(name, str) else name).alias("label"), value.alias("score"))

        return (
            F.when(label.isNull(), None)
            .when(any_of(low, FACTUAL_PHRASES), pair("neutral", neutral))
            .when(any_of(low, NEGATIVE_WORDS) & (label == "negative"), pair("negative", score))
            .when(any_of(low, UNDECIDED_PHRASES) | weak, pair("neutral", score))
            .when(F.coalesce(close, F.lit(False)), pair("neutral", neutral))
            .otherwise(pair(label, score))
        )

    ranked = F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    return F.get(F.transform(F.array(ranked), settle), F.lit(0))


def scorer_json(response: Column, known: Sequence[str]) -> Column:
    """struct(category, relevance, confidence, keywords, reasoning, is_governance) from JSON, fenced or bare.

    An unknown or missing category is non_governance; text that isn't JSON has no category, relevance 0 and confidence 0.5.
    """
    fenced = F.regexp_extract(response, r"(?s)```json(.*?)```", 1)
    schema = "ministry_category string, governance_relevance double, confidence double, keywords array<string>, reasoning string"
    read = F.from_json(F.when(F.contains(response, F.lit("```json")), F.trim(fenced)).otherwise(response), schema)
    category = read["ministry_category"]
    relevance = F.coalesce(read["governance_relevance"], F.lit(0.0))
    return F.struct(
        F.when(category.isin(*known), category).otherwise("non_governance").alias("category"), relevance.alias("relevance"),
        F.coalesce(read["confidence"], F.lit(0.5)).alias("confidence"), F.coalesce(read["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(read["reasoning"], F.lit("")).alias("reasoning"), (relevance >= 0.3).alias("is_governance"),
    )


def scorer_lines(response: Column) -> Column:
    """struct(label, score, justification, topics) from lines ``Sentiment:``, ``Sentiment Score:``, ``Justification:``, ``Topics:``."""

    def line(name: str) -> Column:
        return F.trim(F.regexp_extract(response, rf"(?m)^\s*{name}:[ \t]*(.*)$", 1))

    label = F.lower(line("Sentiment"))
    return F.struct(
        F.when(label == "", "neutral").otherwise(label).alias("label"), F.coalesce(line("Sentiment Score").try_cast("double"), F.lit(0.0)).alias("score"),
        line("Justification").alias("justification"),
        F.filter(F.transform(F.split(line("Topics"), ","), lambda t: F.trim(t)), lambda t: t != "").alias("topics"),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null for a zero vector."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosines(vector: Column, table: Sequence[Sequence[float]]) -> Column:
    """Cosine similarities (array<double>) of an array with each vector of a table: one matrix product a batch of rows.

    Null for a null vector or one of another length than the table's; a similarity with a zero vector is null.
    """
    matrix = np.array(table, np.float64)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, size, out=np.full(matrix.shape, np.nan), where=size > 0)

    @F.arrow_udf("array<double>")
    def near(vectors: pa.Array) -> pa.Array:
        usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), unit.shape[1]), False)
        x = pc.list_flatten(vectors.filter(usable)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, unit.shape[1])
        length = np.linalg.norm(x, axis=1, keepdims=True)
        found = np.divide(x, length, out=np.full(x.shape, np.nan), where=length > 0) @ unit.T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(unit)), pa.array(found.ravel(), from_pandas=True))
        place = np.cumsum(usable.to_numpy(zero_copy_only=False)) - 1
        return lists.take(pa.array(place, mask=~usable.to_numpy(zero_copy_only=False)))

    return near(vector)


def bucket(key: Column, capacities: Mapping[str, int]) -> Column:
    """Routes a key to a name in proportion to the capacities, always the same one."""
    total = sum(capacities.values())
    share = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    out, edge = None, 0.0
    for name, capacity in capacities.items():
        edge += capacity / total
        out = F.when(share < edge, name) if out is None else out.when(share < edge, name)
    return out.otherwise(next(reversed(list(capacities))))
