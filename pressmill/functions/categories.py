"""Categories and issues of mentions: closest category, taxonomy look-ups, canonical issue titles, news-likeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import contains_any, counted, first_rule
from .dictionaries import CATEGORY_TERMS, ISSUE_KEYWORDS, NEWS_ADDRESSES, NEWS_TERMS, NO_CATEGORY, SKIP_TERMS, TITLE_STOP_WORDS
from .terms import best_name


def closest_category(suggestion: Column, rules: Sequence[tuple[str, Sequence[str]]] = CATEGORY_TERMS) -> Column:
    """The category of the first rule with a term in a suggestion; non_governance without one, and for nothing or no category."""
    low = F.lower(suggestion)
    return F.when((F.coalesce(F.length(suggestion), F.lit(0)) == 0) | low.isin(NO_CATEGORY), "non_governance").otherwise(first_rule(low, rules, "non_governance"))


def issue_title(title: Column, rules: Mapping[str, Sequence[str]] = ISSUE_KEYWORDS) -> Column:
    """struct(slug, label): the issue with most keywords in a title, from two on; else a slug of its first three longer words."""
    low = F.lower(title)
    known = counted(low, rules, lambda counts: best_name(counts, 2))
    words = F.filter(F.split(F.trim(low), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(TITLE_STOP_WORDS))
    own = F.array_join(F.slice(words, 1, 3), "-")
    empty = F.coalesce(F.length(title), F.lit(0)) == 0
    slug = F.when(empty | (known.isNull() & (own == "")), "general-issue").otherwise(F.coalesce(known, own))
    label = F.when(empty, "General Issue").otherwise(F.coalesce(F.initcap(F.replace(known, F.lit("-"), F.lit(" "))), title))
    return F.struct(slug.alias("slug"), label.alias("label"))


def news_like(title: Column, url: Column, terms: Sequence[str] = NEWS_TERMS, skip: Sequence[str] = SKIP_TERMS, least: int = 15) -> Column:
    """A title of more than ``least`` characters with a news term in it or in its address, and no skip term in either."""
    low, address = F.lower(title), F.lower(F.coalesce(url, F.lit("")))
    news = contains_any(low, terms) | contains_any(address, [*terms, *NEWS_ADDRESSES])
    return F.coalesce((F.length(title) > least) & news & ~contains_any(low, skip) & ~contains_any(address, skip), F.lit(False))


def category_type(key: Column, issues: Sequence[str], positive: Sequence[str]) -> Column:
    return F.when(key.isin(*issues), "issues").when(key.isin(*positive), "positive").otherwise("non_governance")


def valid_categories(df: DataFrame, taxonomy: DataFrame, key: str, default: str = "non_governance", default_label: str = "Non-Governance Content") -> DataFrame:
    """df with ``key`` replaced by the default where the taxonomy (ministry_key, ministry_name) lacks it, and category_label.

    The taxonomy is a table of some dozens of rows; Spark broadcasts it by its size.
    """
    known = taxonomy.select(F.col("ministry_key").alias("_key"), F.col("ministry_name").alias("_name")).dropDuplicates(["_key"])
    out = df.join(known, F.col(key) == F.col("_key"), "left")
    return out.withColumns({key: F.coalesce("_key", F.lit(default)), "category_label": F.coalesce("_name", F.lit(default_label))}).drop("_key", "_name")


def key_by_name(df: DataFrame, taxonomy: DataFrame, name: str) -> DataFrame:
    """df with ministry_key of the taxonomy's row of that name, whatever the case; null where there is none."""
    known = taxonomy.groupBy(F.lower("ministry_name").alias("_name")).agg(F.min("ministry_key").alias("ministry_key"))
    return df.join(known, F.lower(name) == F.col("_name"), "left").drop("_name")


def subcategories(taxonomy: DataFrame) -> DataFrame:
    """ministry_key and its subcategories (key -> name)."""
    pairs = taxonomy.where("subcategory_key is not null").select("ministry_key", F.struct("subcategory_key", "subcategory_name").alias("pair")).distinct()
    return pairs.groupBy("ministry_key").agg(F.map_from_entries(F.array_sort(F.collect_list("pair"))).alias("subcategories"))
