"""The country of a mention by votes of its place, names, outlet and text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import found_terms, ranges, within
from .dictionaries import ARABIC_NAMES, COUNTRY_VOTES, NEWS_ENDINGS, NEWS_PLATFORMS, SOCIAL
from .geo import has_arabic, has_indic
from .terms import any_of, best_name, hits, let

#: Countries that a script in a text or a name votes for.
ARABIC_VOTE, INDIC_VOTE = "Qatar", "India"


def _first_only(conditions: Mapping[str, Column], weight: int) -> dict[str, Column]:
    """The weight for the first country whose condition holds, 0 for the others."""
    first = F.coalesce(*[F.when(c, name) for name, c in conditions.items()], F.lit(""))
    return {name: F.when(first == name, weight).otherwise(0) for name in conditions}


def spelling_votes(text: Column, rules: Mapping[str, Mapping] = COUNTRY_VOTES) -> dict[str, Column]:
    """For each country, how many of its spellings a lower-cased text has."""
    return {name: hits(text, rule["spelling"]) for name, rule in rules.items()}


def _name_votes(name: Column, rules: Mapping[str, Mapping]) -> list[dict[str, Column]]:
    def codes(rule: Mapping) -> Column:
        ending = F.lit(False)
        for code in rule["endings"]:
            ending = ending | name.endswith("_" + code)
        return name.rlike(r"\b(" + "|".join(rule["codes"]) + r")\b") | ending

    return [
        _first_only({c: codes(rule) for c, rule in rules.items()}, 2),
        _first_only({c: any_of(name, rule["handles"]) for c, rule in rules.items()}, 1),
        _first_only({c: name.contains(rule["people"]) for c, rule in rules.items()}, 1),
        {ARABIC_VOTE: F.when(any_of(name, ARABIC_NAMES), 2).otherwise(0)},
        {ARABIC_VOTE: F.when(has_arabic(name), 3).otherwise(0), INDIC_VOTE: F.when(has_indic(name), 3).otherwise(0)},
    ]


def _text_terms(rules: Mapping[str, Mapping]) -> dict[str, Sequence[str]]:
    """All terms that are looked for in a text, by kind and country."""
    return {f"{kind} {c}": rule[kind] for kind in ("social", "news", "spelling") for c, rule in rules.items()}


def _text_votes(text: Column, found: Column, kind: str, rules: Mapping[str, Mapping]) -> list[dict[str, Column]]:
    at = ranges(_text_terms(rules))
    return [
        *({c: within(found, *at[f"{k} {c}"]) for c in rules} for k in (kind, "spelling")),
        {ARABIC_VOTE: F.when(has_arabic(text), 3).otherwise(0), INDIC_VOTE: F.when(has_indic(text), 3).otherwise(0)},
    ]


def _total(votes: list[dict[str, Column]], rules: Mapping[str, Mapping]) -> dict[str, Column]:
    return {c: sum((v[c] for v in votes if c in v), F.lit(0)) for c in rules}


def detect_country(
    country: Column, text: Column, platform: Column, source: Column, user_location: Column, user_name: Column, user_handle: Column, rules: Mapping[str, Mapping] = COUNTRY_VOTES
) -> Column:
    """A known country as it is, in lower case; else the one with most votes from 2 on, the first of equals; else unknown.

    Posts vote by place, names and text, news by outlet, place and text; other sources don't vote.
    """
    lowered = F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(f"c{i}") for i, c in enumerate((text, platform, source, user_location, user_name, user_handle))], found_terms(F.lower(F.coalesce(text, F.lit(""))), [x for terms in _text_terms(rules).values() for x in terms]).alias("found"))
    known = (F.length(country) > 0) & ~country.isin("none", "unknown")
    return F.when(known, F.lower(country)).otherwise(F.lower(let(lowered, lambda low: _voted(*[low[f"c{i}"] for i in range(6)], low["found"], rules))))


def _voted(text: Column, platform: Column, source: Column, place: Column, name: Column, handle: Column, found: Column, rules: Mapping[str, Mapping]) -> Column:
    social = source.isin(SOCIAL) | platform.isin(SOCIAL)
    news = (source == "news") | platform.isin(NEWS_PLATFORMS)
    post = _total([
        _first_only({c: any_of(place, rule["names"]) for c, rule in rules.items()}, 3), {c: hits(place, rule["cities"], 2) for c, rule in rules.items()},
        *_name_votes(name, rules), *_name_votes(handle, rules), *_text_votes(text, found, "social", rules),
    ], rules)
    domain = any_of(place, NEWS_ENDINGS)
    article = _total([
        {c: hits(platform, rule["outlets"], 4) for c, rule in rules.items()}, {c: F.when(domain, hits(place, rule["domains"], 3)).otherwise(0) for c, rule in rules.items()},
        *_text_votes(text, found, "news", rules),
    ], rules)
    return F.when(social, best_name(post, 2, "unknown")).when(news, best_name(article, 2, "unknown")).otherwise("unknown")
