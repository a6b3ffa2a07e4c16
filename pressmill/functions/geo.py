"""Places: cleaning of locations, URL hosts, and country rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .automaton import found_terms, ranges, within
from .dictionaries import COUNTRY_BY_LOCATION, COUNTRY_BY_USERNAME, FEED_REGIONS, GENERIC_LOCATIONS, LOCATION_RULES
from .terms import any_of, best, first_name, hits, let


def clean_location(location: Column) -> Column:
    """A location fit to count, or null: no placeholder, URL, address or e-mail; single blanks; no trailing , or ."""
    place = F.trim(location)
    low = F.lower(place)
    generic = low.isin(["", "none", "null", "nan", *GENERIC_LOCATIONS])
    for word in GENERIC_LOCATIONS:
        generic = generic | low.startswith(word + ",") | low.endswith("," + word)
    odd = low.startswith("http://") | low.startswith("https://") | low.startswith("www.") | place.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    odd = odd | (place.contains("@") & place.contains("."))
    tidy = F.regexp_replace(F.regexp_replace(place, r"\s+", " "), "[,.]+$", "")
    return F.when(generic | odd | (tidy == ""), None).when(low == "nigeria", "Nigeria").otherwise(tidy)


def url_domain(url: Column) -> Column:
    """Host of a URL without www., of a bare www. address what follows it, else the empty string."""
    host = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    bare = F.regexp_extract(url, r"www\.([^/]+)", 1)
    return F.coalesce(F.when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(bare), F.lit(""))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def country_from_domain(domain: Column, endings: tuple[str, ...] = (".com", ".org", ".net", ".edu", ".gov")) -> Column:
    low = F.lower(domain)
    general = F.lit(False)
    for ending in endings:
        general = general | domain.endswith(ending)
    return (
        F.when(domain.endswith(".qa") | low.contains("qatar"), "qatar")
        .when(domain.endswith(".uk") | domain.contains(".co.uk"), "uk")
        .when(domain.endswith(".ae") | low.contains("uae"), "uae")
        .when(domain.endswith(".ng") | low.contains("nigeria"), "nigeria")
        .when(domain.endswith(".in") | low.contains("india"), "india")
        .when(general, "us/intl")
        .otherwise("unknown")
    )


def country_from_location(location: Column) -> Column:
    return first_name(F.lower(location), COUNTRY_BY_LOCATION, "unknown")


def country_from_username(name: Column) -> Column:
    return first_name(F.lower(name), COUNTRY_BY_USERNAME, "unknown")


def has_arabic(text: Column) -> Column:
    return text.rlike(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]")


def has_indic(text: Column) -> Column:
    return text.rlike(r"[\x{0900}-\x{0D7F}]")


def location_scores(found: Column, platform: Column, source: Column, user_location: Column, user_name: Column, user_handle: Column, rules: Mapping = LOCATION_RULES) -> dict[str, Column]:
    """Score of each country, from lower-cased columns, and the numbers of the countries' keywords found in the text: sources
    and domains 5, text 1, named location 3 and its keywords 2, names 2 for the first five keywords."""
    place, name, handle = user_location, user_name, user_handle
    out, at = {}, ranges({country: rule["keywords"] for country, rule in rules.items()})
    for country, rule in rules.items():
        score = F.size(F.filter(F.array(*map(F.lit, rule["sources"])), lambda s: F.contains(source, s) | F.contains(platform, s))) * F.lit(5.0)
        score = score + hits(place, rule["domains"], 5.0) + within(found, *at[country]) * F.lit(1.0)
        score = score + F.when(place.contains(country.lower()), 3.0).otherwise(0.0) + hits(place, rule["keywords"], 2.0)
        out[country] = score + hits(name, rule["keywords"][:5], 2.0) + hits(handle, rule["keywords"][:5], 2.0)
    return out


def classify_location(text: Column, platform: Column, source: Column, user_location: Column, user_name: Column, user_handle: Column, rules: Mapping = LOCATION_RULES, needs_text: bool = True) -> Column:
    """struct(label, confidence): the country of the highest score from 2 on, and a tenth of the score; nulls for no text, unless
    ``needs_text`` is off: then such rows are judged by their other fields."""

    def judged(found: Column) -> Column:
        usable = found["name"].isNotNull()
        if needs_text:
            usable = (F.length(text) > 0) & usable
        return F.struct(F.when(usable, F.lower(found["name"])).alias("label"), F.when(usable, F.least(F.lit(1.0), found["score"] / 10)).alias("confidence"))

    lowered = F.struct(*[F.lower(F.coalesce(c, F.lit(""))).alias(f"c{i}") for i, c in enumerate((platform, source, user_location, user_name, user_handle))], found_terms(F.lower(F.coalesce(text, F.lit(""))), [x for rule in rules.values() for x in rule["keywords"]]).alias("found"))
    return let(let(lowered, lambda low: best(location_scores(low["found"], *[low[f"c{i}"] for i in range(5)], rules), 2.0)), judged)


def feed_region(url: Column) -> Column:
    return first_name(F.lower(url), FEED_REGIONS, "International")


def mentions_target(text: Column, words: list[str]) -> Column:
    """Any word of three letters or more of a target's names is part of the text."""
    return any_of(F.lower(text), [w for w in words if len(w) >= 3])
