"""Text expressions: normalisation, clean-up, slugs, previews. All take and return Columns; null stays null unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_text(*columns: str) -> Column:
    """The first non-empty one of some text columns, else the empty string. Null and 'NaN' count as empty."""
    filled = [F.when((F.length(c) > 0) & (F.lower(c) != "nan"), F.col(c)) for c in columns]
    return F.coalesce(*filled, F.lit(""))


def normalize_text(text: Column) -> Column:
    """For exact dedup: lower case, single blanks, no URLs, no signs but . , ? ! and -, in this order."""
    out = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    out = F.regexp_replace(out, r"https?://\S+", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}_\s.,?!-]", "")


def normalize_strict(text: Column) -> Column:
    """For word sets: lower case, single blanks, letters and digits alone."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""))


def words(text: Column) -> Column:
    """Distinct words of a strictly normalised text."""
    return F.array_remove(F.array_distinct(F.split(normalize_strict(text), " +")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def clean_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def webvtt_text(content: Column) -> Column:
    """Spoken text of a WebVTT file: no header, cue times or cue numbers."""
    out = F.regexp_replace(content, r"(?ms)^WEBVTT.*?\n\n", "")
    out = F.regexp_replace(out, r"\d{2}:\d{2}:\d{2}\.\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}\.\d{3}[^\n]*\n", "")
    out = F.regexp_replace(out, r"(?m)^\d+\n", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def slug(label: Column) -> Column:
    """Lower case, signs dropped, blanks to hyphens; nothing left gives general-issue."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"[^a-zA-Z0-9\s-]", "")), r"\s+", "-")
    return F.when(out == "", "general-issue").otherwise(out)


def short_slug(label: Column, size: int = 4) -> Column:
    """A slug of the first words longer than three letters."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(label), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) > 3)
    out = F.array_join(F.slice(parts, 1, size), "-")
    return F.when(out == "", "general-issue").otherwise(out)


def first_number(text: Column, metric: str) -> Column:
    """The first number on the first line that names a metric, or null."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), F.lit(metric.lower()))), F.lit(0))
    return F.regexp_extract(line, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
