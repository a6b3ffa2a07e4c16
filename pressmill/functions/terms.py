"""Rules over terms that a text contains: counts, flags, first and best matches.

A dictionary is an ordered mapping from a name to terms; it becomes expressions, a few hundred terms at most in one.
``contains`` means substring, as the rules were written; pass ``whole_words=True`` to ask for whole words.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: More terms than this are one array that is walked, so that the code of an expression stays small.
FEW = 2


def has(text: Column, term: str, whole_words: bool = False) -> Column:
    if whole_words:
        return text.rlike(r"(?<![\p{L}\p{N}])\Q" + term + r"\E(?![\p{L}\p{N}])")
    return text.contains(term)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(text: Column, terms: Sequence[str], whole_words: bool = False) -> Column:
    if len(terms) > FEW and not whole_words:
        return let(text, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda term: F.contains(x, term)))
    out = F.lit(False)
    for term in terms:
        out = out | has(text, term, whole_words)
    return out


def hits(text: Column, terms: Sequence[str], weight: float = 1, whole_words: bool = False) -> Column:
    """How many terms a text contains, times a weight."""
    if len(terms) > FEW and not whole_words:
        return let(text, lambda x: F.size(F.filter(F.array(*map(F.lit, terms)), lambda term: F.contains(x, term)))) * F.lit(weight)
    zero = F.lit(0 if isinstance(weight, int) else 0.0)
    return sum((F.when(has(text, t, whole_words), weight).otherwise(0) for t in terms), zero)


def first_counted(counts: Mapping[str, Column], default: str | None = None) -> Column:
    """The first name with a count."""
    return F.coalesce(*[F.when(n > 0, name) for name, n in counts.items()], F.lit(default))


def first_name(text: Column, rules: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    """The first name with a term in the text."""
    return F.coalesce(*[F.when(any_of(text, terms), name) for name, terms in rules.items()], F.lit(default))


def names(counts: Mapping[str, Column]) -> Column:
    """All names with a count, in order."""
    return F.array_compact(F.array(*[F.when(n > 0, name) for name, n in counts.items()]))


def best(scores: Mapping[str, Column], least: float, default: str | None = None) -> Column:
    """struct(name, score): the name with the highest score of at least ``least``, the first of equals, else the default.

    The scores are evaluated once, into an array.
    """
    names_of = F.array(*map(F.lit, scores))

    def top(values: Column) -> Column:
        score = F.array_max(values)
        name = F.when(score >= least, F.get(names_of, F.array_position(values, score).cast("int") - 1)).otherwise(default)
        return F.struct(name.alias("name"), score.alias("score"))

    return let(F.array(*[s.cast("double") for s in scores.values()]), top)


def best_name(scores: Mapping[str, Column], least: float, default: str | None = None) -> Column:
    """The name with the highest score of at least ``least``; the first of equals."""
    return best(scores, least, default)["name"]

