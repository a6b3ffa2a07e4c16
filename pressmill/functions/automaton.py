"""Many terms at once: one pass over a text finds every term that it contains, whatever their number.

A dictionary becomes an automaton over its characters, made once in a worker; overlapping terms and terms within terms are all
found.  What comes back is numbers of terms, and rules over them are Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import hits, let

try:
    import ahocorasick
except ImportError:  # the same answers, a term at a time
    ahocorasick = None

#: From so many terms on rules use the automaton; for fewer, a search for each costs less than handing texts to Python.
MANY = 40


@lru_cache(maxsize=16)
def finder(terms: tuple[str, ...]) -> Callable[[str], list[int]]:
    """Gives the ascending numbers of the terms that a text contains; equal terms are found under all their numbers."""
    numbers: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        numbers.setdefault(term, []).append(i)
    always = numbers.pop("", [])
    if ahocorasick is None or not numbers:
        return lambda text: sorted(chain(always, *(own for term, own in numbers.items() if term in text)))
    places = list(numbers.values())
    machine = ahocorasick.Automaton()
    for i, term in enumerate(numbers):
        machine.add_word(term, i)
    machine.make_automaton()
    return lambda text: sorted(chain(always, *(places[i] for i in {i for _, i in machine.iter(text)})))


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """Ascending numbers (array<int>) of the terms that a text contains; null for null."""
    terms = tuple(terms)

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        find = finder(terms)
        return pa.array([find(x) if x is not None else None for x in texts.to_pylist()], pa.list_(pa.int32()))

    return found(text)


def within(found: Column, first: int, end: int) -> Column:
    """How many of the numbers lie from first up to, but without, end."""
    return F.coalesce(F.size(F.filter(found, lambda i: (i >= first) & (i < end))), F.lit(0))


def ranges(groups: Mapping[str, Sequence[str]]) -> dict[str, tuple[int, int]]:
    """Where each group's terms stand when they are laid end to end."""
    out, at = {}, 0
    for name, terms in groups.items():
        out[name] = (at, at + len(terms))
        at += len(terms)
    return out


def counted(text: Column, rules: Mapping[str, Sequence[str]], body: Callable[[dict[str, Column]], Column]) -> Column:
    """body of how many terms of each name the text contains; the text is searched once."""
    terms = [t for own in rules.values() for t in own]
    if len(terms) < MANY:
        return let(text, lambda x: body({name: hits(x, own) for name, own in rules.items()}))
    at = ranges(rules)
    return let(found_terms(text, terms), lambda found: body({name: within(found, *at[name]) for name in rules}))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text contains one of many terms; null for null."""
    return F.size(found_terms(text, terms)) > 0


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The value of the first rule with a term in the text; a value may have several rules, and the order decides."""
    values = F.array(*[F.lit(value) for value, terms in rules for _ in terms])
    least = F.get(found_terms(text, [t for _, terms in rules for t in terms]), F.lit(0))
    return F.coalesce(F.get(values, least), F.lit(default))


def name_hits(text: Column, entries: Sequence[tuple[str, str, float]]) -> Column:
    """array of struct(name, n, weight) for entries (name, term, weight): names with terms in the text, in their first order, how
    many of a name's terms, and the sum of those terms' weights."""
    names = list(dict.fromkeys(name for name, _, _ in entries))
    number = {name: i for i, name in enumerate(names)}
    of = np.array([number[name] for name, _, _ in entries], np.int64)
    weights = np.array([w for _, _, w in entries], np.float64)
    terms = tuple(term for _, term, _ in entries)

    @F.arrow_udf("array<struct<name:string,n:int,weight:double>>")
    def scored(texts: pa.Array) -> pa.Array:
        find, sizes, flat, n, weight = finder(terms), [0], [], [], []
        for x in texts.to_pylist():
            found = np.array(find(x) if x is not None else [], np.int64)
            own, place = np.unique(of[found], return_inverse=True)
            flat.append(own)
            n.append(np.bincount(place, minlength=len(own)))
            weight.append(np.bincount(place, weights[found], len(own)))
            sizes.append(len(own))
        flat, n, weight = (np.concatenate([np.zeros(0), *x]) for x in (flat, n, weight))
        values = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(flat.astype(np.int64))), pa.array(n.astype(np.int32)), pa.array(weight)], ["name", "n", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), values)

    return scored(text)
