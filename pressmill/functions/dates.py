"""Dates in the formats that sources write."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .date_text import parse_text
from .terms import let


@dataclass(frozen=True)
class Format:
    """A shape (regular expression) that claims a text, what of it is read (a replacement for the shape), and the patterns to
    read it by, without any as ISO.  A text that a strict format claims and can't read is null; else later formats are tried."""

    shape: str
    take: str
    patterns: tuple[str, ...]
    strict: bool = True


DAY, CLOCK = r"(\d{4}-\d{2}-\d{2})", r"(\d{2}:\d{2}:\d{2})"
#: Offsets and names of zones are left out of what is read: zones are dropped, not converted.
FORMATS = (
    Format(rf"^[A-Za-z]{{3}}\s+([A-Za-z]{{3}})\s+(\d{{1,2}})\s+{CLOCK}\s+\+0000\s+(\d{{4}})$", "$1 $2 $4 $3", ("MMM d yyyy HH:mm:ss",)),
    Format(rf"^[A-Za-z]{{3}}\s+[A-Za-z]{{3}}\s+\d{{1,2}}\s+{CLOCK}\s+\+\d{{4}}\s+\d{{4}}.*$", "", ()),
    Format(rf"^{DAY}\s+{CLOCK}\s+\+\d{{5}}.*$", "$1 $2", ()),
    Format(rf"^{DAY}T(\d{{2}}:\d{{2}})(Z|\+\d{{2}}:?\d{{2}})$", "$1 $2", ()),
    Format(rf"^{DAY}T{CLOCK}(\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:?\d{{2}})$", "$1 $2$3", ()),
    Format(r"^(\d{2}:\d{2})\s+(\d{2})\s+([A-Za-z]{3})\s+(\d{4})$", "$4 $3 $2 $1", ("yyyy MMM dd HH:mm",)),
    Format(rf"^{DAY}\s+{CLOCK}.*$", "$0", ("yyyy-MM-dd HH:mm:ss",)),
    Format(r"^(\d{2}/\d{2}/\d{4}),\s+(\d{1,2}:\d{2})\s+(AM|PM),\s+\+0000\s+UTC$", "$1 $2 $3", ("dd/MM/yyyy h:mm a",), False),
    # the general ones: ISO, mail and feed dates, and dates with names of months
    Format(rf"^{DAY}(?:[T ](\d{{2}}:\d{{2}}(?::\d{{2}})?)(\.\d{{1,6}})?)?$", "$1 $2$3", (), False),
    Format(rf"^(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})\s+([A-Za-z]{{3}})[a-z]*\.?,?\s+(\d{{4}})(?:\s+{CLOCK})?(?:\s+(?:[A-Z]{{1,5}}|[+-]\d{{4}}))?$", "$1 $2 $3 $4", ("d MMM yyyy[ HH:mm:ss]",), False),
    Format(rf"^(?:[A-Za-z]{{3,9}},?\s+)?([A-Za-z]{{3}})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{CLOCK})?$", "$2 $1 $3 $4", ("d MMM yyyy[ HH:mm:ss]",), False),
    Format(rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:\s+{CLOCK})?$", "$1/$2/$3 $4", ("yyyy/M/d[ HH:mm:ss]",), False),
    Format(rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:\s+{CLOCK})?$", "$1/$2/$3 $4", ("M/d/yyyy[ HH:mm:ss]", "d/M/yyyy[ HH:mm:ss]"), False),
)
#: Texts that are no date.
NOTHING = ["none", "nan", "", "unknown"]


def general_date(text: Column, default: str) -> Column:
    """A zoneless timestamp from a text in no fixed format (see date_text); missing parts are those of the default, an ISO date."""
    start = datetime.fromisoformat(default).replace(hour=0, minute=0, second=0, microsecond=0)

    @F.arrow_udf("timestamp_ntz")
    def read(texts: pa.Array) -> pa.Array:
        known = lru_cache(maxsize=4096)(lambda x: parse_text(x, start))  # days repeat
        return pa.array([known(x) if x is not None else None for x in texts.to_pylist()], pa.timestamp("us"))

    return read(text)


def parse_date(text: Column, formats: tuple[Format, ...] = FORMATS, default: str | None = None) -> Column:
    """A zoneless timestamp from the first format that fits, else null; a zone is dropped, not converted.

    A text is classified once: the number of the strict format that claims it, or else those of the others whose shape it has;
    shapes and patterns are then looked up by number.  With a ``default`` date, texts that no format reads and no strict one claims are read by
    general_date().
    """
    low = F.trim(text)
    usable = F.when(~F.lower(low).isin(NOTHING), low)
    strict = F.coalesce(*[F.when(usable.rlike(f.shape), F.array(F.lit(i))) for i, f in enumerate(formats) if f.strict])
    others = F.array_compact(F.array(*[F.when(usable.rlike(f.shape), F.lit(i)) for i, f in enumerate(formats) if not f.strict]))
    shapes, takes = F.array(*[F.lit(f.shape) for f in formats]), F.array(*[F.lit(f.take) for f in formats])
    patterns = F.array(*[F.array(*[F.lit(p) for p in f.patterns]).cast("array<string>") for f in formats])

    def reads(t: Column, i: Column) -> Column:
        taken = F.rtrim(F.regexp_replace(t, F.get(shapes, i), F.get(takes, i)))
        by = F.get(patterns, i)
        read = F.filter(F.transform(by, lambda p: F.try_to_timestamp(taken, p).cast("timestamp_ntz")), lambda x: x.isNotNull())
        return F.when(F.size(by) > 0, F.get(read, F.lit(0))).otherwise(taken.try_cast("timestamp_ntz"))

    def first(x: Column) -> Column:
        return F.get(F.filter(F.transform(x["numbers"], lambda i: reads(x["t"], i)), lambda v: v.isNotNull()), F.lit(0))

    out = let(F.struct(usable.alias("t"), F.coalesce(strict, others).alias("numbers")), first)
    if default is None:
        return out
    return F.coalesce(out, general_date(F.when(strict.isNull(), usable), default))  # no lambda in what Python gets


def lookback_start(last: Column, as_of: Column, default_days: int = 7, most_days: int = 30, overlap_hours: int = 2) -> Column:
    """Where the next collection starts: the last one less an overlap, not too far back; without a last one, some days ago."""
    floor = as_of - F.expr(f"interval {most_days} days")
    return F.when(last.isNull(), as_of - F.expr(f"interval {default_days} days")).otherwise(F.greatest(last - F.expr(f"interval {overlap_hours} hours"), floor))
