"""Figures over mentions: sentiment, regions, engagement, sources, issues, and changes between periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import settled_label
from ..functions.values import ordered_bits, value_of_bits
from ..sources.stored import stored

LABELS = ["positive", "negative", "neutral"]


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 6)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _counts(label: Column | None = None) -> list[Column]:
    label = settled_label(F.col("sentiment_label")) if label is None else label
    return [F.count("*").alias("total"), *[F.count_if(label == x).alias(x) for x in LABELS]]


def sentiment_split(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of the labels (null and others are neutral) and score, the balance in percent."""
    out = df.groupBy(*by).agg(*_counts())
    return out.select("*", *[percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in LABELS], percent(F.col("positive") - F.col("negative"), F.col("total")).alias("score"))


def sentiment_splits(df: DataFrame, as_of: str, days: Sequence[int] = (7, 30, 365), by: str = "ministry_hint", ts: str = "published_at") -> DataFrame:
    """sentiment_split() for trailing ranges, by a group and over all (group 'all'), in one pass over the rows."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = df.where((F.col(ts) <= end) & (F.col(ts) >= end - F.expr(f"interval {max(days)} days")))
    ranges = F.array_compact(F.array(*[F.when(F.col(ts) >= end - F.expr(f"interval {d} days"), d) for d in days]))
    each = recent.withColumn("days", F.explode(ranges)).withColumn("grp", F.explode(F.array(F.lit("all"), F.coalesce(by, F.lit("none")))))
    return sentiment_split(each, ["days", "grp"])


def regional(df: DataFrame, location: str = "user_location") -> DataFrame:
    """By location: counts, mean score times 100 rounded half up over rows with a score."""
    return df.where(F.col(location).isNotNull()).groupBy(location).agg(*_counts(), half_up(F.avg("sentiment_score") * 100).alias("avg_score"))


def leading_regions(df: DataFrame, label: str, most: int = 5, location: str = "user_location") -> DataFrame:
    share = F.round(F.col(label) / F.col("total"), 6)
    return regional(df, location).select(location, "total", label, share.alias("ratio")).orderBy(F.desc("ratio"), F.desc("total"), location).limit(most)


def location_labels(df: DataFrame, location: str = "user_location") -> DataFrame:
    """location x label counts with the share of all located rows."""
    counts = df.where(F.col(location).isNotNull()).groupBy(location, settled_label(F.col("sentiment_label")).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), counts.agg(F.sum("n")).scalar()))


def engagement(df: DataFrame) -> DataFrame:
    out = df.groupBy(F.lower(F.coalesce("platform", F.lit("unknown"))).alias("platform"))
    return out.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("likes", "retweets", "comments", "direct_reach")])


#: Bits of an ordered key that a pass of positional() looks at.
DIGIT = 16


def positional(df: DataFrame, value: str, by: Sequence[str], places: Mapping[str, str], descending: bool = False) -> DataFrame:
    """Values at places of the sorted positives, a place being SQL over n, from 0; exact, however many values a group has.

    Values become integers of the same order.  A pass counts a group's rows by the next digit (of ``DIGIT`` bits) of those that
    agree with what earlier passes have settled, and so settles one digit more of each place; no task sorts a group, and none holds more than
    the counts of a digit.  Digits that are zero throughout are left out.
    """
    kind = dict(df.dtypes)[value]
    exact = kind in ("tinyint", "smallint", "int", "bigint")
    rows = df.where(F.col(value) > 0).select(*by, (F.col(value).cast("long") if exact else ordered_bits(F.col(value))).alias("_k"))
    most = rows.agg(F.max("_k")).first()[0] or 0
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    rank = {name: f"n - 1 - ({place})" if descending else place for name, place in places.items()}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.expr(r).cast("long").alias("_rank")) for name, r in rank.items()])).alias("x")
    settled = sizes.select(*by, each).select(*by, "x._name", "x._rank", F.lit(0).cast("long").alias("_prefix")).where("_rank >= 0")
    first = settled
    for shift in range((max(most, 1).bit_length() - 1) // DIGIT * DIGIT, -1, -DIGIT):
        s = settled.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_name", "_rank", "_prefix")
        on = F.shiftright("_k", shift + DIGIT) == F.col("_prefix") if shift + DIGIT < 63 else F.col("_prefix") == 0
        for i, c in enumerate(by):
            on &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
        near = rows if settled is first else rows.join(s.drop("_name", "_rank").distinct(), on, "left_semi")
        counts = near.groupBy(*by, F.shiftright("_k", shift).alias("_next")).agg(F.count("*").alias("_c"))
        counts = counts.withColumn("_k", F.shiftleft("_next", shift)).join(s, on).select(*by, "_name", "_rank", "_next", "_c")
        upto = F.sum("_c").over(Window.partitionBy(*by, "_name").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0))
        found = counts.withColumn("_upto", upto).where("_upto > _rank and _upto - _c <= _rank")
        settled = found.select(*by, "_name", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), F.col("_next").alias("_prefix"))
    found = F.col("_prefix").cast(kind) if exact else value_of_bits(F.col("_prefix")).cast(kind)
    settled = settled.withColumn("_value", found)
    return settled.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in places])


def value_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """min, max, upper median and mean rounded half up of the positives."""
    basic = df.where(F.col(value) > 0).groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), half_up(F.avg(value)).alias("mean"))
    return basic.join(positional(df, value, by, {"median": "n div 2"}), list(by))


def descending_percentiles(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return positional(df, value, by, {"p50": "n div 2", "p75": "n div 4", "p90": "n div 10"}, descending=True)


def viral(df: DataFrame, by: Sequence[str], engagement_over: float = 50, reach_over: float = 5000) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if((F.col("engagement") > engagement_over) | (F.col("reach") > reach_over)).alias("viral"), F.count("*").alias("n"))


def field_coverage(df: DataFrame, one: str = "issue_label", two: str = "issue_slug") -> DataFrame:
    has_one, has_two = F.col(one).isNotNull(), F.col(two).isNotNull()
    return df.agg(
        F.count("*").alias("total"), F.count_if(has_one).alias("with_label"), F.count_if(has_two).alias("with_slug"), F.count_if(has_one & has_two).alias("both"),
        F.count_if(has_one & ~has_two).alias("label_only"), F.count_if(~has_one & has_two).alias("slug_only"), F.count_if(~has_one & ~has_two).alias("neither"),
    )


def confidence_bands(df: DataFrame, column: str = "issue_confidence") -> DataFrame:
    c = F.col(column)
    return df.where(c.isNotNull()).agg(
        F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c), 6).alias("least"), F.round(F.max(c), 6).alias("most"),
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"),
    )


def issue_counts(df: DataFrame, ts: str = "published_at") -> DataFrame:
    return df.where("issue_slug is not null").groupBy("issue_slug", "issue_label", "ministry_hint").agg(F.count("*").alias("n"), F.round(F.avg("sentiment_score"), 6).alias("avg_score"), F.max(ts).alias("latest"))


def share_of_total(df: DataFrame, by: str, missing: str = "NULL") -> DataFrame:
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit(missing)).alias(by)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), counts.agg(F.sum("n")).scalar()))


def unlabelled_queries(df: DataFrame, by: str = "query") -> DataFrame:
    return df.where(F.col("ministry_hint").isNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("sentiment_label").isNull()).alias("unscored"))


def code_audit(df: DataFrame, mapping: DataFrame, code: str = "ministry_hint") -> DataFrame:
    """Rows by code, with the current name where a mapping (code, name) knows it."""
    counts = df.groupBy(code).agg(F.count("*").alias("n"))
    known = mapping.select(F.col("code").alias(code), "name")
    return counts.join(known, code, "left").select(code, "n", F.coalesce("name", F.lit("unmapped")).alias("name"))


def summary(
    df: DataFrame, dimensions: Sequence[str], sums: Sequence[str] = (), time: str | None = None, latest: int = 1000, order: Sequence[str] = ("published_at", "entry_id"), top: int = 10
) -> DataFrame:
    """(dimension, value, n) of the latest rows of a selection: counters of the top values of each dimension, then under
    ``engagement`` the sum of each column of ``sums`` and the rows with any, and under ``span`` the days of the first and last time."""
    used = [*dict.fromkeys([*dimensions, *sums, *([time] if time else [])])]
    rows = stored(df.orderBy(*[F.desc(c) for c in order]).limit(latest).select(*used))  # read three times
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("NULL")).alias("value")) for d in dimensions]))
    counts = rows.select(each.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    out = counts.withColumn("_r", rank).where(f"_r <= {top}").drop("_r")
    if sums:
        any_ = F.lit(False)
        for c in sums:
            any_ = any_ | (F.coalesce(F.col(c), F.lit(0)) > 0)
        totals = {c: F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in sums} | {"rows with any": F.count_if(any_)}
        wide = rows.agg(F.array(*[F.struct(F.lit("engagement").alias("dimension"), F.lit(c).alias("value"), v.alias("n")) for c, v in totals.items()]).alias("x"))
        out = out.unionByName(wide.select(F.inline("x")))
    if time:
        ends = rows.agg(F.array(*[F.struct(F.lit("span").alias("dimension"), F.lit(n).alias("value"), F.unix_date(f(F.col(time)).cast("date")).cast("long").alias("n")) for n, f in (("first day", F.min), ("last day", F.max))]).alias("x"))
        out = out.unionByName(ends.select(F.inline("x")))
    return out


def fill_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in columns])
    return out.select(*by, "n", *[F.col(c).alias(f"{c}_n") for c in columns], *[percent(F.col(c), F.col("n")).alias(f"{c}_pct") for c in columns])


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(*_counts(), F.count_if((F.col("sentiment_label") == "negative") & (F.col("sentiment_score") < -0.8)).alias("high_priority"))


def source_labels(df: DataFrame, source: str = "platform") -> DataFrame:
    out = df.groupBy(source).pivot("sentiment_label", LABELS).agg(F.count(F.lit(1)))
    return out.na.fill(0, LABELS)


def supportive_sources(df: DataFrame, source: str = "platform") -> DataFrame:
    return source_labels(df, source).where("positive > negative").select(source, "positive", "negative")


def top_values(df: DataFrame, column: Column, most: int, name: str = "topic") -> DataFrame:
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(most)


def high_impact(df: DataFrame, below: float = -0.2) -> DataFrame:
    return df.where((F.col("sentiment_label") == "negative") & (F.col("sentiment_score") < below))


def report(df: DataFrame) -> DataFrame:
    """Mean score, counts (neutral is the rest) and shares."""
    out = df.agg(F.count("*").alias("total"), F.round(F.avg("sentiment_score"), 6).alias("overall"), *[F.count_if(F.col("sentiment_label") == x).alias(x) for x in LABELS[:2]])
    out = out.withColumn("neutral", F.greatest(F.lit(0), F.col("total") - F.col("positive") - F.col("negative")))
    return out.select("*", *[percent(F.col(x), F.col("total")).alias(f"{x}_pct") for x in LABELS])


def topic_counts(df: DataFrame, keywords: Column, edge: float = 0.2) -> DataFrame:
    """Keywords of rows with a score beyond the edges: topic, positive, negative."""
    rows = df.where(F.abs("sentiment_score") > edge).select("sentiment_score", F.explode(keywords).alias("topic"))
    return rows.groupBy("topic").agg(F.count_if(F.col("sentiment_score") > edge).alias("positive"), F.count_if(F.col("sentiment_score") < -edge).alias("negative"))


def source_means(df: DataFrame, source: str = "platform") -> DataFrame:
    return df.where("sentiment_score is not null").groupBy(source).agg(F.round(F.avg("sentiment_score"), 6).alias("mean"), F.count("*").alias("n"))


def sentiment_change(df: DataFrame, period: str, threshold: float = 0.1) -> DataFrame:
    """Change between the rows of period 'current' and 'previous', in one pass: of the mean score and of the shares."""
    def side(name: str, value: Column) -> Column:
        return F.avg(F.when(F.col(period) == name, value))

    change = side("current", F.col("sentiment_score")) - side("previous", F.col("sentiment_score"))
    shares = [
        F.round(100 * (side("current", (F.col("sentiment_label") == x).cast("double")) - side("previous", (F.col("sentiment_label") == x).cast("double"))), 6).alias(f"{x}_change")
        for x in LABELS[:2]
    ]
    out = df.agg(F.round(change, 6).alias("sentiment_change"), *shares)
    return out.withColumns({"neutral_change": F.round(-F.col("positive_change") - F.col("negative_change"), 6), "sentiment_changed": F.abs("sentiment_change") >= threshold})


def topic_shift(df: DataFrame, period: str, keywords: Column) -> DataFrame:
    """New topics (three times or more now, never before) and fading ones (three times or more before, gone or less than halved)."""
    counts = df.select(F.col(period).alias("p"), F.explode(keywords).alias("topic")).groupBy("topic").agg(
        F.count_if(F.col("p") == "current").alias("current_count"), F.count_if(F.col("p") == "previous").alias("previous_count"))
    shift = F.when((F.col("current_count") >= 3) & (F.col("previous_count") == 0), "new").when((F.col("previous_count") >= 3) & (F.col("current_count") < 0.5 * F.col("previous_count")), "fading")
    return counts.withColumn("shift", shift).where("shift is not null")


def dataset_stats(df: DataFrame, ts: str = "published_at") -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.length(F.trim("sentiment_justification")) > 0).alias("enriched"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"),
    )


def label_transitions(df: DataFrame, old: str, new: str, confidence: str) -> DataFrame:
    pair = F.concat(F.coalesce(old, F.lit("None")), F.lit(" -> "), F.coalesce(new, F.lit("None")))
    return df.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(pair.alias("change")).agg(
        F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean"), F.count_if(F.col(confidence) >= 0.7).alias("high"),
        F.count_if((F.col(confidence) >= 0.4) & (F.col(confidence) < 0.7)).alias("medium"), F.count_if(F.col(confidence) < 0.4).alias("low"),
    )


def evaluate(df: DataFrame, expected: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count("*").alias("n")).withColumn("match", F.col("expected").eqNullSafe(F.col("actual")))
