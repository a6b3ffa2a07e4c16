"""Enrichment by a pluggable batch scorer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .dedup import numbered

#: What a scorer adds, and the neutral values of a row that it fails on.
COLUMNS = {"label": ("string", "neutral"), "score": ("double", 0.0), "justification": ("string", "")}


def enrich(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], text: str = "text", key: str = "entry_id", limit: int = 8000) -> DataFrame:
    """Rows of key and the scorer's columns. A scorer takes a frame (key, text) and returns one (key, label, score,
    justification); a batch that it fails on is halved until it fails on single rows alone, which are neutral."""
    kind = df.schema[key].dataType.simpleString()

    def scored(batch: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [scorer(batch)]
        except Exception:
            if len(batch) <= 1:
                return [batch[[key]]]
            half = len(batch) // 2
            return scored(batch.iloc[:half]) + scored(batch.iloc[half:])

    def run(batches):
        for batch in batches:
            out = pd.concat(scored(batch))
            for name, (_, default) in COLUMNS.items():
                out[name] = out[name].where(out[name].notna(), default) if name in out else default
            yield out[[key, *COLUMNS]]

    rows = df.select(key, F.left(F.coalesce(text, F.lit("")), F.lit(limit)).alias("text"))
    return rows.mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} {k}" for n, (k, _) in COLUMNS.items()))


def numbered_batches(df: DataFrame, size: int, order: str = "entry_id") -> DataFrame:
    """df with ``batch`` and ``place``: fixed batches of ``size`` rows (the last may be smaller) in the order of a key."""
    return numbered(df, order).withColumns({"batch": F.expr(f"seq div {size}"), "place": F.col("seq") % size}).drop("seq")


def in_input_order(enriched: DataFrame, df: DataFrame, key: str = "entry_id") -> DataFrame:
    """One row for each row of df, with what an enrichment gave for its key, in the order of the key.

    Rows travel by key, so the order comes back with a range sort at the end, whichever worker took them.
    """
    added = [c for c in enriched.columns if c != key]
    return df.drop(*added).join(enriched, key, "left").orderBy(key)


def rule_enrich(df: DataFrame, positive: list[str], negative: list[str], topics: dict[str, list[str]]) -> DataFrame:
    """The shipped scorer, as expressions alone: label, ministry, topics, action and page type."""
    label = scoring.keyword_label(F.col("text"), positive, negative)
    out = df.withColumns({"label": label, "ministry": scoring.ministry(F.col("text"), topics), "topics": scoring.topics(F.col("text"), topics)})
    score = F.when(F.col("label") == "positive", 0.5).when(F.col("label") == "negative", -0.5).otherwise(0.0)
    return out.withColumns({"score": score, "action": scoring.recommended_action(F.col("label"), score), "page_type": scoring.page_type(F.col("label"))})
