"""Coercions of text to numbers that never fail."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ["", "none", "null", "nan"]


def safe_double(text: Column) -> Column:
    """A double, or null for a missing or unreadable value."""
    return F.when(~F.lower(F.trim(text)).isin(MISSING), F.trim(text).try_cast("double"))


def safe_long(text: Column) -> Column:
    """A long by way of a double, cut towards zero."""
    return safe_double(text).try_cast("bigint")


def count_or_zero(text: Column) -> Column:
    return F.coalesce(safe_long(text), F.lit(0).cast("bigint"))


def ordered_bits(value: Column) -> Column:
    """A positive number as the integer of its double's bits, which has the same order; null for null."""

    @F.arrow_udf("bigint")
    def bits(values: pa.Array) -> pa.Array:
        return pa.array(values.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64), mask=values.is_null().to_numpy(zero_copy_only=False))

    return bits(value.cast("double"))


def value_of_bits(bits: Column) -> Column:
    """The double that ordered_bits() made the integer of."""

    @F.arrow_udf("double")
    def value(numbers: pa.Array) -> pa.Array:
        return pa.array(numbers.fill_null(0).to_numpy(zero_copy_only=False).view(np.float64), mask=numbers.is_null().to_numpy(zero_copy_only=False))

    return value(bits)
