"""Column expressions for cleaning, flags, ratios and entropy. All stay in the JVM but for the vectorised entropy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(c: Column) -> Column:
    """As a double; what isn't a number, and NaN, is null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def text(c: Column, tokens: Sequence[str]) -> Column:
    """Null where the field holds one of the tokens that stand for no value."""
    return F.when(~c.isin(*tokens), c)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is null."""
    return F.when(condition, 1).otherwise(0)


def true_flag(c: Column) -> Column:
    """1 for the texts T and true, else 0."""
    return flag(c.isin("T", "true"))


def other(c: Column, values: Sequence[str]) -> Column:
    return flag(c.isNotNull() & ~c.isin(*values))


def ordinal(c: Column, values: Sequence[str]) -> Column:
    """The value's place in the list; null if it isn't there."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in enumerate(values) for x in (v, float(k)))), c)


def z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def at_least(c: Column, low: float) -> Column:
    """The larger of both; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def log_of(c: Column) -> Column:
    return F.log1p(at_least(c, 0.0))


def filled(c: Column) -> Column:
    """Missing values, NaN included, as -1."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(-1.0))


def first_of(c: Column, is_array: bool) -> Column:
    """First element of a list, or of a text with commas; null if there is none."""
    return F.get(c if is_array else F.split(c, ","), F.lit(0))


def has_items(c: Column, is_array: bool) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False)) if is_array else c.isNotNull()


def rounded_half_up(c: Column, digits: int) -> Column:
    """c rounded to digits, halves away from 0, without a negative 0. In doubles throughout, as DuckDB's round does it, and without a decimal per value."""
    scale = float(10**digits)
    size = F.abs(c) * scale
    near = F.rint(size)
    return F.signum(c) * (near + F.when(size - near == 0.5, 1.0).otherwise(0.0)) / scale + 0.0


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of a text's characters; null for an empty or null text. For short texts, such as log fields.

    Each different character is counted by what the text loses without it: its characters are neither sorted nor told apart one by one.
    """
    size = F.length(c)
    counts = F.transform(F.array_distinct(F.split(c, "")), lambda x: (size - F.length(F.replace(c, x))).cast("double"))
    n = size.cast("double")
    return F.when(size > 0, F.log2(n) - F.aggregate(counts, F.lit(0.0), lambda total, k: total + k * F.log2(k)) / n)


@F.pandas_udf(T.DoubleType())
def long_text_entropy(texts: pd.Series) -> pd.Series:
    """The same for texts of any length: characters of the whole batch are counted together."""
    filled = texts.fillna("")
    size = filled.str.len().to_numpy()
    codes = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    pairs, counts = np.unique(row * 0x110000 + codes, return_counts=True)
    weighted = np.bincount(pairs // 0x110000, counts * np.log2(counts), len(size))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.log2(size) - weighted / size
    return pd.Series(np.where(size > 0, value, np.nan))
