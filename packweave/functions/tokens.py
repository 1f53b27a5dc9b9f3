"""Tokens as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EOS_ID

#: Ids below 14 stay free for padding, begin, end and newline.
FIRST_WORD_ID = 14
WORD_IDS = 31986


def words(text: Column) -> Column:
    """Non-empty words between blanks, tabs and line ends; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \t\r\n]+"), lambda w: w != "")


def word_id(word: Column) -> Column:
    """A fixed id of a word in FIRST_WORD_ID .. FIRST_WORD_ID + WORD_IDS - 1, from its md5."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % WORD_IDS + FIRST_WORD_ID).cast("int")


def hash_tokens(text: Column) -> Column:
    return F.transform(words(text), word_id)


def with_eos(tokens: Column) -> Column:
    """``tokens`` (null: none) and one end mark."""
    return F.concat(F.coalesce(tokens, F.array().cast("array<int>")), F.array(F.lit(EOS_ID)))


def joined(ids: Column) -> Column:
    """Ids as one comma-separated string, for stable comparison."""
    return F.array_join(ids.cast("array<string>"), ",")


def eos_count(ids: Column) -> Column:
    return F.size(F.filter(ids, lambda x: x == EOS_ID))


def order_key(seed: int, *keys: Column) -> Column:
    """The key of a fixed pseudo-random order: md5 of seed and keys, written with dashes between."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def round_half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


@F.pandas_udf(T.ArrayType(T.StructType().add("token", T.IntegerType()).add("cnt", T.LongType())))
def id_counts(ids: pd.Series) -> pd.Series:
    """How often each id stands in a row's array, ids in rising order; null: none."""
    out = []
    for x in ids:
        token, cnt = np.unique(x if x is not None else np.zeros(0, np.int32), return_counts=True)
        out.append([{"token": t, "cnt": c} for t, c in zip(token.tolist(), cnt.tolist(), strict=True)])
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def running_sums(numbers: pd.Series) -> pd.Series:
    """The sums of each array up to every place; null: null."""
    return pd.Series([None if x is None else np.cumsum(x, dtype=np.int32) for x in numbers])
