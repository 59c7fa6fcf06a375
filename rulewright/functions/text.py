"""Text functions that Spark lacks, as vectorised UDFs. Call them on distinct keys, and only where they are needed."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalise_unicode(text: Column) -> Column:
    """NFKC; rows of ASCII text don't leave the JVM's value unchanged, so the UDF's result is only taken for others."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), _nfkc(text)).otherwise(text)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts, in this order."""
    return _ratio(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of sequence_ratio by lengths alone, for a filter before it."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


_OFTEN = " _etaoinsrhldcumfpgwybvkxjqz"


@F.pandas_udf(ArrayType(StringType()))
def _char_tokens(texts: pd.Series) -> pd.Series:
    def tokens(text: str | None) -> list[str] | None:
        if text is None:
            return None
        found = [(-n, -_OFTEN.find(c) if c in _OFTEN else -len(_OFTEN), c) for c, many in Counter(text).items() for n in range(1, many + 1)]
        return [f"{c}{-n}" for n, _, c in sorted(found)]

    return texts.map(tokens)


def char_tokens(text: Column) -> Column:
    """One token for each character of a text: the character and which of its occurrences it is. Later occurrences and rarer characters come first, in the same order for all texts."""
    return _char_tokens(text)
