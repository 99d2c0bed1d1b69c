"""Values that follow a credential keyword."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from keysweep.fixed_values import (
    COMPOUND_KEYWORDS, GENERIC_KEYWORDS, KEYWORD_TAIL, MIN_VALUE_BYTES, PLACEHOLDERS,
)
from keysweep.functions.regex import to_java

KEYWORDS = COMPOUND_KEYWORDS + GENERIC_KEYWORDS


def keyword_pattern(keyword: str) -> str:
    """Pattern of one keyword, in the rule dialect."""
    return r"(?i)\b" + re.sub(r"([^A-Za-z0-9_])", r"\\\1", keyword) + r"\b" + KEYWORD_TAIL


def is_secret_value(value: Column) -> Column:
    upper = F.upper(value)
    placeholder = reduce(lambda a, b: a | b, [upper.contains(word) for word in PLACEHOLDERS])
    return (
        (F.octet_length(value) >= MIN_VALUE_BYTES)
        & ~placeholder
        & value.rlike("[A-Za-z]")
        & value.rlike("[0-9]")
    )


def keyword_values(line: Column) -> Column:
    """Distinct valid values of all keywords.

    One extraction per keyword: values may overlap between keywords, which a
    single alternation would lose.
    """
    found = [F.regexp_extract_all(line, F.lit(to_java(keyword_pattern(k))), F.lit(1)) for k in KEYWORDS]
    return F.array_distinct(F.filter(F.flatten(F.array(*found)), is_secret_value))
