"""Redaction of secrets for reports. All lengths are in bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from keysweep.fixed_values import VISIBLE_PREFIXES

_LOST = "\ufffd"  # stands for one byte of a character that the cut went through


def _cut(text: Column, count: int, take, lost_first: bool) -> Column:
    fits = F.filter(F.sequence(F.lit(0), F.lit(count)), lambda n: F.octet_length(take(text, n)) <= count)
    whole = take(text, F.array_max(fits))
    lost = F.repeat(F.lit(_LOST), F.lit(count) - F.octet_length(whole))
    whole = F.concat(lost, whole) if lost_first else F.concat(whole, lost)
    return F.when(F.octet_length(text) == F.char_length(text), take(text, F.lit(count))).otherwise(whole)


def first_bytes(text: Column, count: int) -> Column:
    """First ``count`` bytes of a text that has at least as many."""
    return _cut(text, count, F.left, lost_first=False)


def last_bytes(text: Column, count: int) -> Column:
    return _cut(text, count, F.right, lost_first=True)


def secret_prefix(text: Column) -> Column:
    return F.regexp_extract(text, r"\A(" + "|".join(re.escape(p) for p in VISIBLE_PREFIXES) + ")", 1)


def redact_multiline(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    count = F.size(lines)
    shown = F.transform(
        lines,
        lambda line, i: F.when(i == 0, F.when(F.octet_length(line) > 20, F.concat(first_bytes(line, 20), F.lit("...")))
                               .otherwise(line))
        .when(i == count - 1, F.when(F.octet_length(line) > 20, F.concat(F.lit("..."), last_bytes(line, 20)))
              .otherwise(line))
        .otherwise(F.lit("    *****")),
    )
    return F.when(count <= 2, F.lit("*" * 20 + " (multiline)")).otherwise(F.array_join(shown, "\n"))


def redact(text: Column) -> Column:
    size = F.octet_length(text)
    prefix = secret_prefix(text)
    # Prefixes are ASCII: their characters are their bytes.
    rest = F.substring(text, F.char_length(prefix) + 1, F.char_length(text))
    left_over = size - F.char_length(prefix)

    def ends(keep: int) -> Column:
        return F.when(left_over < 2 * keep + 3, F.concat(prefix, F.lit("****"))).otherwise(
            F.concat(prefix, first_bytes(rest, keep), F.lit("..."), last_bytes(rest, keep)))

    return (
        F.when(size <= 8, F.repeat(F.lit("*"), size))
        .when(text.contains("\n"), redact_multiline(text))
        .when(size == 9, ends(2))
        .otherwise(ends(4))
    )


def is_fully_masked(text: Column) -> Column:
    return text.rlike(r"\A[* .\-]*\z")
