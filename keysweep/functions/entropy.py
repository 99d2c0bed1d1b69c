"""Long-token detection by Shannon entropy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keysweep.fixed_values import (
    ENTROPY_BOUND, MAX_REPEAT_RUN, MIN_TOKEN_LENGTH, NOISE_PREFIX, NOISE_WORDS, TOKEN_ALPHABET,
)

# Single characters rather than ranges: Java then tests one bit set per character.
TOKEN_CLASS = "[" + TOKEN_ALPHABET.replace("-", r"\-") + "]"


def long_tokens(line: Column) -> Column:
    """All runs of token characters that are long enough, in order."""
    return F.regexp_extract_all(line, F.lit(f"({TOKEN_CLASS}{{{MIN_TOKEN_LENGTH},}})"), F.lit(1))


def has_repeat_run(text: Column) -> Column:
    return text.rlike(rf"(?s)(.)\1{{{MAX_REPEAT_RUN}}}")


def is_noise(token: Column) -> Column:
    low = F.lower(token)
    hit = low.startswith(NOISE_PREFIX)
    for word in NOISE_WORDS:
        hit = hit | low.contains(word)
    return hit | has_repeat_run(token)


def _of_counts(counts: Column, text: Column) -> Column:
    total = F.octet_length(text)
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - n / total * F.log2(n / total))


def shannon_entropy(text: Column) -> Column:
    """Bits per byte over the characters of any text; 0 for the empty text.

    Its sorted characters are cut into runs of equal ones, so the time does not depend on how many different ones there are.
    """
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    return _of_counts(F.transform(F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.char_length), text)


def _alphabet() -> Column:
    return F.split(F.lit(TOKEN_ALPHABET), "")


def token_entropy(token: Column) -> Column:
    """Same value for text of token characters only: their alphabet is known."""
    # A character is counted by deleting it, so a token never becomes an array of its characters.
    counts = F.transform(_alphabet(), lambda c: F.octet_length(token) - F.octet_length(F.replace(token, c, F.lit(""))))
    return _of_counts(F.filter(counts, lambda n: n > 0), token)


def _may_exceed(token: Column, bound: float) -> Column:
    """Entropy is at most log2 of the number of different characters."""
    return F.size(F.filter(_alphabet(), lambda c: token.contains(c))) > int(2 ** bound)


def high_entropy_tokens(line: Column) -> Column:
    return F.filter(
        long_tokens(line),
        lambda t: _may_exceed(t, ENTROPY_BOUND) & ~is_noise(t) & (token_entropy(t) > ENTROPY_BOUND),
    )
