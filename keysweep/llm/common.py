"""Small helpers that several operators of this package use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keysweep.plans.store import size_in_bytes

#: Sides of at most so many bytes, as measured, are broadcast; larger ones are shuffled.
SMALL_BYTES = 16 << 20


def semi_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left_semi",
              small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Join with a stored table, which is broadcast if its measured size allows."""
    if size_in_bytes(right) <= small_bytes:
        right = F.broadcast(right)
    return left.join(right, on, how)


def unused(columns: list[str], name: str) -> str:
    """``name`` with underscores before it until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Codes(dict):
    """Numbers of words, each computed once per worker; emptied when ``limit`` words are held, so memory stays bounded."""

    def __init__(self, code, limit: int = 1 << 19):
        super().__init__()
        self.code, self.limit = code, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = self.code(word)
        return out
