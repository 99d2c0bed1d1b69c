"""From file contents to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Column that holds a line before its carriage return is dropped.
RAW_LINE = "_raw"


def _pieces(content: Column) -> Column:
    return F.split(content, "\n", -1)


def _first_long(pieces: Column, limit: int) -> Column:
    """1-based position of the first line of ``limit`` bytes or more; 0 if there is none."""
    return F.array_position(F.transform(pieces, lambda l: F.octet_length(l) >= limit), True)


def is_truncated(content: Column, limit: int) -> Column:
    """Whether a line is so long that a scan with this ``limit`` leaves out the rest of the content."""
    return F.when(F.octet_length(content) < limit, F.lit(False)) \
        .otherwise(_first_long(_pieces(content), limit) > 0)


def strip_cr(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.left(line, F.char_length(line) - 1)).otherwise(line)


def number_lines(files: DataFrame, *keys: str, content: str = "content", keep: Column | None = None,
                 limit: int | None = None, always: Column | None = None) -> DataFrame:
    """One row ``(*keys, line, text)`` per line, numbered from 1.

    A final newline ends a line and starts none; one trailing carriage return is
    dropped. Lines of any length are kept, unless there is a ``limit``: then one of so many bytes or more and all behind it are left out.
    ``keep`` is a condition on ``RAW_LINE``; it is applied in the same stage as the split,
    so lines without interest are never written anywhere. Contents without a line give no row, but those for which
    ``always`` holds, a condition on the keys, give one with nulls.
    """
    text = F.col(content)
    every = F.col("_all")
    if limit is None:
        short, shown = F.lit(True), every
    else:
        short, stop = F.octet_length(text) < limit, _first_long(every, limit)
        shown = F.when(F.col("_short") | (stop == 0), every).otherwise(F.slice(every, 1, stop.cast("int") - 1))
    lines = (
        files.select(*keys, _pieces(text).alias("_all"), ((text == "") | text.endswith("\n")).alias("_ended"),
                short.alias("_short"))
        # Behind a final newline, and in an empty content, there is one empty piece that is no line.
        .select(*keys, (F.size(every) - F.col("_ended").cast("int")).alias("_count"), shown.alias("_shown"))
        # The outer form keeps the optimizer from inferring size(...) > 0, which would split every content twice.
        .select(*keys, "_count", F.posexplode_outer("_shown").alias("_pos", RAW_LINE))
    )
    raw = F.col(RAW_LINE)
    # Coalesced for the same reason: a plain comparison would make the optimizer test _count before the split.
    wanted = F.coalesce(F.col("_pos") < F.col("_count"), F.lit(False))
    if keep is not None:
        wanted = wanted & keep
    if always is not None:
        wanted = wanted | (F.col("_pos").isNull() & always)
    return lines.where(wanted).select(*keys, (F.col("_pos") + 1).cast("long").alias("line"),
                                      strip_cr(raw).alias("text"))
