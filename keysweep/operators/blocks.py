"""Secrets of several lines between a begin and an end marker, such as private keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysweep.fixed_values import BLOCK_LABEL, BLOCK_TYPE
from keysweep.operators.intervals import with_next
from keysweep.operators.lines import RAW_LINE, number_lines
from keysweep.plans.skew import skew_join
from keysweep.plans.store import stored

_MARKER = rf"-----(BEGIN|END) ({BLOCK_LABEL})-----"
# Between the markers of one line there is no other marker. Possessive, so that long lines need no stack.
_INLINE = rf"-----BEGIN ({BLOCK_LABEL})-----(?:[^-]++|-(?!----(?:BEGIN|END) {BLOCK_LABEL}-----))*+-----END \1-----"


def _marker(kind: str, label: Column) -> Column:
    return F.concat(F.lit(f"-----{kind} "), label, F.lit("-----"))


def multiline_secrets(pieces: DataFrame) -> DataFrame:
    """``(file, line, last_line, type, match)`` of all blocks in ``pieces (file, first_line, content)``.

    A file is one piece or several that end at line ends, each with the number of its first line. A block goes from a begin marker to the next
    marker of the file, if that ends the same label; ``match`` is all between and the markers. So of nested blocks the innermost counts, a begin
    marker without an end gives none, and neither does an end marker without a beginning. Blocks may lie in one line, and lines may hold several.
    A null ``content`` has no lines. A piece without ``first_line`` is left out, as its lines cannot be ordered.

    Only lines with a marker are paired, in buckets of line numbers, and only contents of files with blocks are joined to them.
    """
    given = pieces.where(F.col("first_line").isNotNull()).select("file", F.col("first_line").cast("long").alias("first_line"), "content")
    lines = number_lines(given, "file", "first_line", keep=F.col(RAW_LINE).contains("-----") & F.col(RAW_LINE).rlike(_MARKER))
    lines = lines.select("file", (F.col("first_line") + F.col("line") - 1).alias("line"), "text")
    marks = F.regexp_extract_all("text", F.lit(_MARKER), F.lit(0))
    inline = F.regexp_extract_all("text", F.lit(_INLINE), F.lit(0))
    lines = stored(lines.select("file", "line", "text", marks.alias("marks"), inline.alias("inline")))

    one = lines.select("file", "line", F.explode("inline").alias("match")).select("file", "line", F.col("line").alias("last_line"), "match")

    # What a line leaves open, and what it ends without having begun it.
    opened, closed = F.element_at("marks", -1), F.element_at("marks", 1)
    ends = lines.select(
        "file", "line", F.when(opened.startswith("-----BEGIN"), F.regexp_extract(opened, _MARKER, 2)).alias("opened"),
        F.when(closed.startswith("-----END"), F.regexp_extract(closed, _MARKER, 2)).alias("closed"))
    ends = stored(ends)
    following = with_next(ends, ["file"], "line", "last_line").where("opened IS NOT NULL AND last_line IS NOT NULL").select("file", "line", "opened", "last_line")
    closing = ends.where("closed IS NOT NULL").select("file", F.col("line").alias("last_line"), F.col("closed").alias("opened"))
    blocks = stored(following.join(closing, ["file", "last_line", "opened"]))

    # The lines of a block from the pieces that it lies in.
    # Behind a final newline there is one empty string that is no line.
    cut = given.select("file", "first_line", F.split("content", "\n", -1).alias("lines"), F.col("content").endswith("\n").cast("int").alias("ended"))
    held = skew_join(blocks, cut, "file")
    low = F.greatest(F.col("line") - F.col("first_line"), F.lit(0))
    count = F.least(F.col("last_line") - F.col("first_line") + 1, F.size("lines") - F.col("ended")) - low
    held = held.where((F.col("first_line") <= F.col("last_line")) & (count > 0)) \
        .select("file", "line", "last_line", "opened", F.struct("first_line", F.slice("lines", low.cast("int") + 1, count.cast("int")).alias("lines")).alias("part"))
    parts = held.groupBy("file", "line", "last_line", "opened").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    rows = F.flatten(F.transform("parts", lambda p: p["lines"]))
    begin, end = _marker("BEGIN", F.col("opened")), _marker("END", F.col("opened"))
    several = parts.withColumn("rows", F.transform(rows, lambda r: F.when(r.endswith("\r"), F.left(r, F.char_length(r) - 1)).otherwise(r))).select(
        "file", "line", "last_line", F.concat(
            begin, F.array_join(F.concat(
                F.array(F.call_function("substring_index", F.element_at("rows", 1), begin, F.lit(-1))),
                F.slice("rows", F.lit(2), F.size("rows") - 2),
                F.array(F.call_function("substring_index", F.element_at("rows", -1), end, F.lit(1)))), "\n"), end).alias("match"))
    return one.unionByName(several).select("file", "line", "last_line", F.lit(BLOCK_TYPE).alias("type"), "match")
