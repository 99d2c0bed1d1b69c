"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysweep.llm.common import SMALL_BYTES, semi_join, unused
from keysweep.plans.store import size_in_bytes, stored

HEAD_CHARS = 64
_SPACES = "[\\x20\\x09-\\x0D]+"
# Most texts have no other white space than single blanks and line ends; the check is cheaper than the rewriting.
_UNEVEN = "[\\x09\\x0B-\\x0D]|[\\x20\\x0A][\\x20\\x0A]"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(_UNEVEN), F.regexp_replace(text, _SPACES, " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS,
                 digest_all: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest``.

    Texts are equal if they are the same after ``normalised``. Of each group the row with the smallest id
    stays; of repeated rows with that id, one. A null id is larger than any other. ``digest`` is the SHA-256 of the
    normalised text; without ``digest_all`` it is computed only where length and prefix already agree with
    another row, and null elsewhere. No column but the two named ones is read. An empty table gives no rows.

    Lengths and prefix hashes come from one scan. Repeated ``(id, text)`` rows and whole groups are counted
    before they are shuffled, so a group with a third of all rows is a few partial sums.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    keys = [F.octet_length("t").cast("long").alias("n"), F.xxhash64(F.left("t", F.lit(head_chars))).alias("head")]
    digest = F.sha2(F.col("t"), 256)
    sized = text.select("id", *keys, *([digest.alias("digest")] if digest_all else []))
    rows = stored(sized.groupBy(*sized.columns).agg(F.count("*").alias("copies")))

    lengths = rows.groupBy("n").agg(F.sum("copies").alias("m")).where("m > 1").select("n")
    heads = rows.groupBy("n", "head").agg(F.sum("copies").alias("m")).where("m > 1").select("n", "head")
    heads = stored(heads.join(lengths, "n", "left_semi"))

    if digest_all:
        full = rows
    else:
        wanted = semi_join(text.select("*", *keys), heads, ["n", "head"])
        full = stored(wanted.select("id", "n", "head", digest.alias("digest")).groupBy("id", "n", "head", "digest")
                      .agg(F.count("*").alias("copies")))
    groups = full.groupBy("n", "head", "digest").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = stored(semi_join(groups.where("group_size > 1"), heads, ["n", "head"]))

    # Both sides are stored tables, so an uneven key is split at run time.
    if digest_all:
        every = rows.join(groups, ["n", "head", "digest"], "left")
    else:
        alone = rows.join(heads, ["n", "head"], "left_anti").select(
            "id", "n", "head", F.lit(None).cast("string").alias("digest"), "copies",
            F.lit(None).cast(docs.schema[id_col].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
        every = full.join(groups, ["n", "head", "digest"], "left").select(*alone.columns).unionByName(alone)
    leads = F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    # Repeated rows come back one by one, and only the first of them can stay.
    return every.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(
        "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (leads & (F.col("copy") == 1)).alias("kept"), "digest")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay after ``exact_groups``, with all their columns.

    Of rows that repeat id and text, one stays (any: they may differ in other columns only). Only ids and digests
    of dropped rows are joined back; texts are not shuffled but for repeats of a row that stays.
    """
    own, digest, again, full = (unused(docs.columns, name) for name in ("_id", "_digest", "_again", "_full"))
    lost = stored(exact_groups(docs, id_col, text_col, head_chars).where("NOT kept")
                  .select(F.col("id").alias(own), F.col("digest").alias(digest), F.col("id").eqNullSafe(F.col("keep_id")).alias(again))
                  .distinct())
    if lost.isEmpty():
        return docs
    rows = docs.withColumn(full, F.sha2(normalised(F.col(text_col)), 256))
    if size_in_bytes(lost) <= SMALL_BYTES:
        lost = F.broadcast(lost)
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.col(full) == F.col(digest))
    back = [F.col(f"`{c}`") for c in docs.columns]
    stay = rows.join(lost.select(own, digest).distinct(), same, "left_anti").select(*back)
    again = rows.join(lost.where(again).select(own, digest), same, "left_semi").dropDuplicates([id_col, full]).select(*back)
    return stay.unionByName(again)
