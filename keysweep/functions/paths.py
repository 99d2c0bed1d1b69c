"""Path expressions and the filters that decide which files are scanned."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from keysweep.fixed_values import MAX_BLOB_BYTES, SKIP_DIRS, SKIP_FILES, VALID_EXTENSIONS


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text from the last dot of the base name; ``''`` without a dot."""
    base = base_name(path)
    return F.when(base.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(base, ".", -1)))) \
        .otherwise(F.lit(""))


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(d) for d in SKIP_DIRS]))


def is_skipped_file(path: Column) -> Column:
    return base_name(path).isin(SKIP_FILES)


def has_valid_extension(path: Column) -> Column:
    return extension(path).isin(VALID_EXTENSIONS)


def within_size_cap(size: Column, cap: int = MAX_BLOB_BYTES) -> Column:
    return size <= cap


def _one_of(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


_VALID = f"(?i){_one_of(VALID_EXTENSIONS)}\\z"
_SKIPPED = rf"(?:\A|/)(?:{_one_of(SKIP_DIRS)}(?:/|\z)|{_one_of(SKIP_FILES)}\z)"


def is_scanned(path: Column) -> Column:
    """All path filters as two patterns: the path itself may be an expression, and is used only twice."""
    return path.rlike(_VALID) & ~path.rlike(_SKIPPED)


def relative_to(path: Column, root: str | None) -> Column:
    """Path below ``root``; a path outside of it stays whole."""
    if not root or root == ".":
        return path
    root = root.rstrip("/")
    below = F.substring(path, len(root) + 2, 1 << 30)
    return F.when(path == root, F.lit(".")).when(path.startswith(root + "/"), below).otherwise(path)


def under(base: str | None, name: Column) -> Column:
    """Full path of a commit-tree file below a base folder."""
    return F.concat(F.lit(base.rstrip("/") + "/"), name) if base and base != "." else name


def short_commit(commit: Column) -> Column:
    return F.left(commit, F.lit(8))
