"""Files of a directory tree as a table.

Spark's own file sources pass over every name that begins with a dot or an underscore,
``.env`` and ``__init__.py`` among them, so the tree is listed and read here. Folders
are listed level by level, one row per folder, and files are read in pieces of
bounded size that begin and end at line ends, so neither a wide folder tree nor a huge file
falls to one task.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from keysweep.fixed_values import SKIP_DIRS
from keysweep.functions.paths import base_name, is_scanned, relative_to
from keysweep.plans.store import stored

PIECE_BYTES = 64 << 20
_BATCH_BYTES = 32 << 20
_BEHIND_BYTES = 1 << 20
_TASK_BYTES = 1 << 30
_LISTED_ROWS = 10_000
# Attempts to read a piece, and the seconds before the second one; each later one waits twice as long.
READ_ATTEMPTS = 4
RETRY_SECONDS = 0.2
_LISTED = "path string, size long, is_dir boolean"


def _local(path: str) -> str | None:
    """The path in the local file system, or None for a path in another one."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _list_folder(folder: str) -> Iterator[tuple[str, int, bool]]:
    local = _local(folder)
    if local is not None:
        if os.path.isfile(local):
            yield folder, os.path.getsize(local), False
            return
        with os.scandir(local) as found:
            for item in found:
                path = item.name if folder == "." else os.path.join(folder, item.name)
                # Links to folders are not followed.
                if item.is_dir(follow_symlinks=False):
                    yield path, 0, True
                elif item.is_file():
                    yield path, item.stat().st_size, False
        return
    from pyarrow import fs

    system, inner = _remote(folder)
    start = folder[:len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    info = system.get_file_info(inner)
    if info.is_file:
        yield folder, info.size, False
        return
    for item in system.get_file_info(fs.FileSelector(inner)):
        yield start + item.path, item.size or 0, item.type == fs.FileType.Directory


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = (item for batch in batches for folder in batch["path"] for item in _list_folder(folder))
    while rows := list(islice(found, _LISTED_ROWS)):
        yield pd.DataFrame(rows, columns=["path", "size", "is_dir"])


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of the files below ``root`` that are scanned; skipped folders are not entered.

    One job per level of the tree. A folder that cannot be listed is an error.
    """
    root = root.rstrip("/") or "/"
    level = spark.createDataFrame([(root,)], "path string")
    if os.path.basename(root) in SKIP_DIRS:
        level = level.limit(0)
    levels = []
    cores = spark.sparkContext.defaultParallelism
    while True:
        listed = stored(level.repartition(cores, "path").mapInPandas(_list_folders, _LISTED))
        levels.append(listed.where(~F.col("is_dir")).select("path", "size"))
        level = listed.where(F.col("is_dir") & ~base_name(F.col("path")).isin(SKIP_DIRS)).select("path")
        if level.isEmpty():
            break
    files = reduce(DataFrame.unionAll, levels)
    inside = relative_to(F.col("path"), root)
    name = F.when(inside == ".", base_name(F.col("path"))).otherwise(inside)
    return files.where(is_scanned(name) & (F.col("size") > 0))


def _read(path: str, start: int, count: int) -> bytes:
    local = _local(path)
    if local is not None:
        with open(local, "rb") as file:
            file.seek(start)
            return file.read(count)
    system, inner = _remote(path)
    with system.open_input_file(inner) as file:
        return file.read_at(count, start)


def read_piece(path: str, size: int, piece: int, piece_bytes: int, limit: int | None = None) -> bytes:
    """The lines that begin in the ``piece``-th stretch of a file, the last one to its end.

    With a ``limit`` at most so many bytes behind the stretch are read: a last line that goes on further is over it anyway.
    """
    start, end = piece * piece_bytes, min((piece + 1) * piece_bytes, size)
    before = min(start, 1)  # tells whether the stretch begins at the start of a line
    data = _read(path, start - before, end - start + before)
    if len(data) < end - start + before:
        raise OSError(f"the file ends before byte {end}, which it had when it was listed")
    first = data.find(b"\n", 0, end - start + before) + 1 if before else 0
    if before and first == 0 or first >= end - start + before:
        return b""
    stop = size if limit is None else min(size, end + limit)
    parts, at = [data[first:]], end
    ended = data.endswith(b"\n")
    while not ended and at < stop:
        more = _read(path, at, min(_BEHIND_BYTES, stop - at))
        if not more:
            break
        last = more.find(b"\n") + 1
        parts.append(more[:last] if last else more)
        ended, at = last > 0, at + len(more)
    return b"".join(parts)


def _pieces(batch: pd.DataFrame, piece_bytes: int, limit: int | None, on_error: str) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Row, bytes and null, or row, null and the reason. Never is a row left out."""
    for at, (path, size, piece) in enumerate(zip(batch["path"], batch["size"], batch["piece"])):
        data = reason = None
        for attempt in range(READ_ATTEMPTS):
            if attempt:
                time.sleep(RETRY_SECONDS * 2 ** (attempt - 1))
            try:
                data, reason = read_piece(path, size, piece, piece_bytes, limit), None
                break
            except (OSError, pa.ArrowException) as problem:
                reason = f"{type(problem).__name__}: {problem}"
                if on_error == "fail" and attempt + 1 == READ_ATTEMPTS:
                    raise  # the task fails and is repeated elsewhere
        yield at, data, reason


def _measure(data: bytes, limit: int | None) -> tuple[int, int | None]:
    """Number of lines, and number of the first over-long one."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    edges = np.concatenate(([-1], ends, [len(data)] if data and data[-1] != 10 else [])).astype(np.int64)
    long = np.flatnonzero(np.diff(edges) - 1 >= limit) if limit is not None else ()
    return len(edges) - 1, int(long[0]) + 1 if len(long) else None


def _measured(piece_bytes: int, limit: int | None, on_error: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(batch["path"].iat[at], batch["piece"].iat[at], *(_measure(data, limit) if data is not None else (None, None)))
                    for at, data, _ in _pieces(batch, piece_bytes, limit, on_error)]
            yield pd.DataFrame(rows, columns=["path", "piece", "lines", "long"]).astype({"lines": "Int64", "long": "Int64"})
    return run


def _contents(piece_bytes: int, limit: int | None, on_error: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for at, data, reason in _pieces(batch, piece_bytes, limit, on_error):
                rows.append((batch["path"].iat[at], batch["piece"].iat[at], batch["first_line"].iat[at], batch["stop_line"].iat[at], data, reason))
                held += len(data or b"")
                if held >= _BATCH_BYTES:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)
    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "piece", "first_line", "stop_line", "bytes", "reason"])
    return frame.astype({"first_line": "Int64", "stop_line": "Int64"})


def read_files(files: DataFrame, piece_bytes: int = PIECE_BYTES, limit: int | None = None, on_error: str = "fail") -> DataFrame:
    """``(path, piece, first_line, stop_line, content, reason)`` of listed files, one row per piece.

    A piece that cannot be read, or is shorter than it was when listed, is tried again. Then ``on_error="fail"`` fails the task, which Spark repeats and
    at last the job; ``"reject"`` gives a row with a null content and the ``reason``, and pieces behind it have a null ``first_line``
    if their lines could not be counted. No piece is left out.

    Files of more than one piece are read once more beforehand to number their lines. ``stop_line`` is null unless a ``limit``
    is given; then it is the first line of the file that is so long, which the limit of ``number_lines`` also stops at.
    """
    is_large = F.col("size") > piece_bytes
    total, large_total = files.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(is_large, F.col("size"))), F.lit(0))).first()
    if on_error not in ("fail", "reject"):
        raise ValueError(f"on_error is fail or reject, not {on_error!r}")
    cores = files.sparkSession.sparkContext.defaultParallelism
    last = F.floor((F.col("size") - 1) / piece_bytes).cast("long")
    pieces = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    if large_total:
        numbered = pieces.join(_offsets(pieces.where(is_large), _tasks(large_total, cores), piece_bytes, limit, on_error),
                               ["path", "piece"], "left")
    else:
        numbered = pieces.withColumns({"first_line": F.lit(None), "stop_line": F.lit(None)})
    first = F.when(is_large & (F.col("piece") > 0), F.col("first_line")).otherwise(1)
    numbered = numbered.select("path", "size", "piece", first.cast("long").alias("first_line"),
                               F.col("stop_line").cast("long").alias("stop_line"))
    read = numbered.repartition(_tasks(total, cores), "path", "piece").mapInPandas(
        _contents(piece_bytes, limit, on_error), "path string, piece long, first_line long, stop_line long, bytes binary, reason string")
    return read.select("path", "piece", "first_line", "stop_line",
                       F.make_valid_utf8(F.col("bytes").cast("string")).alias("content"), "reason")


def _tasks(total: int, cores: int) -> int:
    # A task streams its pieces, so its share may be large; this keeps the shuffle of the listing small.
    return max(cores, total // _TASK_BYTES)


def _offsets(pieces: DataFrame, tasks: int, piece_bytes: int, limit: int | None, on_error: str) -> DataFrame:
    """First line of every piece, and first line of its file that is not scanned."""
    counted = stored(pieces.repartition(tasks, "path", "piece").mapInPandas(
        _measured(piece_bytes, limit, on_error), "path string, piece long, lines long, long long"))
    # One row per piece of a file is sorted here, not its lines.
    before = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("path", "piece", "long",
                           # Unknown behind a piece whose lines could not be counted.
                           F.when(F.count_if(F.col("lines").isNull()).over(before) == 0,
                                  F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1).alias("first_line"))
    stop = F.min(F.col("first_line") + F.col("long") - 1).over(Window.partitionBy("path"))
    return first.select("path", "piece", "first_line", stop.alias("stop_line"))
