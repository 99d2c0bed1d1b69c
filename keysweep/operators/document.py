"""One file from a table of any size, written by many tasks at once.

Every task writes its range of the ordered rows to a part beside the file; then the parts are copied to their places in the file, each
by a task; at last the file gets its name. Nothing but the sizes of parts is on the driver, and a job that breaks off leaves no file of that name.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from keysweep.plans.store import stored

_COPY_BYTES = 8 << 20
_PARTS = "part long, name string, size long, n long"


def _local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError("a single document needs a folder that all executors see as a file system")
    return os.path.abspath(path)


def write_document(rows: DataFrame, path: str, order: list[str], head: str = "", between: str = "\n", tail: str = "\n", value: str = "value") -> int:
    """Write the texts ``value`` in the order of the columns ``order`` as one UTF-8 file, and return how many there are.

    ``head`` and ``tail`` enclose them, ``between`` stands between two. The folder of ``path`` must be shared by driver and executors. An
    existing file is replaced at once by the finished one. Null texts are left out; equal keys come in any order.
    """
    path = _local(path)
    scratch = f"{path}.{uuid.uuid4().hex}.parts"
    os.makedirs(scratch)
    try:
        separator = between.encode()

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            # Each attempt has a file of its own; only the one that is told of counts.
            name, size, n = f"{scratch}/{context.partitionId()}-{context.taskAttemptId()}", 0, 0
            with open(name, "wb") as out:
                for batch in batches:
                    for text in batch.column("value"):
                        size += out.write((separator if n else b"") + text.as_py().encode("utf-8", "surrogatepass"))
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((context.partitionId(), name, size, n), (pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["part", "name", "size", "n"])

        ranged = rows.where(F.col(value).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(value).alias("value"))
        parts = [r for r in stored(ranged.mapInArrow(write, _PARTS)).orderBy("part").collect() if r["n"]]  # a row for each partition
        at, places = len(head.encode()), []
        for i, part in enumerate(parts):
            at += len(separator) if i else 0
            places.append((part["name"], at, part["size"]))
            at += part["size"]
        whole = f"{scratch}/whole"
        with open(whole, "wb") as out:
            out.write(head.encode())
            for _, start, _ in places[1:]:
                out.seek(start - len(separator))
                out.write(separator)
            out.seek(at)
            out.write(tail.encode())

        def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("name", "start", "size"))):
                    with open(name, "rb") as part, open(whole, "r+b") as out:
                        out.seek(start)
                        shutil.copyfileobj(part, out, _COPY_BYTES)
                        if out.tell() != start + size:
                            raise OSError(f"{name} has changed its size")
                yield batch.select(["size"])

        spark = rows.sparkSession
        if places:
            table = spark.createDataFrame(places, "name string, start long, size long").repartition(min(len(places), spark.sparkContext.defaultParallelism), "start")
            done = table.mapInArrow(copy, "size long").agg(F.sum("size")).first()[0]
            assert done == sum(p[2] for p in places)
        os.replace(whole, path)
        return sum(p["n"] for p in parts)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
