"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"
_scratch: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a scratch folder only for a local master."""
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = tempfile.mkdtemp(prefix="keysweep-")
    return _scratch[app]


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` and read it back: the lineage is cut, a lost executor costs no recomputation,
    and each reader takes only the columns it needs. Digests in hexadecimal take half the space under the codec zstd."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/keysweep/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """``stored`` in buckets of ``key``, so that joins on it move the other side only, however often the table is joined."""
    spark = df.sparkSession
    name = f"keysweep_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("compression", "zstd") \
        .option("path", f"{checkpoint_root(spark)}/keysweep/{name}").saveAsTable(name)
    return spark.table(name)


def release(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``stored``; only once everything that reads them has been stored itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """Upper bound for the data of a table: the bytes of its texts and 16 for every value."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    row = reduce(lambda a, b: a + b, texts, F.lit(16 * len(df.columns))).cast("long")
    return df.agg(F.sum(row)).first()[0] or 0
