import pytest
from pyspark.sql import types as T


#: Names that operators give to columns of their own beside those of a user.
CLASHES = ("_full", "_id", "_digest", "_again", "_text_key", "q", "chunk", "bucket", "sequence_id", "key", "seeds")


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names clash with those that operators use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *(T.StructField(c, T.StringType()) for c in ("id", "t", "n", "fp", "digest", "copies", "blk", *CLASHES))])

    def make(rows):
        return spark.createDataFrame([(i, t, *(["x"] * (7 + len(CLASHES)))) for i, t in rows], schema)
    return make
