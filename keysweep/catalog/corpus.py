"""Files, blobs, commits and trees derived from the given tables.

The tables hold almost no secrets, so every document becomes a file whose last line
is planted: it triggers one rule or sets one trap, chosen by the document's number.
Every order is a commit and every line item a file in its tree. The SQL
text is the same for Spark and for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PATH = """'repo/' || CASE doc_id % 11 WHEN 0 THEN 'node_modules/x' WHEN 1 THEN 'src/vendor' WHEN 2 THEN 'build'
    ELSE 'pkg/m' || CAST(doc_id % 7 AS STRING) END
  || '/d' || CAST(doc_id AS STRING) || '/'
  || CASE WHEN doc_id % 29 = 0 THEN 'package-lock.json' WHEN doc_id % 31 = 0 THEN '.env'
    ELSE 'f' || CASE doc_id % 9 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.env' WHEN 3 THEN '.JSON'
      WHEN 4 THEN '.yaml' WHEN 5 THEN '.txt' WHEN 6 THEN '.md' WHEN 7 THEN '.lock' ELSE '.ts' END END"""

CORPUS = f"""WITH named AS (
  SELECT doc_id, text, md5(CAST(doc_id AS STRING)) AS h FROM {{documents}}
), keyed AS (
  SELECT *, base64(unhex(h || md5(h) || md5(h || 'x'))) AS b FROM named
)
SELECT doc_id, {PATH} AS path,
  text || chr(10) || CASE doc_id % 16
    WHEN 0 THEN 'token = "ghp_' || substr(h || h, 1, 36) || '"'
    WHEN 1 THEN 'AWS_ACCESS_KEY_ID=AKIA' || upper(substr(h, 1, 16))
    WHEN 2 THEN 'api_key = "' || h || '"' || chr(13)
    WHEN 3 THEN 'password: EXAMPLE' || h
    WHEN 4 THEN 'url: postgresql://svc:' || substr(h, 1, 12) || '@db.internal:5432/app'
    WHEN 5 THEN 'var k = "sk_live_' || h || '"'
    WHEN 6 THEN 'blob ' || b || ' and again ' || b
    WHEN 7 THEN 'auth: token:' || h
    WHEN 8 THEN 'x ' || repeat('a', 8) || b
    WHEN 9 THEN 'sha256-' || b
    WHEN 10 THEN 'eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.' || h || '.' || h
    WHEN 11 THEN '"api_key": "' || h || '"'
    WHEN 12 THEN 'ésecret=' || h
    WHEN 13 THEN 'secret_key' || chr(11) || '= ' || h
    WHEN 14 THEN 'Client_Secret := "' || h || '"'
    ELSE 'shared_secret key: k3y0f7hewhole7eam' END
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS content
FROM keyed"""

# Blocks of several lines: whole, with carriage returns, in one line, nested, without an end, with another end.
KEYS = f"""WITH named AS (SELECT doc_id, text, md5(CAST(doc_id AS STRING)) AS h FROM {{documents}})
SELECT {PATH} AS file, CAST(1 AS BIGINT) AS first_line, text || chr(10) || CASE doc_id % 8
    WHEN 0 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h || chr(10) || md5(h) || chr(10) || '-----END RSA PRIVATE KEY-----'
    WHEN 1 THEN 'k = "-----BEGIN PRIVATE KEY-----' || chr(13) || chr(10) || h || chr(13) || chr(10) || '-----END PRIVATE KEY-----"' || chr(13) || chr(10) || 'x'
    WHEN 2 THEN '"-----BEGIN EC PRIVATE KEY-----' || h || '-----END EC PRIVATE KEY-----",'
    WHEN 3 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || '-----BEGIN EC PRIVATE KEY-----' || chr(10) || h || chr(10) || '-----END EC PRIVATE KEY-----'
      || chr(10) || '-----END RSA PRIVATE KEY-----'
    WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h
    WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || h || chr(10) || '-----END EC PRIVATE KEY-----' || chr(10)
    WHEN 6 THEN '-----BEGIN PGP PRIVATE KEY BLOCK-----' || chr(10) || 'Version: 1-2' || chr(10) || chr(10) || h || chr(10) || '-----END PGP PRIVATE KEY BLOCK-----' || chr(10)
    ELSE '-----BEGIN PUBLIC KEY-----' || chr(10) || h || chr(10) || '-----END PUBLIC KEY-----' END AS content
FROM named"""

_COMMIT = "md5('c' || CAST({0} AS STRING)) || substr(md5('d' || CAST({0} AS STRING)), 1, 8)"

COMMITS = f"""SELECT {_COMMIT.format('o_orderkey')} AS commit, 'change ' || CAST(o_orderkey AS STRING) AS message,
  (SELECT count(*) FROM {{orders}}) - 1 - o_orderkey AS log_pos
FROM {{orders}}"""

# Every order has one parent or two, the first order none.
LINKS = """SELECT o_orderkey AS child, CAST(floor(o_orderkey / 2) AS BIGINT) AS parent FROM {orders} WHERE o_orderkey > 0
UNION ALL SELECT o_orderkey, CAST(floor(o_orderkey / 3) AS BIGINT) FROM {orders} WHERE o_orderkey > 2 AND o_orderkey % 3 = 0"""

_TREES = f"""SELECT {_COMMIT.format('l_orderkey')} AS commit,
  lower(l_linestatus) || '/' || {PATH} AS path, doc_id AS blob_id
FROM {{placed}} AS placed"""
_LINES = "l_orderkey, l_linestatus, l_partkey % (SELECT count(*) FROM {documents}) AS doc_id FROM {lineitem}"
ENTRIES = _TREES.format(placed=f"(SELECT DISTINCT {_LINES})")

# Keys and string columns of every table that has any; a row is a file, its strings are lines in this order.
RAW_COLUMNS = {
    "documents": (("doc_id",), ("text", "lang", "source"), ".txt"),
    "pages": (("page_id",), ("html", "url"), ".json"),
    "conversations": (("conv_id", "turn"), ("text", "role"), ".yml"),
    "benchmark": (("item_id",), ("text",), ".py"),
    "events": (("event_id",), ("props", "event_type"), ".json"),
    "region": (("r_regionkey",), ("r_name",), ".env"),
    "nation": (("n_nationkey",), ("n_name",), ".env"),
    "customer": (("c_custkey",), ("c_name", "c_mktsegment"), ".env"),
    "supplier": (("s_suppkey",), ("s_name",), ".env"),
    "part": (("p_partkey",), ("p_name", "p_brand", "p_type"), ".env"),
    "orders": (("o_orderkey",), ("o_orderstatus", "o_orderpriority"), ".env"),
    "lineitem": (("l_orderkey", "l_linenumber"), ("l_returnflag", "l_linestatus"), ".env"),
}

RAW_FILES = "\nUNION ALL ".join(
    f"SELECT '{name}/' || " + " || '/' || ".join(f"CAST({k} AS STRING)" for k in keys)
    + f" || '{extension}' AS path, concat_ws(chr(10), {', '.join(columns)}) AS content FROM {{{name}}}"
    for name, (keys, columns, extension) in RAW_COLUMNS.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in names})


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CORPUS, "documents")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, KEYS, "documents")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RAW_FILES, *RAW_COLUMNS)


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(spark, sf_dir)
    return made.select(F.col("doc_id").alias("blob_id"), F.octet_length("content").cast("long").alias("size"),
                       "content")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, COMMITS, "orders")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with their parents."""
    links = _sql(spark, sf_dir, f"SELECT child AS o_orderkey, parent FROM ({LINKS}) AS l", "orders")
    parents = links.groupBy("o_orderkey").agg(F.collect_set("parent").alias("parents"))
    # Keys move; the names, which are longer, are made from them afterwards.
    joined = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("time")).join(parents, "o_orderkey", "left")
    return joined.select(F.expr(_COMMIT.format("o_orderkey")).alias("commit"),
                         F.expr(f"transform(parents, p -> {_COMMIT.format('p')})").alias("parents"), "time")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ENTRIES``, those of a commit together."""
    lines = _sql(spark, sf_dir, f"SELECT {_LINES}", "documents", "lineitem")
    return spark.sql(_TREES, placed=lines.repartition("l_orderkey").distinct().sortWithinPartitions("l_orderkey"))
