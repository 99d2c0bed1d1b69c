"""Redacted reports as JSON lines and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keysweep.functions.paths import relative_to
from keysweep.functions.redact import redact
from keysweep.operators.document import write_document
from keysweep.plans.store import stored

_LIFECYCLE = {
    "commit": "string", "message": "string", "introduced_commit": "string", "removed_commit": "string",
    "exposure_commits": "bigint", "exposure_window": "string", "still_present_in_head": "boolean",
}


def redacted(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Report columns of findings; nothing in them shows a whole secret. Absent columns become null."""
    extra = [(F.col(c) if c in findings.columns else F.lit(None)).cast(t).alias(c) for c, t in _LIFECYCLE.items()]
    return findings.select(
        relative_to(F.col("file"), root).alias("file"), "type", "line", redact(F.col("match")).alias("match"), *extra)


def json_rows(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Report rows in which empty, zero and false mean absent."""
    report = redacted(findings, root)
    for name, kind in _LIFECYCLE.items():
        empty = {"string": F.lit(""), "bigint": F.lit(0), "boolean": F.lit(False)}[kind]
        report = report.withColumn(name, F.nullif(F.col(name), empty))
    return report


def json_header(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_findings")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("scan_time"),
        "total_findings", F.lit(True).alias("sanitized"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def markdown_blocks(findings: DataFrame, root: str | None = None) -> DataFrame:
    """One text block per finding, next to the columns that order them."""
    def item(label: str, value: Column, end: str = "  ") -> Column:
        return F.concat(F.lit(f"  **{label}:** "), value, F.lit(end))

    def code(value: Column) -> Column:
        return F.concat(F.lit("`"), value, F.lit("`"))

    introduced, removed, window = _text("introduced_commit"), _text("removed_commit"), _text("exposure_window")
    commits = F.coalesce("exposure_commits", F.lit(0))
    tracked = (introduced != "") | (window != "")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("- **File:** "), code(F.col("file")), F.lit("  ")),
        item("Line", F.col("line").cast("string")),
        item("Match", code(F.col("match")), ""),
        item("Commit", _text("commit")),
        item("Message", code(_text("message"))),
        F.when(introduced != "", item("Introduced", introduced)),
        F.when(tracked & (removed != ""), item("Removed", removed))
        .when(tracked & F.col("still_present_in_head"), item("Removed", F.lit("(still present in HEAD)"))),
        F.when(window != "", item("Exposure", window))
        .when(tracked & (commits > 0),
              item("Exposure", F.concat(F.lit("Exposed for "), commits.cast("string"), F.lit(" commits")))),
    )
    return redacted(findings, root).select("type", "file", "line", "match", block.alias("block"))


def markdown_document(findings: DataFrame, root: str | None = None) -> DataFrame:
    """The whole report as one text column in reading order."""
    return _markdown_rows(findings, root).orderBy(*_MARKDOWN_ORDER).select("value")


_MARKDOWN_ORDER = ["part", "type", "kind", "file", "line", "match"]


def _markdown_rows(findings: DataFrame, root: str | None) -> DataFrame:
    """The texts of a report next to the columns that order them.

    Findings are read once for their blocks and once, beforehand, to be counted by type; headings and the end come from those counts.
    """
    blocks = markdown_blocks(findings, root)
    head = "# Secret Exposure Report\n\n>**Note:** Secret values are automatically redacted for security.\n"

    def place(frame: DataFrame, part: int, kind: int, text: Column, keys=("type",)) -> DataFrame:
        kinds = {"type": "string", "file": "string", "line": "bigint", "match": "string"}
        own = [(F.col(k) if k in keys else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
        return frame.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), *own, text.alias("value"))

    types = stored(findings.groupBy("type").agg(F.count("*").alias("n")))
    total = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    foot = F.when(F.col("n") == 0, F.lit("No secrets found.")) \
        .otherwise(F.concat(F.lit("**Total unique findings:** "), F.col("n").cast("string")))
    pieces = [
        place(total, 0, 0, F.lit(head), ()),
        place(types, 1, 0, F.concat(F.lit("## "), F.col("type"), F.lit("\n"))),
        place(blocks, 1, 1, F.concat(F.col("block"), F.lit("\n")), ("type", "file", "line", "match")),
        place(types, 1, 2, F.lit("---")),
        place(total, 2, 0, foot, ()),
    ]
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    return whole


def write_report(findings: DataFrame, path: str | None, fmt: str = "markdown", root: str | None = None) -> None:
    """Write a report folder: JSON lines with a header beside them, or Markdown in ordered part files.

    ``findings`` are read more than once; pass a stored table if they are costly. Without
    a path nothing is written.
    """
    if fmt not in ("json", "JSON", "markdown", "md", ""):
        raise ValueError(f"unknown report format {fmt!r}: markdown and json are supported")
    if not path:
        return
    if fmt in ("json", "JSON"):
        ordered = json_rows(findings, root).orderBy("file", "line", "type", "match")
        ordered.write.json(f"{path}/findings", ignoreNullFields=True)
        json_header(findings).write.json(f"{path}/header")
    else:
        markdown_document(findings, root).write.text(path)


def write_report_file(findings: DataFrame, path: str, fmt: str = "markdown", root: str | None = None) -> int:
    """Write a report as one valid file, and return its number of findings; see ``write_document`` for where it can lie.

    JSON is an object with ``scan_time``, ``total_findings``, ``sanitized`` and the list ``findings``. ``findings`` are read more than once;
    pass a stored table if they are costly.
    """
    if fmt in ("json", "JSON"):
        rows = json_rows(findings, root)
        keys = ["file", "line", "type", "match"]
        texts = rows.select(*keys, F.to_json(F.struct(*rows.columns)).alias("value"))
        header = json_header(findings).select(F.to_json(F.struct("scan_time", "total_findings", "sanitized"))).first()[0]
        return write_document(texts, path, keys, head=header[:-1] + ',"findings":[\n', between=",\n", tail="\n]}\n")
    if fmt in ("markdown", "md", ""):
        write_document(_markdown_rows(findings, root), path, _MARKDOWN_ORDER)
        return findings.count()
    raise ValueError(f"unknown report format {fmt!r}: markdown and json are supported")
