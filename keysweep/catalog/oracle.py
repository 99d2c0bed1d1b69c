"""The registered queries in plain SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

import json
from importlib import resources

from keysweep import fixed_values as fixed
from keysweep.catalog import corpus
from keysweep.catalog.queries import SHORT_LINE_LIMIT
from keysweep.functions.keywords import KEYWORDS, keyword_pattern

_TABLES = {name: name for name in corpus.RAW_COLUMNS}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _rules() -> list[dict]:
    return json.loads(resources.files("keysweep").joinpath("data/rules.json").read_text())["signatures"]


def _lines(source: str, keys: str, limit: int | None = None) -> str:
    """Numbered lines of a table with a content column; with a limit those before the first one of so many bytes."""
    stop = f"min(CASE WHEN strlen(raw) >= {limit} THEN line END) OVER (PARTITION BY part)" if limit else "NULL"
    return f"""SELECT {keys}, line, CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS text
FROM (
  SELECT *, {stop} AS stop
  FROM (
    SELECT *, unnest(pieces) AS raw, generate_subscripts(pieces, 1) AS line, len(pieces) AS n
    FROM (SELECT *, row_number() OVER () AS part, string_split(content, chr(10)) AS pieces FROM {source})
  )
) WHERE NOT (line = n AND raw = '') AND (stop IS NULL OR line < stop)"""


def _signature(source: str, keys: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(text, {_q(r['pattern'])}) THEN {_q(r['name'])} END" for r in _rules())
    return f"""SELECT {keys}, line, type, text AS match
FROM (SELECT *, unnest([{hits}]) AS type FROM {source}) WHERE type IS NOT NULL"""


def _valid(value: str) -> str:
    words = " OR ".join(f"contains(upper({value}), {_q(w)})" for w in fixed.PLACEHOLDERS)
    return (f"(strlen({value}) >= {fixed.MIN_VALUE_BYTES} AND NOT ({words}) "
            f"AND regexp_matches({value}, '[A-Za-z]') AND regexp_matches({value}, '[0-9]'))")


def _keyword(source: str, keys: str) -> str:
    found = ", ".join(f"regexp_extract_all(text, {_q(keyword_pattern(k))}, 1)" for k in KEYWORDS)
    return f"""SELECT DISTINCT {keys}, line, {_q(fixed.KEYWORD_TYPE)} AS type, match
FROM (SELECT *, unnest(flatten([{found}])) AS match FROM {source}) WHERE {_valid('match')}"""


def _tokens(source: str, keys: str) -> str:
    return f"""SELECT {keys}, line, token FROM (
  SELECT *, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{25,}}')) AS token FROM {source}
) WHERE strlen(token) >= {fixed.MIN_TOKEN_LENGTH}"""


_RUNS = "|".join(c.replace("+", r"\+") + "{" + str(fixed.MAX_REPEAT_RUN + 1) + "}" for c in fixed.TOKEN_ALPHABET)
_REPEATS = f"regexp_matches(token, {_q(_RUNS)})"
_NOISE = ("(" + " OR ".join(f"contains(lower(token), {_q(w)})" for w in fixed.NOISE_WORDS)
          + f" OR starts_with(lower(token), {_q(fixed.NOISE_PREFIX)}) OR {_REPEATS})")


def _entropy(source: str, keys: str) -> str:
    """Bits per byte of the text column ``token`` of every row."""
    return f"""SELECT {keys}, coalesce(sum(CASE WHEN n > 0 THEN -(n / size) * log2(n / size) END), 0) AS bits FROM (
  SELECT {keys}, any_value(size) AS size, c, count(*)::DOUBLE AS n
  FROM (SELECT {keys}, strlen(token)::DOUBLE AS size, unnest(string_split(token, '')) AS c FROM {source})
  GROUP BY {keys}, c
) GROUP BY {keys}"""


def _high_entropy(source: str, keys: str) -> str:
    return f"""SELECT {keys}, line, {_q(fixed.ENTROPY_TYPE)} AS type, token AS match
FROM ({_tokens(source, keys)}) AS t
JOIN (SELECT token AS text_of, bits FROM ({_entropy(f"(SELECT DISTINCT token FROM ({_tokens(source, keys)}))", 'token')}))
  AS e ON t.token = e.text_of
WHERE bits > {fixed.ENTROPY_BOUND} AND NOT {_NOISE}"""


def _detect(source: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in (
        _signature(source, keys), _keyword(source, keys), _high_entropy(source, keys)))


_MARKER = f"-----(?:BEGIN|END) {fixed.BLOCK_LABEL}-----"

# Paths ------------------------------------------------------------------

_BASE = "split_part(path, '/', -1)"
_EXT = f"CASE WHEN contains({_BASE}, '.') THEN lower('.' || split_part({_BASE}, '.', -1)) ELSE '' END"
_IN_SKIPPED_DIR = f"list_has_any(string_split(path, '/'), [{', '.join(_q(d) for d in fixed.SKIP_DIRS)}])"
_SCANNED = (f"({_EXT}) IN {_list(fixed.VALID_EXTENSIONS)} AND {_BASE} NOT IN {_list(fixed.SKIP_FILES)} "
            f"AND NOT {_IN_SKIPPED_DIR}")

# Redaction --------------------------------------------------------------


def _ends(text: str, count: int, side: str) -> str:
    fits = f"list_max(list_filter(range(0, {count + 1}), lambda k: strlen({side}({text}, k)) <= {count}))"
    whole = f"{side}({text}, {fits})"
    lost = f"repeat(chr(65533), {count} - strlen({whole}))"
    return f"({whole} || {lost})" if side == "left" else f"({lost} || {whole})"


_PREFIX = "(CASE " + " ".join(f"WHEN starts_with(v, {_q(p)}) THEN {_q(p)}" for p in fixed.VISIBLE_PREFIXES) \
    + " ELSE '' END)"


def _redacted(source: str, keep: str) -> str:
    """``source`` with the text ``v`` plus its redacted form; ``keep`` lists the columns to pass on."""
    rest = "substr(v, length(p) + 1)"

    def shown(k: int) -> str:
        return (f"CASE WHEN strlen(v) - strlen(p) < {2 * k + 3} THEN p || '****' "
                f"ELSE p || {_ends(rest, k, 'left')} || '...' || {_ends(rest, k, 'right')} END")

    parts = "string_split(v, chr(10))"
    many = f"""array_to_string(list_transform({parts}, lambda l, i:
      CASE WHEN i = 1 THEN CASE WHEN strlen(l) > 20 THEN {_ends('l', 20, 'left')} || '...' ELSE l END
           WHEN i = len({parts}) THEN CASE WHEN strlen(l) > 20 THEN '...' || {_ends('l', 20, 'right')} ELSE l END
           ELSE '    *****' END), chr(10))"""
    return f"""SELECT {keep}, CASE WHEN strlen(v) <= 8 THEN repeat('*', strlen(v))
  WHEN contains(v, chr(10)) THEN CASE WHEN len({parts}) <= 2 THEN repeat('*', 20) || ' (multiline)' ELSE {many} END
  WHEN strlen(v) = 9 THEN {shown(2)} ELSE {shown(4)} END AS redacted
FROM (SELECT *, {_PREFIX} AS p FROM ({source}))"""


# Common table expressions, in order of use ---------------------------------

_CTE = {
    "files": corpus.CORPUS.format(**_TABLES),
    "raw_tables": corpus.RAW_FILES.format(**_TABLES),
    "keys": corpus.KEYS.format(**_TABLES),
    "commits": corpus.COMMITS.format(**_TABLES),
    "entries": corpus.ENTRIES.format(**_TABLES),
    "lines": _lines("files", "doc_id"),
    "scanned": f"SELECT path AS file, content FROM files WHERE {_SCANNED}",
    "scanned_lines": _lines("scanned", "file"),
    "scan": f"SELECT DISTINCT file, line, type, match FROM ({_detect('scanned_lines', 'file')})",
    "blobs": "SELECT doc_id AS blob_id, content FROM files",
    "blob_lines": _lines("blobs", "blob_id"),
    "found": _detect("blob_lines", "blob_id"),
    "tree": f"SELECT commit, path AS file, blob_id FROM entries WHERE {_SCANNED}",
    "snapshot": "SELECT commit, file, line, type, match FROM tree JOIN found USING (blob_id)",
    "ordered": "SELECT commit, message, (SELECT count(*) FROM commits) - 1 - log_pos AS order_index FROM commits",
    "sequence": """SELECT commit, message, order_index, row_number() OVER (ORDER BY order_index) - 1 AS pos
FROM ordered WHERE commit IN (SELECT commit FROM snapshot)""",
    "present": "SELECT DISTINCT pos, commit, type, match FROM snapshot JOIN sequence USING (commit)",
    "islands": """SELECT type, match, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS exposure_commits
FROM (SELECT *, pos - row_number() OVER (PARTITION BY type, match ORDER BY pos) AS island FROM present) GROUP BY type, match, island""",
    "placed": """SELECT DISTINCT file, blob_id, order_index FROM tree JOIN ordered USING (commit)""",
    "lifecycle": """SELECT type, match, arg_min(commit, pos) AS introduced_commit,
  coalesce((SELECT s.commit FROM sequence s WHERE s.pos = max(present.pos) + 1), '') AS removed_commit,
  count(*) AS exposure_commits
FROM present GROUP BY type, match""",
    "life": """SELECT *, removed_commit = '' AS still_present_in_head,
  'Exposed for ' || exposure_commits || CASE WHEN exposure_commits = 1 THEN ' commit' ELSE ' commits' END
  || CASE WHEN removed_commit = '' THEN ' (still present in HEAD)'
     ELSE ' (removed in commit ' || left(removed_commit, 8) || ')' END AS exposure_window
FROM lifecycle""",
    "report": """SELECT file, line, type, match, s.commit, s.message, introduced_commit, removed_commit, exposure_commits,
  exposure_window, still_present_in_head
FROM (SELECT file, line, type, match, min(pos) AS pos FROM snapshot JOIN sequence USING (commit) GROUP BY ALL) AS f
JOIN sequence AS s USING (pos) JOIN life USING (type, match)""",
    "shown": _redacted("""SELECT *, match AS v, CASE WHEN starts_with(file, 'o/repo/') THEN substr(file, 8) ELSE file END
  AS relative FROM report""",
                       "* EXCLUDE (v, p)"),
}

_NEEDS = {
    "lines": ["files"], "scanned": ["files"], "scanned_lines": ["scanned"], "scan": ["scanned_lines"],
    "blobs": ["files"], "blob_lines": ["blobs"], "found": ["blob_lines"], "tree": ["entries"],
    "snapshot": ["tree", "found"], "ordered": ["commits"], "sequence": ["ordered", "snapshot"],
    "present": ["snapshot", "sequence"], "islands": ["present", "sequence"], "placed": ["tree", "ordered"], "lifecycle": ["present", "sequence"], "life": ["lifecycle"],
    "report": ["snapshot", "sequence", "life"], "shown": ["report"],
}


def _closure(names) -> list[str]:
    todo, seen = list(names), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += _NEEDS.get(name, [])
    return [name for name in _CTE if name in seen]


def _with(final: str, *names: str, **extra: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({_CTE[n]})" for n in _closure(names)] + [f"{n} AS ({q})" for n, q in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n" + final


def _json_report() -> str:
    def field(name: str, value: str, present: str) -> str:
        return f"CASE WHEN {present} THEN ',\"{name}\":' || {value} ELSE '' END"

    optional = "".join(
        " || " + field(n, f"to_json({n})::VARCHAR", f"{n} <> ''")
        for n in ("commit", "message", "introduced_commit", "removed_commit"))
    return (
        "SELECT '{\"file\":' || to_json(relative)::VARCHAR || ',\"type\":' || to_json(type)::VARCHAR || ',\"line\":' || line "
        "|| ',\"match\":' || to_json(redacted)::VARCHAR" + optional
        + " || ',\"exposure_commits\":' || exposure_commits || ',\"exposure_window\":' || to_json(exposure_window)::VARCHAR"
        " || CASE WHEN still_present_in_head THEN ',\"still_present_in_head\":true' ELSE '' END || '}' AS json FROM shown")


def _markdown_report() -> str:
    return """SELECT '# Secret Exposure Report' || repeat(chr(10), 2)
  || '>**Note:** Secret values are automatically redacted for security.' || chr(10) AS value
UNION ALL SELECT DISTINCT '## ' || type || chr(10) FROM shown
UNION ALL SELECT '---' FROM (SELECT DISTINCT type FROM shown)
UNION ALL SELECT concat_ws(chr(10), '- **File:** `' || relative || '`  ', '  **Line:** ' || line || '  ',
  '  **Match:** `' || redacted || '`', '  **Commit:** ' || commit || '  ', '  **Message:** `' || message || '`  ',
  '  **Introduced:** ' || introduced_commit || '  ',
  '  **Removed:** ' || CASE WHEN removed_commit = '' THEN '(still present in HEAD)' ELSE removed_commit END || '  ',
  '  **Exposure:** ' || exposure_window || '  ') || chr(10) FROM shown
UNION ALL SELECT CASE WHEN count(*) = 0 THEN 'No secrets found.' ELSE '**Total unique findings:** ' || count(*) END FROM shown"""


def _rule_counts() -> str:
    names = ", ".join(f"({i}, {_q(r['name'])})" for i, r in enumerate(_rules(), 1))
    return f"""SELECT CAST(rule_id AS INTEGER) AS rule_id, name, count(match) AS n_findings
FROM (VALUES {names}) AS r(rule_id, name) LEFT JOIN ({_signature('lines', 'doc_id')}) ON type = name GROUP BY ALL"""


def _raw_scan() -> str:
    extra = {
        "wanted": f"SELECT path AS file, content FROM raw_tables WHERE {_SCANNED}",
        "wanted_lines": _lines("wanted", "file"),
    }
    return _with(f"SELECT DISTINCT file, line, type, match FROM ({_detect('wanted_lines', 'file')})",
                 "raw_tables", **extra)


def oracle_sql() -> dict[str, str]:
    key = "doc_id"
    commit = corpus._COMMIT.format("l_orderkey")
    bits = _entropy("(SELECT doc_id, content AS token FROM files)", key)
    masked = r"regexp_matches({0}, '^[* .\-]*$')"
    return {
        "scan_files": _with("SELECT * FROM scan", "scan"),
        "scan_incremental": _with("SELECT * FROM scan", "scan"),
        "scan_raw_tables": _raw_scan(),
        "scan_commit_snapshots": _with("SELECT * FROM snapshot", "snapshot"),
        "snapshot_files": _with("""SELECT commit, file, blob_id, strlen(content)::BIGINT AS size
FROM tree JOIN blobs USING (blob_id)""", "tree", "blobs"),
        "commit_order": _with("SELECT * FROM ordered", "ordered"),
        "commit_lookup": _with(f"""SELECT * FROM ordered
WHERE commit IN (SELECT {commit} FROM lineitem WHERE l_returnflag = 'R')""", "ordered"),
        "commit_topology": f"""WITH RECURSIVE links AS ({corpus.LINKS.format(**_TABLES)}),
walk(k, generation) AS (
  SELECT o_orderkey, 0::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT child FROM links)
  UNION SELECT child, generation + 1 FROM walk JOIN links ON parent = k
), longest AS (SELECT k, max(generation) AS generation FROM walk GROUP BY k)
SELECT commit, generation, row_number() OVER (ORDER BY generation, time, commit) - 1 AS order_index FROM (
  SELECT {corpus._COMMIT.format('k')} AS commit, generation, o_custkey AS time FROM longest JOIN orders ON o_orderkey = k
)""",
        "path_parts": _with(f"""SELECT doc_id, path, {_BASE} AS base, {_EXT} AS ext,
  CASE WHEN starts_with(path, 'repo/pkg/') THEN substr(path, 10) ELSE path END AS relative,
  '/srv/checkout/' || path AS "full" FROM files""", "files"),
        "filter_skip_dirs": _with(f"SELECT doc_id, path FROM files WHERE NOT {_IN_SKIPPED_DIR}", "files"),
        "filter_skip_files": _with(f"SELECT doc_id, path FROM files WHERE {_BASE} NOT IN {_list(fixed.SKIP_FILES)}",
                                   "files"),
        "filter_valid_ext": _with(f"SELECT doc_id, path FROM files WHERE ({_EXT}) IN {_list(fixed.VALID_EXTENSIONS)}",
                                  "files"),
        "filter_size_cap": f"""SELECT doc_id, size FROM (SELECT doc_id, strlen(text)::BIGINT * 100 AS size FROM documents)
WHERE size <= {fixed.MAX_BLOB_BYTES}""",
        "explode_lines": _with("SELECT doc_id, line, text FROM lines", "lines"),
        "line_limit": _with("SELECT doc_id, truncated, line, text FROM cut", "files",
                            marked=f"""SELECT doc_id, content, list_max(list_transform(string_split(content, chr(10)),
  lambda l: strlen(l))) >= {SHORT_LINE_LIMIT} AS truncated FROM files""",
                            cut=_lines("marked", "doc_id, truncated", SHORT_LINE_LIMIT)),
        "sig_match": _with(_signature("lines", key), "lines"),
        "sig_match_many": _with(_signature("lines", key), "lines"),
        "sig_counts_by_rule": _with(_rule_counts(), "lines"),
        "keyword_match": _with(_keyword("lines", key), "lines"),
        "valid_secret_value": _with(f"""SELECT doc_id, count(*) AS n_words, count(*) FILTER ({_valid('word')}) AS n_valid
FROM (SELECT doc_id, unnest(regexp_split_to_array(content, '[ \\n]')) AS word FROM files) GROUP BY doc_id""", "files"),
        "long_tokens": _with(_tokens("lines", key), "lines"),
        "token_noise": _with(f"""SELECT doc_id, line, token, {_REPEATS} AS repeats, {_NOISE} AS noise
FROM ({_tokens('lines', key)})""", "lines"),
        "shannon_entropy": _with(f"SELECT doc_id, round(bits, 6) AS entropy FROM ({bits})", "files"),
        "high_entropy": _with(_high_entropy("lines", key), "lines"),
        "detect_all": _with(_detect("lines", key), "lines"),
        "dedupe_findings": _with(
            f"SELECT DISTINCT path AS file, line, type, match FROM ({_detect('lines', key)}) JOIN files USING (doc_id)",
            "lines"),
        "sort_findings": _with("SELECT * FROM scan ORDER BY file, line, type, match", "scan"),
        "total_findings": _with("SELECT count(*) AS total_findings FROM scan", "scan"),
        "findings_by_type": _with("SELECT type, count(*) AS n_findings FROM scan GROUP BY type", "scan"),
        "findings_by_commit": _with("SELECT commit, count(*) AS n_findings FROM snapshot GROUP BY commit", "snapshot"),
        "secrets_per_commit": _with("SELECT DISTINCT commit, type, match FROM snapshot", "snapshot"),
        "history_findings": _with("SELECT snapshot.*, message FROM snapshot JOIN commits USING (commit)",
                                  "snapshot", "commits"),
        "commit_sequence": _with("SELECT * FROM sequence", "sequence"),
        "secret_lifecycle": _with("""SELECT type, match, introduced_commit, removed_commit, exposure_commits,
  still_present_in_head FROM life""", "life"),
        "exposure_intervals": _with("""SELECT type, match, s.commit AS introduced_commit, coalesce(e.commit, '') AS removed_commit, exposure_commits
FROM islands JOIN sequence s ON s.pos = first_pos LEFT JOIN sequence e ON e.pos = last_pos + 1""", "islands"),
        "tree_runs": _with("""SELECT file, blob_id, min(order_index) AS first_index, max(order_index) AS last_index
FROM (SELECT *, order_index - row_number() OVER (PARTITION BY file, blob_id ORDER BY order_index) AS island FROM placed)
GROUP BY file, blob_id, island""", "placed"),
        "lifecycle_from_runs": _with("""SELECT type, match, introduced_commit, removed_commit, exposure_commits,
  still_present_in_head FROM life""", "life"),
        "stream_lifecycle": _with("""SELECT type, match, introduced_commit, removed_commit, exposure_commits,
  still_present_in_head FROM life""", "life"),
        "exposure_window": _with("SELECT type, match, exposure_window FROM life", "life"),
        "history_report": _with("SELECT * FROM report ORDER BY file, line, type, match", "report"),
        "redact_match": _with(_redacted(f"SELECT *, match AS v FROM ({_detect('lines', key)})",
                                        "doc_id, line, type, match"), "lines"),
        "secret_prefix": _with(f"""SELECT {_PREFIX} AS prefix, count(*) AS n_lines
FROM (SELECT text AS v FROM lines) GROUP BY ALL""", "lines"),
        "redact_multiline": _with(_redacted("SELECT doc_id, content AS v FROM files", key), "files"),
        "multiline_secrets": _with(
            _redacted(f"SELECT file, line, last_line, {_q(fixed.BLOCK_TYPE)} AS type, match, match AS v FROM joined", "file, line, last_line, type, match"),
            "keys", key_lines=_lines("keys", "file"), marks=f"""SELECT file, line, m, row_number() OVER (PARTITION BY file ORDER BY line, k) AS r FROM (
  SELECT file, line, unnest(regexp_extract_all(text, {_q(_MARKER)})) AS m, generate_subscripts(regexp_extract_all(text, {_q(_MARKER)}), 1) AS k FROM key_lines)""",
            pairs="""SELECT * FROM (SELECT *, lead(line) OVER w AS last_line, lead(m) OVER w AS e FROM marks WINDOW w AS (PARTITION BY file ORDER BY r))
WHERE starts_with(m, '-----BEGIN') AND e = replace(m, '-----BEGIN', '-----END')""",
            joined="""SELECT file, p.line, last_line, string_agg(CASE
  WHEN p.line = last_line THEN m || split_part(split_part(text, m, -1), e, 1) || e
  WHEN l.line = p.line THEN m || split_part(text, m, -1) WHEN l.line = last_line THEN split_part(text, e, 1) || e ELSE text END, chr(10) ORDER BY l.line) AS match
FROM pairs p JOIN key_lines l USING (file) WHERE l.line BETWEEN p.line AND last_line GROUP BY file, p.line, last_line"""),
        "is_fully_masked": _with(f"""SELECT doc_id, count(*) FILTER ({masked.format('v')}) AS n_plain,
  count(*) FILTER ({masked.format('redacted')}) AS n_masked
FROM ({_redacted("SELECT doc_id, text AS v FROM lines", "doc_id, v")}) GROUP BY doc_id""", "lines"),
        "report_json": _with(_json_report(), "shown"),
        "report_markdown": _with(_markdown_report(), "shown"),
    }
