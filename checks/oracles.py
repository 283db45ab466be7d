"""The checking SQL of every registered query, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

from checks import inputs
from checks.queries import CLASS_LINKS, GREP, LINE_LIMIT
from lumberline.functions.heads import BRIEF_NAME, THREADTIME_NAME

E_LINES = f"""log_lines AS (
  SELECT {inputs.FILE} AS file, event_id % 512 + 1 AS line_no,
  {inputs.log_line('list_extract([{}], {})')} AS line
  FROM (SELECT *, strftime(ts, '%m-%d %H:%M:%S.%g') AS t FROM events))"""



def _text_lines(name: str, table: str, text_id: str) -> str:
    return rf"""{name}_parts AS (
  SELECT id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts
  FROM (SELECT {text_id} AS id, string_split_regex(text, '\r\n|\r|\n') AS parts FROM {table})),
{name}_lines AS (
  SELECT id AS file, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS line FROM {name}_parts)"""


D_LINES = _text_lines("doc", "documents", "doc_id")
# Line formats that must be read as the operators read them.
THREADTIME = r"^\s*\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+(?:\d+\s+){1,2}(\d+)\s+[A-Z](?:\s|$)"
BRIEF = r"^\s*\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+[A-Z]/[^:]+\(\s*(\d+)\):"
LOG_HEAD = r"[0-9-]+\s+[0-9:.]+\s+[0-9]+\s+[0-9]+\s+\w(?:\s|$)"
NUMBERS = r"=0x[a-fA-F0-9]+|0x[a-fA-F0-9]+|=[a-fA-F0-9]+|\b[a-fA-F0-9]+\b"
# The stop words, written out here once more, so that a word the code lacks shows as a difference.
STOP_WORDS = """
a about above after again against ain all am an and any are aren as at
be because been before being below between both but by
can couldn d did didn do does doesn doing don down during each few for from further
had hadn has hasn have haven having he her here hers herself him himself his how
i if in into is isn it its itself just ll
m ma me mightn more most mustn my myself needn no nor not now
o of off on once only or other our ours ourselves out over own re
s same shan she should shouldn so some such
t than that the their theirs them themselves then there these they this those through to too
under until up ve very was wasn we were weren what when where which while who whom why will with won wouldn
y you your yours yourself yourselves
""".split()
# The stems of lines that tell of errors, written out here once more too.
ERROR_STEMS = (
    "error|fail|exception|panic|fatal|denied|crash|oops|segfault|abort|corrupt|not|dropped|err|disconnected|timeout|permission"
)
STOP_LIST = "[" + ", ".join(f"'{word}'" for word in STOP_WORDS) + "]"


def _replace(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"


def _fold(expr: str) -> str:
    steps = [
        (r"[^\x00-\x7F\P{L}]", "_"),
        (r"[^\x00-\x7F\P{N}]", "_"),
        (r"[^\x00-\x7F\P{Z}]", " "),
        (r"[\x0b\x1c-\x1f\x{85}]", " "),
        (r"[^\x00-\x7F]", "#"),
    ]
    for pattern, new in steps:
        expr = _replace(expr, pattern, new)
    return expr


def _key(line: str) -> str:
    bare = _replace(_replace(_fold(line), LOG_HEAD, ""), NUMBERS, "")
    words = f"string_split({_replace(bare, '[^a-zA-Z]+', ' ')}, ' ')"
    kept = f"list_filter({words}, lambda w: length(w) > 1 AND NOT list_contains({STOP_LIST}, lower(w)))"
    return f"array_to_string({kept}, ' ')"


def _cleaned(source: str, name: str = "cleaned") -> str:
    return f"""{name} AS (
  SELECT file, max(line_no) AS line_no, cleaned_log, arg_max(line, line_no) AS raw_log
  FROM (SELECT file, line_no, line, {_key('line')} AS cleaned_log FROM {source}
        WHERE NOT (contains(line, 'http://') OR contains(line, 'https://') OR contains(line, 'rtsp://')))
  GROUP BY file, cleaned_log)"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _stripped(expr: str) -> str:
    blanks = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    return _replace(expr, f"^{blanks}+|{blanks}+$", "")


TID = f"""CASE WHEN regexp_matches(line, '{THREADTIME}') THEN regexp_extract(line, '{THREADTIME}', 1)
  WHEN regexp_matches(line, '{BRIEF}') THEN regexp_extract(line, '{BRIEF}', 1) END"""

BATCH_AND_HISTORY = [
    D_LINES,
    _text_lines("turn", "conversations", inputs.TURN_ID),
    _cleaned("doc_lines", "batch"),
    _cleaned("turn_lines", "earlier"),
]


def _block_detector(name: str, start: str, member: str, pid: str, process: str, told_by: str) -> list[str]:
    """CTEs ending in ``<name>_rows``; ``told_by`` says which rows may name process and pid."""
    return [
        f"""{name}_cand AS (
  SELECT file, line_no, line, {start} AS is_start, {TID} AS tid FROM log_lines WHERE {start} OR {member})""",
        f"""{name}_marked AS (
  SELECT *, count(*) FILTER (WHERE is_start) OVER (PARTITION BY file ORDER BY line_no) AS block FROM {name}_cand)""",
        f"""{name}_blocks AS (
  SELECT *, first_value(tid) OVER (PARTITION BY file, block ORDER BY line_no) AS block_tid,
    CASE WHEN {told_by} AND {pid} <> '' THEN {{'process': {process}, 'pid': {pid}}} END AS told
  FROM {name}_marked WHERE block > 0)""",
        f"""{name}_rows AS (
  SELECT '{name}' AS detector, file AS file_name, min(line_no) AS start_line, max(line_no) AS end_line,
    coalesce(nullif(arg_min(told, line_no).process, ''), 'Unknown') AS process_name,
    coalesce(arg_min(told, line_no).pid, 'Unknown') AS pid,
    string_agg(line || chr(10), '' ORDER BY line_no) AS full_stack_trace,
    CAST(NULL AS VARCHAR) AS crash_type, CAST(0 AS INTEGER) AS trace_part
  FROM {name}_blocks WHERE is_start OR tid IS NOT DISTINCT FROM block_tid GROUP BY file, block)""",
    ]


def _extract(pattern: str, group: int = 1) -> str:
    return f"regexp_extract(line, '{pattern}', {group})"


# Marks, frames and attributes of the detectors.
PROCESS = r"Process:\s+(.+?),\s+PID:\s+(\d+)"
DETECTORS = {
    "debug": _block_detector(
        "debug",
        "contains(line, '*** *** *** *** *** *** *** *** *** *** *** *** *** *** *** ***')",
        "contains(line, 'DEBUG')",
        _extract(r"pid:\s*(\d+),\s*tid:\s*(\d+),"),
        _extract(r">>>\s+(.+?)\s+<<<"),
        "TRUE",
    ),
    "runtime": _block_detector(
        "runtime",
        "contains(lower(line), 'fatal exception')",
        "contains(line, 'AndroidRuntime')",
        _extract(PROCESS, 2),
        _extract(PROCESS, 1),
        "NOT is_start",
    ),
    "native": _block_detector(
        "native",
        r"regexp_matches(line, '#00\s+pc\s+[0-9a-fA-F]+')",
        r"regexp_matches(line, '#[0-9][0-9]\s+pc\s+[0-9a-fA-F]+')",
        _extract(r"([A-Za-z0-9_]+)\(\s*(\d+)\):", 2),
        _extract(r"([A-Za-z0-9_]+)\(\s*(\d+)\):", 1),
        "is_start",
    ),
    "java": _block_detector(
        "java",
        r"regexp_matches(line, 'java\.lang\.[a-zA-Z0-9_$]+Exception')",
        r"regexp_matches(line, '\s+at\s+[a-zA-Z0-9_$.]+\(')",
        _extract(r"([A-Za-z0-9_./]+)\(\s*(\d+)\):", 2),
        _extract(r"([A-Za-z0-9_./]+)\(\s*(\d+)\):", 1),
        "is_start",
    ),
    "keywords": [
        r"""keywords_rows AS (
  SELECT 'keywords' AS detector, file AS file_name, line_no AS start_line, line_no AS end_line,
    CASE WHEN contains(line, 'avc: denied') THEN coalesce(nullif(regexp_extract(line, 'comm="([^"]+)"', 1), ''), 'Unknown')
      ELSE 'Unknown' END AS process_name,
    coalesce(nullif(CASE WHEN contains(line, 'avc: denied') THEN regexp_extract(line, 'pid=(\d+)', 1)
      ELSE regexp_extract(line, '\(\s*(\d+)\):', 1) END, ''), 'Unknown') AS pid,
    line || chr(10) AS full_stack_trace, CAST(NULL AS VARCHAR) AS crash_type, CAST(0 AS INTEGER) AS trace_part
  FROM log_lines WHERE contains(line, 'tombstoned:') OR contains(line, '/system/bin/tombstoned'))"""
    ],
    "kernel_panic": [
        """panics AS (
  SELECT p.file, p.line_no AS panic_line, max(h.line_no) AS first_line FROM log_lines p JOIN log_lines h ON h.file = p.file
    AND h.line_no BETWEEN p.line_no - 199 AND p.line_no AND contains(h.line, 'Hardware name')
  WHERE contains(p.line, 'Kernel panic') GROUP BY p.file, p.line_no)""",
        r"""kernel_panic_rows AS (
  SELECT 'kernel_panic' AS detector, p.file AS file_name, first_line AS start_line, max(l.line_no) AS end_line,
    coalesce(nullif(any_value(CASE WHEN contains(b.line, 'PID:') AND contains(b.line, 'Comm:')
      THEN regexp_extract(b.line, 'Comm:\s+(\S+)', 1) END), ''), 'kernel') AS process_name,
    coalesce(nullif(any_value(CASE WHEN contains(b.line, 'PID:') AND contains(b.line, 'Comm:')
      THEN regexp_extract(b.line, 'PID:\s*(\d+)', 1) END), ''), 'unknown') AS pid,
    string_agg(l.line || chr(10), '' ORDER BY l.line_no) AS full_stack_trace,
    'kernel_panic' AS crash_type, CAST(0 AS INTEGER) AS trace_part
  FROM panics p JOIN log_lines l ON l.file = p.file AND l.line_no BETWEEN first_line AND panic_line + 6
  LEFT JOIN log_lines b ON b.file = p.file AND b.line_no = first_line - 1
  GROUP BY p.file, panic_line, first_line)"""
    ],
}


def _crashes(*names: str) -> str:
    parts = [E_LINES]
    for name in names:
        parts += DETECTORS[name]
    return _with(*parts, select=" UNION ALL ".join(f"SELECT * FROM {name}_rows" for name in names))


KERNEL_BLOCKS = r"""kernel_marks AS (
  SELECT file, line_no,
    regexp_matches(line, '(?i)Kernel panic|Internal error|Unable to handle kernel paging request|Oops:') AS is_start,
    regexp_matches(line, '(?i)Modules linked in:|---\[ end trace')
      AND NOT regexp_matches(line, '^\s*([0-9a-fA-F]{8}|[0-9a-fA-F]{16})[: ]') AS is_end
  FROM log_lines),
segments AS (
  SELECT *, coalesce(count(*) FILTER (WHERE is_end) OVER (
    PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment
  FROM kernel_marks WHERE is_start OR is_end),
kernel_found AS (
  SELECT file, min(line_no) FILTER (WHERE is_start) AS start_line, max(line_no) FILTER (WHERE is_end) AS end_line
  FROM segments GROUP BY file, segment)"""

# What makes a file kernel or logcat.
FILE_TYPES = r"""kinds AS (
  SELECT file, line_no, CASE
    WHEN regexp_matches(line, '\[\s*\d+\.\d+(?:@\d+)?\]') THEN 'kernel'
    WHEN regexp_matches(trim(line), '^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+\s+(\d+\s+\d+\s+)?[VDIWEF]') THEN 'logcat'
    WHEN contains(line, 'Hello world, Now in BL33Z') THEN 'banner' END AS kind
  FROM log_lines),
counted AS (
  SELECT *, CASE WHEN kind IS NOT NULL THEN row_number() OVER (PARTITION BY file, kind ORDER BY line_no) END AS nth FROM kinds),
decided AS (
  SELECT file, min(line_no) FILTER (WHERE (kind = 'kernel' AND nth = 20) OR (kind = 'banner' AND nth = 1)) AS kernel_at,
    min(line_no) FILTER (WHERE kind = 'logcat' AND nth = 20) AS logcat_at FROM counted GROUP BY file),
file_types AS (
  SELECT file, CASE WHEN kernel_at IS NOT NULL AND (logcat_at IS NULL OR kernel_at < logcat_at) THEN 'kernel'
    WHEN logcat_at IS NOT NULL THEN 'logcat' ELSE 'unknown' END AS file_type FROM decided)"""


def _grep(source: str, regex: str, up: int, down: int) -> str:
    return f"""found AS (
  SELECT DISTINCT l.file, l.line_no, l.line, regexp_matches(l.line, '{regex}') AS is_match
  FROM {source} l JOIN {source} h ON h.file = l.file AND l.line_no BETWEEN h.line_no - {up} AND h.line_no + {down}
  WHERE regexp_matches(h.line, '{regex}'))"""


MODULE_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
MODULES = f"""catalog AS (
  SELECT s_suppkey AS pos, {inputs.MODULE_NAME} AS module_name, {inputs.MODULE_FILE} AS regex_file_path FROM supplier),
catalog_keys AS (
  SELECT {MODULE_KEY.format('module_name')} AS module_key, arg_min(regex_file_path, pos) AS regex_file_path
  FROM catalog GROUP BY 1),
wanted AS (
  SELECT *, {MODULE_KEY.format('module_name')} AS module_key FROM (
    SELECT DISTINCT c_custkey, trim(unnest(string_split({inputs.REQUEST}, ','))) AS module_name FROM customer)
  WHERE module_name <> '')"""

PATTERNS = f"""patterns AS (
  SELECT DISTINCT trim({inputs.PATTERN}) AS pattern FROM customer WHERE trim({inputs.PATTERN}) <> ''),
usable AS (SELECT pattern FROM patterns WHERE pattern NOT LIKE '(%')"""

FILTERED = f"""filtered AS (
  SELECT file, line_no, raw_log AS log FROM cleaned WHERE EXISTS (
    SELECT 1 FROM usable WHERE regexp_matches('Line ' || line_no || ': ' || raw_log, pattern)))"""


def _mapped(source: str, most: int) -> str:
    return f"""mapped AS (
  SELECT l.file, l.line_no, l.log, coalesce(m.pattern, '') AS regex FROM {source} l LEFT JOIN (
    SELECT file, line_no, pattern, row_number() OVER (PARTITION BY file, line_no ORDER BY pattern) AS nth
    FROM {source} JOIN usable ON regexp_matches(log, '(?i)' || pattern)) m
  ON m.file = l.file AND m.line_no = l.line_no AND nth <= {most})"""


PATTERN_BASE = [E_LINES, _cleaned("log_lines"), PATTERNS, FILTERED]

ENTRIES = f"""entries AS (
  SELECT {inputs.ARCHIVE} AS archive, {inputs.ENTRY_POS} AS pos, {inputs.ENTRY} AS entry FROM lineitem),
result_dirs AS (
  SELECT archive, regexp_extract(lower(entry), '^(.*/)[^/]+/?$', 1) AS parent,
    count(DISTINCT CASE WHEN regexp_extract(lower(entry), '([^/]+/?)$', 1) IN ('test_result.xml', 'test_result.html',
      'test_result_failures_suite.html', 'module_reports/', 'report-log-files/')
      AND length(entry) - length(replace(entry, '/', '')) <= 3
      THEN regexp_extract(lower(entry), '([^/]+/?)$', 1) END) AS held
  FROM entries GROUP BY 1, 2),
results AS (SELECT archive, bool_or(held = 5) AS is_test_result FROM result_dirs GROUP BY archive),
reports AS (
  SELECT archive, bool_or(regexp_matches(lower(archive), '/bugreport-[^/]*\\.zip$')
      OR regexp_matches(lower(entry), '^bugreport-.*\\.txt$|dumpstate_board\\.txt$|dumpstate_log\\.txt$|version\\.txt$'))
      AS is_bugreport,
    (min({{'pos': pos, 'entry': entry}}) FILTER (WHERE lower(entry) LIKE '%bugreport%.txt')).entry AS core_entry
  FROM entries GROUP BY archive)"""


def _answers(wrapped: str) -> str:
    return f"told AS (SELECT conv_id, turn, role, text, {wrapped} AS answer FROM conversations)"


LINKS = " ".join(f"WHEN '{name}' THEN '{link}'" for name, link in CLASS_LINKS.items())
CLASS_TYPE = "CASE WHEN p_size % 11 < 10 THEN 'class_' || (p_size % 11) END"

ORACLES: dict[str, str] = {
    "clean_dedup": _with(D_LINES, _cleaned("doc_lines"), select="SELECT * FROM cleaned"),
    "clean_dedup_logcat": _with(E_LINES, _cleaned("log_lines"), select="SELECT * FROM cleaned"),
    "clean_preview": _with(
        E_LINES, _cleaned("log_lines"), select="SELECT * FROM cleaned ORDER BY file, line_no LIMIT 10"
    ),
    "rendered_lines": _with(
        E_LINES,
        _cleaned("log_lines"),
        select="SELECT file, line_no, 'Line ' || line_no || ': ' || raw_log AS value FROM cleaned",
    ),
    "url_lines_dropped": _with(
        E_LINES, select="SELECT * FROM log_lines WHERE NOT regexp_matches(line, '(https?|rtsp)://')"
    ),
    "normalize_line": _with(
        D_LINES,
        select="SELECT file, line_no, trim("
        + _replace(
            _replace(_replace(_replace(_fold("line"), "0x[0-9a-fA-F]+", ""), r"\b\d+\b", ""), r"[^a-zA-Z\s]", ""),
            r"\s+",
            " ",
        )
        + ") AS normalized FROM doc_lines",
    ),
    "stop_words_removed": _with(
        D_LINES,
        select=f"""SELECT file, line_no, array_to_string(list_filter(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+'),
  lambda w: NOT list_contains({STOP_LIST}, lower(w))), ' ') AS words
  FROM doc_lines""",
    ),
    "log_info": _with(
        E_LINES,
        select=f"""SELECT file, line_no, CASE WHEN regexp_matches(line, '{THREADTIME}') THEN '{THREADTIME_NAME}'
  WHEN regexp_matches(line, '{BRIEF}') THEN '{BRIEF_NAME}' ELSE 'Unknown' END AS type, {TID} AS thread_id FROM log_lines""",
    ),
    "error_lines": _with(
        D_LINES,
        select=f"SELECT * FROM doc_lines WHERE regexp_matches(line, '{ERROR_STEMS}', 'i')",
    ),
    "error_lines_logcat": _with(
        E_LINES,
        select=f"SELECT * FROM log_lines WHERE regexp_matches(line, '{ERROR_STEMS}', 'i')",
    ),
    "error_counts_by_source": _with(
        D_LINES,
        select=f"""SELECT source, CAST(count(*) AS BIGINT) AS error_lines FROM doc_lines JOIN documents ON doc_id = file
  WHERE regexp_matches(line, '{ERROR_STEMS}', 'i') GROUP BY source""",
    ),
    "long_lines": _with(
        D_LINES,
        select=f"SELECT file, line_no, CAST(length(line) AS INTEGER) AS n_chars FROM doc_lines WHERE length(line) <= {LINE_LIMIT}",
    ),
    "grep_context": _with(E_LINES, _grep("log_lines", GREP, 3, 3), select="SELECT * FROM found"),
    "grep_context_down": _with(D_LINES, _grep("doc_lines", "tion[.,]", 0, 1), select="SELECT * FROM found"),
    "grep_groups": _with(
        E_LINES,
        _grep("log_lines", GREP, 2, 0),
        select="""SELECT file, CAST(0 AS BIGINT) AS part,
  string_agg('line ' || line_no || ': ' || trim(line), chr(10) ORDER BY line_no) AS match_lines FROM found GROUP BY file""",
    ),
    "line_range": _with(
        D_LINES,
        select="""SELECT * FROM doc_lines WHERE line_no BETWEEN 2 AND 6
  AND file IN (SELECT file FROM doc_lines GROUP BY file HAVING count(*) >= 8)""",
    ),
    "line_range_errors": _with(
        D_LINES,
        select="""SELECT file, count(*) AS total_lines, 'file has ' || count(*) || ' lines, requested 2-8' AS message
  FROM doc_lines GROUP BY file HAVING count(*) < 8""",
    ),
    "kept_line_range": _with(
        D_LINES,
        select="""SELECT * FROM doc_lines WHERE line_no BETWEEN 2 AND 6
  AND file IN (SELECT file FROM doc_lines GROUP BY file HAVING count(*) >= 8)""",
    ),
    "kept_line_range_errors": _with(
        D_LINES,
        select="""SELECT file, count(*) AS total_lines, 'file has ' || count(*) || ' lines, requested 2-8' AS message
  FROM doc_lines GROUP BY file HAVING count(*) < 8""",
    ),
    "crash_debug": _crashes("debug"),
    "crash_runtime": _crashes("runtime"),
    "crash_native": _crashes("native"),
    "crash_java": _crashes("java"),
    "crash_keywords": _crashes("keywords"),
    "crash_kernel_panic": _crashes("kernel_panic"),
    "crash_all": _crashes("debug", "runtime", "native", "keywords", "kernel_panic"),
    "kernel_blocks": _with(
        E_LINES,
        KERNEL_BLOCKS,
        select=r"""SELECT k.file, start_line, end_line, CAST(0 AS INTEGER) AS part,
  string_agg(line || chr(10), '' ORDER BY line_no) AS block
  FROM kernel_found k JOIN log_lines l ON l.file = k.file AND line_no BETWEEN start_line AND end_line
  WHERE NOT regexp_matches(line, '^\s*([0-9a-fA-F]{8}|[0-9a-fA-F]{16})[: ]') GROUP BY k.file, start_line, end_line""",
    ),
    "file_types": _with(E_LINES, FILE_TYPES, select="SELECT * FROM file_types"),
    "files_by_type": _with(
        E_LINES,
        FILE_TYPES,
        select="""SELECT file_type, CAST(0 AS BIGINT) AS part, string_agg(file, ',' ORDER BY file) AS files
  FROM file_types GROUP BY file_type""",
    ),
    "store_new_records": _with(
        *BATCH_AND_HISTORY,
        select=f"""SELECT sha256(cleaned_log) AS record_id, cleaned_log,
  {_stripped("arg_min(raw_log, file * 1000000 + line_no)")} AS raw_log
  FROM batch WHERE cleaned_log NOT IN (SELECT cleaned_log FROM earlier) GROUP BY cleaned_log""",
    ),
    "store_committed": _with(
        *BATCH_AND_HISTORY,
        """both_logs AS (SELECT 1 AS nth, * FROM earlier UNION ALL SELECT 2 AS nth, * FROM batch
  WHERE cleaned_log NOT IN (SELECT cleaned_log FROM earlier))""",
        select=f"""SELECT sha256(cleaned_log) AS record_id, cleaned_log,
  {_stripped("arg_min(raw_log, file::HUGEINT * 1000000 + line_no)")} AS raw_log
  FROM both_logs GROUP BY nth, cleaned_log""",
    ),
    "stored_keys": _with(D_LINES, _cleaned("doc_lines"), select="SELECT DISTINCT cleaned_log FROM cleaned"),
    "subtract_known": _with(
        *BATCH_AND_HISTORY, select="SELECT * FROM batch WHERE cleaned_log NOT IN (SELECT cleaned_log FROM earlier)"
    ),
    "store_counts": _with(
        *BATCH_AND_HISTORY,
        select="""SELECT processed, processed - new AS skipped, new FROM (
  SELECT count(*) AS processed, count(DISTINCT cleaned_log) FILTER (
    WHERE cleaned_log NOT IN (SELECT cleaned_log FROM earlier)) AS new FROM batch)""",
    ),
    "known_duplicates_excluded": _with(
        D_LINES,
        _cleaned("doc_lines"),
        _text_lines("item", "benchmark", "item_id"),
        _cleaned("item_lines", "known"),
        select="SELECT * FROM cleaned WHERE cleaned_log NOT IN (SELECT cleaned_log FROM known)",
    ),
    "module_lookup": _with(
        MODULES, select="SELECT c_custkey, module_name, module_key, regex_file_path FROM wanted JOIN catalog_keys USING (module_key)"
    ),
    "module_unknown": _with(
        MODULES,
        select="""SELECT c_custkey, module_name, module_key FROM wanted
  WHERE module_key NOT IN (SELECT module_key FROM catalog_keys)""",
    ),
    "module_names": _with(MODULES, select="SELECT pos, module_name FROM catalog"),
    "patterns_combined": _with(
        PATTERNS, select="SELECT pattern, pattern NOT LIKE '(%' AS valid FROM patterns ORDER BY pattern"
    ),
    "patterns_invalid": _with(PATTERNS, select="SELECT pattern FROM patterns WHERE pattern LIKE '(%'"),
    "pattern_filter": _with(*PATTERN_BASE, select="SELECT * FROM filtered"),
    "pattern_mapping": _with(*PATTERN_BASE, _mapped("filtered", 1), select="SELECT * FROM mapped"),
    "pattern_mapping_top2": _with(*PATTERN_BASE, _mapped("filtered", 2), select="SELECT * FROM mapped"),
    "pattern_mapping_all_lines": _with(
        E_LINES,
        _cleaned("log_lines"),
        PATTERNS,
        "all_lines AS (SELECT file, line_no, raw_log AS log FROM cleaned)",
        _mapped("all_lines", 1),
        select="SELECT * FROM mapped",
    ),
    "pattern_mapping_long_list": _with(
        E_LINES,
        _cleaned("log_lines"),
        f"usable AS (SELECT DISTINCT {inputs.LONG_PATTERN} AS pattern FROM orders)",
        "all_lines AS (SELECT file, line_no, raw_log AS log FROM cleaned)",
        _mapped("all_lines", 2),
        select="SELECT * FROM mapped",
    ),
    "pattern_mapping_letters": _with(
        D_LINES,
        "usable(shown, pattern) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in inputs.LETTER_PATTERNS.items()) + ")",
        select="""SELECT l.file, l.line_no, l.line AS log, coalesce(m.shown, '') AS regex FROM doc_lines l LEFT JOIN (
    SELECT file, line_no, shown, row_number() OVER (PARTITION BY file, line_no ORDER BY shown) AS nth
    FROM doc_lines JOIN usable ON regexp_matches(line, '(?i)' || pattern)) m
  ON m.file = l.file AND m.line_no = l.line_no AND nth <= 2""",
    ),
    "pattern_stats": _with(
        *PATTERN_BASE,
        _mapped("filtered", 2),
        select="""SELECT count(DISTINCT (file, line_no)) AS lines_total,
  count(DISTINCT (file, line_no)) FILTER (WHERE regex <> '') AS lines_with_match, count(*) AS rows_written,
  (SELECT count(*) FROM patterns WHERE pattern LIKE '(%') AS invalid_patterns FROM mapped""",
    ),
    "parse_clean_line": _with(
        E_LINES,
        select="""SELECT file, line_no AS at, CASE WHEN line_no % 3 <> 2 THEN line_no END AS line_no,
  CASE WHEN line_no % 3 <> 2 THEN ltrim(line) ELSE line END AS log FROM log_lines""",
    ),
    "rendered_tails": _with(E_LINES, select="SELECT file, line_no, trim(line) AS raw_log FROM log_lines"),
    "truncate_lines": _with(
        D_LINES,
        select="""SELECT file, line_no, CASE WHEN total <= 300 THEN line ELSE line[:300] END AS line FROM (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY file ORDER BY line_no) AS total FROM doc_lines)
  WHERE total <= 300 OR line_no = 1""",
    ),
    "truncate_content": _with(
        r"unified AS (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents)",
        """ends AS (
  SELECT doc_id, text, list_filter(range(1, 301), lambda i: text[i] = chr(10)) AS breaks FROM unified)""",
        select="""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN len(breaks) > 0 THEN text[:list_max(breaks)]
  ELSE text[:300] END AS content FROM ends""",
    ),
    "truncate_chars": "SELECT doc_id, substring(text, 1, 120) AS content FROM documents",
    "char_lengths": "SELECT doc_id, length(replace(text, chr(10), '')) AS n_chars_no_lf FROM documents",
    "used_lines": _with(
        D_LINES,
        """reach AS (
  SELECT file, line_no, length(line) AS n, sum(length(line)) OVER (PARTITION BY file ORDER BY line_no) AS total
  FROM doc_lines WHERE line_no > 1 AND line_no <= 5)""",
        """fit AS (
  SELECT file, count(*) FILTER (WHERE total <= 150) AS fit, arg_min(n, line_no) FILTER (WHERE total > 150) AS next_n
  FROM reach GROUP BY file)""",
        select="""SELECT f.file, CAST(CASE WHEN fit >= 4 THEN 4 WHEN next_n > 150 THEN fit + 1 ELSE coalesce(fit, 0) END AS BIGINT) AS used
  FROM (SELECT DISTINCT file FROM doc_lines) f LEFT JOIN fit USING (file)""",
    ),
    "markdown_table": """SELECT CAST(2 AS INTEGER) AS section, s_suppkey,
  '| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |' AS line FROM supplier
  UNION ALL SELECT 0, NULL, '| s_suppkey | s_name | s_nationkey |' UNION ALL SELECT 1, NULL, '| --- | --- | --- |'""",
    "think_removed": _with(
        _answers(inputs.THINK_ANSWER),
        select="""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN text WHEN 3 THEN ' after </think>' ELSE answer END
  AS answer FROM told""",
    ),
    "think_extracted": _with(
        _answers(inputs.THINK_ANSWER),
        select=f"""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN role WHEN 3 THEN {_stripped('text')} END
  AS thought FROM told""",
    ),
    "fence_markdown": _with(
        _answers(inputs.MARKDOWN_ANSWER),
        select=f"""SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN {_stripped('text')} WHEN 3 THEN ''
  ELSE {_stripped('answer')} END AS answer FROM told""",
    ),
    "fence_json": """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 8 IN (0, 1, 2, 3, 5, 6) THEN conv_id END AS conv,
  CASE WHEN (conv_id + turn) % 8 < 3 THEN role END AS role,
  CASE (conv_id + turn) % 8 WHEN 5 THEN 0.5::DOUBLE WHEN 6 THEN -(turn + 1)::DOUBLE END AS share,
  CASE WHEN (conv_id + turn) % 8 = 5 THEN '+.5 0x1F' END AS note FROM conversations""",
    "class_links": f"SELECT p_partkey, CASE {CLASS_TYPE} {LINKS} ELSE '' END AS link FROM part",
    "archive_test_results": _with(ENTRIES, select="SELECT * FROM results"),
    "archive_bugreports": _with(ENTRIES, select="SELECT * FROM reports"),
    "archive_actions": _with(
        ENTRIES,
        select="""SELECT archive, CASE WHEN is_bugreport THEN CASE WHEN core_entry IS NULL THEN 'skip' ELSE 'core' END
  WHEN is_test_result THEN 'skip' ELSE 'all' END AS action, CASE WHEN is_bugreport THEN core_entry END AS only_entry
  FROM reports JOIN results USING (archive)""",
    ),
    "latest_logset": f"""SELECT regexp_extract(lower(path), '/(cam[0-9]+)_logset$', 1) AS module,
  max({{'mtime': mtime, 'path': path}}).path AS path
  FROM (SELECT {inputs.LOGSET} AS path, o_orderdate AS mtime, 'cam' || (o_custkey % 50) AS m FROM orders)
  WHERE lower(path) LIKE '%\\_logset' ESCAPE '\\' AND (contains(lower(path), '/' || m || '_wrapper/')
    OR contains(lower(path), '/' || m || '_wraper/')) GROUP BY 1""",
    "log_files": f"""SELECT path FROM (SELECT {inputs.FILE_PATH} AS path FROM orders)
  WHERE lower(path) LIKE '%.log' OR lower(path) LIKE '%.txt'""",
    "files_kept_by_name": f"""SELECT path FROM (SELECT {inputs.FILE_PATH} AS path FROM orders)
  WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^F_.*[05]\\.')""",
}
