"""Inputs of the registered queries, all derived from the given tables.

The expressions are shared by Spark and the checking SQL, so that both see the same lines, names and entries;
what is done with them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.runtime import spread
from lumberline.sources.lines import lines_from_table

FILE = "CAST((event_id - event_id % 512) / 512 AS BIGINT)"
TID = "(1000 + CAST((event_id - event_id % 8) / 8 AS BIGINT) % 5)"


# Line templates by event_id % 32 (0 to 27), then those that replace one of them in some files or events.
TEMPLATES = [
    "{h}E AndroidRuntime: FATAL EXCEPTION: main",
    "{h}E AndroidRuntime: Process: com.example.app{u7}, PID: {u1000}",
    "{h}E AndroidRuntime: java.lang.IllegalStateException: bad state {e}",
    "{h}E AndroidRuntime:  at com.example.Main.run(Main.java:{e})",
    "{h}W Net: connection timeout =0x1f{u} retry {e}",
    "{h}I Player: open http://example.com/{e}",
    "Hello world, Now in BL33Z",
    "",
    "{t} D/FrameFeeder( 4410): #00 pc 0c{u11000}  /opt/feed/bin/feeder",
    "{t} D/FrameFeeder( 4410): #01 pc 0c{u12000}  /opt/feed/bin/feeder",
    "{t} D/Other( 99): #02 pc 0d{u13000}  /opt/feed/bin/other",
    "",
    "{t} W/System.err( {u1000}): java.lang.IllegalArgumentException: wake lock",
    "{t} W/System.err( {u1000}):  at android.os.Wake.release(Wake.java:{e97})",
    "{t} W/System.err( 1000):  at android.os.Wake.release(Wake.java:{e97})",
    "",
    "{h}F DEBUG   : *** *** *** *** *** *** *** *** *** *** *** *** *** *** *** ***",
    "{h}F DEBUG   : pid: {u1000}, tid: {u2000}, name: mixer  >>> /opt/run/feed{u5} <<<",
    "{h}F DEBUG   : signal 11 (SIGSEGV) fault addr 0x{e}",
    "",
    "{t} I/tombstoned( {u300}): tombstoned: received crash request",
    "",
    "[  {e}.000123] CPU: 0 PID: {u} Comm: worker{u3}",
    "[  {e}.000124] Hardware name: board (DT)",
    "[  {e}.000125] Unable to handle kernel paging request at 0000{e}",
    "ffffff80: {e} {e}",
    "[  {e}.000126] Modules linked in: frontcam",
    "[  {e}.000127] Kernel panic - not syncing",
    "plain text",
    "",
    "[  {e}.000999] svc: {type} for user {u}",
    "{h}I Svc: {type} handled for user {u} id={e}",
]
PLAIN, BLANK, KERNEL_SVC, SVC, OTHER_FRAME = 28, 29, 30, 31, 14
TEMPLATE = f"""CASE
  WHEN event_id % 32 IN (0, 1, 2, 3, 4, 5, 8, 9, 10, 12, 16, 17, 18, 20, 22, 24, 25, 26) THEN event_id % 32
  WHEN event_id % 32 = 6 AND {FILE} % 5 = 2 THEN 6
  WHEN event_id % 32 = 13 THEN CASE WHEN event_id % 64 = 13 THEN 13 ELSE {OTHER_FRAME} END
  WHEN event_id % 32 = 23 AND event_id % 512 < 32 THEN 23
  WHEN event_id % 32 = 27 THEN CASE WHEN event_id % 64 = 27 THEN 27 ELSE {PLAIN} END
  WHEN event_id % 32 = 28 THEN {BLANK}
  WHEN {FILE} % 4 = 1 THEN {KERNEL_SVC}
  ELSE {SVC} END"""

# What stands for each mark of a template; t is the event time as MM-dd HH:mm:ss.SSS.
MARKS = {
    "{h}": f"t || '  2000  ' || {TID} || ' '",
    "{t}": "t",
    "{e}": "event_id",
    "{e97}": "event_id % 97",
    "{u}": "user_id",
    "{u3}": "user_id % 3",
    "{u5}": "user_id % 5",
    "{u7}": "user_id % 7",
    "{u300}": "300 + user_id",
    "{u1000}": "1000 + user_id",
    "{u2000}": "2000 + user_id",
    "{u11000}": "11000 + user_id",
    "{u12000}": "12000 + user_id",
    "{u13000}": "13000 + user_id",
    "{type}": "event_type",
}


def log_line(pick: str) -> str:
    """The line of an event; ``pick`` spells, in the dialect at hand, choosing from an array of literals."""
    literals = ", ".join(f"'{template}'" for template in TEMPLATES)
    line = pick.format(literals, f"CAST({TEMPLATE} AS INT) + 1")
    for mark, value in MARKS.items():
        line = f"replace({line}, '{mark}', CAST({value} AS STRING))"
    return line


# A pattern per customer: overlapping, case-differing, anchored, blank and invalid ones.
PATTERN = """CASE
  WHEN c_custkey % 7 = 0 THEN ' user ' || (c_custkey % 40) || ' id= '
  WHEN c_custkey % 7 = 1 THEN 'NET: CONNECTION'
  WHEN c_custkey % 7 = 2 THEN '(' || c_mktsegment
  WHEN c_custkey % 7 = 3 THEN 'handled for user [0-9]+ id'
  WHEN c_custkey % 7 = 4 THEN '^Line [0-9]+: .*Process: '
  WHEN c_custkey % 7 = 5 THEN '^[0-9][0-9]-[0-9][0-9] .* E AndroidRuntime'
  ELSE CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'connection timeout' END
END"""

# A long list: many hundreds of distinct patterns, most of which match nothing, some read apart by Java and Python.
LONG_PATTERN = """CASE WHEN o_orderkey % 100 = 7 THEN 'user [' || (o_orderkey % 10) || '&&]+ id'
  ELSE 'user ' || (o_orderkey % 1000) || ' id' END"""

# Catalog: several suppliers share a normalised module name. Requests: one per customer, some names unknown.
MODULE_NAME = "CASE WHEN s_suppkey % 2 = 0 THEN 'Module_' || s_nationkey || '-Hal' ELSE 'module.' || s_nationkey || ' HAL' END"
MODULE_FILE = "'/patterns/' || s_suppkey || '.txt'"
REQUEST = "' module-' || c_nationkey || '-HAL, ,MODULE ' || (c_custkey % 30) || ' hal,,MODULE ' || (c_custkey % 30) || ' hal'"

# Archives: suppliers; directories inside them: groups of orders, some nested too deep.
ARCHIVE = "'/in/' || CASE WHEN l_suppkey % 10 = 3 THEN 'Bugreport-' ELSE 'result-' END || l_suppkey || '.zip'"
ENTRY = """CASE WHEN l_orderkey % 40 >= 30 THEN 'a/b/c/d' || (l_orderkey % 40) ELSE 'Run' || (l_orderkey % 40) END || '/' ||
CASE l_partkey % 8
  WHEN 0 THEN 'test_result.xml' WHEN 1 THEN 'Test_Result.html' WHEN 2 THEN 'test_result_failures_suite.html'
  WHEN 3 THEN 'module_reports/' WHEN 4 THEN 'report-log-files/' WHEN 5 THEN 'logcat.txt'
  WHEN 6 THEN CASE WHEN l_suppkey % 10 = 7 AND l_orderkey % 100 = 5 THEN 'dumpstate_board.txt' ELSE 'kernel.log' END
  ELSE CASE WHEN l_suppkey % 10 = 3 AND l_linenumber = 5 THEN 'bugreport-' || l_orderkey || '.txt' ELSE 'notes.md' END
END"""
ENTRY_POS = "l_orderkey * 8 + l_linenumber"

# Directory listing: one log set per order; some are not below a wrapper of their own module.
LOGSET = """'/ws/Cam' || (o_custkey % 50) || CASE o_orderkey % 3 WHEN 0 THEN '_Wrapper' WHEN 1 THEN '_wraper' ELSE '_other' END
|| '/' || o_orderkey || '/' || CASE WHEN o_orderkey % 11 = 0 THEN 'logs' ELSE 'cam' || (o_custkey % 50) || '_logset' END"""
FILE_PATH = """'/logs/' || o_custkey || '/' || o_orderstatus || '_' || o_orderkey ||
CASE o_orderkey % 5 WHEN 0 THEN '.log' WHEN 1 THEN '.TXT' WHEN 2 THEN '.log.gz' WHEN 3 THEN '.bin' ELSE '.Log' END"""

# One text per turn of a conversation.
TURN_ID = "conv_id * 1000 + turn"

# Chat answers wrapped in fences and tags.
MARKDOWN_ANSWER = """CASE conv_id % 4
  WHEN 0 THEN chr(10) || ' ```markdown title' || chr(10) || text || chr(10) || '``` '
  WHEN 1 THEN '```markdown' || chr(10) || text
  WHEN 2 THEN chr(9) || text || chr(10)
  ELSE NULL END"""
THINK_ANSWER = """CASE (conv_id + turn) % 4
  WHEN 0 THEN 'before <think> ' || role || chr(10) || ' </think>' || text
  WHEN 1 THEN '<think>' || text
  WHEN 2 THEN text
  ELSE '</think><think>' || text || '</think> after </think>' END"""
JSON_ANSWER = """CASE (conv_id + turn) % 8
  WHEN 0 THEN 'see ```json' || chr(10) || '{"conv": ' || conv_id || ', "role": "' || role || '"}' || chr(10) || '``` end'
  WHEN 1 THEN '```json {''conv'': ' || conv_id || ', ''role'': ''' || role || '''}```'
  WHEN 2 THEN '```json {conv: ' || conv_id || ', /* who */ role: "' || role || '"}```'
  WHEN 3 THEN '```json {"conv": ' || conv_id || ',}```'
  WHEN 4 THEN '```json {broken```'
  WHEN 5 THEN '```json {conv: +' || conv_id || ', share: .5, note: "+.5 0x1F"}```'
  WHEN 6 THEN '```json {"conv": 0x' || hex(conv_id) || ', "share": -' || (turn + 1) || '.}```'
  ELSE text END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_table(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text")


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr(f"{TURN_ID} AS turn_id", "text")
    return lines_from_table(spread(turns, "turn_id"), "turn_id", "text")


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_table(table(spark, sf_dir, "benchmark"), "item_id", "text")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = spread(table(spark, sf_dir, "events"), "event_id").withColumn("t", F.date_format("ts", "MM-dd HH:mm:ss.SSS"))
    # explode keeps the optimizer from copying the long expression into every later test of the line
    line = f"explode(array({log_line('element_at(array({}), {})')})) AS line"
    return timed.selectExpr(f"{FILE} AS file", "event_id % 512 + 1 AS line_no", line)


def long_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey AS module_key", f"{LONG_PATTERN} AS pattern")


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey AS module_key", f"{PATTERN} AS pattern")


# Patterns with classes and borders of words that read letters beyond ASCII, each with the same in explicit classes.
_WORD, _OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
LETTER_PATTERNS = {
    r"\bfür\b": f"(?:^|{_OTHER})für(?:$|{_OTHER})",
    r"\w+ción\b": f"{_WORD}+ción(?:$|{_OTHER})",
    r"ß\s\w": f"ß[\\s\\p{{Z}}]{_WORD}",
    r"\Bü\b": f"{_WORD}ü(?:$|{_OTHER})",
    r"^\w+é\W": f"^{_WORD}+é{_OTHER}",
}


def letter_patterns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(pattern,) for pattern in LETTER_PATTERNS], "pattern STRING")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [f"{MODULE_NAME} AS module_name", f"{MODULE_FILE} AS regex_file_path"]
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS pos", *named)


def module_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{REQUEST} AS request")


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_suppkey").selectExpr(
        f"{ARCHIVE} AS archive", f"{ENTRY_POS} AS pos", f"{ENTRY} AS entry"
    )


def logset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{LOGSET} AS path", "o_orderdate AS mtime")


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"{FILE_PATH} AS path", "o_orderdate AS mtime")


def answers(spark: SparkSession, sf_dir: str, wrapped: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", f"{wrapped} AS answer")
