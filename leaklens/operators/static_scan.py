"""Detection over plugin source text (D1-D10, J6): scanner rules as Spark jobs.

The reference runs an AST matcher per plugin.  Here every rule is a
line-level regular expression over ``(path, line_no, line)`` rows made by
``posexplode(split(content, '\\n'))`` of whole files - a textual
approximation with the same rule ids and the same output shape as the
scanner's findings table.  The definitions below are the contract (the
DuckDB oracle uses the same expressions):

* line rules, all evaluated in ONE pass (array of matching ids, exploded):
  D1 ``file_put_contents(`` whose first argument (up to the first comma)
  contains ``log``; D7 a ``wp_upload_dir(`` call; D8 ``/wp-content/`` in the
  line; D9/D10 ``define('WP_DEBUG'|'WP_DEBUG_LOG', true)``, blanks free.
* assignment-before-use rules D2-D6 (J6): ``$v = expr;`` on an earlier line
  of the same file, then ``sink($v, ...)``.  Scope is the file, not the
  block (over-matches across functions).  The latest earlier qualifying
  assignment is found with a window ``last(ignorenulls)`` per (file, var) -
  linear, never the pairwise self-join; a file is read whole by one task,
  so a (file, var) window never exceeds one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.functions.scalar import strip_plugins_dir
from leaklens.operators.merge import dense_ids

# ---------------------------------------------------------------------------
# Rule ids of the scanner rule file and our textual contract.
# ---------------------------------------------------------------------------
# Blanks: one explicit class, so Java (Spark) and RE2 (oracle) agree exactly.
WS = r"[ \t\n\x0B\f\r]"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"

LINE_RULES: dict[str, tuple[str, str]] = {
    # rule id: (kind, expression) - kind "re" = regex search, "contains" = substring
    "file-put-contents_": ("re", rf"file_put_contents{WS}*\([^,]*log"),
    "wp-upload-dir_": ("re", rf"wp_upload_dir{WS}*\("),
    "hardcoded-wp-content-path": ("contains", "/wp-content/"),
    "WP-DEBUG_enabling": ("re", rf"""define{WS}*\({WS}*['"]WP_DEBUG['"]{WS}*,{WS}*(?i:true){WS}*\)"""),
    "WP-DEBUG-LOG_enabling": ("re", rf"""define{WS}*\({WS}*['"]WP_DEBUG_LOG['"]{WS}*,{WS}*(?i:true){WS}*\)"""),
}

ASSIGN_RE = rf"^{WS}*\$({IDENT}){WS}*={WS}*([^;]*);"
USE_RE = rf"(file_put_contents|fopen|fwrite|fprintf|fputs){WS}*\({WS}*\$({IDENT}){WS}*,"

# sink function -> (rule id, which qualification of the assigned expression)
VAR_RULES = {
    "file_put_contents": ("file-put-contents_log-file-var-assignment", "log"),
    "fopen": ("fopen_var-assignment", "log"),
    "fwrite": ("fwrite_with-fopen", "fopen_log"),
    "fprintf": ("fprintf_with-fopen", "fopen_log"),
    "fputs": ("fputs_with-fopen", "fopen_log"),
}
QUALIFY = {"log": r"log", "fopen_log": r"(?s)fopen\(.*log.*\)"}

# rule id -> the message its findings carry
MESSAGES = {
    "file-put-contents_": "Possible file write sink file_put_contents",
    "file-put-contents_log-file-var-assignment": "Variable passed to file_put_contents contains 'log'",
    "fopen_var-assignment": "Variable passed to file_put_contents contains 'log'",
    "fwrite_with-fopen": "Variable passed to file_put_contents contains 'log'",
    "fprintf_with-fopen": "Variable passed to file_put_contents contains 'log'",
    "fputs_with-fopen": "Variable passed to file_put_contents contains 'log'",
    "wp-upload-dir_": "Use of wp_upload_dir (may indicate log or file path handling)",
    "hardcoded-wp-content-path": "Hardcoded path under /wp-content/ detected",
    "WP-DEBUG_enabling": "Plugin enabled WP_DEBUG is assumed to be FALSE in wp-config.php",
    "WP-DEBUG-LOG_enabling": "Plugin enabled WP_DEBUG_LOG is assumed to be FALSE in wp-config.php",
}

SCAN_EXCLUDE_RE = r"/(vendor|tests)/"


def php_sources(files: DataFrame, path: str = "path") -> DataFrame:
    """Only ``*.php`` files outside vendor and tests directories."""
    return files.filter(F.col(path).endswith(".php") & ~F.col(path).rlike(SCAN_EXCLUDE_RE))


def slug_of(path_col: str = "path") -> F.Column:
    """Plugin directory of a source path ``plugins/<slug>/...``."""
    return F.regexp_extract(F.col(path_col), r"^plugins/([^/]+)/", 1)


def source_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Whole files -> one row per line with its 1-based number."""
    return files.select(
        F.col(path).alias("path"),
        slug_of(path).alias("plugin_slug"),
        F.posexplode(F.split(F.col(content), "\n")).alias("pos", "line"),
    ).select("path", "plugin_slug", (F.col("pos") + 1).alias("line_no"), "line")


def _rule_pred(kind: str, expr: str) -> F.Column:
    return F.col("line").contains(expr) if kind == "contains" else F.col("line").rlike(expr)


_QSTRUCT = "struct<n:int,text:string>"


def _records(lines: DataFrame, line_rules: bool, var_rules: bool) -> DataFrame:
    """Per line, the small tagged records the rules need (most lines give none):
    ``hit`` (a line rule matched), ``a`` (an assignment), ``u`` (a sink use)."""
    def rec(kind, rule_id, var, sink, quals):
        return F.struct(F.lit(kind).alias("kind"), rule_id.alias("rule_id"), var.alias("var"),
                        sink.alias("sink"), *[q.alias(f"q_{n}") for n, q in quals.items()])

    null_s = F.lit(None).cast("string")
    no_q = {n: F.lit(None).cast(_QSTRUCT) for n in QUALIFY}
    recs = []
    if line_rules:
        for r, (k, e) in LINE_RULES.items():
            recs.append(F.when(_rule_pred(k, e), rec("hit", F.lit(r), null_s, null_s, no_q)))
    if var_rules:
        line_struct = F.struct(F.col("line_no").cast("int").alias("n"), F.col("line").alias("text"))
        expr = F.regexp_extract("line", ASSIGN_RE, 2)
        quals = {n: F.when(expr.rlike(q), line_struct) for n, q in QUALIFY.items()}
        recs.append(F.when(F.col("line").rlike(ASSIGN_RE),
                           rec("a", null_s, F.regexp_extract("line", ASSIGN_RE, 1), null_s, quals)))
        recs.append(F.when(F.col("line").rlike(USE_RE),
                           rec("u", null_s, F.regexp_extract("line", USE_RE, 2),
                               F.regexp_extract("line", USE_RE, 1), no_q)))
    arr = F.filter(F.array(*recs), lambda x: x.isNotNull())
    return (lines.select("path", "plugin_slug", "line_no", "line", F.explode(arr).alias("r"))
            .select("path", "plugin_slug", "line_no", "line", "r.*"))


def _findings(recs: DataFrame) -> DataFrame:
    """One window over (path, var) turns uses into findings; hits pass through.

    ``last(.., ignorenulls)`` over lines strictly before the current one
    (``rangeBetween(unboundedPreceding, -1)``) carries the latest earlier
    assignment of each qualification forward - linear, never the pairwise
    assignment x use self-join.
    """
    w = Window.partitionBy("path", "var").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    carried = recs.select(
        "path", "plugin_slug", "line_no", "line", "kind", "rule_id", "sink",
        *[F.last(f"q_{n}", ignorenulls=True).over(w).alias(f"c_{n}") for n in QUALIFY])
    var_rule = F.lit(None).cast("string")
    qual = F.lit(None).cast(_QSTRUCT)
    for sink, (rid, qname) in VAR_RULES.items():
        var_rule = F.when(F.col("sink") == sink, F.lit(rid)).otherwise(var_rule)
        qual = F.when(F.col("sink") == sink, F.col(f"c_{qname}")).otherwise(qual)
    is_hit = F.col("kind") == "hit"
    out = carried.select(
        "kind", "path", "plugin_slug", "line_no", "line",
        F.when(is_hit, F.col("rule_id")).otherwise(var_rule).alias("rule_id"),
        F.when(is_hit, F.lit(None).cast(_QSTRUCT)).otherwise(qual).alias("a"))
    found = out.filter(is_hit | ((F.col("kind") == "u") & F.col("a").isNotNull()))
    return found.select(
        "rule_id", "plugin_slug", strip_plugins_dir("path").alias("file_path"),
        F.when(is_hit, F.col("line_no")).otherwise(F.col("a.n")).alias("start_line"),
        F.col("line_no").alias("end_line"),
        F.when(is_hit, F.col("line")).otherwise(F.concat(F.col("a.text"), F.lit("\n"), F.col("line"))).alias("lines"))


def line_rule_findings(lines: DataFrame) -> DataFrame:
    """D1, D7-D10 in one pass: matching rule ids per line, exploded; no shuffle."""
    hits = _records(lines, True, False)
    return hits.select("rule_id", "plugin_slug", strip_plugins_dir("path").alias("file_path"),
                       F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("lines"))


def var_rule_findings(lines: DataFrame) -> DataFrame:
    """D2-D6 (J6): latest earlier qualifying assignment of the used variable."""
    return _findings(_records(lines, False, True))


def scan_sources(files: DataFrame) -> DataFrame:
    """S8 + all ten rules over a source tree in ONE scan of the text:
    findings (rule, plugin, file, start, end, lines)."""
    return _findings(_records(source_lines(php_sources(files)), True, True))


def scan_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S8 + S9: a scan in the warehouse's shape, (runs, findings), that J1 and
    every report read.

    One run per plugin that has a scanned file, also without findings, numbered
    by slug; a text scan has no scanner errors.  Findings are numbered by run,
    file, lines and rule, so a repeated scan gives the same ids.
    """
    slugs = php_sources(files).select(slug_of().alias("plugin_slug")).distinct()
    runs = dense_ids(slugs, ["plugin_slug"], "run_id").select(
        "run_id", "plugin_slug", F.lit(0).alias("error_count"), F.lit("null").alias("errors"))
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    found = scan_sources(files).join(runs.select("run_id", "plugin_slug"), "plugin_slug").select(
        "run_id", "rule_id", "file_path", F.col("start_line").cast("int").alias("start_line"),
        F.col("end_line").cast("int").alias("end_line"), message[F.col("rule_id")].alias("message"), "lines")
    order = ["run_id", "file_path", "start_line", "end_line", "rule_id", "lines"]
    return runs, dense_ids(found, order, "finding_id").select("finding_id", *found.columns)
