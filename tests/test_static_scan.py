"""The ten scanner rules on hand-written PHP (the textual contract)."""

from leaklens.operators import static_scan

PHP = "\n".join([
    "<?php",                                                   # 1
    "$log = WP_CONTENT_DIR . '/debug.log';",                   # 2  assignment, expr has 'log'
    "file_put_contents($log, $msg);",                          # 3  D2 (uses $log, assigned on 2) and D1
    "file_put_contents(ABSPATH . 'error.log', $x);",           # 4  D1 (first arg has 'log')
    "file_put_contents($cache, $x);",                          # 5  nothing: $cache never assigned
    "$fh = fopen($dir . '/app-log.txt', 'a');",                # 6  assignment, expr = fopen(..log..)
    "fwrite($fh, $line);",                                     # 7  D4
    "fprintf($fh, '%s', $line);",                              # 8  D5
    "fputs($fh, $line);",                                      # 9  D6
    "$p = $base . '/logs/x.txt';",                             # 10 assignment with 'log'
    "$h = fopen($p, 'w');",                                    # 11 D3 (fopen($p) after 10)
    "$u = wp_upload_dir();",                                   # 12 D7
    "$path = '/var/www/html/wp-content/uploads/a.log';",      # 13 D8
    "define( 'WP_DEBUG', true );",                             # 14 D9
    "define('WP_DEBUG_LOG',TRUE);",                            # 15 D10
    "define('WP_DEBUG', false);",                              # 16 nothing
    "$log = 'plain.txt';",                                     # 17 re-assigned without 'log' in expr? ('plain.txt' no)
    "file_put_contents($log, 1);",                             # 18 D2: latest QUALIFYING assignment is line 2
])


def test_ten_rules_on_php(spark):
    files = spark.createDataFrame([("plugins/acme/inc/a.php", PHP), ("plugins/acme/vendor/b.php", PHP),
                                   ("plugins/acme/inc/c.js", PHP)], "path string, content string")
    got = sorted((r["rule_id"], r["start_line"], r["end_line"]) for r in static_scan.scan_sources(files).collect())
    assert got == sorted([
        ("file-put-contents_log-file-var-assignment", 2, 3),
        ("file-put-contents_", 3, 3),     # the first argument's text '$log' contains 'log'
        ("file-put-contents_", 4, 4),
        ("file-put-contents_", 18, 18),
        ("fwrite_with-fopen", 6, 7),
        ("fprintf_with-fopen", 6, 8),
        ("fputs_with-fopen", 6, 9),
        ("fopen_var-assignment", 10, 11),
        ("wp-upload-dir_", 12, 12),
        ("hardcoded-wp-content-path", 13, 13),
        ("WP-DEBUG_enabling", 14, 14),
        ("WP-DEBUG-LOG_enabling", 15, 15),
        ("file-put-contents_log-file-var-assignment", 2, 18),
    ])
    rows = {(r["rule_id"], r["end_line"]): r for r in static_scan.scan_sources(files).collect()}
    r = rows[("file-put-contents_log-file-var-assignment", 3)]
    assert r["file_path"] == "acme/inc/a.php" and r["plugin_slug"] == "acme"
    assert r["lines"] == "$log = WP_CONTENT_DIR . '/debug.log';\nfile_put_contents($log, $msg);"


ROUTES_PHP = "\n".join([
    "<?php",
    "add_action('wp_ajax_nopriv_save_item', function() { $id = $_POST['id']; $n = $_REQUEST[\"name\"]; });",
    "add_action(\"wp_ajax_export\", array($this, 'export'));",
    "add_action('wp_ajax_load', 'cb_load');",
    "add_action('wp_ajax_load', 'cb_load2');",
    "function cb_load2() { $q = $_GET['q']; $f = $_FILES[ 'up' ]; $bad = $_POST['x\"]; }",
])


def test_routes_closures_and_callbacks(spark):
    from leaklens.operators import routes

    files = spark.createDataFrame([("plugins/acme/inc/r.php", ROUTES_PHP)], "path string, content string")
    cl = [(r["action"], r["priv"], [(a["method"], a["arg"]) for a in r["args"]])
          for r in routes.closure_routes(files).collect()]
    # the array callback is not a closure (F11); quotes must match in P14
    assert cl == [("save_item", False, [("POST", "id"), ("REQUEST", "name")])]
    cb = sorted((r["hook"], r["callback"], r["action"], r["priv"]) for r in routes.callback_routes(files).collect())
    assert cb == [("'wp_ajax_load'", "cb_load2", "load", True)]          # last registration wins (W4)
    args = sorted((r["fname"], r["method"], r["arg"]) for r in routes.callback_arguments(files, faithful=False).collect())
    assert args == [("cb_load2", "FILES", "up"), ("cb_load2", "GET", "q")]


def test_second_argument_is_read_whole(spark):
    from leaklens.operators import routes

    php = "\n".join([
        "add_action('wp_ajax_a', function() { usort($r, function($a, $b) { return f($a); }); $b = $_GET['two']; }, 10, 2);",
        "add_action('wp_ajax_b', array($this, 'run'), 5);",
        "add_action('wp_ajax_c', function() { $s = ') } ,'; // don't ) stop",
        "  /* } ) */ add_action('wp_ajax_d', 'inner'); $x = $_POST[\"x\"]; } );",
        "add_action('wp_ajax_e', function() { $never = $_POST['closed'];"])
    files = spark.createDataFrame([("plugins/p/a.php", php), ("plugins/p/b.php", None), ("plugins/p/c.php", "")], "path string, content string")
    got = {r.hook: r.closure for r in routes.second_arguments(files).collect()}
    assert set(got) == {"'wp_ajax_a'", "'wp_ajax_b'", "'wp_ajax_c'", "'wp_ajax_d'"}
    assert got["'wp_ajax_a'"].endswith("$_GET['two']; }") and got["'wp_ajax_b'"] == "array($this, 'run')"
    assert got["'wp_ajax_c'"].endswith('$_POST["x"]; }') and got["'wp_ajax_d'"] == "'inner'"
    args = {(r.hook, a.arg) for r in routes.closure_routes(files).collect() for a in r.args}
    assert args == {("'wp_ajax_a'", "two"), ("'wp_ajax_c'", "x")}


def test_every_rule_and_a_closure_occur_in_the_test_tables(spark):
    import __spark_entry__ as entry
    from conftest import SF_SMALL

    queries = entry.queries()
    rules = {r.rule_id for r in queries["s8_scan_all_rules"](spark, SF_SMALL).select("rule_id").distinct().collect()}
    assert rules == set(static_scan.LINE_RULES) | {r for r, _ in static_scan.VAR_RULES.values()}
    closures = queries["d12_f11_closure_routes"](spark, SF_SMALL).collect()
    assert closures and {r.n_args for r in closures} == {2}


def test_arguments_that_run_past_the_next_registration(spark):
    from leaklens.operators import routes

    php = "\n".join([
        "add_action('wp_ajax_a', function() { $s = 'add_action(\"wp_ajax_no\", x)'; $n = 1 / 2; });",
        "add_action('wp_ajax_b', function() { /* , ) add_action('wp_ajax_c', 'in') */ $x = $_GET['k']; }, 3);",
        "add_action('wp_ajax_d', 'it, add_action(\"wp_ajax_e\", is) odd');"])
    files = spark.createDataFrame([("plugins/p/a.php", php)], "path string, content string")
    got = {r.hook: r.closure for r in routes.second_arguments(files).collect()}
    assert got["'wp_ajax_a'"] == "function() { $s = 'add_action(\"wp_ajax_no\", x)'; $n = 1 / 2; }"
    assert got["'wp_ajax_b'"].endswith("$x = $_GET['k']; }") and got["'wp_ajax_c'"] == "'in'"
    assert got["'wp_ajax_d'"] == "'it, add_action(\"wp_ajax_e\", is) odd'" and got['"wp_ajax_e"'] == "is"


def test_callback_patterns_equal_brute_force(spark):
    import re

    from leaklens.operators import routes

    patterns = ["save", "save_[0-9]?", "sav?e", "savee*", "save{1}_1", "save+", "x|load", "(load|save)_1", ".*_1", "[ls].*", "load$", "loa.\\w*"]
    names = ["save", "save_1", "sae", "savee", "load", "load_1", "xx", "upload", "SAVE", "savve"]
    r = spark.createDataFrame([("p", c) for c in patterns] + [("q", "save")], "plugin_slug string, callback string")
    f = spark.createDataFrame([("p", n) for n in names], "plugin_slug string, fname string")
    got = {(x.callback, x.fname) for x in routes.match_callbacks(r, f).collect()}
    assert got == {(c, n) for c in patterns for n in names if re.search("^" + c, n)}
    shuffled = routes.callback_arguments(spark.createDataFrame([("plugins/p/a.php", "")], "path string, content string"))
    plan = shuffled._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "body" in line]


def test_scan_in_warehouse_shape(spark):
    rows = [("plugins/b/inc/a.php", PHP), ("plugins/a/x.php", "nothing here"), ("plugins/b/inc/a.php", PHP),
            ("plugins/c/tests/a.php", PHP), ("plugins/d/e.php", None), ("plugins/a/y.php", "$u = wp_upload_dir();")]
    runs, found = static_scan.scan_tables(spark.createDataFrame(rows, "path string, content string"))
    assert [(r.run_id, r.plugin_slug) for r in runs.orderBy("run_id").collect()] == [(0, "a"), (1, "b"), (2, "d")]
    got = found.orderBy("finding_id").collect()
    assert [r.finding_id for r in got] == list(range(27))       # 13 of each row of b's file, one of a
    assert (got[0].run_id, got[0].rule_id, got[0].file_path, got[0].start_line) == (0, "wp-upload-dir_", "a/y.php", 1)
    assert got[0].message == "Use of wp_upload_dir (may indicate log or file path handling)"
    assert {r.run_id for r in got[1:]} == {1} and all(r.message for r in got)
    empty = static_scan.scan_tables(spark.createDataFrame([], "path string, content string"))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_flagship_reads_scan_tables(spark):
    from leaklens.operators import reports
    files = spark.createDataFrame([("plugins/b/a.php", PHP), ("plugins/z/a.php", PHP)], "path string, content string")
    runs, found = static_scan.scan_tables(files)
    plugins = spark.createDataFrame([("b", 10)], "slug string, num_downloads int")
    got = {r.rule_id: r for r in reports.plugin_classification(found, runs, plugins).collect()}
    assert got["file-put-contents_"].n_plugins == 1 and got["file-put-contents_"].n_total == 3
    assert got["file-put-contents_"].n_error == 1
    downloads = reports.debug_enabling_plugins(runs, found, plugins).collect()
    assert [(r.plugin_slug, r.rule_id) for r in downloads] == [("b", "WP-DEBUG-LOG_enabling"), ("b", "WP-DEBUG_enabling")]
