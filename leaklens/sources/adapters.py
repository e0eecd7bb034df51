"""Adapter views: the reference's tables derived from the driver's test tables.

One SQL text serves both engines: Spark registers each as a temp view over
the parquet tables, the DuckDB oracle inlines the same text as a CTE.  The
views only give rows in the shapes the jobs expect; all work is done by the
jobs on top of them.  The texts are the ones in FIXTURES.md (part B).
"""

from __future__ import annotations

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

ADAPTERS: dict[str, str] = {}

ADAPTERS["plugins"] = """
SELECT c_name AS name, 'plugin-' || CAST(c_custkey AS STRING) AS slug, c_mktsegment AS version,
 'https://example.invalid/plugin-' || CAST(c_custkey AS STRING) || '.zip' AS download_link,
 CAST(floor((c_acctbal + 1000) * 100) AS INT) AS num_downloads, CAST(c_nationkey * 1000 AS INT) AS active_installations FROM customer
"""

ADAPTERS["semgrep_runs"] = """
SELECT o_orderkey AS run_id, 'plugin-' || CAST(o_custkey AS STRING) AS plugin_slug, CAST(o_orderkey % 4 AS INT) AS error_count,
 CASE WHEN o_orderkey % 4 = 0 THEN 'null' ELSE '[{"code": ' || CAST(o_orderkey % 5 AS STRING) || '}]' END AS errors FROM orders
"""

ADAPTERS["findings_semgrep"] = """
SELECT l_orderkey * 10 + l_linenumber AS finding_id, l_orderkey AS run_id,
 CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'file-put-contents_' WHEN 1 THEN 'file-put-contents_log-file-var-assignment'
  WHEN 2 THEN 'fopen_var-assignment' WHEN 3 THEN 'fwrite_with-fopen' WHEN 4 THEN 'fprintf_with-fopen' WHEN 5 THEN 'wp-upload-dir_'
  WHEN 6 THEN 'hardcoded-wp-content-path' WHEN 7 THEN 'WP-DEBUG_enabling' ELSE 'WP-DEBUG-LOG_enabling' END AS rule_id,
 'plugin/src/f' || CAST(l_suppkey AS STRING) || '.php' AS file_path, l_linenumber AS start_line, l_linenumber + 2 AS end_line,
 CASE l_partkey % 13
  WHEN 0 THEN 'file_put_contents($dir . "/error.log", $m)' WHEN 1 THEN 'file_put_contents(ABSPATH . "fail-log.txt", $m)'
  WHEN 2 THEN '$f = fopen($p . "/Debug.log", "a");' || chr(10) || 'fwrite($f, $m);'
  WHEN 3 THEN '$f = fopen("trace.log", "a");' || chr(10) || 'fopen($f, "error");'
  WHEN 4 THEN 'file_put_contents("app-" . date("Y") . ".log", $m)' WHEN 5 THEN '$log = $base . "/fatal.log";' || chr(10) || 'file_put_contents($log, $m);'
  WHEN 6 THEN '$log = "x";' || chr(10) || 'error(); file_put_contents($log, $m);' WHEN 7 THEN 'file_put_contents($d . ".htaccess", "log")'
  WHEN 8 THEN '$f = fopen(sys_get_temp_dir() . "log", "a");' WHEN 9 THEN '$f = fopen( $log, "w"); fwrite($f, md5($m));'
  WHEN 10 THEN '$log = "/tmp/verbose.log"; fopen($log, "a");' WHEN 11 THEN 'file_put_contents(dev_log(), 1)' ELSE NULL END AS lines FROM lineitem
"""

ADAPTERS["dynamic_analysis"] = """
SELECT 'plugin-' || CAST(c_custkey AS STRING) AS plugin_slug, CAST(c_custkey % 60 AS INT) AS num_unique_rest_endpoints,
 CAST(c_custkey % 50 AS INT) AS num_rest_endpoints_called, CAST(greatest(0, c_custkey % 50 - c_custkey % 7) AS INT) AS num_rest_endpoints_http_ok,
 CAST(c_custkey % 9 AS INT) AS num_ajax_endpoints, CAST(2 * (c_custkey % 9) AS INT) AS num_ajax_endpoints_called,
 CAST(c_custkey % 9 AS INT) AS num_ajax_endpoints_http_ok, CAST(c_custkey % 301 AS DOUBLE) / 4 AS time_spend FROM customer
"""

ADAPTERS["hook_records"] = """
SELECT event_id, 'plugin-' || CAST(user_id AS STRING) AS plugin_slug,
 CASE event_type WHEN 'click' THEN 'file_exists' WHEN 'view' THEN 'fopen' WHEN 'error' THEN 'file_put_contents' WHEN 'signup' THEN 'is_dir' ELSE 'realpath' END AS function,
 CASE event_id % 12 WHEN 0 THEN '/var/www/html/.maintenance' WHEN 1 THEN 'core/post-comments' WHEN 2 THEN '/var/www/html/wp-content/uploads/app-' || CAST(user_id AS STRING) || '.log'
  WHEN 3 THEN '/var/www/html/wp-content/logo.png' WHEN 4 THEN '/var/www/html/wp-content/blog/x.txt' WHEN 5 THEN '/var/www/html/wp-content/logs/log.php'
  WHEN 6 THEN '/var/www/html/wp-content/Error-logs/e.txt' WHEN 7 THEN '/var/www/html/wp-content/logs/debug.txt' WHEN 8 THEN '/tmp/catalog.js'
  WHEN 9 THEN '/var/www/html/wp-content/LOG.TXT' WHEN 10 THEN '/vendor/monolog/a.txt' ELSE '/var/www/html/wp-content/install-log' END AS path0, props AS error FROM events
"""

ADAPTERS["change_records"] = """
SELECT event_id, 'plugin-' || CAST(user_id AS STRING) AS plugin_slug, ts,
 CASE event_type WHEN 'click' THEN 'REST' WHEN 'view' THEN 'AJAX' ELSE 'WP_CLI' END AS interface,
 CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
 'http://localhost:8080/wp-json/shop/v1/slots/' || CAST(event_id % 17 AS STRING) AS url, props AS data,
 '/var/www/html/wp-content/' || CASE event_id % 13 WHEN 0 THEN 'debug.log' WHEN 1 THEN 'uploads/error-log.txt' WHEN 2 THEN 'catalog.css' WHEN 3 THEN 'logs/.htaccess'
  WHEN 4 THEN 'LOG/app.dat' WHEN 5 THEN 'blog.webp' WHEN 6 THEN 'CHANGELOG.md' WHEN 7 THEN 'temp-write-test-log' WHEN 8 THEN 'cache/x.bin'
  WHEN 9 THEN 'log' || chr(10) || 'x.txt' WHEN 10 THEN 'plugin/index.php' WHEN 11 THEN 'logs/Debug-Error.json' ELSE 'uploads/app.log' END AS name_of_changed_file,
 CASE event_id % 2 WHEN 0 THEN 'CLOSE_WRITE,CLOSE' ELSE 'DELETE' END AS type_of_operation FROM events
"""

ADAPTERS["watch_stream"] = """
SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'purchase' THEN 'clear' ELSE 'change' END AS kind,
 CASE WHEN event_type = 'signup' THEN props END AS test FROM events
"""

# Markers carry the test that runs, changes the file; nothing links the two but their order.
ADAPTERS["watch_records"] = """
SELECT event_id, 'plugin-' || CAST(user_id AS STRING) AS plugin_slug, ts,
 CASE WHEN event_type = 'signup' THEN 'set' WHEN event_type = 'purchase' THEN 'clear' ELSE 'change' END AS kind,
 CASE WHEN event_type = 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'WP_CLI' WHEN 1 THEN 'AJAX' WHEN 2 THEN 'AJAX' ELSE 'REST' END END AS interface,
 CASE WHEN event_type = 'signup' AND event_id % 5 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END END AS method,
 CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'wp shop slots ' || CAST(event_id % 11 AS STRING)
  ELSE 'http://localhost:8080/wp-json/shop/v1/slots/' || CAST(event_id % 17 AS STRING) END END AS url,
 CASE WHEN event_type = 'signup' THEN props END AS data,
 CASE WHEN event_type NOT IN ('signup', 'purchase') THEN '/var/www/html/wp-content/uploads/app-' || CAST(event_id % 23 AS STRING) || '.log' END AS name_of_changed_file,
 CASE WHEN event_type NOT IN ('signup', 'purchase') THEN CASE event_id % 2 WHEN 0 THEN 'CLOSE_WRITE,CLOSE' ELSE 'DELETE' END END AS type_of_operation FROM events
"""

ADAPTERS["ajax_routes"] = """
SELECT p_partkey AS route_id, 'plugin-' || CAST(p_partkey % 150 AS STRING) AS plugin_slug, 'action_' || CAST(p_partkey AS STRING) AS action, p_size % 2 = 0 AS priv FROM part
"""

ADAPTERS["ajax_route_arguments"] = """
SELECT DISTINCT l_partkey AS route_id, CASE l_linenumber % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'GET' WHEN 2 THEN 'FILES' ELSE 'REQUEST' END AS method,
 'arg' || CAST(l_linenumber AS STRING) AS arg_name FROM lineitem WHERE l_partkey % 3 <> 0
"""

ADAPTERS["http_attempts"] = """
SELECT o_orderkey AS attempt_id, 'plugin-' || CAST(o_custkey AS STRING) AS plugin_slug, CASE o_orderkey % 2 WHEN 0 THEN 'REST' ELSE 'AJAX' END AS interface,
 'GET' AS method, CAST(CASE o_orderkey % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 302 WHEN 3 THEN NULL ELSE 200 END AS INT) AS status FROM orders
"""

# One row per HTTP call as the runner makes it: the route it tests, the url called, the body.
ADAPTERS["request_log"] = """
SELECT event_id AS attempt_id, 'plugin-' || CAST(user_id AS STRING) AS plugin_slug, ts, CASE event_id % 3 WHEN 0 THEN 'AJAX' ELSE 'REST' END AS interface,
 CASE event_id % 5 WHEN 0 THEN 'POST' ELSE 'GET' END AS method, '/shop/v1/slots' || CAST(event_id % 4 AS STRING) AS route,
 'http://localhost:8080/wp-json/shop/v1/slots' || CAST(event_id % 4 AS STRING) || CASE event_id % 6 WHEN 1 THEN '?a=1' WHEN 2 THEN '?' ELSE '' END AS url,
 CASE event_id % 10 WHEN 0 THEN '{"a":1}' END AS data,
 CAST(CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 302 WHEN 3 THEN NULL ELSE 200 END AS INT) AS status FROM events
"""

ADAPTERS["source_files"] = """
SELECT 'plugins/' || source || CASE doc_id % 5 WHEN 0 THEN '/vendor/' WHEN 1 THEN '/tests/' ELSE '/inc/' END || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '.js' ELSE '.php' END AS path,
 '$log = $base . "/my-log.txt";' || chr(10) || CASE doc_id % 12 WHEN 0 THEN 'file_put_contents($log, $x);' WHEN 1 THEN '$fh = fopen($log, "a");' || chr(10) || 'fwrite($fh, 1);'
  WHEN 2 THEN 'define( ''WP_DEBUG'', true );' WHEN 3 THEN '$fh = fopen($log, "a");' || chr(10) || 'fprintf($fh, "x");'
  WHEN 4 THEN '$fh = fopen($log, "a");' || chr(10) || 'fputs($fh, "x");' WHEN 5 THEN '$up = wp_upload_dir();' || chr(10) || '$p = "/wp-content/uploads";'
  WHEN 6 THEN 'define("WP_DEBUG_LOG", TRUE);'
  WHEN 7 THEN 'add_action(''wp_ajax_list_' || CAST(doc_id AS STRING) || ''', function() { usort($r, function($a, $b) { return 1; }); $b = $_GET[''two'']; /* ) */ $c = $_POST["a)b"]; }, 10, 2);'
  WHEN 8 THEN 'add_action( "wp_ajax_nopriv_any_' || CAST(doc_id AS STRING) || '", "cb_' || CAST(doc_id AS STRING) || '[0-9]?" );'
  WHEN 9 THEN 'add_action(''wp_ajax_del_' || CAST(doc_id AS STRING) || ''', array($this, ''del''), 5);'
  ELSE 'add_action(''wp_ajax_nopriv_save_' || CAST(doc_id AS STRING) || ''', ''cb_' || CAST(doc_id AS STRING) || ''');' END || chr(10) ||
 'function cb_' || CAST(doc_id AS STRING) || '() { $a = $_POST[''k' || CAST(doc_id % 3 AS STRING) || '''] . $_GET["q"]; }' || chr(10) || text AS content FROM documents
"""

ADAPTERS["rules"] = """
SELECT * FROM (VALUES ('file-put-contents_','ERROR','file-put-contents'),('file-put-contents_log-file-var-assignment','ERROR','file-put-contents'),
 ('fopen_var-assignment','ERROR','fopen'),('fwrite_with-fopen','ERROR','fwrite'),('fprintf_with-fopen','ERROR','fprintf'),('fputs_with-fopen','ERROR','fputs'),
 ('wp-upload-dir_','INFO','wp-upload-dir'),('hardcoded-wp-content-path','INFO',NULL),('WP-DEBUG_enabling','WARNING','WP-DEBUG'),('WP-DEBUG-LOG_enabling','WARNING','WP-DEBUG-LOG')) AS t(rule_id, severity, sink)
"""

ADAPTERS["baseline_paths"] = """
SELECT * FROM (VALUES ('/var/www/html/.maintenance'),('core/post-comments'),('/var/www/html/wp-content/db.php')) AS t(path)
"""

ADAPTERS["catalogue_raw"] = """
SELECT c_custkey AS fetch_pos, c_name AS name, 'plugin-' || CAST(c_custkey % 1400 AS STRING) AS slug,
 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) || ',' || lpad(CAST(c_nationkey AS STRING), 3, '0') END AS downloads FROM customer
"""

ADAPTERS["hook_names"] = """
SELECT p_partkey AS pos, 'plugin-' || CAST(p_partkey % 150 AS STRING) AS slug,
 CASE p_partkey % 4 WHEN 0 THEN '''wp_ajax_save_' || CAST(p_size AS STRING) || '''' WHEN 1 THEN '''wp_ajax_nopriv_save_' || CAST(p_size AS STRING) || ''''
  WHEN 2 THEN '"wp_ajax_nopriv_wp_ajax_x"' ELSE '''wp_ajax_export_' || CAST(p_size AS STRING) || '''' END AS hook, 'cb_' || CAST(p_partkey AS STRING) AS callback FROM part
"""

ADAPTERS["run_log_lines"] = """
SELECT 'run-' || CAST(user_id AS STRING) || '.log' AS file, event_id AS line_no,
 CASE WHEN event_id % 97 = 0 THEN 'Dynamic Analysis Finished' ELSE event_type || ' ' || props END AS line FROM events
"""

ADAPTERS["arg_specs"] = """
SELECT p_partkey AS route_id, CASE p_partkey % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PATCH' END AS method, 'a' || CAST(p_size AS STRING) AS arg,
 CASE p_partkey % 8 WHEN 0 THEN 'string' WHEN 1 THEN 'null' WHEN 2 THEN 'boolean' WHEN 3 THEN 'integer' WHEN 4 THEN 'number' WHEN 5 THEN 'array' WHEN 6 THEN 'object' ELSE 'other' END AS type,
 CASE p_partkey % 16 WHEN 0 THEN 'email' WHEN 8 THEN 'uri' END AS format FROM part
"""

ADAPTERS["rest_namespaces"] = """
SELECT * FROM (VALUES ('wp/v2'),('oembed/1.0'),('wp-site-health/v1'),('wp-block-editor/v1'),('shop/v1'),('forms/v2')) AS t(namespace)
"""

# Derived on top of the adapters (same text in both engines).
DERIVED: dict[str, str] = {
    # the three routed change tables of the warehouse
    "findings_rest": "SELECT * FROM change_records WHERE interface = 'REST'",
    "findings_ajax": "SELECT * FROM change_records WHERE interface = 'AJAX'",
    "findings_wp_cli": "SELECT * FROM change_records WHERE interface = 'WP_CLI'",
}

# Which adapters each derived view needs.
DERIVED_DEPS = {
    "findings_rest": ["change_records"],
    "findings_ajax": ["change_records"],
    "findings_wp_cli": ["change_records"],
}


def cte(*names: str) -> str:
    """``WITH`` clause for the DuckDB oracle holding the named adapters.

    Derived views pull in what they depend on; order is dependency order.
    """
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in DERIVED_DEPS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = []
    for n in ordered:
        body = ADAPTERS.get(n) or DERIVED[n]
        parts.append(f"{n} AS ({body.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
