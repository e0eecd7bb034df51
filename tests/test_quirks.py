"""Hand-written fixtures for each behaviour the reference shows (faithful and fixed)."""

import datetime as dt

from pyspark.sql import functions as F


from leaklens.functions import classify
from leaklens.functions.predicates import log_file, log_path, name_contains_ci
from leaklens.functions.scalar import (
    hook_to_route_callback,
    hook_to_route_closure,
    params_text,
    rule_sink,
    url_faithful,
    url_fixed,
)
from leaklens.operators import attribution, merge, reports, routes


def _one(df):
    return df.collect()[0]


def test_keyword_on_second_line_not_counted(spark):
    f = spark.createDataFrame([
        (classify.FPC_VAR, "$x = 1;\nerror();"),          # keyword only on line 2
        (classify.FPC_VAR, "$log = 'error.log';\nfoo();"),  # keyword on line 1
    ], "rule_id string, lines string")
    r = _one(reports.log_name_classes(f))
    assert r["n_total"] == 2 and r["n_error"] == 1


def test_like_underscore_is_a_wildcard(spark):
    f = spark.createDataFrame([(classify.FPC, "fileXputXcontents(error.log, $m)")], "rule_id string, lines string")
    assert _one(reports.log_name_classes(f))["n_error"] == 1


def test_null_lines_count_in_total_only(spark):
    f = spark.createDataFrame([(classify.FOPEN_VAR, None), (classify.FOPEN_VAR, "$f = fopen('debug.log');")],
                              "rule_id string, lines string")
    r = _one(reports.log_name_classes(f))
    assert r["n_total"] == 2 and r["n_debug"] == 1 and r["n_error"] == 0


def test_residual_quirk_and_misspelt_htaccess(spark):
    f = spark.createDataFrame([
        (classify.FPC_VAR, "$l = 'error.log';"),
        (classify.FPC, "file_put_contents($d . '.htaccess', 'x')"),
    ], "rule_id string, lines string")
    rows = {r["rule_id"]: r for r in reports.log_name_classes(f).collect()}
    var = rows[classify.FPC_VAR]
    # faithful: total - error - error - htaccess; fixed: total - error - debug - htaccess
    assert var["n_other"] == 1 - 1 - 1 - 0       # error subtracted twice
    assert var["n_other_fixed"] == 1 - 1 - 0 - 0
    fpc = rows[classify.FPC]
    assert fpc["n_htaccess"] == 0 and fpc["n_htaccess_fixed"] == 1


def test_securing_bracket_quirk(spark):
    f = spark.createDataFrame([(classify.FPC, "file_put_contents('/tmp/app.log', $m)")], "rule_id string, lines string")
    r = _one(reports.log_name_classes(f))
    assert r["n_securing"] == 0 and r["n_securing_fixed"] == 1


def test_params_text_and_log_path(spark):
    df = spark.createDataFrame([(["/a b/x.log", "/y.php"],), (["/var/log/app.log"],), (["/x/catalog.json"],)],
                               "params array<string>")
    out = df.select(params_text("params").alias("t")).select("t", log_path("t").alias("lp")).collect()
    got = {r["t"]: r["lp"] for r in out}
    assert got["[/a b/x.log, /y.php]"] is False        # ends with .php]
    assert got["[/var/log/app.log]"] is True
    assert got["[/x/catalog.json]"] is False           # %.js% also drops .json


def test_url_strip_is_a_character_set(spark):
    df = spark.createDataFrame([("http://localhost:8080/wp-json/shop/v1/slots",)], "url string")
    r = _one(df.select(url_faithful("url").alias("a"), url_fixed("url").alias("b")))
    assert r["a"] == "wp-json/shop/v1"
    assert r["b"] == "/wp-json/shop/v1/slots"


def test_hook_branches(spark):
    df = spark.createDataFrame([("'wp_ajax_nopriv_wp_ajax_x'",), ("'wp_ajax_save'",)], "hook string")
    a1, p1 = hook_to_route_callback("hook")
    a2, p2 = hook_to_route_closure("hook")
    rows = {r["hook"]: r for r in df.select("hook", a1.alias("a1"), p1.alias("p1"), a2.alias("a2"), p2.alias("p2")).collect()}
    r = rows["'wp_ajax_nopriv_wp_ajax_x'"]
    assert (r["a1"], r["p1"]) == ("wp_ajax_x", False)
    assert (r["a2"], r["p2"]) == ("x", False)
    r = rows["'wp_ajax_save'"]
    assert (r["a1"], r["p1"], r["a2"], r["p2"]) == ("save", True, "save", True)


def test_rule_sink(spark):
    df = spark.createDataFrame([("file-put-contents_",), ("hardcoded-wp-content-path",), ("a_b_c",)], "id string")
    got = [r[0] for r in df.select(rule_sink("id")).collect()]
    assert got == ["file-put-contents", None, None]


def test_callback_regex_prefix_vs_fixed(spark):
    files = spark.createDataFrame([(
        "plugins/p/inc/a.php",
        "add_action('wp_ajax_go', 'cb_1');\nfunction cb_1() { $a = $_POST['x']; }\n"
        "function cb_12() { $b = $_GET[\"y\"]; }\n",
    )], "path string, content string")
    faithful = {(r["fname"], r["arg"]) for r in routes.callback_arguments(files, True).collect()}
    fixed = {(r["fname"], r["arg"]) for r in routes.callback_arguments(files, False).collect()}
    assert faithful == {("cb_1", "x"), ("cb_12", "y")}
    assert fixed == {("cb_1", "x")}


def test_rule_that_never_fires_gets_zero(spark):
    rules = spark.createDataFrame([("a",), ("b",)], "rule_id string")
    findings = spark.createDataFrame([("a",), ("a",), ("z",)], "rule_id string")
    got = {r["rule_id"]: r["n_findings"] for r in reports.findings_per_rule(rules, findings).collect()}
    assert got == {"a": 2, "b": 0, "z": 1}


def test_shard_merge_offset(spark):
    a = spark.createDataFrame([(0, "p"), (1, "q")], "run_id long, plugin_slug string")
    b = spark.createDataFrame([(0, "r"), (1, "s")], "run_id long, plugin_slug string")
    fixed, _ = merge.merge_shard(a, b, [], [], faithful=False)
    faithful, _ = merge.merge_shard(a, b, [], [], faithful=True)
    assert sorted(r[0] for r in fixed.select("run_id").collect()) == [0, 1, 2, 3]
    assert sorted(r[0] for r in faithful.select("run_id").collect()) == [0, 1, 1, 2]
    found_a = spark.createDataFrame([(1, 0), (2, 1)], "finding_id long, run_id long")
    found_b = spark.createDataFrame([(1, 0), (2, 1)], "finding_id long, run_id long")
    _, (found,) = merge.merge_shard(a, b, [found_a], [found_b])
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1), (4, 2), (5, 3)]
    runs, (found,) = merge.merge_shard(a.limit(0), b, [found_a.limit(0)], [found_b])
    assert sorted(map(tuple, found.collect())) == [(1, 0), (2, 1)]
    assert sorted(map(tuple, runs.collect())) == [(0, "r"), (1, "s")]


def test_division_by_zero_gives_null(spark):
    d = spark.createDataFrame([(0, 0, 0, 0, 1.5)], "num_rest_endpoints_called int, num_rest_endpoints_http_ok int, "
                              "num_ajax_endpoints_called int, num_ajax_endpoints_http_ok int, time_spend double")
    r = _one(reports.dynamic_summary(d))
    assert r["rest_success_ratio"] is None and r["ajax_success_ratio"] is None
    assert r["total_time_spent"] == 61.5


def test_name_with_newline(spark):
    df = spark.createDataFrame([("/x/y\ndebug.log",)], "n string")
    r = _one(df.select(name_contains_ci("n", "debug").alias("dbg"), log_file("n", "REST").alias("lf")))
    assert r["dbg"] is False     # no dot-all: the newline blocks (?i).*debug.*
    assert r["lf"] is True       # (?si).*log.* crosses it


def _events(spark, rows):
    return spark.createDataFrame(
        [(i, "p", dt.datetime(2024, 1, 1, 0, 0, s), k, t) for i, s, k, t in rows],
        "event_id long, plugin_slug string, ts timestamp_ntz, kind string, test string")


def test_marker_cleared_before_change(spark):
    ev = _events(spark, [(1, 0, "set", "A"), (2, 1, "change", None), (3, 2, "clear", None), (4, 3, "change", None)])
    got = [(r["event_id"], r["test"], r["zip_counter"]) for r in attribution.attribute_changes(ev).collect()]
    assert got == [(2, "A", 1)]


def test_two_markers_same_instant(spark):
    ev = _events(spark, [(2, 0, "set", "B"), (1, 0, "set", "A"), (3, 0, "change", None), (4, 5, "change", None)])
    got = sorted((r["event_id"], r["test"], r["zip_counter"]) for r in attribution.attribute_changes(ev).collect())
    # same instant: event id orders the markers, so B (id 2) is current
    assert got == [(3, "B", 1), (4, "B", 2)]


def test_rest_matrix_shapes(spark):
    from leaklens.operators import matrix

    specs = spark.createDataFrame([(1, "GET", "q", "integer", None), (1, "GET", "p", "string", "email"),
                                   (2, "POST", "b", "boolean", None)],
                                  "route_id long, method string, arg string, type string, format string")
    routes = spark.createDataFrame([(1, ["GET"]), (2, ["POST"]), (3, ["DELETE", "GET"])], "route_id long, methods array<string>")
    rows = matrix.rest_cases(specs, "2024-01-01T00:00:00", routes).collect()
    kinds = sorted((r["route_id"], r["method"], r["case_kind"]) for r in rows)
    # GET: valid+invalid per arg, all-valid, all-invalid, plain; POST: ..., empty body; no args: first method
    assert kinds.count((1, "GET", "valid")) == 2 and (1, "GET", "plain") in kinds
    assert (2, "POST", "empty") in kinds and (3, "DELETE", "plain") in kinds and len(kinds) == 7 + 5 + 1
    vals = {(r["route_id"], r["arg"], r["case_kind"]): r["value"] for r in rows}
    assert vals[(1, "p", "valid")] == "test@test.com" and vals[(1, "q", "invalid")].startswith("0123456789abc")
    assert vals[(1, "*", "all_valid")] == "p=test@test.com&q=9223372036854775807"


def test_log_file_name_styles(spark):
    # name styles of the manually reviewed log files: expected (log?, debug?, error?)
    cases = {
        "/var/www/html/wp-content/debug.log": (True, True, False),
        "/x/fatal-errors-7b1f691e744c2fee6b22a11b30d4574e.log": (True, False, True),
        "/x/wppa-log.txt": (True, False, False),
        "/x/log.json": (True, False, False),          # .json is not cut by the .js suffix test
        "/x/cc-blog-paths": (True, False, False),     # 'blog' contains 'log'
        "/x/CHANGELOG.md": (False, False, False),
        "/x/logs/error.log": (True, False, True),
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r["n"]: (r["lf"], r["dbg"], r["err"]) for r in df.select(
        "n", log_file("n", "WP_CLI").alias("lf"), name_contains_ci("n", "debug").alias("dbg"),
        name_contains_ci("n", "error").alias("err")).collect()}
    assert got == cases


def test_context_lines_merge_overlaps(spark):
    from leaklens.functions.predicates import finished_line

    rows = [("a.log", i, "Dynamic Analysis Finished" if i in (10, 14) else f"l{i}") for i in range(1, 31)]
    rows += [("b.log", i * 7, "x") for i in range(1, 5)]
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    out = attribution.context_lines(lines, finished_line("line"))
    got = sorted((r["file"], r["line_no"]) for r in out.collect())
    # 5 before the first marker to 5 after the second, each line once; b.log has no marker
    assert got == [("a.log", i) for i in range(5, 20)]


def test_merge_routes_hash_keys(spark):
    from leaklens.operators import routes as r

    a = r.route_ids(spark.createDataFrame([("p", "save", True)], "plugin_slug string, action string, priv boolean"))
    b = r.route_ids(spark.createDataFrame([("p", "save", True), ("q", "go", False)],
                                          "plugin_slug string, action string, priv boolean"))
    args_a = a.select("route_id", F.lit("POST").alias("method"), F.lit("x").alias("arg_name"))
    args_b = b.select("route_id", F.lit("POST").alias("method"), F.lit("x").alias("arg_name"))
    routes_m, args_m = merge.merge_routes(a, b, args_a, args_b)
    assert routes_m.count() == 2 and args_m.count() == 2


def test_rest_index_shapes(spark, tmp_path):
    """Empty and missing arguments, type lists, enums, several endpoints."""
    import json

    from leaklens.operators import matrix

    index = {"routes": {
        "/a/v1/none": {"endpoints": [{"methods": ["PUT", "GET"], "args": []}, {"methods": ["GET"]}]},
        "/a/v1/empty": {"endpoints": [{"methods": ["GET", "POST"], "args": {}}]},
        "/a/v1/one": {"endpoints": [{"methods": ["POST"], "args": {"q": {"type": ["string", "null"], "enum": ["x", "y"]}}}]}}}
    (tmp_path / "index.json").write_text(json.dumps(index))
    rows = spark.read.schema(matrix.REST_INDEX).json(str(tmp_path / "index.json"))
    got = matrix.rest_index_cases(rows, "http://h", "now").collect()
    assert sorted((r.method, r.case_kind, r.url) for r in got if r.route == "/a/v1/none") == [
        ("GET", "no_arguments", "http://h/a/v1/none"), ("PUT", "no_arguments", "http://h/a/v1/none")]
    assert sorted((r.method, r.url, r.data) for r in got if r.route == "/a/v1/empty") == [
        ("GET", "http://h/a/v1/empty", None), ("GET", "http://h/a/v1/empty?", None), ("GET", "http://h/a/v1/empty?", None),
        ("POST", "http://h/a/v1/empty", {})]
    one = [(r.case_kind, r.data) for r in got if r.route == "/a/v1/one"]
    assert [c for c, _ in one].count("enum") == 2 and {"q": "x"} in [d for _, d in one]
    assert sorted(c for c, _ in one) == ["all_invalid", "all_valid", "enum", "enum", "invalid", "none", "valid"]
    from leaklens.functions.scalar import PRINTABLE
    assert dict(one)["valid"] == {"q": PRINTABLE}      # a list of types has no sample of its own


def test_whole_warehouses_with_ids_of_their_own(spark):
    def tables(plugins, runs, findings, rts, args):
        return {"plugins": spark.createDataFrame(plugins, "slug string, name string"),
                "semgrep_runs": spark.createDataFrame(runs, "run_id long, plugin_slug string"),
                "findings_semgrep": spark.createDataFrame(findings, "finding_id long, run_id long"),
                "ajax_routes": spark.createDataFrame(rts, "route_id long, plugin_slug string, action string, priv boolean"),
                "ajax_route_arguments": spark.createDataFrame(args, "route_id long, method string, arg_name string")}

    base = tables([("p", "old")], [(0, "p"), (1, "p")], [(0, 1)], [(0, "p", "a", True), (1, "p", None, None)], [(0, "GET", "x")])
    shard = tables([("p", "new"), ("q", "q")], [(0, "q")], [(0, 0), (1, 0)],
                   [(5, "p", "a", True), (6, "p", None, None), (7, "q", "a", True), (8, "q", "a", True)],
                   [(5, "GET", "x"), (5, "POST", "y"), (6, "GET", "z"), (7, "GET", "x"), (8, "GET", "x"), (99, "GET", "lost")])
    got = {k: sorted(map(tuple, v.collect()), key=str) for k, v in merge.merge_warehouses(base, shard).items()}
    assert got["plugins"] == [("p", "old"), ("q", "q")]
    assert got["semgrep_runs"] == [(0, "p"), (1, "p"), (2, "q")] and got["findings_semgrep"] == [(0, 1), (1, 2), (2, 2)]
    assert got["ajax_routes"] == [(0, "p", "a", True), (1, "p", None, None), (9, "q", "a", True)]
    assert got["ajax_route_arguments"] == [(0, "GET", "x"), (0, "POST", "y"), (1, "GET", "z"), (9, "GET", "x")]
    assert got["orphan_arguments"] == [(99, "GET", "lost")]
    empty = {k: v.limit(0) for k, v in base.items()}
    alone = {k: sorted(map(tuple, v.collect()), key=str) for k, v in merge.merge_warehouses(empty, shard).items()}
    assert alone["semgrep_runs"] == [(0, "q")] and alone["findings_semgrep"] == [(0, 0), (1, 0)]
    assert [r[0] for r in alone["ajax_routes"]] == [5, 6, 7] and len(alone["ajax_route_arguments"]) == 4


def test_run_metrics(spark):
    from leaklens.operators import matrix

    log = spark.createDataFrame([
        (1, "p", 10, "REST", "GET", "/a", "/a", None, 200), (2, "p", 11, "REST", "GET", "/a", "/a", None, 404),
        (3, "p", 12, "REST", "GET", "/a", "/a?x=1", None, 302), (4, "p", 13, "REST", "POST", "/b", "/b", "{}", None),
        (5, "p", 14, "AJAX", "POST", "r", "/ajax", "d", 200), (6, "p", 15, "AJAX", "POST", "r", "/ajax", "d", 302),
        (7, "q", 9, "AJAX", "POST", "r", "/ajax", "d", 500)],
        "attempt_id long, plugin_slug string, s long, interface string, method string, route string, url string, data string, status int")
    got = {r.plugin_slug: tuple(r)[1:] for r in matrix.run_metrics(log.selectExpr("*", "timestamp_seconds(s) AS ts")).collect()}
    # the last REST route, /b, has one case
    assert got == {"p": (3, 1, 4, 2, 1, 2, 1, 5.0), "q": (0, 0, 0, 0, 1, 1, 0, 0.0)}
