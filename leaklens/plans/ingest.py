"""Queries for ingest, catalogue ranking, sinks, keys and shard merging.

Where a reader needs files, the adapter rows are first written in the
tool's file shape under the session's checkpoint folder (stand-in input:
rows only); the library's readers and jobs then do the work.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.functions.scalar import other_calls, params_text, parse_thousands
from leaklens.operators import changes, hooks, ingest, joins, merge, reports
from leaklens.plans import hook_change_reports, static_reports  # noqa: F401  (oracles reused below)
from leaklens.plans.registry import REGISTRY, query
from leaklens.session import drop_paths, scratch_path, shuffles_dropped
from leaklens.sources import files, sinks, warehouse
from leaklens.sources.adapters import cte

_CAT = cte("catalogue_raw") + """, cat AS (SELECT fetch_pos, name, slug,
 coalesce(TRY_CAST(replace(downloads, ',', '') AS BIGINT), 0) AS num_downloads FROM catalogue_raw)
"""
_RANKED = _CAT + "SELECT * FROM cat ORDER BY num_downloads DESC, fetch_pos "


def catalogue(t):
    """P1 + P2: catalogue rows with parsed download counts."""
    return t["catalogue_raw"].select(
        "fetch_pos", "name", "slug", parse_thousands("downloads").alias("num_downloads"))


def ranked(t):
    return ingest.rank_catalogue(catalogue(t), "num_downloads", ("fetch_pos",))


@query("t1_top_plugins", "T1 P1 P2", _RANKED + f"LIMIT {ingest.TOP_N}")
def t1(t):
    """The 10 000 most downloaded plugins, missing downloads = 0."""
    return ingest.top_plugins(catalogue(t), ingest.TOP_N, "num_downloads", ("fetch_pos",))


@query("t2_nth_plugin", "T2", _RANKED + "LIMIT 1 OFFSET 5")
def t2(t):
    """The catalogue row at rank 5 (0-based)."""
    return ingest.nth_plugin(ranked(t), 5)


@query("t3_rank_interval", "T3", _RANKED + "LIMIT 50 OFFSET 100")
def t3(t):
    """Ranks 100..149."""
    return ingest.rank_interval(ranked(t), 100, 50)


_PAGE = 250  # fixed value: catalogue API page size


@query("s1_catalogue_pages", "S1 P1 P2", _CAT + f"""SELECT CAST(floor((fetch_pos - 1) / {_PAGE}) AS INTEGER) + 1 AS page,
 slug, num_downloads AS downloaded FROM cat """)
def s1(t):
    """Saved catalogue pages read back and flattened, every plugin of every page."""
    spark = t.spark
    path = scratch_path(spark, "s1-pages")
    c = t["catalogue_raw"].withColumn("page", (F.floor((F.col("fetch_pos") - 1) / _PAGE) + 1).cast("int"))
    # stand-in: one page document per line, plugins in fetch order, downloads as raw text
    docs = (c.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(
        "fetch_pos", "name", "slug", F.col("downloads").alias("downloaded")))).alias("plugins"))
        .select(F.struct("page").alias("info"), "plugins"))
    docs.write.mode("overwrite").json(path)
    pages = ingest.read_catalogue_pages(spark, path, multi_line=False)
    return pages.select("page", "slug", F.coalesce("downloaded", F.lit(0)).alias("downloaded"))


@query("s2_s3_catalogue_csv_roundtrip", "S2 S3 P1", _RANKED.replace("SELECT * FROM cat", "SELECT name, slug, num_downloads FROM cat")
       + f"LIMIT {ingest.TOP_N}")
def s2s3(t):
    """S3 then S2: ranked catalogue written as CSV with header, read back typed."""
    spark = t.spark
    path = scratch_path(spark, "s3-csv")
    top = ingest.top_plugins(catalogue(t), ingest.TOP_N, "num_downloads", ("fetch_pos",))
    ingest.write_catalogue_csv(top.select(
        "name", "slug", F.col("num_downloads").alias("downloaded"),
        F.lit(None).cast("long").alias("active_installs"), F.lit(None).cast("string").alias("version"),
        F.lit(None).cast("string").alias("download_link")), path)
    return ingest.read_catalogue_csv(spark, path).select("name", "slug", "num_downloads")


def _semgrep_docs(t, path):
    """Stand-in: one scanner document per run, its findings as ``results``
    and its raw error objects as ``errors`` (rows only, no job logic)."""
    f = t["findings_semgrep"]
    res = f.groupBy("run_id").agg(F.collect_list(F.struct(
        F.col("rule_id").alias("check_id"), F.concat(F.lit("plugins/"), "file_path").alias("path"),
        F.struct(F.col("start_line").alias("line")).alias("start"),
        F.struct(F.col("end_line").alias("line")).alias("end"),
        F.struct(F.lit("m").alias("message"), F.col("lines").alias("lines")).alias("extra"))).alias("results"))
    runs = t["semgrep_runs"].select(
        "run_id", "plugin_slug", F.when(F.col("errors") == "null", F.lit("[]")).otherwise(F.col("errors")).alias("e"))
    doc = runs.join(res, "run_id", "left").select(
        F.concat(F.lit('{"errors": '), F.col("e"), F.lit(", "), F.expr("substring(to_json(struct(run_id, plugin_slug, results)), 2)")).alias("value"))
    doc.write.mode("overwrite").text(path)


@query("s4_p7_p4_scanner_findings", "S4 P7 P4",
       cte("findings_semgrep") + "SELECT run_id, rule_id, replace(file_path, 'plugins/', '') AS file_path, start_line, end_line, lines FROM findings_semgrep")
def s4(t):
    """S4 + P7 + P4: scanner documents read back and flattened to findings."""
    spark = t.spark
    path = scratch_path(spark, "s4-docs")
    _semgrep_docs(t, path)
    _runs, fnd, _bad = ingest.read_semgrep(spark, path, multi_line=False)
    return fnd.select("run_id", "rule_id", "file_path", "start_line", "end_line", "lines")


@query("s4_p3_run_errors", "S4 P3",
       cte("semgrep_runs") + """SELECT run_id, plugin_slug,
 CASE WHEN errors = 'null' THEN 0 ELSE CAST(json_array_length(errors) AS INTEGER) END AS error_count, errors FROM semgrep_runs""")
def s4_errors(t):
    """S4 + P3: per run, the number of scanner errors and their JSON text
    ('null' when there are none) from its document."""
    spark = t.spark
    path = scratch_path(spark, "s4-errs")
    _semgrep_docs(t, path)
    runs, _f, _bad = ingest.read_semgrep(spark, path, multi_line=False)
    return runs.select("run_id", "plugin_slug", "error_count", "errors")


@query("s5_change_jsonl", "S5",
       cte("change_records") + "SELECT event_id, plugin_slug, ts, interface, method, url, data, name_of_changed_file, type_of_operation FROM change_records")
def s5(t):
    """Change records as JSON lines, read with a schema; corrupt lines quarantined."""
    spark = t.spark
    path = scratch_path(spark, "s5-jsonl")
    cols = [c.name for c in files.CHANGE_SCHEMA if c.name != "_corrupt_record"]
    t["change_records"].select(*cols).write.mode("overwrite") \
        .option("timestampNTZFormat", files.TS_FORMAT).json(path)
    good, _bad = files.split_corrupt(files.read_jsonl(spark, path, files.CHANGE_SCHEMA))
    return good


@query("s6_p15_hook_jsonl", "S6 P15 P16",
       cte("hook_records") + "SELECT plugin_slug, function, '[' || path0 || ']' AS params_text, error FROM hook_records")
def s6(t):
    """S6 + P15: hook records as JSON lines (one record per line, tagged with
    its plugin), read as text and parsed with from_json."""
    spark = t.spark
    path = scratch_path(spark, "s6-hooks")
    t["hook_records"].select(F.to_json(F.struct(
        "plugin_slug", "function", F.array("path0").alias("params"), "error")).alias("value")) \
        .write.mode("overwrite").text(path)
    parsed, _bad = hooks.parse_hook_lines(spark.read.text(path), schema=hooks.HOOK_SCHEMA_WITH_SLUG)
    return parsed.select("plugin_slug", "function", params_text("params").alias("params_text"), "error")


@query("s7_rules_with_counts", "S7 P6 F13 J2",
       cte("rules", "findings_semgrep") + """SELECT r.rule_id, r.severity, r.sink, coalesce(c.n, 0) AS n_findings
FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM findings_semgrep GROUP BY rule_id) c ON c.rule_id = r.rule_id
WHERE r.severity IN ('INFO', 'ERROR', 'WARNING')""")
def s7(t):
    """The rule dimension (sink derived by P6, severities checked by F13)
    with the number of findings per rule."""
    rules = ingest.rules_table(t.spark)
    counts = t["findings_semgrep"].groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"))
    return rules.join(counts, "rule_id", "left").select(
        "rule_id", "severity", "sink", F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


@query("j2_plugin_orphans", "J2",
       cte("plugins", "catalogue_raw") + "SELECT name, slug FROM plugins p WHERE NOT EXISTS (SELECT 1 FROM catalogue_raw c WHERE c.slug = p.slug)")
def j2(t):
    """Plugins whose slug has no catalogue row (a foreign-key violation)."""
    return joins.orphans(t["plugins"].select("name", "slug"), t["catalogue_raw"], "slug", "slug")


@query("j2_finding_orphans", "J2",
       cte("findings_semgrep", "semgrep_runs") + "SELECT count(*) AS n_orphans, count(*) FILTER (WHERE rule_id IS NULL) AS n_null_rule "
       "FROM findings_semgrep f WHERE NOT EXISTS (SELECT 1 FROM semgrep_runs s WHERE s.run_id = f.run_id)")
def j2b(t):
    """Findings whose run does not exist."""
    o = joins.orphans(t["findings_semgrep"], t["semgrep_runs"], "run_id", "run_id")
    return o.agg(F.count(F.lit(1)).alias("n_orphans"), F.count_if(F.col("rule_id").isNull()).alias("n_null_rule"))


@query("u5_insert_or_ignore", "U5 P1 P2",
       _CAT + """, firsts AS (SELECT slug, name, num_downloads FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY fetch_pos) AS rn FROM cat) WHERE rn = 1)
, plugins AS (""" + cte("plugins").split("plugins AS (", 1)[1].rsplit(")", 1)[0] + """)
SELECT slug, name, num_downloads FROM plugins
UNION ALL
SELECT slug, name, num_downloads FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM plugins p WHERE p.slug = f.slug)""")
def u5(t):
    """Catalogue rows inserted into plugins unless the slug exists; among
    duplicate catalogue rows the first fetched wins."""
    existing = t["plugins"].select("slug", "name", "num_downloads")
    firsts = ingest.first_per_slug(catalogue(t), "fetch_pos", ["name", "num_downloads"])
    return ingest.insert_or_ignore(existing, firsts)


_SHARDS = cte("semgrep_runs", "findings_semgrep") + """, a_runs AS (SELECT * FROM semgrep_runs WHERE run_id % 2 = 0)
, b0 AS (SELECT * FROM semgrep_runs WHERE run_id % 2 = 1)
, b_runs AS (SELECT run_id - (SELECT min(run_id) FROM b0) AS run_id, plugin_slug, error_count, errors FROM b0)
, a_f AS (SELECT finding_id, run_id, rule_id FROM findings_semgrep WHERE run_id % 2 = 0)
, b_f0 AS (SELECT finding_id, run_id, rule_id FROM findings_semgrep WHERE run_id % 2 = 1)
, b_f AS (SELECT finding_id - (SELECT min(finding_id) FROM b_f0) AS finding_id, run_id - (SELECT min(run_id) FROM b0) AS run_id, rule_id FROM b_f0)
"""


def _shards(t):
    """Stand-in: the runs split into two shard warehouses, the second's runs
    and findings numbered from 0 again (as an independent loader would)."""
    r, f = t["semgrep_runs"], t["findings_semgrep"].select("finding_id", "run_id", "rule_id")
    b0 = r.filter(F.col("run_id") % 2 == 1)
    base = b0.select(F.min("run_id")).scalar()
    a_runs = r.filter(F.col("run_id") % 2 == 0)
    b_runs = b0.withColumn("run_id", F.col("run_id") - base)
    a_f = f.filter(F.col("run_id") % 2 == 0)
    b_f0 = f.filter(F.col("run_id") % 2 == 1)
    first = b_f0.select(F.min("finding_id")).scalar()
    b_f = b_f0.withColumn("run_id", F.col("run_id") - base).withColumn("finding_id", F.col("finding_id") - first)
    return a_runs, b_runs, a_f, b_f


@query("u4_merge_shards_fixed", "U4",
       _SHARDS + """, off AS (SELECT max(run_id) + 1 AS o FROM a_runs), foff AS (SELECT max(finding_id) + 1 AS o FROM a_f)
SELECT 'run' AS kind, run_id, plugin_slug AS ref FROM a_runs
UNION ALL SELECT 'run', run_id + (SELECT o FROM off), plugin_slug FROM b_runs
UNION ALL SELECT 'finding', run_id, CAST(finding_id AS STRING) FROM a_f
UNION ALL SELECT 'finding', run_id + (SELECT o FROM off), CAST(finding_id + (SELECT o FROM foff) AS STRING) FROM b_f""")
def u4(t):
    """U4 fixed: shard runs shifted by max+1 in runs AND findings, findings by
    their own max+1, all appended."""
    a_runs, b_runs, a_f, b_f = _shards(t)
    runs, (fnd,) = merge.merge_shard(a_runs, b_runs, [a_f], [b_f], faithful=False)
    return (runs.select(F.lit("run").alias("kind"), "run_id", F.col("plugin_slug").alias("ref"))
            .unionByName(fnd.select(F.lit("finding").alias("kind"), "run_id",
                                    F.col("finding_id").cast("string").alias("ref"))))


@query("u4_merge_shards_faithful_collisions", "U4",
       _SHARDS + """, merged AS (SELECT run_id FROM a_runs UNION ALL SELECT run_id + (SELECT max(run_id) FROM a_runs) FROM b_runs)
SELECT count(*) AS n_runs, count(DISTINCT run_id) AS n_distinct_run_ids FROM merged""")
def u4_faithful(t):
    """U4 faithful: offset = max(run_id) makes the first shifted id collide."""
    a_runs, b_runs, a_f, b_f = _shards(t)
    runs, _ = merge.merge_shard(a_runs, b_runs, [a_f], [b_f], faithful=True)
    return runs.agg(F.count(F.lit(1)).alias("n_runs"), F.countDistinct("run_id").alias("n_distinct_run_ids"))


_ROUTE_SHARDS = (_SHARDS.replace(cte("semgrep_runs", "findings_semgrep"), cte("semgrep_runs", "findings_semgrep", "plugins", "ajax_routes", "ajax_route_arguments"))
                 + """, off AS (SELECT coalesce(max(run_id) + 1, 0) AS o FROM a_runs), foff AS (SELECT coalesce(max(finding_id) + 1, 0) AS o FROM a_f)
, a_rt AS (SELECT * FROM ajax_routes WHERE route_id % 3 <> 0), a_ar AS (SELECT * FROM ajax_route_arguments WHERE route_id % 3 <> 0)
, b_rt AS (SELECT 1000000007 - route_id AS route_id, plugin_slug, action, priv FROM ajax_routes WHERE route_id % 2 = 0)
, b_ar AS (SELECT 1000000007 - route_id AS route_id, method, arg_name FROM ajax_route_arguments WHERE route_id % 2 = 0)
, roff AS (SELECT coalesce(max(route_id) + 1, 0) AS o FROM a_rt)
, map AS (SELECT b.route_id AS old, coalesce(min(a.route_id), min(b.route_id) + (SELECT o FROM roff)) AS new, min(a.route_id) IS NULL AS fresh
 FROM b_rt b LEFT JOIN a_rt a ON a.plugin_slug = b.plugin_slug AND a.action = b.action AND a.priv = b.priv GROUP BY b.route_id)
""")


@query("u4_merge_whole_warehouses", "U4 U5 U6",
       _ROUTE_SHARDS + """SELECT 'plugin' AS kind, CAST(NULL AS BIGINT) AS id, slug AS ref FROM plugins
UNION ALL SELECT 'run', run_id, plugin_slug FROM a_runs
UNION ALL SELECT 'run', run_id + (SELECT o FROM off), plugin_slug FROM b_runs
UNION ALL SELECT 'finding', finding_id, CAST(run_id AS STRING) FROM a_f
UNION ALL SELECT 'finding', finding_id + (SELECT o FROM foff), CAST(run_id + (SELECT o FROM off) AS STRING) FROM b_f
UNION ALL SELECT 'route', route_id, plugin_slug || ' ' || action FROM a_rt
UNION ALL SELECT 'route', m.new, b.plugin_slug || ' ' || b.action FROM b_rt b JOIN map m ON m.old = b.route_id WHERE m.fresh
UNION ALL SELECT 'argument', route_id, method || ' ' || arg_name FROM (SELECT route_id, method, arg_name FROM a_ar
 UNION SELECT m.new, b.method, b.arg_name FROM b_ar b JOIN map m ON m.old = b.route_id)""")
def u4_whole(t):
    """U4 for whole warehouses: two shards with ids of their own and plugins,
    routes and arguments in common become one."""
    a_runs, b_runs, a_f, b_f = _shards(t)
    plugins, rts, args = t["plugins"], t["ajax_routes"], t["ajax_route_arguments"]
    own = (F.lit(1000000007) - F.col("route_id")).cast(rts.schema["route_id"].dataType)
    odd = F.regexp_extract("slug", "([0-9]+)", 1).cast("long") % 3
    merged = merge.merge_warehouses(
        {"plugins": plugins.filter(odd != 0), "semgrep_runs": a_runs, "findings_semgrep": a_f,
         "ajax_routes": rts.filter("route_id % 3 <> 0"), "ajax_route_arguments": args.filter("route_id % 3 <> 0")},
        {"plugins": plugins.filter(odd != 1), "semgrep_runs": b_runs, "findings_semgrep": b_f,
         "ajax_routes": rts.filter("route_id % 2 = 0").withColumn("route_id", own),
         "ajax_route_arguments": args.filter("route_id % 2 = 0").withColumn("route_id", own)})

    def part(name: str, kind: str, id_: Column, ref: Column) -> DataFrame:
        return merged[name].select(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), ref.cast("string").alias("ref"))

    return (part("plugins", "plugin", F.lit(None), F.col("slug"))
            .unionByName(part("semgrep_runs", "run", F.col("run_id"), F.col("plugin_slug")))
            .unionByName(part("findings_semgrep", "finding", F.col("finding_id"), F.col("run_id")))
            .unionByName(part("ajax_routes", "route", F.col("route_id"), F.concat_ws(" ", "plugin_slug", "action")))
            .unionByName(part("ajax_route_arguments", "argument", F.col("route_id"), F.concat_ws(" ", "method", "arg_name"))))


@query("w3_dense_finding_ids", "W3",
       cte("findings_semgrep") + "SELECT finding_id, row_number() OVER (ORDER BY run_id, finding_id) - 1 AS id FROM findings_semgrep")
def w3(t):
    """Dense ids 0..n-1 in (run, finding) order, numbered per partition."""
    return merge.dense_ids(t["findings_semgrep"].select("run_id", "finding_id"), ["run_id", "finding_id"]) \
        .select("finding_id", "id")


@query("p9_dynamic_analysis_table", "P9",
       cte("dynamic_analysis") + "SELECT *, num_rest_endpoints_called - num_rest_endpoints_http_ok AS num_rest_endpoints_http_other FROM dynamic_analysis")
def p9(t):
    """The dynamic-analysis table with its generated column."""
    d = t["dynamic_analysis"]
    return d.withColumn("num_rest_endpoints_http_other",
                        other_calls("num_rest_endpoints_called", "num_rest_endpoints_http_ok"))


@query("s9_warehouse_roundtrip", "S9",
       cte("plugins", "semgrep_runs", "findings_semgrep", "dynamic_analysis", "change_records") + """
SELECT 'plugins' AS tbl, count(*) AS n_rows FROM plugins
UNION ALL SELECT 'semgrep_runs', count(*) FROM semgrep_runs
UNION ALL SELECT 'findings_semgrep', count(*) FROM findings_semgrep
UNION ALL SELECT 'dynamic_analysis', count(*) FROM dynamic_analysis
UNION ALL SELECT 'findings_' || lower(interface), count(*) FROM change_records GROUP BY interface""")
def s9(t):
    """The typed warehouse written as parquet tables and read back (row counts)."""
    spark = t.spark
    root = scratch_path(spark, "s9-warehouse")
    tables = {"plugins": t["plugins"], "semgrep_runs": t["semgrep_runs"],
              "findings_semgrep": t["findings_semgrep"], "dynamic_analysis": t["dynamic_analysis"],
              "findings_changes": changes.route_changes(t["change_records"])}
    sinks.write_warehouse(tables, root, {"findings_changes": ["interface"]})
    out = None
    for name in ["plugins", "semgrep_runs", "findings_semgrep", "dynamic_analysis"]:
        df = sinks.read_table(spark, f"{root}/{name}").agg(F.count(F.lit(1)).alias("n_rows")) \
            .select(F.lit(name).alias("tbl"), "n_rows")
        out = df if out is None else out.unionByName(df)
    routed = sinks.read_table(spark, f"{root}/findings_changes").groupBy("interface").agg(
        F.count(F.lit(1)).alias("n_rows")).select(
        F.concat(F.lit("findings_"), F.lower("interface")).alias("tbl"), "n_rows")
    return out.unionByName(routed)


@query("s11_report_csv_roundtrip", "S11 A5", REGISTRY["a5_findings_per_rule"].oracle)
def s11(t):
    """The findings-per-rule report written as one CSV file, read back."""
    spark = t.spark
    path = scratch_path(spark, "s11-report")
    sinks.write_report_csv(reports.findings_per_rule(t["rules"], t["findings_semgrep"]), path, one_file=True)
    return spark.read.schema("rule_id string, n_findings long").option("header", True).csv(path)


@query("s12_routed_rest_partition", "S12 P10",
       REGISTRY["p10_routed_changes"].oracle.replace("FROM change_records", "FROM change_records WHERE interface = 'REST'"))
def s12(t):
    """Changes written partitioned by interface; the REST table is read
    back through partition pruning."""
    spark = t.spark
    path = scratch_path(spark, "s12-routed")
    sinks.write_routed(changes.route_changes(t["change_records"]), path)
    cols = REGISTRY["p10_routed_changes"].build(t).columns
    return sinks.read_table(spark, path).filter(F.col("interface") == "REST").select(*cols)


@query("s4_j4_route_documents", "S4 J4 U6 W3",
       cte("ajax_routes", "ajax_route_arguments") + """SELECT DISTINCT r.plugin_slug, r.action, r.priv, a.method, a.arg_name
FROM ajax_routes r JOIN ajax_route_arguments a ON a.route_id = r.route_id""")
def s4_routes(t):
    """S4 + W3 + J4 + U6: route documents (closures with their arguments,
    callbacks without) read back; routes get hash ids, arguments are looked
    up by (plugin, action, priv) and deduplicated."""
    spark = t.spark
    base = scratch_path(spark, "s4-routes")
    r, a = t["ajax_routes"], t["ajax_route_arguments"]
    args = a.groupBy("route_id").agg(F.collect_list(F.array("method", "arg_name")).alias("args"))
    with_args = r.join(args, "route_id")
    with_args.select("plugin_slug", "priv", "action", "args").write.mode("overwrite").json(f"{base}/closures")
    r.join(args, "route_id", "left_anti").select("plugin_slug", "action", "priv") \
        .write.mode("overwrite").json(f"{base}/functions")
    empty = spark.createDataFrame([], "plugin_slug string, action string, priv boolean, method string, arg string")
    routes, ok, _bad = ingest.load_routes(
        ingest.read_closure_routes(spark, f"{base}/closures", multi_line=False)[0],
        ingest.read_function_routes(spark, f"{base}/functions", multi_line=False)[0], empty)
    return ok.join(routes, "route_id").select("plugin_slug", "action", "priv", "method", "arg_name")


_CUT_OFF = 97   # fixed value: in the stand-ins one document or line in so many is cut off
# Bounds of a tree (a folder with its file takes two blocks and two inodes whatever
# is in it, and a listed file some of the driver's memory) and of a join's shuffle.
_WAVE_FOLDERS, _WAVE_ROWS, _PART_ROWS = 50_000, 1 << 22, 1 << 24


@query("s4_folder_documents", "S4 P3 P7 P4",
       cte("findings_semgrep", "semgrep_runs") + f"""SELECT plugin_slug,
 CASE WHEN CAST(replace(plugin_slug, 'plugin-', '') AS BIGINT) % {_CUT_OFF} = 0 THEN 'malformed' ELSE 'run' END AS status,
 CASE WHEN CAST(replace(plugin_slug, 'plugin-', '') AS BIGINT) % {_CUT_OFF} <> 0 THEN count(DISTINCT CASE WHEN error_count > 0 THEN r.run_id END) END AS error_count,
 CASE WHEN CAST(replace(plugin_slug, 'plugin-', '') AS BIGINT) % {_CUT_OFF} <> 0 THEN count(finding_id) END AS n_findings,
 CASE WHEN CAST(replace(plugin_slug, 'plugin-', '') AS BIGINT) % {_CUT_OFF} <> 0 THEN sum(start_line) END AS sum_start_line
FROM semgrep_runs r LEFT JOIN findings_semgrep f ON f.run_id = r.run_id GROUP BY plugin_slug""")
def s4_folders(t):
    """S4 on real shapes: a scanner document per plugin folder, without slug or
    run id; documents that are cut off are reported, not read as empty runs.

    The trees of folders come in waves: each is written, read, and removed
    while the next one is made (the last stays, as a single one does).  A plugin
    is in one wave, found by its hash; the findings get their plugin beforehand,
    in parts by the hash of the run."""
    spark, runs, f = t.spark, t["semgrep_runs"], t["findings_semgrep"]
    n = f.count()
    n_folders = runs.agg(F.approx_count_distinct("plugin_slug")).first()[0]       # only how many waves to make
    waves, parts = max(1, -(-n_folders // _WAVE_FOLDERS), -(-n // _WAVE_ROWS)), max(1, -(-n // _PART_ROWS))
    wave = F.pmod(F.xxhash64("plugin_slug"), F.lit(waves))
    named, kept = scratch_path(spark, "s4-findings"), scratch_path(spark, "s4-read")
    with shuffles_dropped(spark), ThreadPoolExecutor(1) as beside:
        for i in range(parts):
            mine = F.pmod(F.xxhash64("run_id"), F.lit(parts)) == i
            rows = f.filter(mine).join(runs.filter(mine).select("run_id", "plugin_slug"), "run_id").select(
                "plugin_slug", "rule_id", "file_path", "start_line", "end_line", "lines", wave.alias("wave"))
            rows.write.mode("append").option("compression", "zstd").partitionBy("wave").parquet(named)
        findings = spark.read.schema(rows.schema).parquet(named)
        old, removed = (), None
        for i in range(waves):
            if old:
                if removed:
                    removed.result()        # two trees at most are there
                removed = beside.submit(drop_paths, spark, *old)
            path, once = scratch_path(spark, "s4-folders"), scratch_path(spark, "s4-documents")
            _write_documents(runs.filter(wave == i), findings.filter(F.col("wave") == i), path)
            _read_documents(spark, path, once).write.mode("append").parquet(kept)
            old = path, once
        drop_paths(spark, named)
    return spark.read.schema("plugin_slug string, status string, error_count long, n_findings long, sum_start_line long").parquet(kept)


def _write_documents(runs, f, path):
    """Stand-in: a scanner document per plugin folder, some of them cut off."""
    res = f.groupBy("plugin_slug").agg(F.collect_list(F.struct(
        F.col("rule_id").alias("check_id"), F.concat(F.lit("plugins/"), "file_path").alias("path"),
        F.struct(F.col("start_line").alias("line")).alias("start"),
        F.struct(F.col("end_line").alias("line")).alias("end"),
        F.struct(F.lit("m").alias("message"), F.col("lines").alias("lines")).alias("extra"))).alias("results"))
    errors = runs.groupBy("plugin_slug").agg(
        F.collect_list(F.when(F.col("error_count") > 0, F.struct(F.col("run_id").alias("code")))).alias("errors"))
    doc = errors.join(res, "plugin_slug", "left").withColumn("results", F.coalesce("results", F.array().cast(res.schema["results"].dataType)))
    text = F.to_json(F.struct("errors", "results"))
    cut = F.replace(F.col("plugin_slug"), F.lit("plugin-")).cast("long") % _CUT_OFF == 0
    files.write_folders(doc.select(
        F.col("plugin_slug").alias("folder"), F.when(cut, F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text).alias("value")), path)


def _read_documents(spark, path, through):
    """The runs of a tree with the number of their findings, and its quarantine."""
    runs, findings, bad = ingest.read_semgrep(spark, path, through=through)
    per = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start_line").alias("s"))
    good = runs.join(per, "run_id", "left").select(
        "plugin_slug", F.lit("run").alias("status"), F.col("error_count").cast("long").alias("error_count"),
        F.coalesce("n", F.lit(0)).alias("n_findings"), F.col("s").alias("sum_start_line"))
    none = F.lit(None).cast("long")
    return good.union(bad.select("folder", "reason", none, none, none))


def _lines_in_folders(rows, path):
    """Stand-in: JSON lines in a folder per plugin, some of them cut off."""
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in ("plugin_slug", "event_id")]))
    cut = F.col("event_id") % _CUT_OFF == 0
    files.write_folders(rows.select(
        F.col("plugin_slug").alias("folder"), F.when(cut, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text).alias("value"))
        .repartition("folder"), path)


@query("s5_folder_changes", "S5 W1 P10",
       cte("change_records") + f"""SELECT plugin_slug, CASE WHEN event_id % {_CUT_OFF} = 0 THEN 'malformed' ELSE 'change' END AS status,
 CASE WHEN event_id % {_CUT_OFF} <> 0 THEN event_id * 3 END AS zip_file_number, CASE WHEN event_id % {_CUT_OFF} <> 0 THEN interface END AS interface,
 CASE WHEN event_id % {_CUT_OFF} <> 0 THEN url END AS url, CASE WHEN event_id % {_CUT_OFF} <> 0 THEN name_of_changed_file END AS name_of_changed_file
FROM change_records""")
def s5_folders(t):
    """S5 on real shapes: the watcher's lines per plugin folder, with their
    file number; the slug is the folder's name, bad lines are reported."""
    path = scratch_path(t.spark, "s5-folders")
    _lines_in_folders(t["change_records"].withColumn("zip_counter", F.col("event_id") * 3).drop("ts"), path)
    good, bad = ingest.read_changes(t.spark, path)
    none = F.lit(None).cast("string")
    return good.select("plugin_slug", F.lit("change").alias("status"), "zip_file_number", "interface", "url", "name_of_changed_file") \
        .union(bad.select("folder", "reason", none.cast("long"), none, none, none))


@query("s6_folder_hooks", "S6 P15 P16",
       cte("hook_records") + f"""SELECT plugin_slug, CASE WHEN event_id % {_CUT_OFF} = 0 THEN 'malformed' ELSE 'record' END AS status,
 CASE WHEN event_id % {_CUT_OFF} <> 0 THEN function END AS function, CASE WHEN event_id % {_CUT_OFF} <> 0 THEN '[' || path0 || ', r]' END AS params_text,
 CASE WHEN event_id % {_CUT_OFF} <> 0 THEN error END AS error FROM hook_records""")
def s6_folders(t):
    """S6 on real shapes: hook records per plugin folder, one per line, with
    several parameters; bad lines are reported."""
    path = scratch_path(t.spark, "s6-folders")
    _lines_in_folders(t["hook_records"].withColumn("params", F.array("path0", F.lit("r"))).drop("path0"), path)
    good, bad = ingest.read_hooks(t.spark, path)
    none = F.lit(None).cast("string")
    return good.select("plugin_slug", F.lit("record").alias("status"), "function", params_text("params").alias("params_text"), "error") \
        .union(bad.select("folder", "reason", none, none, none))


# --- the typed warehouse: planted faults in the stand-ins -------------------
# plugins: every 50th (remainder 7) missing, every 100th twice, every 60th
# without a version; one rule has an unknown severity; the orphans follow from
# the references, and some finding ids of the tables repeat.
_FAULTY = cte("plugins", "dynamic_analysis", "ajax_routes", "ajax_route_arguments", "semgrep_runs", "rules", "findings_semgrep",
              "change_records", "hook_records") + """,
p0 AS (SELECT *, CAST(replace(slug, 'plugin-', '') AS BIGINT) AS k FROM plugins),
p1 AS (SELECT name, slug, CASE WHEN k % 60 = 1 THEN NULL ELSE version END AS version, download_link, num_downloads, active_installations
 FROM p0 WHERE k % 50 <> 7),
plugins_g AS (SELECT * FROM p1 WHERE version IS NOT NULL),
rules_b AS (SELECT rule_id, CASE WHEN rule_id = 'WP-DEBUG_enabling' THEN 'FATAL' ELSE severity END AS severity, sink FROM rules),
rules_g AS (SELECT * FROM rules_b WHERE severity <> 'FATAL'),
dyn_g AS (SELECT d.* FROM dynamic_analysis d WHERE plugin_slug IN (SELECT slug FROM plugins_g)),
routes_g AS (SELECT * FROM ajax_routes WHERE plugin_slug IN (SELECT slug FROM plugins_g)),
args_g AS (SELECT * FROM ajax_route_arguments WHERE route_id IN (SELECT route_id FROM routes_g)),
runs_g AS (SELECT * FROM semgrep_runs WHERE plugin_slug IN (SELECT slug FROM plugins_g)),
f_all AS (SELECT *, rule_id NOT IN (SELECT rule_id FROM rules_g) AS no_rule, run_id NOT IN (SELECT run_id FROM runs_g) AS no_run,
 row_number() OVER (PARTITION BY finding_id ORDER BY run_id, rule_id, file_path, start_line, end_line, lines NULLS FIRST) > 1 AS again FROM findings_semgrep),
c_all AS (SELECT *, plugin_slug NOT IN (SELECT plugin_slug FROM dyn_g) AS no_plugin FROM change_records),
h_all AS (SELECT *, plugin_slug NOT IN (SELECT plugin_slug FROM dyn_g) AS no_plugin FROM hook_records),
kept AS (
SELECT 'plugins' AS tbl, concat_ws('|', name, slug, version, download_link, num_downloads, active_installations) AS r FROM plugins_g
UNION ALL SELECT 'dynamic_analysis', concat_ws('|', plugin_slug, num_unique_rest_endpoints, num_rest_endpoints_called, num_rest_endpoints_http_ok,
 num_ajax_endpoints, num_ajax_endpoints_called, num_ajax_endpoints_http_ok, CAST(time_spend * 100 AS BIGINT)) FROM dyn_g
UNION ALL SELECT 'ajax_routes', concat_ws('|', route_id, plugin_slug, action, priv) FROM routes_g
UNION ALL SELECT 'ajax_route_arguments', concat_ws('|', route_id, method, arg_name) FROM args_g
UNION ALL SELECT 'semgrep_runs', concat_ws('|', run_id, plugin_slug, error_count, errors) FROM runs_g
UNION ALL SELECT 'rules', concat_ws('|', rule_id, severity, sink) FROM rules_g
UNION ALL SELECT 'findings_semgrep', concat_ws('|', finding_id, run_id, rule_id, file_path, start_line, end_line, lines) FROM f_all WHERE NOT no_rule AND NOT no_run AND NOT again
UNION ALL SELECT 'findings_rest', concat_ws('|', event_id, plugin_slug, trim(url, 'http://localhost:8080'), method, event_id * 3, data, name_of_changed_file, type_of_operation) FROM c_all WHERE NOT no_plugin AND interface = 'REST'
UNION ALL SELECT 'findings_ajax', concat_ws('|', event_id, plugin_slug, trim(url, 'http://localhost:8080'), method, event_id * 3, data, name_of_changed_file, type_of_operation) FROM c_all WHERE NOT no_plugin AND interface = 'AJAX'
UNION ALL SELECT 'findings_wp_cli', concat_ws('|', event_id, plugin_slug, url, type_of_operation, event_id * 3, name_of_changed_file) FROM c_all WHERE NOT no_plugin AND interface = 'WP_CLI'
UNION ALL SELECT 'findings_function_hooks', concat_ws('|', event_id, plugin_slug, function, '[' || path0 || ']', error) FROM h_all WHERE NOT no_plugin)
"""
_WAREHOUSE_SQL = _FAULTY + """
SELECT tbl, 'kept' AS status, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(r), 1, 8) AS BIGINT)) AS BIGINT) AS content FROM kept GROUP BY tbl
UNION ALL SELECT 'plugins', 'null:version', count(*), NULL FROM p1 WHERE version IS NULL
UNION ALL SELECT 'plugins', 'key:slug', count(*), NULL FROM p0 WHERE k % 100 = 0
UNION ALL SELECT 'rules', 'domain:severity', count(*), NULL FROM rules_b WHERE severity = 'FATAL'
UNION ALL SELECT 'dynamic_analysis', 'orphan:plugin_slug', (SELECT count(*) FROM dynamic_analysis) - (SELECT count(*) FROM dyn_g), NULL
UNION ALL SELECT 'ajax_routes', 'orphan:plugin_slug', (SELECT count(*) FROM ajax_routes) - (SELECT count(*) FROM routes_g), NULL
UNION ALL SELECT 'ajax_route_arguments', 'orphan:route_id', (SELECT count(*) FROM ajax_route_arguments) - (SELECT count(*) FROM args_g), NULL
UNION ALL SELECT 'semgrep_runs', 'orphan:plugin_slug', (SELECT count(*) FROM semgrep_runs) - (SELECT count(*) FROM runs_g), NULL
UNION ALL SELECT 'findings_semgrep', 'key:finding_id', count(*), NULL FROM f_all WHERE again
UNION ALL SELECT 'findings_semgrep', 'orphan:rule_id', count(*), NULL FROM f_all WHERE no_rule
UNION ALL SELECT 'findings_semgrep', 'orphan:run_id', count(*), NULL FROM f_all WHERE no_run
UNION ALL SELECT 'findings_' || lower(interface), 'orphan:plugin_slug', count(*), NULL FROM c_all WHERE no_plugin GROUP BY interface
UNION ALL SELECT 'findings_function_hooks', 'orphan:plugin_slug', count(*), NULL FROM h_all WHERE no_plugin HAVING count(*) > 0"""


def _faulty_tables(t):
    """Stand-in: rows for all tables of the warehouse, some of them faulty."""
    k = F.replace(F.col("slug"), F.lit("plugin-")).cast("long")
    p = t["plugins"].filter(k % 50 != 7).withColumn("version", F.when(k % 60 != 1, F.col("version")))
    twice = p.filter(k % 100 == 0).withColumn("name", F.concat(F.col("name"), F.lit("~")))
    rules = t["rules"].withColumn("severity", F.when(F.col("rule_id") == "WP-DEBUG_enabling", F.lit("FATAL")).otherwise(F.col("severity")))
    routed = changes.route_changes(t["change_records"].withColumn("zip_file_number", F.col("event_id") * 3), "event_id") \
        .withColumnRenamed("event_id", "finding_id")
    routes = {f"findings_{i.lower()}": routed.filter(F.col("interface") == i) for i in ("REST", "AJAX", "WP_CLI")}
    hook = t["hook_records"].select(F.col("event_id").alias("finding_id"), "plugin_slug", "function",
                                    params_text(F.array("path0")).alias("params"), "error")
    same = {name: t[name] for name in ("dynamic_analysis", "ajax_routes", "ajax_route_arguments", "semgrep_runs", "findings_semgrep")}
    return {"plugins": p.unionByName(twice), "rules": rules, "findings_function_hooks": hook, **routes, **same}


@query("s9_j2_f13_typed_warehouse", "S9 J2 F13 U6 P10 P16", _WAREHOUSE_SQL)
def s9_checked(t):
    """S9 + J2 + F13: all eleven tables checked against their types, keys,
    references and domains, written, and read back with a hash of the content;
    the quarantine by rule."""
    root = scratch_path(t.spark, "s9-typed")
    warehouse.load(_faulty_tables(t), root)
    out = None
    for name, table in warehouse.WAREHOUSE.items():
        cells = [(F.col(c) * 100).cast("long") if kind == "double" else F.col(c) for c, (kind, _) in table.columns.items()]
        digest = F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cells])), 1, 8), 16, 10).cast("long")
        kept = warehouse.read(t.spark, root, name).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).alias("content"))
        bad = (warehouse.quarantine(t.spark, root, name).select(F.explode("violations").alias("status"))
               .groupBy("status").agg(F.count(F.lit(1)).alias("n_rows")))
        both = kept.select(F.lit(name).alias("tbl"), F.lit("kept").alias("status"), "n_rows", "content").unionByName(
            bad.select(F.lit(name).alias("tbl"), "status", "n_rows", F.lit(None).cast("long").alias("content")))
        out = both if out is None else out.unionByName(both)
    return out
