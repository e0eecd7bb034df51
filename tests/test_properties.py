"""Property checks: chunked scans equal plain windows, invariances, identities."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaklens.operators import attribution, hooks, reports
from leaklens.operators.sequence import bucket_levels, scan
from leaklens.plans.attribution import watch_events


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randint(0, 40)}"
        order = rnd.randint(0, 5000)
        val = rnd.choice([None, None, None, f"v{i}"])
        rows.append((key, order, i, val))
    return spark.createDataFrame(rows, "k string, o long, i long, v string")


def test_chunked_last_equals_plain_window(spark):
    df = _skewed(spark)
    levels, names = bucket_levels(F.col("o"), [7, 49, 343])
    got = scan(df, ["k"], ["o", "i"], "v", "out", "last", levels, names)
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.last("v", ignorenulls=True).over(w))
    a = sorted((r["i"], r["out"]) for r in got.collect())
    b = sorted((r["i"], r["ref"]) for r in ref.collect())
    assert a == b


def test_chunked_sum_equals_plain_window(spark):
    df = _skewed(spark).withColumn("x", F.lit(1).cast("long"))
    levels, names = bucket_levels(F.col("o"), [5, 100])
    got = scan(df, ["k"], ["o", "i"], "x", "out", "sum", levels, names)
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.row_number().over(w))
    assert sorted((r["i"], r["out"]) for r in got.collect()) == sorted((r["i"], r["ref"]) for r in ref.collect())


def test_stream_equals_batch_attribution(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    sf = "/root/testdata/sf0.001"
    a = sorted(tuple(r) for r in qs["j7_attributed_changes"](spark, sf).select(
        "event_id", "plugin_slug", "test", "zip_counter").collect())
    b = sorted(tuple(r) for r in qs["st1_stream_attribution"](spark, sf).select(
        "event_id", "plugin_slug", "test", "zip_counter").collect())
    assert a == b and len(a) > 0


def test_attribution_invariant_under_repartition(spark, tables):
    ev = watch_events(tables)
    a = sorted(tuple(r) for r in attribution.attribute_changes(ev).collect())
    b = sorted(tuple(r) for r in attribution.attribute_changes(ev.repartition(5, "event_id")).collect())
    assert a == b


def test_classification_identity_and_invariance(spark, tables):
    f = tables["findings_semgrep"]
    a = {r["rule_id"]: r.asDict() for r in reports.log_name_classes(f).collect()}
    b = {r["rule_id"]: r.asDict() for r in reports.log_name_classes(f.repartition(7)).collect()}
    assert a == b
    for r in a.values():
        assert r["n_other_fixed"] == r["n_total"] - r["n_error"] - r["n_debug"] - r["n_htaccess_fixed"]
        for c in ("n_error", "n_debug", "n_securing", "n_htaccess", "n_from_variable"):
            assert 0 <= r[c] <= r["n_total"]


def test_distinct_not_above_count_and_antijoin_disjoint(spark, tables):
    from leaklens.plans.hook_change_reports import hook_table

    h = hook_table(tables)
    r = hooks.log_path_counts(h).collect()[0]
    assert r["n_distinct_log_paths"] <= r["n_log_paths"]
    base = {x[0] for x in tables["baseline_paths"].collect()}
    kept = {x[0] for x in h.select(F.element_at("params", 1)).collect()}
    assert not (base & kept)


def test_chunked_scan_keeps_null_keys(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3}", i * 3 % 97, i, f"v{i}" if i % 4 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, i long, v string")
    levels, names = bucket_levels(F.col("o"), [4, 16])
    got = scan(df, ["k"], ["o", "i"], "v", "out", "last", levels, names)
    w = Window.partitionBy("k").orderBy("o", "i").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("ref", F.last("v", ignorenulls=True).over(w))
    assert got.count() == 400
    assert sorted((r["i"], r["out"]) for r in got.collect()) == sorted((r["i"], r["ref"]) for r in ref.collect())


def test_hook_overview_approx_close_to_exact(spark, tables):
    from leaklens.plans.hook_change_reports import hook_table

    h = hook_table(tables)
    exact = hooks.hook_overview(h).collect()[0]
    approx = hooks.hook_overview(h, approx_rsd=0.01).collect()[0]
    assert approx["n_hooks"] == exact["n_hooks"]
    assert abs(approx["n_paths"] - exact["n_paths"]) <= max(2, 0.05 * exact["n_paths"])
    assert approx["n_functions"] == exact["n_functions"]


def test_all_reports_build_and_run(spark, tables):
    from leaklens.plans.hook_change_reports import hook_table

    w = {n: tables[n] for n in ("plugins", "rules", "semgrep_runs", "findings_semgrep", "ajax_routes",
                                "ajax_route_arguments", "dynamic_analysis", "findings_rest", "findings_ajax",
                                "findings_wp_cli")}
    w["findings_function_hooks"] = hook_table(tables).drop("params_text")
    out = reports.all_reports(w)
    assert len(out) == 24
    for name, df in out.items():
        df.write.format("noop").mode("overwrite").save()


def test_cluster_conf_fills_only_unset(spark):
    from leaklens.session import CLUSTER_CONF, apply_cluster_conf

    saved = {k: spark.conf.get(k, None) for k in CLUSTER_CONF}
    try:
        before = spark.conf.get("spark.sql.shuffle.partitions")
        applied = apply_cluster_conf(spark, overrides={"spark.sql.shuffle.partitions": before})
        assert spark.conf.get("spark.sql.shuffle.partitions") == before          # explicit override kept
        assert set(applied) <= set(CLUSTER_CONF)
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:   # the session is shared by later tests: put every option back
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
