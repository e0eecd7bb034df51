"""Sinks (S9, S11, S12) and the streaming jobs' restart behaviour."""

import dataclasses
import datetime as dt
import io
import json
from contextlib import redirect_stdout

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaklens.operators import changes
from leaklens.sources import files, sinks, warehouse
from leaklens.operators.attribution import attributed
from leaklens.streaming.attribution_stream import (
    RECORD_SCHEMA, TEST_FIELDS, read_tables, run_attribution, run_routed_changes, run_watch_to_tables)


def _changes(spark):
    rows = [(i, "p1", dt.datetime(2024, 1, 1, 0, 0, i), iface, "GET", "http://localhost:8080/wp-json/a/v1/x",
             "{}", f"/var/www/html/wp-content/f{i}.log", "DELETE")
            for i, iface in enumerate(["REST", "AJAX", "WP_CLI", "REST"])]
    schema = T.StructType([c for c in files.CHANGE_SCHEMA if c.name != "_corrupt_record"])
    return spark.createDataFrame(rows, schema)


def test_routed_write_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "routed")
    sinks.write_routed(changes.route_changes(_changes(spark)), path)
    rest = sinks.read_table(spark, path).filter(F.col("interface") == "REST")
    assert rest.count() == 2
    buf = io.StringIO()
    with redirect_stdout(buf):
        rest.explain("formatted")
    assert "PartitionFilters: [isnotnull(interface" in buf.getvalue()
    cli = sinks.read_table(spark, path).filter(F.col("interface") == "WP_CLI").collect()
    assert cli[0]["command"] == "http://localhost:8080/wp-json/a/v1/x" and cli[0]["url"] is None


def test_report_csv_is_one_file(spark, tmp_path):
    path = tmp_path / "report"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "rule_id string, n long").repartition(3)
    sinks.write_report_csv(df, str(path))
    parts = [p for p in path.iterdir() if p.name.startswith("part-")]
    assert len(parts) == 1


def test_long_report_keeps_its_order_over_files(spark, tmp_path):
    path = str(tmp_path / "long")
    sinks.write_report_csv(spark.range(0, 1000, 1, 8).orderBy("id"), path, one_file=False)
    ids = [int(line) for p in sorted((tmp_path / "long").glob("part-*")) for line in p.read_text().split()[1:]]
    assert ids == list(range(1000))


def test_warehouse_overwrite_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "wh")
    t = {"plugins": spark.createDataFrame([("a", 1)], "slug string, n int")}
    sinks.write_warehouse(t, root)
    sinks.write_warehouse(t, root)        # a retried job
    assert sinks.read_table(spark, f"{root}/plugins").count() == 1


def test_routed_stream_restart_does_not_duplicate(spark, tmp_path):
    src, table, ck = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck")
    _changes(spark).write.option("timestampNTZFormat", files.TS_FORMAT).json(src)
    first = run_routed_changes(spark, src, table, ck).count()
    # restart on the same checkpoint with no new input: nothing is re-appended
    again = run_routed_changes(spark, src, table, ck).count()
    assert first == again == 4


def test_attribution_stream_state_crosses_batches(spark, tmp_path):
    src, sink, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    batches = [
        [(1, "p", 0, "set", "T1"), (2, "p", 1, "change", None)],
        [(3, "p", 2, "change", None), (4, "p", 3, "clear", None)],
        [(5, "p", 4, "change", None), (6, "p", 5, "set", "T2"), (7, "p", 6, "change", None)],
    ]
    for i, rows in enumerate(batches):
        (tmp_path / "in").mkdir(exist_ok=True)
        with open(tmp_path / "in" / f"{i:03d}.json", "w") as fh:
            for eid, slug, sec, kind, test in rows:
                fh.write(json.dumps({"event_id": eid, "plugin_slug": slug,
                                     "ts": f"2024-01-01T00:00:{sec:02d}.000000", "kind": kind, "test": test}) + "\n")
        out = run_attribution(spark, src, sink, ck)
    got = sorted((r["event_id"], r["test"], r["zip_counter"]) for r in out.collect())
    # batch 2 needs the marker of batch 1; after the clear, nothing until T2
    assert got == [(2, "T1", 1), (3, "T1", 2), (7, "T2", 3)]


def test_chunked_stream_state_and_restart(spark, tmp_path):
    from leaklens.streaming.attribution_stream import run_attribution_chunked

    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    (tmp_path / "in").mkdir()
    batches = [
        [(1, "p", 0, "set", "T1"), (2, "p", 1, "change", None), (8, "q", 1, "change", None)],
        [(3, "p", 2, "change", None), (4, "p", 3, "clear", None), (9, "q", 2, "set", "Q")],
        [(5, "p", 4, "change", None), (6, "p", 5, "set", "T2"), (7, "p", 6, "change", None),
         (10, "q", 7, "change", None)],
    ]
    for i, rows in enumerate(batches):
        with open(tmp_path / "in" / f"{i:03d}.json", "w") as fh:
            for eid, slug, sec, kind, test in rows:
                fh.write(json.dumps({"event_id": eid, "plugin_slug": slug,
                                     "ts": f"2024-01-01T00:00:{sec:02d}.000000", "kind": kind, "test": test}) + "\n")
        res = run_attribution_chunked(spark, src, out, ck)
    got = sorted((r["event_id"], r["test"], r["zip_counter"]) for r in res.collect())
    assert got == [(2, "T1", 1), (3, "T1", 2), (7, "T2", 3), (10, "Q", 1)]
    again = run_attribution_chunked(spark, src, out, ck)     # restart, no new input
    assert sorted((r["event_id"], r["zip_counter"]) for r in again.collect()) == [(2, 1), (3, 2), (7, 3), (10, 1)]


def test_report_cli_over_a_warehouse(spark, tables, tmp_path):
    from leaklens.operators import changes as ch
    from leaklens.plans.hook_change_reports import hook_table
    from leaklens.report import write_reports

    root, out = str(tmp_path / "wh"), str(tmp_path / "reports")
    w = {n: tables[n] for n in ("plugins", "rules", "semgrep_runs", "findings_semgrep", "ajax_routes",
                                "ajax_route_arguments", "dynamic_analysis")}
    w["findings_function_hooks"] = hook_table(tables).drop("params_text")
    w["findings_changes"] = ch.route_changes(tables["change_records"])
    sinks.write_warehouse(w, root, {"findings_changes": ["interface"]})
    names = write_reports(spark, root, out)
    assert len(names) == 24
    fpr = spark.read.option("header", True).csv(f"{out}/findings_per_rule")
    assert fpr.count() == 10


def _records(n=400):
    """Watcher records of three plugins in order, one of them hot; and what a
    plain loop over them records."""
    import random

    rng, out, state, number = random.Random(11), [], {}, {}
    rows = []
    for i in range(n):
        slug = rng.choice(["hot"] * 8 + ["p1", "p2"])
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * i)
        kind = rng.choice(["change"] * 6 + ["set", "clear"])
        test = (rng.choice(["REST", "AJAX", "WP_CLI"]), "GET", f"http://localhost:8080/wp-json/a/{i}", f"d{i}")
        file = (f"/f{i}.log", "DELETE")
        rows.append((i, slug, ts, kind, *(test if kind == "set" else (None,) * 4), *(file if kind == "change" else (None,) * 2)))
        if kind != "change":
            state[slug] = test if kind == "set" else None
        elif state.get(slug):
            number[slug] = number.get(slug, 0) + 1
            out.append((i, slug, *state[slug], *file, number[slug]))
    return rows, out


def test_attributed_records_equal_a_loop(spark):
    rows, want = _records()
    events = spark.createDataFrame(rows, RECORD_SCHEMA)
    for widths in ([60_000_000, 3_600_000_000], [120_000_000], [1_000_000, 60_000_000, 600_000_000]):
        got = attributed(events.repartition(7), TEST_FIELDS, widths=widths)
        got = got.select("event_id", "plugin_slug", *TEST_FIELDS, "name_of_changed_file", "type_of_operation", "zip_counter")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_stream_into_tables_equals_a_loop_and_cleans_up(spark, tmp_path):
    rows, want = _records()
    src, tables, ck = (str(tmp_path / x) for x in ("in", "tables", "ck"))
    for a in range(0, 300, 60):
        spark.createDataFrame(rows[a:a + 60], RECORD_SCHEMA).coalesce(1).write.mode("append") \
            .option("timestampNTZFormat", files.TS_FORMAT).json(src)
    run_watch_to_tables(spark, src, tables, ck)
    # a second run goes on from the state of the first
    spark.createDataFrame(rows[300:], RECORD_SCHEMA).coalesce(1).write.mode("append") \
        .option("timestampNTZFormat", files.TS_FORMAT).json(src)
    got = run_watch_to_tables(spark, src, tables, ck)
    assert sorted((r.event_id, r.plugin_slug, r.zip_file_number, r.interface) for r in got.collect()) == \
        [(w[0], w[1], w[-1], w[2]) for w in want]
    assert sorted(p.name for p in (tmp_path / "ck/watch-state").iterdir()) == ["version=4", "version=5"]
    # rows of a batch that broke off before its manifest line are not read
    (tmp_path / "tables/manifest/batch=5").rename(tmp_path / "unlisted")
    assert {r.event_id for r in read_tables(spark, tables).collect()} == {w[0] for w in want if w[0] < 300}


def test_warehouse_quarantines_every_kind_of_fault(spark, tmp_path):
    root = str(tmp_path / "wh")
    contract = {"plugins": warehouse.WAREHOUSE["plugins"], "semgrep_runs": warehouse.WAREHOUSE["semgrep_runs"],
                "rules": warehouse.WAREHOUSE["rules"], "findings_semgrep": warehouse.WAREHOUSE["findings_semgrep"]}
    plugins = spark.createDataFrame(
        [("A", "a", "1", "u", "5", "1"), ("A", "a", "1", "u", "5", "1"), ("B", "b", "1", "u", "many", "1"), ("Z", "a", "2", "u", "6", "1"),
         ("C", "c", None, "u", "1", "1")], "name string, slug string, version string, download_link string, num_downloads string, active_installations string")
    runs = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, None, None)], "run_id long, plugin_slug string, error_count int")
    rules = spark.createDataFrame([("r", "INFO", None), ("s", "FATAL", None)], "rule_id string, severity string, sink string")
    finding = "finding_id long, run_id long, rule_id string, file_path string, start_line int, end_line int, extra string"
    findings = spark.createDataFrame([(1, 1, "r", "f", 1, 1, "x"), (2, 2, "s", "f", 1, 1, "x"), (3, 1, "none", "f", 1, 1, "x")], finding)
    for _ in range(2):      # a repeated load leaves no duplicates
        counts = warehouse.load({"plugins": plugins, "semgrep_runs": runs, "rules": rules, "findings_semgrep": findings}, root, contract)
    assert counts == {"plugins": {"read": 5, "kept": 1, "quarantined": 4}, "semgrep_runs": {"read": 3, "kept": 1, "quarantined": 2},
                      "rules": {"read": 2, "kept": 1, "quarantined": 1}, "findings_semgrep": {"read": 3, "kept": 1, "quarantined": 2}}
    assert [tuple(r) for r in warehouse.read(spark, root, "plugins", contract).collect()] == [("A", "a", "1", "u", 5, 1)]
    broken = {name: sorted(tuple(r.violations) for r in warehouse.quarantine(spark, root, name, contract).collect()) for name in contract}
    assert broken == {
        "plugins": [("key:slug",), ("key:slug",), ("null:version",), ("type:num_downloads",)],
        "semgrep_runs": [("null:plugin_slug", "null:error_count"), ("orphan:plugin_slug",)],
        "rules": [("domain:severity",)], "findings_semgrep": [("orphan:rule_id",), ("orphan:rule_id", "orphan:run_id")]}
    raw = [json.loads(r.raw) for r in warehouse.quarantine(spark, root, "plugins", contract).collect()]
    assert {"many"} == {r["num_downloads"] for r in raw if r["slug"] == "b"}
    (row,) = warehouse.read(spark, root, "findings_semgrep", contract).collect()
    assert (row.finding_id, row.message) == (1, None)


def _finding_rows(spark):
    """Keys that come once, with equal rows, with other rows, with a fault, and none."""
    rows = [(k, 1, "r", f"f{k % 7}", k, k + 1, None if k % 5 else "line") for k in range(60)]
    rows += rows[:10] + rows[:5] + [(k, 2, "r", "a", 0, 0, None) for k in range(5, 15)] + [(3, 9, "s", None, 1, 1, "x"), (None, 1, "r", "f", 1, 1, "x")]
    return spark.createDataFrame(rows, "finding_id long, run_id long, rule_id string, file_path string, start_line int, end_line int, lines string")


def test_warehouse_in_parts_is_the_warehouse_at_once(spark, tmp_path, monkeypatch):
    table = warehouse.WAREHOUSE["findings_semgrep"]
    contract = {"findings_semgrep": dataclasses.replace(table, references={}), "args": warehouse.Table(
        {"a": ("int", False), "b": ("double", True)}, ("a", "b"))}
    given = {"findings_semgrep": _finding_rows(spark),
             "args": spark.createDataFrame([(str(k % 9), [0.0, -0.0, 1.5][k % 3]) for k in range(40)] + [("x", 1.0)], "a string, b double")}

    def loaded(root):
        counts = warehouse.load(given, root, contract)
        return counts, {n: [sorted(map(str, read(spark, root, n, contract).collect())) for read in (warehouse.read, warehouse.quarantine)]
                        for n in contract}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    whole = loaded(str(tmp_path / "whole"))
    counts, got = whole
    assert counts["findings_semgrep"] == {"read": 87, "kept": 60, "quarantined": 27}
    assert sum("key:finding_id" in r for r in got["findings_semgrep"][1]) == 25
    monkeypatch.setattr(warehouse, "PART_ROWS", 45)
    shuffles = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    there = shuffles.size()
    assert loaded(str(tmp_path / "parts")) == whole
    assert spark.conf.get(key, None) == before and shuffles.size() <= there      # no shuffle files are left


def test_warehouse_shuffles_no_text_of_rows(spark):
    """Where the typed columns tell a row's text, it is made after the last shuffle."""
    table = dataclasses.replace(warehouse.WAREHOUSE["findings_semgrep"], references={})
    rows = _finding_rows(spark)
    for given, retold in ((rows, True), (rows.withColumn("start_line", F.col("start_line").cast("string")), False)):
        checked = warehouse.checked(given, table, {})
        assert any("raw#" in below for below in _below_aggregates(checked._jdf.queryExecution().optimizedPlan())) != retold
        line = 0 if retold else "0"
        again = {"finding_id": 5, "run_id": 2, "rule_id": "r", "file_path": "a", "start_line": line, "end_line": 0}
        text = [r.raw for r in checked.collect() if r.finding_id == 5 and r.violations == ["key:finding_id"]]
        assert sorted(json.loads(t)["run_id"] for t in text) == [1, 2] and json.dumps(again, separators=(",", ":")) in text


def _below_aggregates(plan):
    if plan.nodeName() == "Aggregate":
        yield plan.child().toString()
    for i in range(plan.children().size()):
        yield from _below_aggregates(plan.children().apply(i))
