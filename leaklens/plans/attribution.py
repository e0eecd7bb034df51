"""Queries for attribution, carry-forward, counters and run-log context."""

from __future__ import annotations

from pyspark.sql import functions as F

from leaklens.functions.predicates import finished_line
from leaklens.operators import attribution, changes
from leaklens.plans.registry import query
from leaklens.session import scratch_path
from leaklens.sources import sinks
from leaklens.sources.adapters import cte


def watch_events(t):
    """The marker/change stream keyed by plugin slug."""
    return t["watch_stream"].withColumn("plugin_slug", F.concat(F.lit("plugin-"), F.col("user_id").cast("string")))


_W = "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

J7_SQL = cte("watch_stream") + f""", s AS (
 SELECT *, last_value(CASE WHEN kind <> 'change' THEN event_id END IGNORE NULLS) OVER ({_W}) AS marker_id FROM watch_stream),
a AS (SELECT s.event_id, s.user_id, s.ts, m.test FROM s JOIN watch_stream m ON m.event_id = s.marker_id
      WHERE s.kind = 'change' AND m.kind = 'set')
SELECT event_id, 'plugin-' || CAST(user_id AS STRING) AS plugin_slug, ts, test,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS zip_counter FROM a"""


@query("j7_attributed_changes", "J7 W1 W5", J7_SQL)
def j7(t):
    """J7+W1: changes attributed to the current test, with zip counter."""
    return attribution.attribute_changes(watch_events(t))


TEST = ["interface", "method", "url", "data"]      # what a marker says of the running test
ROUTED = ["event_id", "plugin_slug", "url", "http_method", "data", "command", "name_of_changed_file", "type_of_operation",
          "zip_file_number", "interface"]

ROUTED_SQL = cte("watch_records") + """, s AS (
 SELECT *, last_value(CASE WHEN kind <> 'change' THEN event_id END IGNORE NULLS) OVER (
  PARTITION BY plugin_slug ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker_id FROM watch_records),
a AS (SELECT s.event_id, s.plugin_slug, m.interface, m.method, m.url, m.data, s.name_of_changed_file, s.type_of_operation,
  row_number() OVER (PARTITION BY s.plugin_slug ORDER BY s.ts, s.event_id) AS zip_file_number
  FROM s JOIN watch_records m ON m.event_id = s.marker_id WHERE s.kind = 'change' AND m.kind = 'set')
SELECT event_id, plugin_slug, CASE WHEN interface <> 'WP_CLI' THEN trim(url, 'http://localhost:8080') END AS url,
 CASE WHEN interface <> 'WP_CLI' THEN method END AS http_method, CASE WHEN interface <> 'WP_CLI' THEN data END AS data,
 CASE WHEN interface = 'WP_CLI' THEN url END AS command, name_of_changed_file, type_of_operation, zip_file_number, interface FROM a"""


@query("j7_s12_attributed_tables", "J7 W1 W5 P5 P10 S12", ROUTED_SQL)
def j7_s12(t):
    """J7 + W1 + P5 + P10 + S12 as one flow: changes take the test of their
    marker and their number, and land in the three routed tables."""
    path = scratch_path(t.spark, "j7-tables")
    rows = attribution.attributed(t["watch_records"], TEST, counter="zip_file_number")
    sinks.write_routed(changes.route_changes(rows, "event_id"), path)
    return sinks.read_table(t.spark, path).select(*ROUTED)


@query("w5_current_marker", "W5",
       cte("watch_stream") + f""", s AS (
 SELECT *, last_value(CASE WHEN kind <> 'change' THEN event_id END IGNORE NULLS) OVER ({_W}) AS marker_id FROM watch_stream)
SELECT s.event_id, 'plugin-' || CAST(s.user_id AS STRING) AS plugin_slug, s.kind, m.kind AS current_kind, m.test AS current_test,
 s.marker_id AS current_event_id
FROM s LEFT JOIN watch_stream m ON m.event_id = s.marker_id""")
def w5(t):
    """Latest marker carried forward onto every event."""
    cur = attribution.current_marker(watch_events(t))
    return cur.select("event_id", "plugin_slug", "kind",
                      F.col("current.kind").alias("current_kind"),
                      F.col("current.test").alias("current_test"),
                      F.col("current.event_id").alias("current_event_id"))


@query("w1_change_counter", "W1",
       cte("change_records") + """SELECT event_id, plugin_slug, interface,
 row_number() OVER (PARTITION BY plugin_slug ORDER BY ts, event_id) AS zip_counter FROM change_records""")
def w1(t):
    """Running change counter per plugin over all change records."""
    c = t["change_records"]
    levels, names = attribution._time_levels("ts")
    return attribution.running_count(c, "plugin_slug", ["ts", "event_id"], "zip_counter",
                                     levels, names).select("event_id", "plugin_slug", "interface", "zip_counter")


@query("w2_finished_context_lines", "W2 F12",
       cte("run_log_lines") + """, p AS (
 SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no, line) AS pos FROM run_log_lines),
m AS (SELECT file, pos FROM p WHERE line LIKE '%Dynamic Analysis Finished%')
SELECT file, line_no, line FROM p
WHERE EXISTS (SELECT 1 FROM m WHERE m.file = p.file AND p.pos BETWEEN m.pos - 5 AND m.pos + 5)""")
def w2(t):
    """5 lines before and after each 'finished' line, per run log."""
    return attribution.context_lines(t["run_log_lines"], finished_line("line"))


@query("a24_finished_runs", "A24 F12",
       cte("run_log_lines") + "SELECT count(*) FILTER (WHERE line LIKE '%Dynamic Analysis Finished%') AS n_finished_runs "
       "FROM run_log_lines")
def a24a(t):
    """How many runs printed the finished marker."""
    return t["run_log_lines"].agg(F.count_if(finished_line("line")).alias("n_finished_runs"))


@query("a24_hook_records_per_plugin", "A24",
       cte("hook_records") + "SELECT plugin_slug, count(*) AS n_records FROM hook_records GROUP BY plugin_slug")
def a24b(t):
    """Hook records per plugin's hook file (wc -l per file)."""
    return t["hook_records"].groupBy("plugin_slug").agg(F.count(F.lit(1)).alias("n_records"))
