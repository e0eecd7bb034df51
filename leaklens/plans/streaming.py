"""Streaming queries: run the stream over all available input, return the sink.

The stand-in input is the adapter's rows written as JSON-lines files in
time slices (what a watcher would have appended); the streaming jobs then
do all the work.  Folders live under the session's checkpoint folder.

Two attribution designs are registered (both checked against the J7
oracle): the state API (``applyInPandasWithState``) and the chunked
``foreachBatch`` variant that keeps a hot plugin out of a single task.
"""

from __future__ import annotations

from leaklens.plans.attribution import J7_SQL, ROUTED, ROUTED_SQL, watch_events
from leaklens.plans.hook_change_reports import p10
from leaklens.plans.registry import REGISTRY, query
from leaklens.session import scratch_path
from leaklens.sources.files import write_time_slices
from leaklens.streaming.attribution_stream import (
    run_attribution, run_attribution_chunked, run_routed_changes, run_watch_to_tables)

SLICES = 4
FILES_PER_TRIGGER = 2   # several micro-batches, so state crosses batch boundaries


@query("st1_stream_attribution", "ST1 ST2 S10", J7_SQL)
def st1(t):
    """ST1/ST2: stateful streaming attribution with running counter."""
    spark = t.spark
    base = scratch_path(spark, "st1")
    ev = watch_events(t).select("event_id", "plugin_slug", "ts", "kind", "test")
    write_time_slices(ev, f"{base}/input", "ts", SLICES)
    return run_attribution(spark, f"{base}/input", f"{base}/sink", f"{base}/checkpoint",
                           files_per_trigger=FILES_PER_TRIGGER)


@query("st3_stream_routed_changes", "ST3 S10 S12 P10", REGISTRY["p10_routed_changes"].oracle)
def st3(t):
    """ST3: change records appended continuously, routed by interface."""
    spark = t.spark
    base = scratch_path(spark, "st3")
    c = t["change_records"].select("event_id", "plugin_slug", "ts", "interface", "method", "url",
                                   "data", "name_of_changed_file", "type_of_operation")
    write_time_slices(c, f"{base}/input", "ts", SLICES)
    out = run_routed_changes(spark, f"{base}/input", f"{base}/table", f"{base}/checkpoint",
                             files_per_trigger=FILES_PER_TRIGGER)
    return out.select(*p10(t).columns)



@query("st1_stream_attribution_chunked", "ST1 ST2 S10", J7_SQL)
def st1_chunked(t):
    """ST1/ST2 without per-plugin groups: each micro-batch runs the chunked
    batch attribution seeded with the per-plugin state of the previous one."""
    spark = t.spark
    base = scratch_path(spark, "st1c")
    ev = watch_events(t).select("event_id", "plugin_slug", "ts", "kind", "test")
    write_time_slices(ev, f"{base}/input", "ts", SLICES)
    return run_attribution_chunked(spark, f"{base}/input", f"{base}/out", f"{base}/checkpoint",
                                   files_per_trigger=FILES_PER_TRIGGER)


@query("st1_st3_stream_tables", "ST1 ST2 ST3 S10 S12 P10", ROUTED_SQL)
def st1_st3(t):
    """ST1 -> ST3 as one stream: watcher records are attributed batch by batch
    and appended to the three routed tables with their file numbers."""
    base = scratch_path(t.spark, "st13")
    write_time_slices(t["watch_records"], f"{base}/input", "ts", SLICES)
    return run_watch_to_tables(t.spark, f"{base}/input", f"{base}/tables", f"{base}/checkpoint",
                               files_per_trigger=FILES_PER_TRIGGER).select(*ROUTED)
