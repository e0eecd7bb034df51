"""Measure task balance of the ordered per-plugin scans under a hot key.

Usage: python tools/skew_check.py [sf_dir] > SKEW.md

One third of the events is assigned to a single plugin (the test harness
only re-labels rows).  J7 runs twice: with the chunked scan of
``operators.sequence`` and with a plain ``Window.partitionBy(plugin)``.
Spark's event log (written to a scratch folder) gives, for every shuffle
stage, the records each task read; the report shows the largest share of a
stage's rows that one task had to process.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def session(log_dir: str) -> SparkSession:
    return (SparkSession.builder.master("local[8]").appName("skew-check")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.sql.adaptive.enabled", "true")
            # keep 8 reduce tasks: at this size AQE would merge them and hide the spread
            .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", log_dir)
            .config("spark.eventLog.compress", "false")
            .config("spark.eventLog.rolling.enabled", "false")
            .getOrCreate())


def plain_attribution(ev):
    w = Window.partitionBy("plugin_slug").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("kind") != "change", F.struct(F.col("kind").alias("kind"), F.col("test").alias("test")))
    cur = ev.withColumn("current", F.last(marker, ignorenulls=True).over(w))
    att = cur.filter((F.col("kind") == "change") & (F.col("current.kind") == "set"))
    w2 = Window.partitionBy("plugin_slug").orderBy("ts", "event_id")
    return att.select("event_id", "plugin_slug", "ts", F.col("current.test").alias("test"),
                      F.row_number().over(w2).alias("zip_counter"))


def max_task_records(log_file: str, job_group: str, exclude: str | None = None) -> tuple[int, int]:
    """(most shuffle records any single task of the job read, #shuffle stages)."""
    jobs, stages_of_job, tasks = {}, {}, {}
    files = sorted(glob.glob(os.path.join(log_file, "*"))) if os.path.isdir(log_file) else [log_file]
    for line in (ln for f in files for ln in open(f)):
        e = json.loads(line)
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            props = e.get("Properties") or {}
            jobs[e["Job ID"]] = props.get("spark.job.description", "")
            stages_of_job[e["Job ID"]] = e.get("Stage IDs", [])
        elif ev == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            r = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
            tasks.setdefault(e["Stage ID"], []).append(r)
    wanted = {s for j, d in jobs.items() if job_group in d and not (exclude and exclude in d)
              for s in stages_of_job[j]}
    reads = [(s, max(recs)) for s, recs in tasks.items() if s in wanted and sum(recs) > 0]
    return (max(r for _, r in reads) if reads else 0), len(reads)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="leaklens-eventlog-")
    spark = session(log_dir)
    spark.sparkContext.setLogLevel("ERROR")
    from leaklens.operators import attribution
    from leaklens.sources.tables import Tables

    w = Tables(spark, sf_dir)["watch_stream"]
    # harness: one plugin holds every third event (a third of all rows)
    ev = w.withColumn("plugin_slug", F.when(F.col("event_id") % 3 == 0, F.lit("plugin-hot"))
                      .otherwise(F.concat(F.lit("plugin-"), F.col("user_id").cast("string"))))
    total = ev.count()
    hot = ev.filter(F.col("plugin_slug") == "plugin-hot").count()
    results = {}
    for label, fn in (("chunked scan (library)", attribution.attribute_changes), ("plain window per plugin", plain_attribution)):
        spark.sparkContext.setJobDescription(label)
        out = fn(ev)
        out.write.format("noop").mode("overwrite").save()
        results[label] = sorted(tuple(r) for r in out.select("event_id", "test", "zip_counter").collect())
    # per-plugin aggregations under the same hot key: partial aggregation
    # collapses the hot plugin to one row per map task before the shuffle
    from leaklens.operators import hooks, routes
    from leaklens.plans.hook_change_reports import hook_table

    t = Tables(spark, sf_dir)
    h = hook_table(t).withColumn("plugin_slug", F.when(F.col("event_id") % 3 == 0, F.lit("plugin-hot"))
                                 .otherwise(F.col("plugin_slug")))
    n_hooks = h.count()
    spark.sparkContext.setJobDescription("A14 per-plugin log-path counts")
    hooks.log_path_counts_per_plugin(h).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription("W4-style last-wins per plugin (max_by)")
    routes.last_per_hook(h.withColumn("hook", F.lit("h")), ["event_id"], ["function"]) \
        .write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    # streaming: both ST1 designs over the same hot-key events, two micro-batches
    from leaklens.sources.files import write_time_slices
    from leaklens.streaming import attribution_stream as st

    scratch = tempfile.mkdtemp(prefix="leaklens-skew-")
    write_time_slices(ev.select("event_id", "plugin_slug", "ts", "kind", "test"), f"{scratch}/in", "ts", 2)
    src = (spark.readStream.schema(st.WATCH_SCHEMA).option("maxFilesPerTrigger", 1)
           .option("timestampNTZFormat", st.TS_FORMAT).json(f"{scratch}/in"))
    q = (st.attribution_stream(src).writeStream.queryName("st1_state").format("parquet")
         .option("path", f"{scratch}/out1").option("checkpointLocation", f"{scratch}/ck1")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    batch_rows = max(pr["numInputRows"] for pr in q.recentProgress)   # same files, same batches for both
    spark.sparkContext.setLocalProperty("spark.job.description", None)
    st.run_attribution_chunked(spark, f"{scratch}/in", f"{scratch}/out2", f"{scratch}/ck2").count()
    same = results["chunked scan (library)"] == results["plain window per plugin"]
    app = spark.sparkContext.applicationId
    spark.stop()
    log = [f for f in glob.glob(os.path.join(log_dir, "*")) if app in f][0]
    rows = ["# SKEW", "",
            f"Events at `{sf_dir}`: {total} rows, of which the hot plugin holds {hot} ({hot / total:.0%}). "
            "Run on local[8] with 8 shuffle partitions and AQE on, partition coalescing off. Generated by "
            "`tools/skew_check.py` from Spark's event log.", "",
            "The metric is the most rows any single task read from a shuffle, as a share of the operator's input rows. "
            "With 8 tasks an even spread is 12.5 %; a task that holds the hot plugin whole reads at least 33 %.", "",
            "| operator | input rows | largest task read | share of input | shuffle stages |",
            "|---|---|---|---|---|"]
    for label, n_in in ((lab, total) for lab in results):
        mx, n = max_task_records(log, label)
        rows.append(f"| J7, {label} | {n_in} | {mx} | {mx / n_in:.1%} | {n} |")
    for label in ("A14 per-plugin log-path counts", "W4-style last-wins per plugin (max_by)"):
        mx, n = max_task_records(log, label)
        rows.append(f"| {label} | {n_hooks} | {mx} | {mx / n_hooks:.1%} | {n} |")
    mx, n = max_task_records(log, "st1_state")
    rows.append(f"| ST1, applyInPandasWithState (per micro-batch) | {batch_rows} | {mx} | {mx / batch_rows:.1%} | {n} |")
    mx, n = max_task_records(log, "batch = ", exclude="st1_state")
    rows.append(f"| ST1, chunked foreachBatch (per micro-batch) | {batch_rows} | {mx} | {mx / batch_rows:.1%} | {n} |")
    rows += ["", f"Both J7 implementations give identical attributed rows: {same}.", "",
             "The plain window must send the hot plugin's third of the events to one task. The chunked scan "
             "spreads that plugin's time chunks over all tasks. The aggregations combine map-side, so the hot "
             "plugin reaches the shuffle as one partial row per map task. In streaming (two micro-batches "
             "of time-ordered files), the state API gives the hot plugin's rows of a batch to one Python call; the "
             "chunked foreachBatch variant keeps the busiest task near an even share of the batch."]
    print("\n".join(rows))


if __name__ == "__main__":
    main()
