"""Structured Streaming: live attribution of change events (ST1-ST3).

ST1/ST2: marker and change events arrive in ONE stream.  State per plugin
(``applyInPandasWithState``) holds the current marker and the running
change counter; inside a micro-batch a plugin's rows are ordered by
(ts, event_id) and processed vectorised with pandas.  The state of a key
is three scalars, so it stays small however long a plugin runs.

ST3: change records appended continuously and routed by interface with
``foreachBatch`` into a partitioned table (idempotent per batch id).

Late events (older than what a plugin's state has already seen) are out of
scope, as in the watcher: arrival order is event order.  The batch J7 job
is the oracle for ST1 on the same input.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from leaklens.operators.changes import route_changes
from leaklens.sources.files import CHANGE_SCHEMA, TS_FORMAT, WATCH_SCHEMA

ATTRIBUTED_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("plugin_slug", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("test", T.StringType()),
    T.StructField("zip_counter", T.LongType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("counter", T.LongType()),
])


def _attribute_group(key, pdfs, state):
    """ST1 state function: one plugin's events of one micro-batch."""
    (slug,) = key
    if state.exists:
        kind0, test0, counter0 = state.get
    else:
        kind0, test0, counter0 = None, None, 0
    frames = [f for f in pdfs if len(f)]
    if not frames:
        return
    pdf = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    order = np.lexsort((pdf["event_id"].to_numpy(), pdf["ts"].to_numpy()))   # by (ts, event_id)
    kinds = pdf["kind"].to_numpy(dtype=object)[order]
    tests = pdf["test"].to_numpy(dtype=object)[order]
    event_ids = pdf["event_id"].to_numpy()[order]
    ts = pdf["ts"].to_numpy()[order]
    is_marker = kinds != "change"
    pos = np.where(is_marker, np.arange(len(kinds)), -1)
    last = np.maximum.accumulate(pos)
    cur_kind = np.where(last >= 0, kinds[np.maximum(last, 0)], kind0)
    cur_test = np.where(last >= 0, tests[np.maximum(last, 0)], test0)
    attributed = (~is_marker) & (cur_kind == "set")
    counter = counter0 + np.cumsum(attributed)
    if last[-1] >= 0:
        kind0, test0 = kinds[last[-1]], tests[last[-1]]
    state.update((kind0, test0, int(counter[-1]) if len(counter) else counter0))
    out = pd.DataFrame({
        "event_id": event_ids[attributed],
        "plugin_slug": slug,
        "ts": ts[attributed],
        "test": cur_test[attributed],
        "zip_counter": counter[attributed].astype("int64"),
    })
    if len(out):
        yield out


# The state function runs in executors' Python workers.  Ship this module's
# code by value with it, so executors need no installed copy of the package
# (only pandas and numpy, which PySpark's Arrow path needs anyway).
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def attribution_stream(events: DataFrame) -> DataFrame:
    """ST1/ST2: streaming DataFrame of attributed changes with zip counter."""
    return events.groupBy("plugin_slug").applyInPandasWithState(
        _attribute_group, ATTRIBUTED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def run_attribution(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                    files_per_trigger: int = 1) -> DataFrame:
    """S10 -> ST1 -> parquet sink; runs all available input, returns the sink."""
    src = (spark.readStream.schema(WATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("timestampNTZFormat", TS_FORMAT).json(source_dir))
    q = (attribution_stream(src).writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(ATTRIBUTED_SCHEMA).parquet(sink_dir)


def run_routed_changes(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str,
                       files_per_trigger: int = 1) -> DataFrame:
    """S10 -> ST3: change records appended per micro-batch into a table
    partitioned by interface (the three routed tables).  Each batch writes
    under its own batch-id folder, replaced on retry, so a re-run batch
    never duplicates rows."""
    src = (spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("timestampNTZFormat", TS_FORMAT).json(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        good = batch.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        (route_changes(good)
         .write.mode("overwrite").partitionBy("interface")
         .parquet(f"{table_dir}/batch_id={batch_id}"))

    q = (src.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", table_dir).parquet(table_dir).drop("batch_id")


# ---------------------------------------------------------------------------
# ST1, chunked variant: no per-plugin group in one task.
#
# ``applyInPandasWithState`` hands all of a plugin's rows of a micro-batch
# to one Python call.  This variant runs the batch attribution (chunked
# scan, ``operators.attribution``) on every micro-batch instead, seeded
# with the state each plugin ended the previous batch with: its last marker
# (as a marker row before every event) and its counter.  State is a small
# table (one row per plugin that has seen a marker) versioned by batch id
# in the checkpoint folder; a re-run batch rewrites its own output and
# state version, so retries never double-count.
# ---------------------------------------------------------------------------

STATE_TABLE_SCHEMA = "plugin_slug string, kind string, test string, counter long"
_SEED_TS = "0001-01-01 00:00:00"


def _attribute_batch(batch: DataFrame, prev_state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: (attributed changes, new per-plugin state)."""
    from leaklens.operators.attribution import attribute_changes

    ev = batch.select("event_id", "plugin_slug", "ts", "kind", "test")
    seeds = prev_state.filter(F.col("kind").isNotNull()).select(
        F.lit(-1).cast("long").alias("event_id"), "plugin_slug",
        F.lit(_SEED_TS).cast("timestamp_ntz").alias("ts"), "kind", "test")
    att = attribute_changes(ev.unionByName(seeds))
    offsets = prev_state.select("plugin_slug", F.col("counter").alias("__prev"))
    out = (att.join(offsets, "plugin_slug", "left")
           .withColumn("zip_counter", F.col("zip_counter") + F.coalesce("__prev", F.lit(0)))
           .select("event_id", "plugin_slug", "ts", "test", "zip_counter"))
    # new state: last marker over seeds + batch, counter + attributed in batch
    markers = ev.unionByName(seeds).filter(F.col("kind") != "change")
    last = markers.groupBy("plugin_slug").agg(
        F.max_by(F.struct("kind", "test"), F.struct("ts", "event_id")).alias("m"))
    n_new = att.groupBy("plugin_slug").agg(F.count(F.lit(1)).alias("__n"))
    state = (last.join(offsets, "plugin_slug", "full").join(n_new, "plugin_slug", "full")
             .select("plugin_slug", F.col("m.kind").alias("kind"), F.col("m.test").alias("test"),
                     (F.coalesce("__prev", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("counter")))
    return out, state


def run_attribution_chunked(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                            files_per_trigger: int = 1) -> DataFrame:
    """S10 -> ST1 (chunked) -> per-batch output folders; returns all output."""
    state_dir = f"{checkpoint}/plugin-state"
    src = (spark.readStream.schema(WATCH_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("timestampNTZFormat", TS_FORMAT).json(source_dir))

    def process(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        prev = (s.read.schema(STATE_TABLE_SCHEMA).parquet(f"{state_dir}/batch_id={batch_id - 1}")
                if batch_id > 0 else s.createDataFrame([], STATE_TABLE_SCHEMA))
        # two writes read the batch: keep it for the batch's duration (it is
        # re-read from the source files if an executor holding it is lost)
        batch = batch.persist()
        try:
            out, state = _attribute_batch(batch, prev)
            out.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            state.write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    q = (src.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(ATTRIBUTED_SCHEMA).option("basePath", out_dir).parquet(f"{out_dir}/batch_id=*") \
        .select(*[f.name for f in ATTRIBUTED_SCHEMA])


# ---------------------------------------------------------------------------
# The whole flow as one stream: watcher records -> attribution -> the three
# routed tables with their file numbers.  Each micro-batch is attributed by
# the chunked scan (no plugin in a single task), seeded with the state table.
# ---------------------------------------------------------------------------

RECORD_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("plugin_slug", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("kind", T.StringType()),
    T.StructField("interface", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("name_of_changed_file", T.StringType()),
    T.StructField("type_of_operation", T.StringType()),
])
TEST_FIELDS = ["interface", "method", "url", "data"]
_RECORD_STATE = "plugin_slug string, kind string, interface string, method string, url string, data string, counter long"
_MANIFEST = "batch_id long, n_rows long"


def _record_batch(batch: DataFrame, prev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: (whole attributed changes, new per-plugin state).

    A plugin's state is its last marker, with the test it holds, and the
    number of its last attributed change; the marker enters the batch as a
    row before all others."""
    from leaklens.operators.attribution import attributed

    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA}
    fixed = {"event_id": F.lit(-1).cast("long").alias("event_id"), "ts": F.lit(_SEED_TS).cast("timestamp_ntz").alias("ts"),
             **{c: F.col(c) for c in ("plugin_slug", "kind", *TEST_FIELDS)}}
    seeds = prev.filter(F.col("kind").isNotNull()).select(*[fixed.get(c, e) for c, e in empty.items()])
    rows = batch.select(*empty).unionByName(seeds)
    changes = attributed(rows, TEST_FIELDS, counter="zip_file_number")
    offsets = prev.select(F.col("plugin_slug").alias("__slug"), F.col("counter").alias("__prev"))
    changes = (changes.join(offsets, changes["plugin_slug"].eqNullSafe(offsets["__slug"]), "left")
               .withColumn("zip_file_number", F.col("zip_file_number") + F.coalesce("__prev", F.lit(0)))
               .drop("__slug", "__prev"))
    last = (rows.filter(F.col("kind") != "change").groupBy("plugin_slug")
            .agg(F.max_by(F.struct("kind", *TEST_FIELDS), F.struct("ts", "event_id")).alias("m")))
    return changes, last.join(offsets, last["plugin_slug"].eqNullSafe(offsets["__slug"]), "left") \
        .select("plugin_slug", "m.*", F.coalesce("__prev", F.lit(0)).alias("counter"))


def _counted(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` with the numbers that ``changes`` reached."""
    reached = changes.groupBy(F.col("plugin_slug").alias("__slug")).agg(F.max("zip_file_number").alias("__most"))
    joined = state.join(reached, state["plugin_slug"].eqNullSafe(reached["__slug"]), "left")
    return joined.withColumn("counter", F.coalesce("__most", "counter")).drop("__slug", "__most")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_watch_to_tables(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str,
                        files_per_trigger: int = 1) -> DataFrame:
    """S10 -> ST1 -> ST3: watcher records in, the three routed tables out.

    A batch writes its rows, then its state version, then its line in the
    manifest; readers take the batches the manifest lists, so a batch that
    broke off is not seen and its retry overwrites the same folders.  A batch
    needs the version before it; older ones are deleted.  The state keeps one
    row per plugin that has had a marker."""
    state_dir, rows_dir, manifest = f"{checkpoint}/watch-state", f"{table_dir}/rows", f"{table_dir}/manifest"
    src = (spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("timestampNTZFormat", TS_FORMAT).json(source_dir))

    def process(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        prev = (s.read.schema(_RECORD_STATE).parquet(f"{state_dir}/version={batch_id - 1}")
                if batch_id > 0 else s.createDataFrame([], _RECORD_STATE))
        changes, state = _record_batch(batch, prev)
        out = f"{rows_dir}/batch_id={batch_id}"
        route_changes(changes, "event_id").write.mode("overwrite").partitionBy("interface").parquet(out)
        routed = s.read.schema("plugin_slug string, zip_file_number long").parquet(out)
        _counted(state, routed).write.mode("overwrite").parquet(f"{state_dir}/version={batch_id}")
        (routed.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("n_rows"))
         .write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}"))
        _delete(s, f"{state_dir}/version={batch_id - 2}")

    q = (src.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return read_tables(spark, table_dir)


def read_tables(spark: SparkSession, table_dir: str) -> DataFrame:
    """The routed rows of all batches in the manifest."""
    listed = spark.read.schema(_MANIFEST).parquet(f"{table_dir}/manifest/batch=*").select("batch_id")
    kinds = {"event_id": "long", "zip_file_number": "long"}
    names = ("event_id", "plugin_slug", "url", "http_method", "data", "command", "name_of_changed_file", "type_of_operation",
             "zip_file_number", "batch_id", "interface")
    schema = ", ".join(f"{c} {'long' if c == 'batch_id' else kinds.get(c, 'string')}" for c in names)
    rows = spark.read.schema(schema).option("basePath", f"{table_dir}/rows").parquet(f"{table_dir}/rows")
    return rows.join(listed, "batch_id", "left_semi")
