"""Attribution of file changes to the test that caused them (batch).

Marker events (``set`` a current test, ``clear`` it) and change events of
one plugin travel in one stream ordered by (ts, event_id).  A change is
attributed to the latest earlier marker if that marker is a ``set``; a
change with no marker, or after a ``clear``, is not recorded (the watcher
writes a record only while the marker file exists).  Attributed changes get
a running per-plugin counter (the zip counter).

All ordered passes are chunked by time, so a plugin with a huge share of
events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaklens.operators.sequence import bucket_levels, scan

# Chunk widths for the ordered scans, in microseconds: 1 minute, 1 day.
TIME_LEVELS_US = [60_000_000, 86_400_000_000]
# Chunk widths over line numbers for per-file scans.
LINE_LEVELS = [4096, 4096 * 4096]


def _time_levels(ts: str, widths=None):
    # days and the time of day of the zone-less value: monotone in every session zone
    t = F.col(ts)
    days = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    micros = (days * 86_400 + second) * 1_000_000 + F.pmod(F.date_format(t, "SSSSSS").cast("bigint"), F.lit(1_000_000))
    return bucket_levels(micros, list(widths or TIME_LEVELS_US))


def current_marker(events: DataFrame, key: str = "plugin_slug", ts: str = "ts",
                   seq: str = "event_id", kind: str = "kind", test: str = "test",
                   widths=None) -> DataFrame:
    """Every event with the latest marker at or before it (struct
    ``current`` of (kind, test, event_id); NULL before the first marker)."""
    marker = F.when(F.col(kind) != "change",
                    F.struct(F.col(kind).alias("kind"), F.col(test).alias("test"),
                             F.col(seq).alias("event_id")))
    levels, names = _time_levels(ts, widths)
    ev = events.withColumn("__marker", marker)
    return scan(ev, [key], [ts, seq], "__marker", "current", "last", levels, names).drop("__marker")


def running_count(df: DataFrame, key: str, order: list[str], out: str, levels, names) -> DataFrame:
    """1, 2, 3, ... per key in order, without a per-key single task."""
    return scan(df.withColumn("__one", F.lit(1).cast("bigint")), [key], order, "__one", out,
                "sum", levels, names).drop("__one")


def marker_scan(df: DataFrame, key: str, order: list[str], levels, names: list[str]) -> DataFrame:
    """Segmented prefix scan of the watcher's state: adds ``carry`` (the last
    marker before the row) and ``before`` (attributed changes before it).

    ``df`` has ``marker`` (struct with ``kind``; NULL on a change), ``head``
    (changes no marker of the row's own precedes) and ``tail`` (changes known
    to be attributed).  A row is the state's transition, and so is a chunk of
    rows: its last marker, the changes before its first one - which count only
    if the carried marker is a ``set`` - and the attributed ones after it.
    Chunks therefore scan like rows, level by level, and marker and counter
    come out of one pass.
    """
    chunk = [key, names[0]] if levels else [key]
    if levels:
        df = df.withColumn(names[0], levels[0]).repartition(*chunk)
    w = Window.partitionBy(*chunk).orderBy(*order)
    so_far, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.last("marker", ignorenulls=True).over(earlier))
    df = df.withColumn("__h", F.when(F.col("__in").isNull(), F.col("head")).otherwise(F.lit(0)))
    df = df.withColumn("__t", F.col("tail") + F.when(F.col("__in.kind") == "set", F.col("head")).otherwise(F.lit(0)))
    head, tail = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("__h", "__t"))
    if not levels:
        return df.withColumn("before", tail).withColumnRenamed("__in", "carry").drop("__h", "__t")
    ends = (df.withColumn("__m", F.last("marker", ignorenulls=True).over(so_far))
            .withColumn("__hs", F.sum("__h").over(so_far)).withColumn("__ts", F.sum("__t").over(so_far))
            .withColumn("__end", F.lead(F.lit(1)).over(w).isNull()).filter("__end")
            .select(*chunk, F.col("__m").alias("marker"), F.col("__hs").alias("head"), F.col("__ts").alias("tail")))
    above = marker_scan(ends, key, [names[0]], levels[1:], names[1:])
    above = above.select(F.col(key).alias("__k"), F.col(names[0]).alias("__c"), F.col("carry").alias("__carry"),
                         F.col("before").alias("__before"))
    df = df.withColumn("__hx", head).withColumn("__tx", tail)
    joined = df.join(above, df[key].eqNullSafe(above["__k"]) & df[names[0]].eqNullSafe(above["__c"]), "left")
    own = F.when(F.col("__carry.kind") == "set", F.col("__hx")).otherwise(F.lit(0))
    return (joined.withColumn("carry", F.coalesce("__in", "__carry"))
            .withColumn("before", F.coalesce("__before", F.lit(0)) + F.col("__tx") + own)
            .drop("__in", "__h", "__t", "__hx", "__tx", "__k", "__c", "__carry", "__before", names[0]))


def attributed(events: DataFrame, test: list[str], key: str = "plugin_slug", ts: str = "ts", seq: str = "event_id",
               kind: str = "kind", counter: str = "zip_counter", widths=None) -> DataFrame:
    """J7 + W1: the change rows that a test caused, whole, with the ``test``
    columns of their marker and the running counter of their plugin."""
    levels, names = _time_levels(ts, widths)
    is_change = F.col(kind) == "change"
    marker = F.when(~is_change, F.struct(F.col(kind).alias("kind"), *test))
    rows = (events.withColumn("marker", marker).withColumn("head", is_change.cast("bigint"))
            .withColumn("tail", F.lit(0).cast("bigint")))
    rows = marker_scan(rows, key, [ts, seq], levels, names)
    kept = [c for c in events.columns if c not in (kind, *test)]
    return (rows.filter(is_change & (F.col("carry.kind") == "set"))
            .select(*kept, *[F.col(f"carry.{c}").alias(c) for c in test], (F.col("before") + 1).alias(counter)))


def attribute_changes(events: DataFrame, key: str = "plugin_slug", ts: str = "ts",
                      seq: str = "event_id", kind: str = "kind", test: str = "test",
                      widths=None) -> DataFrame:
    """J7 + W1: attributed change events with their test and zip counter."""
    rows = events.select(seq, key, ts, kind, test)
    return attributed(rows, [test], key, ts, seq, kind, widths=widths)


def context_lines(lines: DataFrame, is_marker, before: int = 5, after: int = 5,
                  file: str = "file", line_no: str = "line_no", text: str = "line") -> DataFrame:
    """W2 (grep -B/-A): lines within ``before``/``after`` lines of a marker
    line of the same file; overlapping windows merge (each line once).

    Line positions come from a chunked running count; each marker emits the
    positions of its window and a semi-join on (file, position) keeps the
    lines - linear in lines + markers, no per-file single task.
    """
    levels, names = bucket_levels(F.col(line_no), LINE_LEVELS)
    pos = running_count(lines, file, [line_no, text], "__pos", levels, names)
    targets = (pos.filter(is_marker)
               .select(file, F.explode(F.sequence(F.col("__pos") - before, F.col("__pos") + after)).alias("__pos"))
               .distinct())
    return pos.join(targets, [file, "__pos"], "left_semi").drop("__pos")
