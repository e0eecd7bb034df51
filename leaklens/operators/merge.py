"""Merging shard warehouses (U4) and surrogate keys.

U4: two warehouses built in parallel both number runs from 0.  The merge
shifts every run key of the incoming shard - in the runs AND in the tables
that reference them - by ``max(base run_id) + 1`` and appends all tables.
Tables with ids of their own (``finding_id``) are shifted past the base
table's ids in the same way.  Without base rows the shift is 0.  An offset is
a scalar subquery (one tiny aggregate, evaluated once and inlined), not a
join.  ``faithful=True`` reproduces the reference's ``max`` offset (which
collides: ids start at 0) for comparison.

Routes with W3 hash keys of (plugin, action, priv) are equal in every shard,
so their tables are a union with duplicates dropped (``merge_routes``).  Where
each warehouse numbered its routes itself, ``merge_warehouses`` maps old ids to
new ones by the natural key: a route that the base knows takes the base's id,
any other its own id past the base's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaklens.operators.ingest import insert_or_ignore
from leaklens.session import checkpoint_dir


def id_offset(base: DataFrame, faithful: bool = False, col: str = "run_id") -> Column:
    """What is added to a shard's ids; 0 where the base has none."""
    top = F.max(col) if faithful else F.max(col) + F.lit(1)
    return base.select(F.coalesce(top, F.lit(0))).scalar()


def shift_ids(df: DataFrame, offset: Column, col: str = "run_id") -> DataFrame:
    return df.withColumn(col, F.col(col) + offset)


def merge_shard(base_runs: DataFrame, shard_runs: DataFrame, base_children: list[DataFrame],
                shard_children: list[DataFrame], faithful: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """U4: merged runs and merged child tables (each child has ``run_id``,
    and maybe a ``finding_id``, which is shifted too)."""
    off = id_offset(base_runs, faithful)
    runs = base_runs.unionByName(shift_ids(shard_runs, off))
    children = []
    for base, shard in zip(base_children, shard_children):
        shard = shift_ids(shard, off)
        if "finding_id" in base.columns:
            shard = shift_ids(shard, id_offset(base, faithful, "finding_id"), "finding_id")
        children.append(base.unionByName(shard))
    return runs, children


def hash_key(*cols: str) -> Column:
    """Stable 64-bit surrogate key from the natural key."""
    return F.xxhash64(*cols)


def dense_ids(df: DataFrame, order: list[str], col: str = "id") -> DataFrame:
    """Dense 0..n-1 ids in ``order`` without a global window or Python.

    The sorted data is checkpointed to the shared checkpoint folder, so its
    partitions are fixed even if an executor is lost and a task re-runs.
    Then ``monotonically_increasing_id`` (partition index in the high bits,
    row index in the low 33) minus a per-partition offset gives the rank.
    The offsets table has one row per partition - bounded by the partition
    count, not by the data - and is broadcast.
    """
    checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).checkpoint(eager=True)
    tagged = ordered.withColumn("__pid", F.spark_partition_id()) \
        .withColumn("__mono", F.monotonically_increasing_id())
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    rank = F.col("__mono") - F.shiftleft(F.col("__pid").cast("long"), 33) + F.col("__off")
    return (tagged.join(F.broadcast(offsets), "__pid")
            .withColumn(col, rank).drop("__pid", "__mono", "__off"))


def remapped_ids(base: DataFrame, shard: DataFrame, natural: list[str], col: str) -> DataFrame:
    """(old, new, fresh) for every id of ``shard``.

    ``natural`` columns say which rows are the same thing (NULLs are equal).
    Rows that the base knows take its smallest id, the others their own
    smallest id shifted past the base's; ``fresh`` marks the one row of a
    natural key that the base lacks.
    """
    off = id_offset(base, col=col)

    def smallest(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*[F.col(c).alias(f"{name}_{c}") for c in natural]).agg(F.min(col).alias(name))

    def same(name: str) -> Column:
        on = F.lit(True)
        for c in natural:
            on = on & F.col(c).eqNullSafe(F.col(f"{name}_{c}"))
        return on

    return (shard.select(col, *natural).distinct()
            .join(smallest(shard, "own"), same("own")).join(smallest(base, "known"), same("known"), "left")
            .select(F.col(col).alias("old"), F.coalesce("known", F.col("own") + off).alias("new"),
                    (F.col("known").isNull() & (F.col(col) == F.col("own"))).alias("fresh")))


def merge_warehouses(base: dict[str, DataFrame], shard: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """U4 for whole warehouses with ids of their own: plugins (by slug; the
    base's row wins), semgrep_runs, findings_semgrep, ajax_routes (by plugin,
    action, priv) and ajax_route_arguments.

    Arguments whose route their shard lacks come back as ``orphan_arguments``.
    """
    runs, (findings,) = merge_shard(base["semgrep_runs"], shard["semgrep_runs"],
                                    [base["findings_semgrep"]], [shard["findings_semgrep"]])
    ids = remapped_ids(base["ajax_routes"], shard["ajax_routes"], ["plugin_slug", "action", "priv"], "route_id")
    new_routes = (shard["ajax_routes"].join(ids.filter("fresh"), F.col("route_id") == F.col("old"))
                  .withColumn("route_id", F.col("new")).select(*base["ajax_routes"].columns))
    keyed = (shard["ajax_route_arguments"].join(ids, F.col("route_id") == F.col("old"), "left"))
    args = (keyed.filter("old is not null").withColumn("route_id", F.col("new"))
            .select(*base["ajax_route_arguments"].columns))
    return {
        "plugins": insert_or_ignore(base["plugins"], shard["plugins"]),
        "semgrep_runs": runs,
        "findings_semgrep": findings,
        "ajax_routes": base["ajax_routes"].unionByName(new_routes),
        "ajax_route_arguments": base["ajax_route_arguments"].unionByName(args)
        .dropDuplicates(["route_id", "method", "arg_name"]),
        "orphan_arguments": keyed.filter("old is null").select(*shard["ajax_route_arguments"].columns),
    }


def merge_routes(base_routes: DataFrame, shard_routes: DataFrame,
                 base_args: DataFrame, shard_args: DataFrame) -> tuple[DataFrame, DataFrame]:
    """U4 for the route tables: hash-keyed ids, so union and drop duplicates."""
    return (base_routes.unionByName(shard_routes).dropDuplicates(["route_id"]),
            base_args.unionByName(shard_args).dropDuplicates(["route_id", "method", "arg_name"]))
