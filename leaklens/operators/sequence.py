"""Ordered scans per key that do not put a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key
to one task; one plugin holding a third of all events would then be a
third of the job in a single task.  ``scan`` splits each key's rows into
chunks ``(key, bucket)`` where ``bucket`` is a non-decreasing function of
the order (e.g. time // 60 s):

1. a window over ``(key, bucket)`` computes the in-chunk running value;
2. the last row of each chunk carries the chunk's summary (no second
   aggregation: the window output already holds it);
3. the chunk summaries are scanned the same way at the next, coarser
   level (recursively), giving each chunk the carry from earlier chunks;
4. a join on ``(key, bucket)`` adds the carry to every row.

Supported scans: ``last`` (last non-null value, e.g. the current test
marker) and ``sum`` (running sum, e.g. a per-plugin counter).  Results are
exact for any data; the bucket widths only change how work is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _frame(keys: list[str], order: list[str], exclusive: bool):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def scan(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
         how: str, levels: list[Column], level_names: list[str] | None = None,
         exclusive: bool = False) -> DataFrame:
    """Add column ``out``: running ``how`` of ``value`` per ``keys`` in ``order``.

    ``levels`` are bucket expressions over ``order``'s leading column, from
    fine to coarse; each coarser bucket must be a function of the finer
    one's value (pass them as expressions of ``F.col("__b0")`` etc. via
    ``bucket_levels``).  ``exclusive`` excludes the row itself.
    """
    if how not in ("last", "sum"):
        raise ValueError(how)
    if not levels:
        agg = (F.last(value, ignorenulls=True) if how == "last" else F.sum(value))
        return df.withColumn(out, agg.over(_frame(keys, order, exclusive)))

    names = level_names or [f"__b{i}" for i in range(len(levels))]
    b = names[0]
    inc, loc, car, last = f"__inc{b}", f"__local{b}", f"__carry{b}", f"__last{b}"
    # One shuffle by (key, chunk) serves the window and the carry join.  The
    # summary branch needs only the key, order and value columns, so column
    # pruning gives it its own narrow read: a two-pass prefix scan (AQE
    # reuses the shuffle where both branches read the same columns).
    data = df.withColumn(b, levels[0]).repartition(*keys, b)
    agg = (F.last(value, ignorenulls=True) if how == "last" else F.sum(value))
    in_chunk = Window.partitionBy(*keys, b).orderBy(*order)
    # 1. running value inside the chunk (inclusive; exclusive when asked)
    data = data.withColumn(inc, agg.over(_frame(keys + [b], order, False)))
    data = data.withColumn(loc, agg.over(_frame(keys + [b], order, True)) if exclusive else F.col(inc))
    data = data.withColumn(last, F.lead(F.lit(1)).over(in_chunk).isNull())
    # 2. one summary row per chunk: the inclusive value at the chunk's last row
    summ = data.filter(F.col(last)).select(*keys, b, F.col(inc).alias("__v"))
    # 3. carry from earlier chunks: exclusive scan of the summaries by chunk
    carry = scan(summ, keys, [b], "__v", car, how, list(levels[1:]), names[1:], exclusive=True)
    ck = [f"__ck{i}" for i in range(len(keys) + 1)]
    carry = carry.select(*[F.col(c).alias(a) for c, a in zip(keys + [b], ck)], car)
    # 4. every row gets its chunk's carry.  The null-safe condition keeps
    # NULL keys exact and stops the optimiser from inferring IS NOT NULL
    # filters into the summary branch, which would make its shuffle differ
    # from the main branch's and defeat exchange reuse (a second scan).
    cond = [data[c].eqNullSafe(carry[a]) for c, a in zip(keys + [b], ck)]
    joined = data.join(carry, cond, "left").drop(*ck)
    if how == "last":
        res = F.coalesce(F.col(loc), F.col(car))
    else:
        res = F.coalesce(F.col(loc), F.lit(0)) + F.coalesce(F.col(car), F.lit(0))
    return joined.withColumn(out, res).drop(inc, loc, car, last, b)


def bucket_levels(base: Column, widths: list[int]) -> tuple[list[Column], list[str]]:
    """Bucket expressions for ``scan``: level 0 = base // widths[0], level i =
    level i-1 // (widths[i] // widths[i-1]), so each is a function of the one
    below (at level i the summary rows only carry the level i-1 bucket)."""
    names = [f"__b{i}" for i in range(len(widths))]
    exprs = [F.floor(base / F.lit(widths[0]))]
    for i in range(1, len(widths)):
        exprs.append(F.floor(F.col(names[i - 1]) / F.lit(widths[i] // widths[i - 1])))
    return exprs, names
