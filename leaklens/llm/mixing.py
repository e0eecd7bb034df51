"""Operator 1: mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words; the documents of a source all get
the same expected number of copies, target / size of the source.  Its whole
part is given outright.  The fractional parts are rounded in pairs: the largest
open document against the bundle of all smaller ones.  Mass moves from one side
to the other so that the sum of size times fraction stays and a document becomes
0 or 1, with probabilities that keep every document's expectation.  A bundle
shares a move by size*q*(1 - q).  Every group of documents leaves its smallest
ones open, and those that outweigh all smaller ones of the group; these residuals
meet in the next level of a tree until a source is one group with one document
left, which a last draw settles.  That is the smallest document of the source's
last group, unless a document outweighs the open mass of all smaller ones
together: the words taken from a source differ from its target by less than the
document that is left.

All draws are hashes of the source, doc_id and ``seed``: reruns agree, however
the rows are partitioned.

Results in corner cases: a null or empty text has size 0 and is rounded by its
own draw; rows with the same source and doc_id are rounded together (as one
document of their total size); a null source is a source of its own, after all
others; a null doc_id counts as an id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaklens.llm.graph import written

WEIGHTS = (5, 2, 1)         # of the sources in code point order, repeating
SHARE = 1.5                 # of all sizes, to be taken in total
MOST_COPIES = 2             # a target stops at so many times its source's size
GROUP = 4096                # documents that one step of the tree rounds together, about half of it on average
KEPT = 64                   # small documents that a group leaves open for the next level
NEAR = 1e-12                # a chance so near to 0 or 1 is that number


def text_size(text: Column) -> Column:
    """Runs of characters other than space, tab, LF, VT, FF and CR; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: position by source, null last.

    Ranges of sources are numbered in parallel; only one row per range meets
    in one place.
    """
    placed = (sources.repartitionByRange(F.col("source").asc_nulls_last())
              .withColumn("part", F.spark_partition_id()))
    placed = written(placed, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = (placed.groupBy("part").agg(F.count("*").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return (placed.join(start, "part").withColumn("rank", F.col("start") + F.row_number().over(within) - 1)
            .drop("part", "start"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The total is dealt by weight; what a source cannot take beyond ``most``
    times its size is dealt again among the others until none is above.
    """
    ranked = _ranked(sizes)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(pattern, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = written(ranked.withColumn("cap", F.col("source_size") * float(most)).drop("rank"), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, 0
    while True:         # the level rises until no more source is full; one scan of the sources a round
        full_now = F.col("cap") <= F.col("weight") * level
        row = ranked.agg(F.sum(F.when(full_now, F.col("cap")).otherwise(0.0)).alias("taken"),
                         F.sum(F.when(full_now, 0.0).otherwise(F.col("weight"))).alias("open"),
                         F.count_if(full_now).alias("full")).first()
        if not row["open"] or (level >= 0 and row["full"] == full):
            break
        level, full = max(0.0, (share * total - row["taken"]) / row["open"]), row["full"]
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def _draw(*columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the given columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _reduce(pdf: pd.DataFrame, last: bool = True) -> pd.DataFrame:
    """Round the documents of one group; at most one stays open.

    Of a group that is not the ``last``, the ``KEPT`` smallest documents stay
    open, and those that outweigh the open mass of all smaller ones."""
    pdf = pdf.sort_values(["size", "draw", "tie"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    size, chance = pdf["size"].to_numpy(np.float64), pdf["chance"].to_numpy(np.float64, copy=True)
    random = np.random.default_rng([int(d * 2**52) for d in pdf["draw"].iloc[:4]])
    for i in range(len(pdf) - 1 if last else len(pdf) - KEPT):
        p, s = chance[i], size[i]
        while 0.0 < p < 1.0:
            q, t = chance[i + 1:], size[i + 1:]
            share = t * q * (1 - q)             # of the moved mass; smaller documents keep their expectation by it
            open_ = share > 0
            if not open_.any():
                break
            total = share.sum()
            # the most that i can gain or lose before it or a smaller document is integral
            up = min(1 - p, total / (s * (1 - q[open_]).max()))
            down = min(p, total / (s * q[open_].max()))
            if not last and (up < 1 - p or down < p):
                break
            move = up if random.random() * (up + down) < down else -down
            q -= move * s * q * (1 - q) / total
            q[q < NEAR], q[q > 1 - NEAR] = 0.0, 1.0
            p += move
            p = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p
        chance[i] = p
    return pdf.assign(chance=chance)


def _rounded(units: DataFrame) -> DataFrame:
    """(source, doc_id, extra) for units (source, doc_id, size, chance)."""
    units = units.withColumn("draw", _draw("source", "doc_id", F.lit(17))).withColumn("tie", F.col("doc_id").cast("string"))
    free = units.filter("size = 0 or chance <= 0 or chance >= 1")
    free = free.select("source", "doc_id", (F.col("draw") < F.col("chance")).cast("int").alias("extra"))
    open_ = units.filter("size > 0 and chance > 0 and chance < 1")
    most = open_.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done = [free]
    groups = max(1, math.ceil(most / (GROUP // 2)))
    while True:
        # hash(draw) deals the documents of a source to the same groups in every run
        keyed = open_.withColumn("g", F.floor(_draw("source", "draw", F.lit(groups)) * groups).cast("long"))
        last = groups == 1
        # ``written`` runs it at once, with this level's ``last``
        rows = keyed.groupBy("source", "g").applyInPandas(lambda key, pdf: _reduce(pdf, last), keyed.schema)
        rows = written(rows, "mix-level")
        settled = rows if last else rows.filter("chance <= 0 or chance >= 1")
        again = _draw("source", "doc_id", F.lit(29))
        done.append(settled.select("source", "doc_id", (again < F.col("chance")).cast("int").alias("extra")))
        if last:
            break
        open_ = rows.filter("chance > 0 and chance < 1").drop("g")
        groups = math.ceil(groups / (GROUP // 2 // KEPT))
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, doc_id, rows, size, source_size, target, copies): one row per
    source and doc_id, how often each of its rows is taken (0 to ``most``)."""
    each = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    units = written(each.groupBy("source", "doc_id").agg(F.count("*").alias("rows"), F.sum("size").alias("size")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source; null-safe, as null is a source too
    aim = targets(sizes, weights, share, most).withColumnRenamed("source", "__source")
    units = units.join(aim, units["source"].eqNullSafe(aim["__source"]), "left").drop("__source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = written(units.withColumn("whole", F.floor(copies)).withColumn("chance", copies - F.floor(copies)), "mix-chances")
    extra = _rounded(units.select("source", "doc_id", "size", "chance"))
    extra = extra.select(F.col("source").alias("__source"), F.col("doc_id").alias("__id"), "extra")
    both = units["source"].eqNullSafe(extra["__source"]) & units["doc_id"].eqNullSafe(extra["__id"])
    return units.join(extra, both, "left").select(
        "source", "doc_id", "rows", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken,
    with ``copy`` (from 0; ``copy_`` where ``docs`` has such a column, and so on)."""
    number = "copy"
    while number in docs.columns:
        number += "_"
    taken = mix(docs, weights, share, most).filter("copies > 0")
    taken = taken.select(F.col("source").alias("__source"), F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    both = docs["source"].eqNullSafe(taken["__source"]) & docs["doc_id"].eqNullSafe(taken["__id"])
    return (docs.join(taken, both).withColumn(number, F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
            .drop("__source", "__id", "__copies"))
