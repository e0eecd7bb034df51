"""Operator 3: MinHash near-duplicate detection with DartMinHash signatures.

The weight of a five-word shingle is its count in the document.  Every
(shingle, weight layer) is a region of a plane; darts fall on it as a Poisson
process whose arrival ranks, heights, coordinates and identities are hashes of
the region, so equal regions of two documents receive equal darts.  A
coordinate of the signature is the identity of its earliest dart, and two
documents agree on a coordinate with the probability of their weighted Jaccard
similarity.  28 bands of 5 coordinates miss a pair of similarity 0.8 with a
probability of about 2e-5.

Documents that share a band form a family (components over band leaders, no
pairs).  Families are compared exactly in blocks: every block against itself
and against the family's pivots, then every document outside the family's
largest class against the whole family.  Links are pairs with an exact
weighted Jaccard similarity of at least ``threshold``; classes are their
components.

Results in corner cases: documents without words (null, empty, punctuation)
link with nothing; a document of one to four words has one shingle of all of
them; documents of equal word sequences are copies and share a class; rows
with the same doc_id count as one document; a row with a null doc_id takes the
class of its copies, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaklens.llm import words as W
from leaklens.llm.graph import components, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 28, 5
BLOCK = 256         # documents of a family that one task compares with each other
PIVOTS = 128        # members of a large family that every block is compared with
SMALL = 64          # families up to this size share tasks

_U = np.uint64


def dart_signatures(elements: np.ndarray, weights: np.ndarray, ptr: np.ndarray, k: int) -> np.ndarray:
    """(documents, k) identities of the earliest dart of each coordinate.

    ``elements`` are 64-bit hashes, distinct within a document, and
    ``weights`` positive; document i owns the range ptr[i]:ptr[i+1].  Rows of
    documents without elements are all ones.
    """
    n = len(ptr) - 1
    sig = np.full(n * k, ~_U(0), dtype=_U)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    total = np.bincount(doc, weights, minlength=n)
    with np.errstate(divide="ignore"):
        reach = k * (math.log(k) + 4.0) / total
    todo = np.flatnonzero(total > 0)
    while len(todo):
        pick = np.isin(doc, todo) if len(todo) < n else slice(None)
        _throw(sig, elements[pick], weights[pick], doc[pick], reach, k)
        hollow = (sig.reshape(n, k)[todo] == ~_U(0)).any(axis=1)
        todo = todo[hollow]
        reach[todo] *= 2
    return sig.reshape(n, k)


def _throw(sig, elements, weights, doc, reach, k) -> None:
    """Throw all darts with a rank up to ``reach`` of their document."""
    layer, low, width = 0, 0.0, 1.0
    while True:
        inside = np.flatnonzero(weights > low)
        if not len(inside):
            return
        key = W.mix(elements[inside] + _U((layer * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        at, room = doc[inside], weights[inside] - low
        rank = np.zeros(len(inside))
        turn = 0
        while len(key):
            turn += 1
            draw = W.mix(key + _U((turn * 0xD1342543DE82EF95) & (2**64 - 1)))
            rank = rank - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            near = rank <= reach[at]
            key, at, room, rank, draw = key[near], at[near], room[near], rank[near], draw[near]
            own = W.mix(draw ^ _U(0xA0761D6478BD642F))
            height = (own >> _U(40)).astype(np.float64) * 2.0**-24 * width
            coordinate = (((own >> _U(8)) & _U(0xFFFFFFFF)) * _U(k) >> _U(32)).astype(np.int64)
            dart = (rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32)) | (draw & _U(0xFFFFFFFF))
            hit = height < room
            np.minimum.at(sig, at[hit] * k + coordinate[hit], dart[hit])
        low, width, layer = low + width, max(1.0, low + width), layer + 1


def _weighted(shingle: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((shingle, doc))
    s, d = shingle[order], doc[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(s)]])).astype(np.float64)
    return s[first], count, np.searchsorted(d[first], np.arange(len(ptr)))


def _digest(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's word sequence."""
    n = np.diff(words.ptr)
    place = (np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], n)).astype(_U)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        each = W.mix(words.hash + W.mix(place + _U(seed)))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(each, dtype=_U)])
        out.append(total[words.ptr[1:]] - total[words.ptr[:-1]])
    return out[0], out[1]


def signatures(docs: DataFrame, n: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, th, n_words, d1, d2, bands): hash of the text, word-sequence
    digest and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = W.split(part.column("text"))
                shingle, ptr = W.shingles(words, n)
                element, weight, eptr = _weighted(shingle, ptr)
                sig = dart_signatures(element, weight, eptr, bands * rows).reshape(-1, bands, rows)
                band = W.mix(np.broadcast_to(np.arange(1, bands + 1, dtype=_U), sig.shape[:2]).copy())
                for i in range(rows):
                    band = W.mix(band * _U(0x9E3779B97F4A7C15) + sig[:, :, i])
                d1, d2 = _digest(words)
                offsets = np.arange(0, (len(d1) + 1) * bands, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), part.column("th"), pa.array(np.diff(words.ptr).astype(np.int64)),
                    pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(offsets, band.reshape(-1).view(np.int64)),
                ], ["doc_id", "th", "n_words", "d1", "d2", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, "doc_id long, th long, n_words long, d1 long, d2 long, bands array<long>")


def _with_sets(docs: DataFrame, info: DataFrame, n: int) -> DataFrame:
    """``info`` (node, th, ...) with ``shingles``, the packed set of the
    occurrence-tagged shingles of the document's text with hash ``th``; one row
    per node."""
    names = info.columns
    rows = docs.select(F.col("doc_id").alias("node"), F.xxhash64("text").alias("th"), F.col("text").alias("__text"))
    rows = rows.join(info.hint("merge"), ["node", "th"])
    rows = rows.dropDuplicates(["node"])
    schema = T.StructType([*info.schema.fields, T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "__text"):
                shingle, ptr = W.shingles(W.split(part.column("__text")), n)
                tagged = W.occurrences(shingle, ptr)
                packed = [tagged[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names] + [pa.array(packed, pa.binary())], names + ["shingles"])

    return rows.select(*names, "__text").mapInArrow(run, schema)


def _linked(sets: list[bytes], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs of sets with a Jaccard similarity of at
    least ``threshold``; only shared elements enter the product."""
    arrays = [np.frombuffer(s, _U) for s in sets]
    size = np.array([len(a) for a in arrays], dtype=np.float64)
    row = np.repeat(np.arange(len(arrays)), size.astype(np.int64))
    _, col, count = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    dense = np.cumsum(np.concatenate([[0], col[1:] != col[:-1]])) if len(col) else col
    both = np.zeros((len(arrays), len(arrays)), dtype=np.float64)
    width = 4096
    cut = np.searchsorted(dense, np.arange(0, (dense[-1] + 1 if len(dense) else 0) + width, width))
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:])):
        part = np.zeros((len(arrays), width), dtype=np.float32)
        part[row[a:b], dense[a:b] - i * width] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    return (both >= threshold * union) & (both > 0)


def _forest(node: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """Star edges that connect what ``linked`` connects."""
    np.fill_diagonal(linked, True)
    label = np.arange(len(node))
    while True:
        low = np.where(linked, label[None, :], len(node)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(node))
    return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})


def _links(docs: DataFrame, family: DataFrame, n: int, threshold: float) -> DataFrame:
    """Edges (a, b) whose components are those of all linked pairs within the
    families; ``family``: (node, th, family, size)."""
    small = family.filter(F.col("size") <= SMALL).count()
    packs = max(1, math.ceil(small / (2 * SMALL)))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    info = family.select(
        "node", "th", "family", "size", (F.col("size") <= SMALL).alias("packed"),
        F.when(F.col("size") <= SMALL, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.col("family")).alias("g"),
        blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("block"),
        ((blocks > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.col("size")) < PIVOTS)).alias("pivot"))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return _forest(pdf["node"].to_numpy(), _linked(list(pdf["shingles"]), threshold))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        linked = _linked(list(pdf["shingles"]), threshold)
        return _forest(pdf["node"].to_numpy(), linked)

    placed = written(_with_sets(docs, info, n), "near-sets")      # the texts of all documents move once
    copies = placed.withColumn("block", F.explode(F.when(
        F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    links = written(copies.select("packed", "g", "block", "node", "shingles").groupBy("packed", "g", "block")
                    .applyInPandas(within, "a long, b long"), "near-links")
    large = family.filter(F.col("size") > BLOCK)
    if large.isEmpty():
        return links
    # what lies outside a large family's largest class is compared with the whole family
    found = components(links)
    large = written(large.join(found, "node", "left").select(
        "node", "family", "size", F.coalesce("root", "node").alias("root")), "near-large")
    classes = large.groupBy("family", "root").agg(F.count("*").alias("n"))
    most = classes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("n"))
    rest = large.join(most, "family").withColumn("out", F.col("size") - F.col("n")).filter("out > 0")
    near, far = F.ceil(F.col("size") / BLOCK).cast("long"), F.ceil(F.col("out") / BLOCK).cast("long")
    i, j = F.pmod(F.xxhash64("node", F.lit(2)), far), F.pmod(F.xxhash64("node", F.lit(3)), near)
    as_member = rest.select("node", "family", F.explode(F.sequence(F.lit(0), far - 1)).alias("i"), j.alias("j"))
    as_rest = rest.filter("root <> most").select("node", "family", i.alias("i"), F.explode(F.sequence(F.lit(0), near - 1)).alias("j"))
    sets = placed.filter(F.col("size") > BLOCK).select("node", "shingles")
    pairs = as_member.union(as_rest).join(sets, "node")
    more = pairs.select("family", "i", "j", "node", "shingles").groupBy("family", "i", "j").applyInPandas(across, "a long, b long")
    return links.union(written(more, "near-links"))


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class),
    copy_of (smallest doc_id of the same word sequence), n_words and kept
    (the row represents its class).

    Only the columns doc_id and text are read; others may have any name.
    """
    return _decided(docs, n, threshold).drop("th")


def _decided(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The rows of ``near_duplicates`` with ``th``, the hash of the row's text.

    Texts that share their smallest doc_id are one node; the one with the
    smallest hash stands for it, the others are compared with nothing."""
    sig = written(signatures(docs, n), "near-signatures")
    reps = sig.filter("n_words > 0").groupBy("d1", "d2").agg(F.min(F.when(
        F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("first"))
    reps = written(reps.select("d1", "d2", F.col("first.doc_id").alias("copy_of"), F.col("first.th").alias("rep_th")), "near-reps")
    nodes = written(reps.filter("copy_of is not null").groupBy(F.col("copy_of").alias("doc_id")).agg(F.min("rep_th").alias("th")), "near-nodes")
    band = (sig.join(nodes, ["doc_id", "th"], "left_semi")
            .select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")))
    lead = band.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead <> last")
    star = written(band.join(lead, "band").filter("node <> lead")
                   .select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "near-star")
    member = components(star)
    sizes = member.groupBy("root").agg(F.count("*").alias("size"))
    family = member.join(sizes, "root").select("node", F.col("root").alias("family"), "size")
    family = written(family.join(nodes.withColumnRenamed("doc_id", "node"), "node"), "near-families")
    classes = components(_links(docs, family, n, threshold)).join(nodes.withColumnRenamed("doc_id", "node"), "node")
    classes = classes.select(F.col("node").alias("copy_of"), F.col("th").alias("rep_th"), "root")
    out = (sig.select("doc_id", "th", "n_words", "d1", "d2").join(reps, ["d1", "d2"], "left")
           .join(classes, ["copy_of", "rep_th"], "left"))
    alone = F.col("n_words") == 0
    copy_of = F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of"))
    class_id = F.when(alone, F.col("doc_id")).otherwise(F.coalesce("root", "copy_of"))
    first = alone | F.col("rep_th").isNull() | (F.col("th") == F.col("rep_th"))
    return out.select("doc_id", "th", class_id.alias("class_id"), copy_of.alias("copy_of"), "n_words",
                      (class_id.eqNullSafe(F.col("doc_id")) & first).alias("kept"))


def drop_near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that represent their class, all columns unchanged.

    Rows are decided by doc_id and text: a copy goes, whatever other texts its
    doc_id has.  Of rows with equal doc_id and text one stays, the smallest by a
    hash of its columns; rows without a doc_id are copies only of each other."""
    decided = _decided(docs, n, threshold).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(
        F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    is_gone = ~F.col("__kept") & F.col("__id").isNotNull()
    decided = written(decided.filter(is_gone | (F.col("__n") > 1)), "near-decided")
    gone = decided.filter(is_gone).select("__id", "__th")
    several = decided.filter(~is_gone).select("__id", "__th")

    def same(rows: DataFrame) -> Column:
        return docs["doc_id"].eqNullSafe(rows["__id"]) & (F.xxhash64(docs["text"]) == rows["__th"])

    rest = docs.join(gone, same(gone), "left_anti")
    if several.isEmpty():
        return rest
    names = docs.columns
    again = docs.join(several, same(several)).groupBy("__id", "__th").agg(
        F.min_by(F.struct(*[docs[c] for c in names]), F.xxhash64(*[docs[c] for c in names])).alias("__row"))
    return rest.join(several, same(several), "left_anti").unionByName(again.select("__row.*"))
