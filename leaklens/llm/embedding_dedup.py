"""Operator 9: near-duplicate embeddings by product quantisation.

Equal vectors are collapsed first.  A coarse k-means and one codebook per
subspace of the residuals are fitted on a bounded sample (``SAMPLE`` vectors by
hash); every vector is indexed: list, code and the exact length of its
quantisation error.  A vector probes every list whose cell can hold a vector
within the link radius: it must lie no farther than the radius from the plane
between its own centroid and that list's.  In a list, the asymmetric
table-lookup distance minus the member's error bounds the true distance from
below, so the filter loses no link; survivors are reranked by the exact cosine
in double precision.  Lists are split into blocks of members and of queries.

Results in corner cases: vectors that are null, empty, zero or hold null or
non-finite components, and rows without a label, link with nothing; vectors of
unequal length never link; rows with the same vec_id count as one vector where
their values are equal; a row with a null vec_id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm.graph import components, written

COSINE = 0.98
SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
LIST_SIZE = 1024        # members a list should have in the largest label
MOST_LISTS = 4096
BLOCK = 1024
ROUNDS = 8


def _normed(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by a power of two first, so that the squares
    of very large or very small components stay in range."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(rows: list[bytes]) -> np.ndarray:
    return _normed(np.stack([np.frombuffer(r, "<f8") for r in rows]))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :])


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids; fewer points than centroids give the points."""
    if len(x) <= k:
        return x.copy() if len(x) else np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(x[a:a + 8192], c).argmin(1) for a in range(0, len(x), 8192)])
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


class Index:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, coarse: np.ndarray, books: list[np.ndarray]):
        self.coarse, self.books = coarse, books
        self.cuts = np.array_split(np.arange(coarse.shape[1]), len(books))

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The arrays of an index."""
        coarse = _kmeans(sample, lists, 9)
        rest = sample - coarse[_distances(sample, coarse).argmin(1)]
        cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        return coarse, [_kmeans(rest[:, cut], CODES, 10 + i) for i, cut in enumerate(cuts)]

    def add(self, x: np.ndarray):
        """(list, codes, error length, squared distances to the centroids)."""
        far = _distances(x, self.coarse)
        own = far.argmin(1)
        rest = x - self.coarse[own]
        codes = np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        for i, (cut, book) in enumerate(zip(self.cuts, self.books)):
            codes[:, i] = _distances(rest[:, cut], book).argmin(1)
        return own, codes, np.linalg.norm(rest - self._decode(codes), axis=1), far

    def _decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def probes(self, far: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Boolean (vectors, lists): lists that can hold a vector within reach."""
        gap = np.sqrt(_distances(self.coarse, self.coarse))[own]
        near = far - far[np.arange(len(own)), own][:, None] <= 2 * radius * gap + 1e-6
        near[np.arange(len(own)), own] = True
        return near

    def lookup(self, queries: np.ndarray, where: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries, members) in list ``where``."""
        rest = queries - self.coarse[where]
        total = np.zeros((len(queries), len(codes)))
        for i, (cut, book) in enumerate(zip(self.cuts, self.books)):
            total += _distances(rest[:, cut], book)[:, codes[:, i]]
        return np.sqrt(total)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the pairs connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _valid(vectors: DataFrame) -> DataFrame:
    """(rep, label, dim, copies, key): distinct usable vectors, smallest
    vec_id first; key packs the components as doubles."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    return (vectors.select("vec_id", "label", "embedding").filter(ok).withColumn("x", x).filter(F.coalesce(fine, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"), "label", "x", F.xxhash64("x").alias("d1"),
                    F.xxhash64("x", F.lit(1)).alias("d2"), F.size("x").alias("dim")).distinct())


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per input row."""
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    valid = written(_valid(vectors), "pq-valid")
    groups = valid.groupBy("label", "dim", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = written(groups, "pq-groups")
    reps = written(valid.join(groups, (valid["vec_id"] == groups["rep"]) & (valid["label"] == groups["label"])
                              & (valid["d1"] == groups["d1"]) & (valid["d2"] == groups["d2"]))
                   .select("rep", valid["label"], valid["dim"], "copies", "x"), "pq-reps")
    sizes = reps.groupBy("dim", "label").agg(F.count("*").alias("n")).groupBy("dim").agg(F.max("n").alias("most"), F.sum("n").alias("n")).collect()
    found = spark.createDataFrame([], "a long, b long, n long")
    for size in sizes:      # one index per vector length
        found = found.union(_links(reps.filter(F.col("dim") == size["dim"]), size["n"], size["most"], cosine, radius))
    found = written(found, "pq-links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = components(found.filter("b is not null").select("a", "b"))
    state = (groups.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "dim", "d1", "d2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("root", "rep").alias("component_id")))
    each = valid.join(state, ["label", "dim", "d1", "d2"]).groupBy("vec_id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select("vec_id").join(each.withColumnRenamed("vec_id", "__id"), F.col("vec_id") == F.col("__id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                       F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(reps: DataFrame, n: int, most: int, cosine: float, radius: float) -> DataFrame:
    """Rows (a, b, n): with b null, a has n links; else a and b are connected."""
    share = min(1.0, SAMPLE / n)
    draw = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = reps.filter(draw).select("rep", "x").orderBy("rep").toPandas()     # about SAMPLE rows
    x = np.array([np.asarray(v, dtype=np.float64) for v in sample["x"]]) if len(sample) else np.ones((1, reps.first()["dim"]))
    x = _normed(x)
    lists = min(MOST_LISTS, max(4, math.ceil(most / LIST_SIZE)))
    # plain arrays, as a broadcast names the classes it holds
    shipped = reps.sparkSession.sparkContext.broadcast(Index.fit(x, lists))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = [np.asarray(v, dtype="<f8").tobytes() for v in part.column("x").to_pylist()]
                if not raw:
                    continue
                own, codes, error, far = index.add(_unit(raw))
                near = index.probes(far, own, radius)
                probes = [np.flatnonzero(r).tolist() for r in near]
                yield pa.RecordBatch.from_arrays([
                    part.column("rep"), part.column("label"), part.column("copies"), pa.array(raw, pa.binary()),
                    pa.array(own.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error),
                    pa.array(probes, pa.list_(pa.int64()))],
                    ["rep", "label", "copies", "raw", "list", "codes", "error", "probes"])

    label = reps.schema["label"].dataType.simpleString()
    placed = written(reps.select("rep", "label", "copies", "x").mapInArrow(
        place, f"rep long, label {label}, copies long, raw binary, list long, codes binary, error double, probes array<long>"), "pq-codes")
    asked = placed.select("rep", "label", "raw", F.explode("probes").alias("list"))
    blocks = (placed.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("mb"))
              .join(asked.groupBy("label", "list").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("qb")), ["label", "list"]))
    blocks = written(blocks, "pq-blocks")
    none = F.lit(None)
    members = (placed.join(blocks, ["label", "list"]).withColumn("m", F.pmod(F.xxhash64("rep"), F.col("mb")))
               .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
               .select("label", "list", "m", F.col("q").cast("long").alias("q"), "rep", "raw", "copies", "codes", "error"))
    queries = (asked.join(blocks, ["label", "list"]).withColumn("q", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("qb")))
               .withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
               .select("label", "list", F.col("m").cast("long").alias("m"), "q", "rep", "raw", none.cast("long").alias("copies"),
                       none.cast("binary").alias("codes"), none.cast("double").alias("error")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["codes"].isna().to_numpy()
        ask, have = pdf[asks], pdf[~asks]
        if not len(ask) or not len(have):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x, y = _unit(list(ask["raw"])), _unit(list(have["raw"]))
        codes = np.stack([np.frombuffer(c, np.uint8) for c in have["codes"]])
        bound = Index(*shipped.value).lookup(x, int(pdf["list"].iloc[0]), codes) - have["error"].to_numpy()[None, :]
        i, j = np.nonzero(bound <= radius + 1e-6)
        exact = np.concatenate([np.einsum("ij,ij->i", x[i[a:a + 65536]], y[j[a:a + 65536]])
                                for a in range(0, max(1, len(i)), 65536)])
        a, b = ask["rep"].to_numpy()[i], have["rep"].to_numpy()[j]
        linked = (exact >= cosine) & (a != b)
        a, b, j, i = a[linked], b[linked], j[linked], i[linked]
        if not len(a):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        count = np.bincount(i, have["copies"].to_numpy(np.float64)[j], minlength=len(ask))
        some = np.flatnonzero(count)
        left, right = _forest(a, b)
        return pd.DataFrame({
            "a": np.concatenate([ask["rep"].to_numpy()[some], left]),
            "b": pd.array([None] * len(some) + right.tolist(), dtype="Int64"),
            "n": np.concatenate([count[some].astype(np.int64), np.zeros(len(left), np.int64)])})

    return members.union(queries).groupBy("label", "list", "m", "q").applyInPandas(compare, "a long, b long, n long")
