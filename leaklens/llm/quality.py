"""Operator 2: text quality by an interpolated modified Kneser-Ney model.

The model is over characters, of order ``ORDER`` (lower-cased text, every white
space character a space, ``ORDER - 1`` start marks before each text), and is
trained on the documents that the labels call good, but for one in
``HELD_OUT`` (by a hash of the text, so copies stay together).  Counts, continuation
counts, discounts, back-off weights and probabilities are tables made by
aggregations and joins on the n-gram, so the model is sharded by n-gram and
never gathered in one place.

Texts travel compressed in bundles of neighbouring documents; the labels meet
document ids, and only the places of the trusted documents in their bundles go
back to the texts.  Documents are scored in blocks: the distinct n-grams of a block (pre-aggregated
by the task that read it) are joined with the model, and the block's documents
meet the block's probabilities.  A document is kept if its perplexity per
character is at most the ``QUANTILE`` of the good documents of its language that
were left out of the counts (of all such documents where its language has none; of
all good documents where nothing was left out).  Texts that the model has seen have
lower perplexities than new ones of the same kind: their quantile would drop new ones.

Results in corner cases: a null or empty text has no perplexity and is not
kept; characters beyond the basic plane are folded into it; a null language is
a language of its own; a document is good if any of its labels says so;
without good documents nothing is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.llm import words as W
from leaklens.llm.graph import written

ORDER = 4               # four characters of 16 bits fill a 64-bit key
QUANTILE = 0.99
HELD_OUT = 5            # one of so many good texts sets the thresholds instead of the counts
BLOCK_CHARS = 32_000_000
BUNDLE = 256            # documents at most that are compressed together

_U = np.uint64


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ptr): the n-gram that ends at each character of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ptr = np.concatenate([[0], np.cumsum(size)])
    flat = "".join(texts.to_pylist())
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(_U) & _U(0xFFFF)
    code[(code <= 32) | (code == 0xA0)] = 32
    place = np.arange(len(code)) - np.repeat(ptr[:-1], size)
    key = code.copy()
    for back in range(1, ORDER):
        reach = np.flatnonzero(place >= back)
        key[reach] |= code[reach - back] << _U(16 * back)
    return key, ptr


def _suffix(key: Column, length: int) -> Column:
    """The last ``length`` characters of an n-gram."""
    return key if length == ORDER else key.bitwiseAND(F.lit((1 << (16 * length)) - 1))


def _context(key: Column) -> Column:
    """An n-gram without its last character."""
    return F.shiftrightunsigned(key, 16)


def count_ngrams(texts: DataFrame, packed: bool = False) -> DataFrame:
    """(gram, n) over the column text (or over the texts ``rows`` of the
    bundles packed), summed in each task first."""
    column = "packed" if packed else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        for batch in batches:
            for part in W.pieces(batch, column):
                values = part.column(column)
                if packed:
                    values = pa.array([bundle[i] for bundle, rows in zip(map(_unpacked, values.to_pylist()), part.column("rows").to_pylist())
                                       for i in rows], pa.large_string())
                new, n = np.unique(ngrams(values)[0], return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    wanted = texts.select("packed", "rows") if packed else texts.select("text")
    return wanted.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of one order from its counts of counts."""
    of = {r["n"]: r["times"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count("*").alias("times")).collect()}
    n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
    if not n1:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def train(texts: DataFrame, packed: bool = False) -> dict[int, tuple[DataFrame, DataFrame]]:
    """{order: (probabilities (gram, p), back-off weights (context, gamma))}."""
    counts = {ORDER: written(count_ngrams(texts, packed), "kn-counts")}
    for order in range(ORDER - 1, 0, -1):       # continuation counts: distinct characters before
        counts[order] = written(counts[order + 1].groupBy(_suffix(F.col("gram"), order).alias("gram"))
                                .agg(F.count("*").alias("n")), "kn-counts")
    letters = counts[1].count()
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[order])
        rows = counts[order].withColumn("context", _context(F.col("gram")))
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        weights = written(rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
                          .select("context", "total", (F.col("cut") / F.col("total")).alias("gamma")), "kn-gamma")
        seen = rows.join(weights, "context").withColumn("own", (F.col("n") - cut) / F.col("total"))
        if order == 1:
            seen = seen.withColumn("lower", F.lit(1.0 / (letters + 1)))
        else:
            below = model[order - 1][0].select(F.col("gram").alias("tail"), F.col("p").alias("lower"))
            seen = seen.withColumn("tail", _suffix(F.col("gram"), order - 1)).join(below, "tail")
        seen = written(seen.select("gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p")), "kn-model")
        model[order] = (seen, weights.select("context", "gamma"))
    return model


def probabilities(grams: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, logp) for a table of distinct n-grams (gram): seen ones by the
    model, others through the back-off weights of their contexts."""
    found = grams
    for order in range(1, ORDER + 1):
        p, gamma = model[order]
        found = (found.withColumn("key", _suffix(F.col("gram"), order)).withColumn("context", _context(F.col("key")))
                 .join(p.select(F.col("gram").alias("key"), F.col("p").alias(f"p{order}")), "key", "left")
                 .join(gamma.withColumnRenamed("gamma", f"g{order}"), "context", "left").drop("key", "context"))
    letters = model[1][0].count()
    value = F.lit(1.0 / (letters + 1))
    for order in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"p{order}"), F.coalesce(F.col(f"g{order}"), F.lit(1.0)) * value)
    return found.select("gram", F.log(value).alias("logp"))


def held_out(text: Column) -> Column:
    """Whether a good text is kept from the counts."""
    return F.pmod(F.xxhash64(text), F.lit(HELD_OUT)) == 0


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, bundle, doc_id, lang, held, packed): documents in bundles, their
    columns as lists and their texts compressed together; bundles in blocks of
    about BLOCK_CHARS characters of one task's input."""
    rows = docs.select("doc_id", "lang", "text", held_out(F.col("text")).alias("held")).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, chars, block, bundle = zstandard.ZstdCompressor(level=9), 0, 0, 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                for at in range(0, part.num_rows, BUNDLE):
                    some = part.slice(at, BUNDLE)
                    texts = some.column("text").to_pylist()
                    chars += sum(len(t or "") for t in texts)
                    first = some.column("part")[0].as_py()
                    lists = [pa.array([some.column(c).to_pylist()], pa.list_(kind))
                             for c, kind in (("doc_id", pa.int64()), ("lang", pa.string()), ("held", pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([(first << 24) + block]), pa.array([(first << 32) + bundle]), *lists, pa.array([_packed(press, texts)], pa.binary())],
                        ["block", "bundle", "doc_id", "lang", "held", "packed"])
                    bundle += 1
                if chars >= BLOCK_CHARS:
                    block, chars = block + 1, 0

    return rows.mapInArrow(run, "block long, bundle long, doc_id array<long>, lang array<string>, held array<boolean>, packed binary")


def _packed(press: zstandard.ZstdCompressor, texts: list[str | None]) -> bytes:
    """The number of texts, their sizes and bytes, compressed."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return press.compress(np.array([len(raw), *map(len, raw)], "<u4").tobytes() + b"".join(raw))


def _unpacked(packed: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 * (n + 1), *ends.tolist()], ends.tolist())]


def _trusted(blocks: DataFrame, good: DataFrame) -> DataFrame:
    """(packed, rows): the bundles with the places of the documents that the
    model is trained on.  Ids meet the labels; texts meet their places."""
    ids = (blocks.select("bundle", F.posexplode(F.arrays_zip("doc_id", "held")).alias("row", "d"))
           .select("bundle", "row", "d.doc_id", "d.held").filter("not held"))
    places = ids.join(good, ids["doc_id"] == good["__good"], "left_semi").groupBy("bundle").agg(F.collect_list("row").alias("rows"))
    places = written(places, "kn-places")       # of known size: texts move only if the places are many
    return blocks.select("bundle", "packed").join(places, "bundle").select("packed", "rows")


def _block_grams(blocks: DataFrame) -> DataFrame:
    """(block, gram): the distinct n-grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed")):
                new = np.unique(ngrams(pa.array(_unpacked(packed.as_py()), pa.large_string()))[0])
                seen[block] = np.union1d(seen[block], new) if block in seen else new
        for block, keys in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), block)), pa.array(keys.view(np.int64))], ["block", "gram"])

    return blocks.select("block", "packed").mapInArrow(run, "block long, gram long").distinct()


def perplexities(blocks: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(doc_id, lang, held, n, perplexity) of every document of ``blocks``
    under the model."""
    grams = written(_block_grams(blocks), "kn-grams")
    known = written(probabilities(grams.select("gram").distinct(), model), "kn-known")
    table = grams.join(known, "gram").select("block", "gram", "logp")

    def score(docs: pa.Table, table: pa.Table) -> pa.Table:
        keys, logp = table.column("gram").to_numpy().view(_U), table.column("logp").to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        total, size = [], []
        for packed in docs.column("packed"):
            key, ptr = ngrams(pa.array(_unpacked(packed.as_py()), pa.large_string()))
            value = np.concatenate([[0.0], np.cumsum(logp[np.searchsorted(keys, key)])]) if len(key) else np.zeros(1)
            total.append(value[ptr[1:]] - value[ptr[:-1]])
            size.append(np.diff(ptr))
        total, size = np.concatenate(total), np.concatenate(size)
        with np.errstate(invalid="ignore", divide="ignore"):
            perplexity = np.where(size > 0, np.exp(-total / size), np.nan)
        rows = {c: pc.list_flatten(docs.column(c)) for c in ("doc_id", "lang", "held")}
        return pa.table({**rows, "n": size, "perplexity": perplexity})

    scored = blocks.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(
        score, "doc_id long, lang string, held boolean, n long, perplexity double")
    return scored.withColumn("perplexity", F.when(F.col("n") > 0, F.col("perplexity")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept, one row per document row."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct()
    blocks = written(_blocks(docs), "kn-blocks")
    scored = written(perplexities(blocks, train(_trusted(blocks, good), packed=True)), "kn-scores")
    of_good = scored.join(good, scored["doc_id"] == good["__good"], "left_semi").filter("n > 0")
    if of_good.filter("held").isEmpty():
        of_good = of_good.withColumn("held", F.lit(True))
    of_good = of_good.filter("held")
    by_lang = of_good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    overall = of_good.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    by_lang = by_lang.withColumnRenamed("lang", "__lang")
    rows = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["__lang"]), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return rows.select("doc_id", "lang", "perplexity", threshold.alias("threshold"),
                       F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
