"""Operator 4: benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over hashed words; document frequencies count all
distinct texts, and no word weighs less than 1, however many texts hold it.  A
randomised SVD of the benchmark's passages (up to ``ITEM_PASSAGE`` words each)
gives ``RANK`` latent directions.  Every window of ``PASSAGE`` words of every
document is compared with every benchmark passage by the cosine of the window
with the passage's latent approximation; a window is skipped if the most that
each of its words adds to the cosine with any passage sums to less than
``COSINE``.  A passage of which
the directions hold less than ``CAPTURED`` of the length is compared by the
cosine of the whole vectors instead, for the windows that share one of its rare
words (without one of these the cosine cannot reach ``COSINE``).

A candidate is checked on the words: the longest common subsequence of the
item with the stretch of the document around the candidate windows must cover
``LCS_SURE`` of the item, or ``LCS_PARAPHRASE`` of it together with the answer,
the item's last ``ANSWER`` words (at least half of their distinct words in that
stretch).

The SVD is a distributed power iteration: every task adds up its part of
A^T A Q, and only the sum, one row of RANK numbers for each hashed word of the
items (2^HASH_BITS rows at most), reaches the driver.  Benchmark items are searched in blocks of about ``ITEM_BLOCK``, each
block with directions of its own.

Results in corner cases: texts and items without words match nothing; items
of equal text each have their rows; a passage is found however long the
document is; without benchmark items or documents the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaklens.llm import words as W
from leaklens.llm.graph import written

PASSAGE, ITEM_PASSAGE = 32, 48
STRIDE = 8
HASH_BITS = 16
RANK = 256
POWER_ROUNDS = 2
COSINE = 0.28
CAPTURED = 0.9
LCS_SURE, LCS_PARAPHRASE = 0.75, 0.5
ANSWER = 6
ITEM_BLOCK = 2000
GROUPS = 24             # of passages, each with a bound of its own
SLICE = 4096            # blocks of STRIDE words whose sums are made at once

_U = np.uint64


def _buckets(words: W.Words) -> np.ndarray:
    return (words.hash >> _U(64 - HASH_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(bucket, n): in how many documents a hashed word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << HASH_BITS, dtype=np.int64)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = W.split(part.column("text"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(words.ptr))
                once = np.unique((doc << HASH_BITS) | _buckets(words))
                count += np.bincount(once & ((1 << HASH_BITS) - 1), minlength=len(count))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _block_sums(words: W.Words, table: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of ``table`` over blocks of ``stride`` words of each
    document (the last block of a document may be shorter), and how many
    blocks each document has."""
    n = np.diff(words.ptr)
    blocks = -(-n // stride)
    step = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(words.ptr[:-1], blocks) + step * stride
    if not len(start):
        return np.zeros((0, table.shape[1]), table.dtype), blocks
    bucket, sums = _buckets(words), np.empty((len(start), table.shape[1]), table.dtype)
    many, until = max(1, SLICE * STRIDE // stride), np.append(start, len(bucket))
    for a in range(0, len(start), many):        # the rows of all words at once would fill the memory
        b = min(a + many, len(start))
        sums[a:b] = np.add.reduceat(table[bucket[until[a]:until[b]]], start[a:b] - until[a], axis=0)
    return sums, blocks


def _row_sums(ptr: np.ndarray, row: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``_block_sums`` over STRIDE words, to the bit, where word i
    has row ``row[i]`` of a small ``table``."""
    n = np.diff(ptr)
    blocks = -(-n // STRIDE)
    step = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(ptr[:-1], blocks) + step * STRIDE
    size = np.minimum(np.repeat(ptr[1:], blocks) - start, STRIDE)
    sums = np.empty((len(start), table.shape[1]), table.dtype)
    for a in range(0, len(start), SLICE):       # as in _block_sums
        first, left = start[a:a + SLICE], size[a:a + SLICE]
        rest = np.zeros((len(first), table.shape[1]), table.dtype)
        for i in range(1, STRIDE):
            if left.min() > i:
                rest += np.take(table, row[first + i], axis=0)
            else:
                reach = np.flatnonzero(left > i)
                rest[reach] += np.take(table, row[first[reach] + i], axis=0)
        np.add(np.take(table, row[first], axis=0), rest, out=sums[a:a + SLICE])
    return sums, blocks


def _passages(sums: np.ndarray, blocks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, document, first block) of every window of ``width`` blocks;
    a shorter document is one window."""
    doc = np.repeat(np.arange(len(blocks)), blocks)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    left = blocks[doc] - place
    total = sums.copy()
    for i in range(1, width):
        reach = np.flatnonzero(left > i)
        total[reach] += sums[reach + i]
    real = (left >= width) | (place == 0)
    return total[real], doc[real], place[real]


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _power_step(texts: DataFrame, q: np.ndarray, used: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A^T A Q over the passages A (of length 1) of ``texts``; the rows of Q
    and of the result belong to the buckets ``used``."""
    shipped = texts.sparkSession.sparkContext.broadcast((q.astype(np.float32), used, idf[used].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, used, weight = shipped.value
        table = np.zeros((1 << HASH_BITS, q.shape[1] + 1), dtype=np.float32)
        table[used, :-1], table[used, -1] = q * weight[:, None], weight**2
        at_row = np.full(1 << HASH_BITS, -1)
        at_row[used] = np.arange(len(used))
        out = np.zeros(q.shape, dtype=np.float64)
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = W.split(part.column("text"))
                projected, _ = _block_sums(words, table, ITEM_PASSAGE)
                projected = projected[:, :-1] / np.maximum(projected[:, -1:], 1e-9)
                place = np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
                passage = np.cumsum(place % ITEM_PASSAGE == 0) - 1
                row = at_row[_buckets(words)]
                order = np.argsort(row, kind="stable")
                order = order[row[order] >= 0]
                if len(order):
                    seen, at = np.unique(row[order], return_index=True)
                    out[seen] += np.add.reduceat(projected[passage[order]], at, axis=0) * weight[seen][:, None]
        seen = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array([out[i].tobytes() for i in seen], pa.binary())], ["at", "row"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, inverse = np.unique(pdf["at"].to_numpy(), return_inverse=True)
        total = np.zeros((len(seen), q.shape[1]))
        np.add.at(total, inverse, np.stack([np.frombuffer(r) for r in pdf["row"]]))
        return pd.DataFrame({"at": seen, "row": [r.tobytes() for r in total]})

    parts = texts.mapInArrow(run, "at long, row binary")
    rows = (parts.withColumn("slice", F.col("at") % 64).groupBy("slice")
            .applyInPandas(lambda pdf: add(pdf[["at", "row"]]), "at long, row binary").toPandas())
    shipped.unpersist()
    out = np.zeros(q.shape)
    for at, row in zip(rows["at"], rows["row"]):
        out[at] = np.frombuffer(row)
    return out


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed IDF weight (1 at least) of every hashed word over the distinct
    texts of ``docs``: copies of a text count once, and a passage that many
    texts share keeps its weight against itself."""
    texts = docs.select("text").distinct()
    pairs = document_frequencies(texts).toPandas()      # at most 2^HASH_BITS rows
    n = docs.agg(F.count_distinct(F.xxhash64("text"))).first()[0]
    df = np.zeros(1 << HASH_BITS)
    df[pairs["bucket"].to_numpy(np.int64)] = pairs["n"]
    return 1 + np.log((max(n, df.max()) + 1) / (df + 1))


def latent_directions(items: DataFrame, idf: np.ndarray, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(used, directions): the hashed words of ``items``, and the orthonormal
    (len(used), up to RANK) directions of its passages."""
    used = np.sort(document_frequencies(items).toPandas()["bucket"].to_numpy(np.int64))
    q = np.random.default_rng(seed).standard_normal((len(used), min(RANK, len(used))))
    for _ in range(POWER_ROUNDS if len(used) else 0):
        q, _ = np.linalg.qr(_power_step(items, q, used, idf))
    return used, q


def _item_blocks(items: DataFrame) -> Iterator[DataFrame]:
    """Benchmark items (item_id, text) in hashed blocks of about ITEM_BLOCK rows."""
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    blocks = max(1, round(known.count() / ITEM_BLOCK))
    for i in range(blocks):
        yield known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one long integer
    per word of ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & at.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _most(table: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The largest product, 0 at least, of each row of ``table`` with any
    vector of each of GROUPS runs of neighbouring vectors."""
    most = np.zeros((len(table), GROUPS), dtype=np.float32)
    for g, run in enumerate(np.array_split(vectors, GROUPS)):
        for a in range(0, len(table) if len(run) else 0, 4096):
            for b in range(0, len(run), 1024):
                np.maximum(most[a:a + 4096, g], (table[a:a + 4096] @ run[b:b + 1024].T).max(axis=1), out=most[a:a + 4096, g])
    return most


def _bounds(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each bucket, rows of ``most``): equal rows of zeros become one."""
    some = most.any(axis=1)
    return np.where(some, np.cumsum(some), 0), np.concatenate([np.zeros((1, most.shape[1]), np.float32), most[some]])


def _windows(words: W.Words, idf2: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]):
    """Blocks of STRIDE words, and the windows of them that may reach COSINE:
    (block of each word, first block, document, place, weight) of the windows."""
    bucket, (at, most) = _buckets(words), bounds
    weight, blocks = _row_sums(words.ptr, bucket, idf2.astype(np.float32)[:, None])
    best, _ = _row_sums(words.ptr, at[bucket], most)
    total, doc, place = _passages(np.concatenate([weight, best], axis=1), blocks, PASSAGE // STRIDE)
    start = np.concatenate([[0], np.cumsum(blocks)])
    first = start[doc] + place
    best = total[:, 1:].max(axis=1)     # the words of a window must meet in one group of passages
    hopeful = best >= (COSINE - 1e-4) * np.sqrt(total[:, 0])     # less the rounding of float32
    hopeful &= best > 0
    place_of = np.arange(len(words.hash)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
    block = np.repeat(start[:-1], np.diff(words.ptr)) + place_of // STRIDE
    return block, blocks, first[hopeful], doc[hopeful], place[hopeful], total[hopeful, 0]


class _Whole(NamedTuple):
    """Unit vectors of the passages that are compared as a whole."""
    vector: np.ndarray      # place of each among all passages
    left: np.ndarray        # length of the part of each vector outside the posts
    words: np.ndarray       # buckets that have posts, sorted
    ptr: np.ndarray         # posts of word i are ptr[i]:ptr[i+1]
    at: np.ndarray          # passage of a post
    value: np.ndarray
    keys: np.ndarray        # passage << HASH_BITS | bucket of every entry, sorted
    entries: np.ndarray


def _entries(words: W.Words, passage: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage << HASH_BITS | bucket, TF-IDF) of the passages (first, last word)."""
    first, last = passage
    n = last - first
    word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    keys, tf = np.unique((np.repeat(np.arange(len(n)), n) << HASH_BITS) | _buckets(words)[word], return_counts=True)
    return keys, tf * idf[keys & ((1 << HASH_BITS) - 1)]


def _whole(keys: np.ndarray, entries: np.ndarray, vector: np.ndarray) -> _Whole:
    """The index of passages: posts for the rarest words of each, so that the
    rest of its vector is shorter than half of COSINE."""
    own, bucket = keys >> HASH_BITS, keys & ((1 << HASH_BITS) - 1)
    norm = np.sqrt(np.bincount(own, entries**2, minlength=len(vector)))
    value = entries / norm[own]
    order = np.lexsort((value, own))
    run = np.cumsum(value[order]**2)
    head = np.searchsorted(own[order], np.arange(len(vector)))
    run -= np.concatenate([[0], run])[head][own[order]]
    posted = np.sort(order[run >= (COSINE / 2)**2])
    rest = np.ones(len(keys), dtype=bool)
    rest[posted] = False
    left = np.sqrt(np.bincount(own[rest], value[rest]**2, minlength=len(vector)))
    posted = posted[np.argsort(bucket[posted], kind="stable")]
    seen, ptr = np.unique(bucket[posted], return_index=True)
    return _Whole(vector, left, seen, np.append(ptr, len(posted)), own[posted], value[posted], keys, value)


def _whole_cosines(whole: _Whole, bucket: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray,
                   length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, passage, cosine) of at least COSINE for windows of the words
    ``start`` to ``end``."""
    at_word = np.full(1 << HASH_BITS, -1)
    at_word[whole.words] = np.arange(len(whole.words))
    posts = np.diff(whole.ptr)
    row = at_word[bucket]
    cost = np.concatenate([[0], np.cumsum(np.where(row >= 0, posts[row], 0))])
    step = np.concatenate([[0], np.cumsum(cost[end] - cost[start])])
    a = 0
    while a < len(start):           # about a million posts at a time
        b = max(a + 1, int(np.searchsorted(step, step[a] + (1 << 20), side="right")) - 1)
        n = end[a:b] - start[a:b]
        window = np.repeat(np.arange(a, b), n)
        word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[window]
        window, word = window[row[word] >= 0], word[row[word] >= 0]
        n = posts[row[word]]
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(whole.ptr[row[word]], n)
        pair, inverse = np.unique(np.repeat(window, n) * len(whole.vector) + whole.at[post], return_inverse=True)
        part = np.bincount(inverse, whole.value[post] * np.repeat(weight[word], n), minlength=len(pair))
        window, passage = pair // len(whole.vector), pair % len(whole.vector)
        near = part / length[window] + whole.left[passage] >= COSINE
        window, passage = window[near], passage[near]
        if len(window):
            n = end[window] - start[window]
            word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[window], n)
            key = (np.repeat(passage, n) << HASH_BITS) | bucket[word]
            at = np.minimum(np.searchsorted(whole.keys, key), len(whole.keys) - 1)
            value = np.where(whole.keys[at] == key, whole.entries[at], 0) * weight[word]
            cosine = np.add.reduceat(value, np.cumsum(n) - n) / length[window]
            near = cosine >= COSINE
            yield window[near], whole.vector[passage[near]], cosine[near]
        a = b


def _search(docs: DataFrame, idf: np.ndarray, items: DataFrame) -> DataFrame | None:
    """Checked matches of one block of items."""
    rows = items.collect()
    if not rows:
        return None
    words = W.split(pa.array([r["text"] for r in rows], pa.string()))
    used, directions = latent_directions(items.select("text"), idf)
    if not len(used):
        return None
    table = np.zeros((1 << HASH_BITS, directions.shape[1]), dtype=np.float32)
    table[used] = directions * idf[used][:, None]
    sums, blocks = _block_sums(words, table, STRIDE)
    width = ITEM_PASSAGE // STRIDE
    vectors, owner, place = _passages(sums, blocks, width)
    chosen = (place % (width // 2) == 0) | (place == blocks[owner] - width)
    vectors, owner, place = vectors[chosen], owner[chosen], place[chosen]
    first = words.ptr[:-1][owner] + place * STRIDE
    keys, entries = _entries(words, (first, np.minimum(first + ITEM_PASSAGE, words.ptr[1:][owner])), idf)
    length = np.sqrt(np.bincount(keys >> HASH_BITS, entries**2, minlength=len(owner)))
    low = np.linalg.norm(vectors, axis=1) < CAPTURED * length
    mine = low[keys >> HASH_BITS]
    renumbered = (np.cumsum(low) - 1)[keys[mine] >> HASH_BITS]
    whole = _whole((renumbered << HASH_BITS) | (keys[mine] & ((1 << HASH_BITS) - 1)), entries[mine], np.flatnonzero(low))
    most = np.zeros((1 << HASH_BITS, 2 * GROUPS), dtype=np.float32)
    most[used, :GROUPS] = _most(table[used], _unit(vectors[~low]).astype(np.float32))
    bucket, group = whole.keys & ((1 << HASH_BITS) - 1), (whole.keys >> HASH_BITS) * GROUPS // max(1, len(whole.vector))
    np.maximum.at(most, (bucket, GROUPS + group), (whole.entries * idf[bucket]).astype(np.float32))
    most = most[:, most.any(axis=0)] if most.any() else most[:, :1]
    item_words = [words.hash[a:b] for a, b in zip(words.ptr[:-1], words.ptr[1:])]
    ids = [r["item_id"] for r in rows]
    shipped = docs.sparkSession.sparkContext.broadcast(
        (idf, most, used, table[used], _unit(vectors[~low]), owner[np.concatenate([np.flatnonzero(~low), np.flatnonzero(low)])],
         tuple(whole._replace(vector=(~low).sum() + np.arange(low.sum()))), item_words, ids))     # a broadcast names the classes it holds
    width = PASSAGE // STRIDE
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("lcs", pa.int64()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, most, known, latent, vec, own, arrays, item, item_ids = shipped.value
        whole = _Whole(*arrays)
        idf2, bounds, read = weight**2, _bounds(most), {}
        at_row = np.full(len(weight), -1)
        at_row[known] = np.arange(len(known))
        lengths = np.array([len(x) for x in item])
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words = W.split(part.column("text"))
                block, blocks, first, doc, place, total = _windows(words, idf2, bounds)
                if not len(first):
                    continue
                wanted = np.zeros(blocks.sum() + width, dtype=bool)
                for i in range(width):
                    wanted[first + i] = True
                row = at_row[_buckets(words)]
                pick = np.flatnonzero((row >= 0) & wanted[block])
                lead = np.flatnonzero(np.diff(block[pick], prepend=-1))
                sums = np.empty((len(lead) + 1, latent.shape[1]), latent.dtype)
                sums[-1] = 0
                until = np.append(lead, len(pick))
                for a in range(0, len(lead), SLICE):        # bounded, however long a document is
                    part_of = pick[until[a]:until[min(a + SLICE, len(lead))]]
                    sums[a:a + SLICE][:len(lead) - a] = np.add.reduceat(latent[row[part_of]], lead[a:a + SLICE] - lead[a], axis=0)
                at = np.full(len(wanted), len(lead))
                at[block[pick][lead]] = np.arange(len(lead))
                doc_ids, hashes = part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("th").to_pylist()
                hits: list[tuple[np.ndarray, ...]] = []     # document, item, place, cosine
                ends = np.cumsum(blocks)[doc]
                for a in range(0, len(first) if len(vec) else 0, 8192):
                    f = first[a:a + 8192]
                    mine = sums[at[f]]
                    for i in range(1, width):
                        mine = mine + np.where((f + i < ends[a:a + 8192])[:, None], sums[at[f + i]], 0)
                    cosine = (mine / np.sqrt(total[a:a + 8192])[:, None].astype(np.float32)) @ vec.T
                    i, j = np.nonzero(cosine >= COSINE)
                    hits.append((doc[a + i], own[j], place[a + i], cosine[i, j].astype(np.float64)))
                if len(whole.vector):
                    start = words.ptr[doc] + place * STRIDE
                    end = np.minimum(start + PASSAGE, words.ptr[doc + 1])
                    for i, j, cosine in _whole_cosines(whole, _buckets(words), weight[_buckets(words)], start, end, np.sqrt(total)):
                        hits.append((doc[i], own[j], place[i], cosine))
                if not hits:
                    continue
                out = {name: [] for name in schema.names}
                for d, k, stretches in _stretches([np.concatenate(x) for x in zip(*hits)], lengths):
                    if k not in read:
                        read[k] = _read(item[k])
                    best = _check(words.hash[words.ptr[d]:words.ptr[d + 1]], item[k], read[k], stretches)
                    if best:
                        for name, value in zip(schema.names, (doc_ids[d], hashes[d], item_ids[k], len(item[k]), *best)):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, "doc_id long, th long, item_id long, item_words long, lcs long, first_word long, last_word long, cosine double")


def _stretches(hits: list[np.ndarray], lengths: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(document, item, its stretches) of the candidate windows ``hits``
    (document, item, place, cosine); ``lengths`` are the items' words.  A
    stretch (first word, end, best cosine) covers neighbouring windows and as
    many words around them as the item has."""
    order = np.lexsort((hits[2], hits[1], hits[0]))
    doc, item, place, cosine = (x[order] for x in hits)
    if not len(doc):
        return
    n = lengths[item]
    first, end = np.maximum(0, place * STRIDE - n), place * STRIDE + PASSAGE + n
    pair = np.ones(len(doc), dtype=bool)
    pair[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    new = pair.copy()
    new[1:] |= first[1:] > end[:-1]
    at = np.flatnonzero(new)
    runs = list(zip(first[at].tolist(), end[np.append(at[1:], len(doc)) - 1].tolist(), np.maximum.reduceat(cosine, at).tolist()))
    of = np.flatnonzero(pair[at])
    for a, b in zip(of.tolist(), np.append(of[1:], len(at)).tolist()):
        yield int(doc[at[a]]), int(item[at[a]]), runs[a:b]


def _read(item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(its distinct words, the place of each word in them, the distinct words
    of its answer)."""
    return *np.unique(item, return_inverse=True), np.unique(item[-ANSWER:])


def _check(text: np.ndarray, item: np.ndarray, read: tuple[np.ndarray, np.ndarray, np.ndarray],
           stretches: list[tuple[int, int, float]]):
    """(lcs, first word, last word, cosine) of the best stretch of a document
    that passes the word checks for an item, or None; long stretches are read
    in overlapping pieces."""
    n, best = len(item), None
    known, place, answer = read
    reach = 2 * n + PASSAGE
    for a, b, cosine in stretches:
        near = text[a:b + reach]
        at_known = np.minimum(np.searchsorted(known, near), len(known) - 1)
        hit = known[at_known] == near
        shared = np.concatenate([[0], np.cumsum(hit)])      # a subsequence is no longer than this in its piece
        for at in range(a, max(a + 1, min(b, len(text)) - reach // 2), reach // 2):
            part = text[at:at + reach]
            here = slice(at - a, at - a + len(part))
            if not len(part) or shared[here.stop] - shared[here.start] < LCS_PARAPHRASE * n:
                continue
            found = np.zeros(len(known), dtype=bool)
            found[at_known[here][hit[here]]] = True
            if np.count_nonzero(found[place]) < LCS_PARAPHRASE * n:
                continue
            common = _lcs(item, part)
            if common < LCS_PARAPHRASE * n or (best and common <= best[0]):
                continue
            if common >= LCS_SURE * n or np.isin(answer, part).mean() >= 0.5:
                best = (common, at, at + len(part), cosine)
    return best


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id,
    item_words, lcs, first_word, last_word (the stretch checked) and cosine."""
    return _found(docs, items).drop("th")


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``contaminations`` with ``th``, the hash of the row's text."""
    spark: SparkSession = docs.sparkSession
    # no rows, without the RDD whose Python workers would stay beside those of the search
    found = spark.range(0).select(*[F.lit(None).cast("double" if c == "cosine" else "long").alias(c) for c in (
        "doc_id", "th", "item_id", "item_words", "lcs", "first_word", "last_word", "cosine")])
    idf = inverse_frequencies(docs.select("text"))
    for block in _item_blocks(items):
        part = _search(docs, idf, block)
        if part is not None:
            found = found.union(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; a row is
    decided by its own text, whatever other rows its doc_id has.  Rows without
    a doc_id are kept."""
    hit = written(_found(docs, items).filter("doc_id is not null")
                  .select(F.col("doc_id").alias("__hit"), F.col("th").alias("__th")).distinct(), "lsa-hits")
    return docs.join(hit, (docs["doc_id"] == hit["__hit"]) & (F.xxhash64(docs["text"]) == hit["__th"]), "left_anti")
