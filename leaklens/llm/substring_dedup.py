"""Operator 6: repeated passages by content-defined chunking.

A gear hash rolls over the words of a document and keeps the last
``GEAR_WORDS`` of them.  A chunk may start wherever the hash is the smallest of
some ``WINDOW`` consecutive words, and runs from there to the first word after
``MIN_WORDS`` whose hash ends in zero bits, or to ``MAX_WORDS``.  Starts and
ends depend on the nearby words alone: an insertion changes only the chunks
around it, and the chunks inside a passage are the same wherever it stands.
Chunks may overlap, so no position decides what is found: every repeat of at
least GEAR_WORDS - 1 + WINDOW + MAX_WORDS = 49 words holds a whole chunk, and a
repeat of fewer than ``MIN_WORDS`` words never does.

Chunks are deduplicated by the digest of their words: the document with the
smallest doc_id keeps a chunk, every other document (and every later place in
the same document) has it marked.

Results in corner cases: null and empty texts have no chunks; a text shorter
than a chunk is never marked; rows with the same doc_id count as one document;
rows with a null doc_id neither keep nor lose a passage to other documents,
only repeats within their own text are marked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaklens.llm import words as W
from leaklens.llm.graph import written

GEAR_WORDS = 2
WINDOW = 14
MIN_WORDS, MAX_WORDS = 26, 34
MASK = 3            # a chunk ends where these bits of the hash are zero

_U = np.uint64


def _gear(words: W.Words) -> np.ndarray:
    """The rolling hash at every word; it starts anew with each document."""
    value = W.mix(words.hash ^ _U(0x8F1BBCDCBFA53E0B))
    place = np.arange(len(value)) - np.repeat(words.ptr[:-1], np.diff(words.ptr))
    rolled = value.copy()
    for back in range(1, GEAR_WORDS):
        reach = np.flatnonzero(place >= back)
        rolled[reach] += value[reach - back] << _U(back)
    return W.mix(rolled)


def _units(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, word after the last, digest) of every chunk."""
    total = len(words.hash)
    if total < MIN_WORDS:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U)
    gear = _gear(words)
    place = np.arange(total)
    stop = np.repeat(words.ptr[1:], np.diff(words.ptr))
    # smallest hash of each window; the low bits hold the position
    low = (gear & ~_U(0xFFFFFFFF)) | place.astype(_U)
    for step in (1, 2, 4, WINDOW - 8):      # windows of 2, 4, 8 and WINDOW words
        low = np.minimum(low, np.concatenate([low[step:], np.full(step, ~_U(0))]))
    first = np.unique((low[place + WINDOW <= stop] & _U(0xFFFFFFFF)).astype(np.int64))
    ends = np.append(np.flatnonzero((gear & _U(MASK)) == 0) + 1, total)
    last = ends[np.minimum(np.searchsorted(ends, first + MIN_WORDS), len(ends) - 1)]
    last = np.minimum(np.maximum(last, first + MIN_WORDS), first + MAX_WORDS)
    inside = last <= stop[first]
    first, last = first[inside], last[inside]
    doc = np.searchsorted(words.ptr, first, side="right") - 1
    # a polynomial over the words: prefix sums give the digest of any range
    power = np.ones(len(words.hash) + 1, dtype=_U)
    power[1:] = _U(0xD6E8FEB86659FD93)
    power = np.cumprod(power, dtype=_U)
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(words.hash * power[:-1], dtype=_U)])
    inverse = np.ones(len(words.hash) + 1, dtype=_U)
    inverse[1:] = _U(pow(0xD6E8FEB86659FD93, -1, 2**64))
    inverse = np.cumprod(inverse, dtype=_U)
    digest = W.mix((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(_U))
    return doc, first, last, digest


def _first_in_doc(doc: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether a unit is the first of its digest in its document."""
    order = np.lexsort((np.arange(len(doc)), digest, doc))
    d, g = doc[order], digest[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    first = np.empty(len(doc), dtype=bool)
    first[order] = new
    return first


def unit_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): the distinct chunks of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                doc, _, _, digest = _units(W.split(part.column("text"), lower=False))
                own = _first_in_doc(doc, digest)
                ids = part.column("doc_id").cast(pa.int64()).take(pa.array(doc[own]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(digest[own].view(np.int64))], ["doc_id", "digest"])

    rows = docs.select("doc_id", "text").filter("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, digest long")


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, digests, keepers): the units a document shares with others;
    keepers[i] is the smallest doc_id with digests[i], maybe its own."""
    units = written(unit_digests(docs), "chunk-units")
    shared = (units.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other"))
              .filter("keeper <> other").drop("other"))
    return (units.join(shared, "digest").groupBy("doc_id")
            .agg(F.collect_list("digest").alias("digests"), F.collect_list("keeper").alias("keepers")))


def _spans(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unions of overlapping or touching ranges (sorted by document and start)."""
    if not len(doc):
        return
    reach = np.maximum.accumulate(last)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])
    at = np.flatnonzero(new)
    for i, j in zip(at, np.concatenate([at[1:], [len(doc)]])):
        yield int(doc[i]), int(first[i]), int(reach[j - 1])


def _marked(part: pa.RecordBatch):
    """(words, [(document, first, last, keeper, removed)]) of a batch with the
    columns doc_id, text, digests and keepers."""
    words = W.split(part.column("text"), lower=False)
    doc, first, last, digest = _units(words)
    again = ~_first_in_doc(doc, digest)
    own = part.column("doc_id").cast(pa.int64()).to_pylist()
    keeper = np.full(len(doc), -1, dtype=np.int64)
    found = np.zeros(len(doc), dtype=bool)
    bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
    digests, keepers = part.column("digests"), part.column("keepers")
    mine = np.zeros(len(doc), dtype=bool)
    for i in range(part.num_rows):
        a, b = bounds[i], bounds[i + 1]
        if a == b or not digests[i].is_valid:
            continue
        known = np.asarray(digests[i].values).view(_U)
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], digest[a:b]), len(known) - 1)
        hit = known[order][at] == digest[a:b]
        keeper[a:b] = np.asarray(keepers[i].values)[order][at]
        found[a:b] = hit
        mine[a:b] = hit & (keeper[a:b] == own[i])
    gone = again | (found & ~mine)
    spans = [(d, f, t, True) for d, f, t in _spans(doc[gone], first[gone], last[gone])]
    kept = found & ~gone
    spans += [(d, f, t, False) for d, f, t in _spans(doc[kept], first[kept], last[kept])]
    return words, spans, (doc, first, keeper, found)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per marked or kept passage: doc_id, start_char, end_char,
    n_words, keeper (doc_id that keeps the passage's first unit) and removed
    (false where the document itself keeps it for others).

    Documents without repeated passages have no row.
    """
    shared = repeated_units(docs)
    rows = docs.select("doc_id", "text").join(shared, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words, spans, (doc, first, keeper, found) = _marked(part)
                ids = part.column("doc_id").cast(pa.int64()).to_pylist()
                texts = part.column("text")
                out = {"doc_id": [], "start_char": [], "end_char": [], "n_words": [], "keeper": [], "removed": []}
                for d, f, t, removed in sorted(spans):
                    raw = words.data[words.base[d]:words.base[d + 1]]
                    a, b = words.start[f] - words.base[d], words.end[t - 1] - words.base[d]
                    lead = raw[:a]
                    start = int(((lead & 0xC0) != 0x80).sum())
                    i = np.searchsorted(doc, d) + np.searchsorted(first[doc == d], f)
                    out["doc_id"].append(ids[d])
                    out["start_char"].append(start)
                    out["end_char"].append(start + int(((raw[a:b] & 0xC0) != 0x80).sum()))
                    out["n_words"].append(t - f)
                    out["keeper"].append(int(keeper[i]) if found[i] else ids[d])
                    out["removed"].append(removed)
                del texts
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()),
                        ("n_words", pa.int64()), ("keeper", pa.int64()), ("removed", pa.bool_())])
    return rows.mapInArrow(run, "doc_id long, start_char long, end_char long, n_words long, keeper long, removed boolean")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with every marked passage cut out of text (and n_chars set to
    the new length, where that column exists).  All rows and columns stay; a
    null text stays null."""
    plain = {"doc_id", "text", "n_chars"}
    if set(docs.columns) - plain & {"digests", "keepers", "__id"}:
        taken = [c if c in plain else f"__c{i}" for i, c in enumerate(docs.columns)]
        return drop_repeated_passages(docs.toDF(*taken)).toDF(*docs.columns)
    names = docs.columns
    shared = repeated_units(docs).select(F.col("doc_id").alias("__id"), "digests", "keepers")
    rows = docs.join(shared, docs["doc_id"] == shared["__id"], "left").drop("__id")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.pieces(batch, "text"):
                words, spans, _ = _marked(part)
                keep = np.ones(len(words.data), dtype=bool)
                for _, f, t, removed in spans:
                    if removed:
                        keep[words.start[f]:words.end[t - 1]] = False
                total = np.concatenate([[0], np.cumsum(keep)])[words.base]
                text = pa.Array.from_buffers(pa.large_string(), part.num_rows, [
                    None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(words.data[keep])])
                text = pc.if_else(part.column("text").is_valid(), text, pa.scalar(None, pa.large_string()))
                out = {c: part.column(c) for c in names}
                kind = out["text"].type
                out["text"] = text.cast(kind)
                if "n_chars" in out:
                    out["n_chars"] = pc.utf8_length(text).cast(out["n_chars"].type)
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

    return rows.select(*names, "digests", "keepers").mapInArrow(run, schema)
