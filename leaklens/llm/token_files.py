"""Operator 11: token ids of a corpus as flat binary files.

A folder of shards, each of three flat little-endian arrays:

* ``kind=0``: the token ids of its documents one after another, each document
  closed by the end id; unsigned 16-bit integers if all ids fit, else 32-bit;
* ``kind=1``: unsigned 64-bit offsets, where each document starts in the shard;
* ``kind=2``: pairs of 64-bit integers per document, its doc_id and 1 if that
  is null.

Documents stand in ascending doc_id order within a shard and over the shards.
The ids before a shard (its base) are the prefix sum of the shard sizes, so a
document's place in the whole corpus is base + offset, and no shard waits for
another when it is written.

Spark's own writer commits the files, so a lost task leaves no half-written
shard and any file system that Spark knows will do.  It writes lines, not
arrays; as every number here ends with a zero byte, that byte is the line end.
Where the folder is mounted, readers memory-map the files; elsewhere Spark
reads each shard whole, whose size the shuffle partitions bound.

Encoding goes through the tokenizer piece by piece: this pre-tokenizer never
lets a token cross a space that another character follows or precedes, so the
pieces between such spaces encode alone as they do in the text, and each
distinct piece is encoded once per task (of pieces not in use any more at most
``CACHE`` are kept).  A word and the ASCII marks after it (without an
apostrophe) never share a token either and are encoded apart.  New pieces are
encoded many at a time, as one text, and told apart by their leading space.
Other kinds of tokenizer encode whole texts.

Results in corner cases: a null or empty text is the end id alone; null
doc_ids come first; rows with one doc_id follow one another in the order of a
hash of their text, equal rows have equal entries; an empty table gives a
folder without shards; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaklens.llm.words import pieces, without_cycles

END_ID = 2
CACHE = 400_000
IDS, OFFSETS, DOCS = 0, 1, 2        # values of ``kind``
SHARD = r"part-(\d+)"

_LOOSE = re.compile(r"\s (?!\S)")    # a space that may not be cut at
_CUT = re.compile(r"(?<=\S) | (?=\S)")
_MARKED = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]+)")     # a word and marks after it
_PLAIN = re.compile(r"\S(?:[^ ]*\S)?")
JOINED = 500            # pieces encoded as one text


def id_type(tokenizer: str, end_id: int = END_ID) -> str:
    """Type of the ids: 16 bits if every id fits (and the end id has a zero byte), else 32."""
    spec = json.loads(tokenizer)
    vocab = spec["model"]["vocab"]
    vocab = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    most = max([*vocab, end_id, *(t["id"] for t in spec.get("added_tokens") or [])], default=end_id)
    return "<u2" if most < 1 << 16 and end_id < 1 << 8 else "<u4"


def splits_at_spaces(tokenizer: str) -> bool:
    """Whether texts may be cut at spaces: byte-level pre-tokens, nothing that rewrites the text."""
    spec = json.loads(tokenizer)
    pre = spec.get("pre_tokenizer") or {}
    return (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE")


@lru_cache(maxsize=1)
def _loaded(tokenizer: str) -> tuple["Tokenizer", np.ndarray]:
    """The tokenizer, and which of its ids begin with a space; a worker keeps
    them for its next task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(tokenizer)
    found.encode_special_tokens = True      # their strings in a text are ordinary text
    vocab = found.get_vocab(with_added_tokens=True)
    spaced = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
    spaced[[i for token, i in vocab.items() if token[:1] in ("\u0120", " ")]] = True
    return found, spaced


class _Numbers(dict):
    """Piece -> number; a piece that is not known takes the next one and joins ``new``."""

    def __init__(self, numbers: Iterator[int]):
        self.numbers, self.new = numbers, []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = next(self.numbers)
        self.new.append(piece)
        return number


class Encoder:
    """Texts to ids, each distinct piece encoded once.

    Pieces have numbers, 0 is the end of a document; the ids of piece i are
    ``pool[at[i]:at[i] + size[i]]``."""

    def __init__(self, tokenizer: str, end_id: int, kind: str, cuts: bool):
        self.tokenizer, self.spaced = _loaded(tokenizer)
        self.kind, self.cuts, self.turn = kind, cuts, 0
        self.end = np.array([end_id], kind)
        self._set({}, {}, self.end, np.ones(1, np.int64), np.zeros(1, np.int64))

    def _set(self, first: dict[str, int], rest: dict[str, int], pool: np.ndarray, size: np.ndarray, last: np.ndarray) -> None:
        numbers = iter(range(len(size), 1 << 62))
        self.first, self.rest = _Numbers(numbers), _Numbers(numbers)        # pieces at the start of a text, pieces after a space
        self.first.update(first)
        self.rest.update(rest)
        self.pool, self.size, self.last, self.at = pool, size, last, np.cumsum(size) - size

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _encode_spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their numbers) of pieces without spaces of any kind at their
        ends or plain ones inside, each after a space."""
        ids, sizes = [], []
        runs = [pieces[a:a + JOINED] for a in range(0, len(pieces), JOINED)]
        for run, found in zip(runs, self._encode([" " + " ".join(run) for run in runs])):
            at = np.flatnonzero(self.spaced[found])
            if len(at) == len(run) and at[0] == 0:
                ids.append(found)
                sizes.append(np.diff(at, append=len(found)))
            else:       # a vocabulary that does not show the spaces
                alone = self._encode([" " + x for x in run])
                ids += alone
                sizes.append(np.array([len(x) for x in alone], np.int64))
        return np.concatenate(ids or [self.end[:0]]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        place = np.arange(size.sum()) + np.repeat(self.at[numbers] - np.cumsum(size) + size, size)
        return self.pool[place]

    def _add(self, numbers: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.at[numbers] = len(self.pool) + np.cumsum(size) - size
        self.size[numbers] = size
        self.pool = np.concatenate([self.pool, ids])

    def _learn(self) -> None:
        """Encode the pieces that came up."""
        whole, marked = [], []
        for piece in self.rest.new:
            match = None if piece.isalpha() else _MARKED.fullmatch(piece)
            if match:
                marked.append((piece, *match.groups()))
            else:
                whole.append(piece)
        self.rest.new = []
        parts = np.array([(self.rest[piece], self.rest[word], self.first[marks]) for piece, word, marks in marked],
                         np.int64).reshape(-1, 3)
        whole += self.rest.new          # words that came up with marks alone
        heads, self.first.new, self.rest.new = self.first.new, [], []
        many = 1 + len(self.first) + len(self.rest) - len(self.size)
        self.at, self.size, self.last = (np.concatenate([x, np.zeros(many, np.int64)]) for x in (self.at, self.size, self.last))
        plain = [x for x in whole if x.isalpha() or _PLAIN.fullmatch(x)]
        self._add(np.array([self.rest[x] for x in plain], np.int64), *self._encode_spaced(plain))
        other = set(whole).difference(plain)
        alone = self._encode(heads + [" " + x for x in other])
        self._add(np.array([self.first[x] for x in heads] + [self.rest[x] for x in other], np.int64),
                  np.concatenate([*alone, self.end[:0]]), np.array([len(x) for x in alone], np.int64))
        self._add(parts[:, 0], self._gather(parts[:, 1:].ravel()), self.size[parts[:, 1:]].sum(axis=1))

    def _forget(self) -> None:
        """Leave the latest pieces, at most half of CACHE, if there are more than CACHE."""
        if len(self.size) <= CACHE:
            return
        keep = self.last > np.sort(self.last)[-(CACHE // 2) - 1]
        keep[0] = True
        kept, number = np.flatnonzero(keep), (np.cumsum(keep) - 1).tolist()
        first, rest = ({x: number[i] for x, i in known.items() if keep[i]} for known in (self.first, self.rest))
        self._set(first, rest, self._gather(kept), self.size[kept], self.last[kept])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, and how many each has)."""
        if not self.cuts:
            found = self._encode(texts)
            return (np.concatenate([x for text in found for x in (text, self.end)] or [self.end[:0]]),
                    np.array([len(x) + 1 for x in found], np.int64))
        self._forget()
        numbers, count = [], []
        for text in texts:
            cut = text.split(" ") if not _LOOSE.search(text) else _CUT.split(text)
            numbers.append(self.first[cut[0]])
            numbers.extend(map(self.rest.__getitem__, islice(cut, 1, None)))
            numbers.append(0)
            count.append(len(cut) + 1)
        if self.first.new or self.rest.new:
            self._learn()
        numbers = np.array(numbers, np.int64)
        self.turn += 1
        self.last[numbers] = self.turn
        size = np.concatenate([[0], np.cumsum(self.size[numbers])])
        ends = np.cumsum(count, dtype=np.int64)
        return self._gather(numbers), size[ends] - size[ends - np.array(count, np.int64)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the end id, as bytes."""
        ids, size = self.ids(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] if texts else []


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the shards of ``docs`` (doc_id, text); ``tokenizer`` is the JSON
    of a tokenizers file."""
    kind, cuts = id_type(tokenizer, end_id), splits_at_spaces(tokenizer)
    # only a range's own rows meet in a task; equal ids with different texts spread
    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
              .withColumn("tie", F.xxhash64("text"))
              .repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie")
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, turn = None, 0, 0
        with without_cycles():
            for batch in batches:
                encode = encode or Encoder(tokenizer, end_id, kind, cuts)
                for piece in pieces(batch, "text"):
                    if not piece.num_rows:
                        continue
                    ids, size = encode.ids(piece.column("text").to_pylist())
                    start = at + np.cumsum(size) - size
                    at += int(size.sum())
                    doc = piece.column("doc_id")
                    names = np.zeros((piece.num_rows, 2), dtype="<i8")
                    names[:, 0] = doc.fill_null(0).to_numpy(zero_copy_only=False)
                    names[:, 1] = doc.is_null().to_numpy(zero_copy_only=False)
                    arrays = [ids.tobytes(), start.astype("<u8").tobytes(), names.tobytes()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([IDS, OFFSETS, DOCS], pa.int32()), pa.array([turn] * 3, pa.int64()),
                         pa.array([x[:-1] for x in arrays], pa.binary())], ["kind", "turn", "value"])
                    turn += 1

    (placed.select("doc_id", "text").mapInArrow(run, "kind int, turn long, value binary")
     .sortWithinPartitions("kind", "turn").select("kind", F.col("value").cast("string").alias("value"))
     .write.partitionBy("kind").option("lineSep", "\0").text(folder))


def shards(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(shard, ids, offsets, docs, base): file paths of every shard and the
    ids before it, a prefix sum over the files' sizes (one row per shard)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select(F.regexp_extract("path", SHARD, 1).cast("long").alias("shard"),
                     F.regexp_extract("path", r"/kind=(\d)/", 1).cast("int").alias("kind"), "path", "length"))
    one = [F.max(F.when(F.col("kind") == k, F.col("path"))).alias(name)
           for k, name in ((IDS, "ids"), (OFFSETS, "offsets"), (DOCS, "docs"))]
    size = F.max(F.when(F.col("kind") == IDS, F.col("length")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (files.groupBy("shard").agg(*one, (size / np.dtype(kind).itemsize).cast("long").alias("size"))
            .withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))))


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"


def _documents(ids: np.ndarray, offsets: np.ndarray, docs: np.ndarray, base: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Entries of one shard's arrays, a few thousand documents at a time."""
    ends = np.append(offsets[1:], len(ids)).astype(np.int64)
    for at in range(0, len(offsets), 4096):
        start, end = offsets[at:at + 4096].astype(np.int64), ends[at:at + 4096]
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(start, end)]
        name = docs.reshape(-1, 2)[at:at + 4096]
        values = [ids[a:b].astype(np.int64) for a, b in zip(start, end)] if whole else None
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[:, 0], pa.int64(), mask=name[:, 1] != 0), pa.array(start + base), pa.array(end - start),
             pa.array(crc, pa.int64()), pa.array(values, pa.list_(pa.int64())) if whole else pa.nulls(len(start), pa.list_(pa.int64()))],
            ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def mounted(folder: str) -> bool:
    return urlparse(folder).scheme in ("", "file")


def read(spark: SparkSession, folder: str, kind: str, whole: bool = False, mapped: bool | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the
    files; ``ids`` only if ``whole``.  ``mapped`` overrides whether the files
    are memory-mapped or read through Spark."""
    every = shards(spark, folder, kind)
    types = (kind, "<u8", "<i8")
    if mounted(folder) if mapped is None else mapped:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    arrays = [np.memmap(urlparse(row[c]).path, dtype=t, mode="r")
                              for c, t in zip(("ids", "offsets", "docs"), types)]
                    yield from _documents(*arrays, row["base"], whole)

        spread = every.repartition(F.col("shard")).select("ids", "offsets", "docs", "base")
        return spread.mapInArrow(run, _READ)

    def parse(table: pa.Table) -> pa.Table:
        row = {r["kind"]: r for r in table.to_pylist()}
        arrays = [np.frombuffer(row[k]["content"], t) for k, t in zip((IDS, OFFSETS, DOCS), types)]
        return pa.Table.from_batches(list(_documents(*arrays, row[IDS]["base"], whole)))

    path = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("path")) for k, c in ((IDS, "ids"), (OFFSETS, "offsets"), (DOCS, "docs"))]
    wanted = every.select("shard", "base", F.explode(F.array(*path)).alias("f")).select("shard", "base", "f.kind", "f.path")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return content.join(wanted, "path").drop("path").groupBy("shard").applyInArrow(parse, _READ)
