"""Operator 13: fill-in-the-middle examples, cut at line ends.

A text's units are its lines (the last one may lack its line feed).  Two draws
choose after how many units the prefix and the middle end; the rest is the
suffix.  To find the cuts, the text's bytes are seen as fixed blocks, and a
Fenwick tree over the blocks stores two counts, units ended and code points
begun.  A cut after k units descends the tree by powers of two to the block
that holds the k-th unit's end and takes the code points of the blocks before
it on the way; the end itself is then looked up inside that block alone.

Draws depend on the doc_id and ``seed`` only, so reruns agree and a lost task
is repeated with the same result.  One document's text is worked on at a time.

Results in corner cases: a null text is read as empty; an empty text, and one
that holds a sentinel, stays plain (``output`` is the text); a null doc_id
draws as the empty string; rows with one doc_id get the same draws; input
columns named like a result are replaced by it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaklens.llm.words import pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
CUT_PERCENT = 100       # of the texts that are cut at all
SPM_PERCENT = 50        # of the cut texts that are written suffix first
BLOCK = 4096            # bytes
LINE_FEED = 0x0A

_ADDED = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


class LineTree:
    """Fenwick tree over the blocks of one text: units ended, code points begun."""

    def __init__(self, data: bytes, block: int = BLOCK):
        self.raw, self.block = np.frombuffer(data, np.uint8), block
        starts = np.arange(0, len(data), block)
        self.blocks = len(starts)
        self.top = 1 << (self.blocks.bit_length() - 1) if self.blocks else 0
        ends, points = self.raw == LINE_FEED, (self.raw & 0xC0) != 0x80
        counts = np.zeros((self.blocks + 1, 2), dtype=np.int64)
        if self.blocks:
            counts[1:, 0] = np.add.reduceat(ends, starts, dtype=np.int64)
            counts[1:, 1] = np.add.reduceat(points, starts, dtype=np.int64)
            if data[-1] != LINE_FEED:
                counts[-1, 0] += 1          # the last unit ends with the text
        self.units, self.points = counts.sum(axis=0).tolist()
        # node i holds blocks i - lowbit(i) + 1 to i: a difference of running sums
        total, at = np.cumsum(counts, axis=0), np.arange(self.blocks + 1)
        self.node = total - total[at - (at & -at)]

    def after(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        if k >= self.units:
            return len(self.raw), self.points
        at, units, points, step = 0, 0, 0, self.top
        while step:
            to = at + step
            if to <= self.blocks and units + self.node[to, 0] < k:
                at, units, points = to, units + int(self.node[to, 0]), points + int(self.node[to, 1])
            step >>= 1
        inside = self.raw[at * self.block:(at + 1) * self.block]
        end = int(np.flatnonzero(inside == LINE_FEED)[k - units - 1]) + 1
        return at * self.block + end, points + int(((inside[:end] & 0xC0) != 0x80).sum())


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: str | None, doc_id: int | None, seed: int = SEED, cut_percent: int = CUT_PERCENT,
               spm_percent: int = SPM_PERCENT, block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = (text or "").encode()
    tree = LineTree(data, block)
    h = draws(doc_id, seed)
    if not data or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= cut_percent:
        return tree.units, "plain", None, None, text or ""
    low, high = sorted(x % (tree.units + 1) for x in h[:2])
    (a, chars_a), (b, chars_b) = tree.after(low), tree.after(high)
    prefix, middle, suffix = data[:a].decode(), data[a:b].decode(), data[b:].decode()
    if h[3] % 100 < spm_percent:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return tree.units, form, chars_a, chars_b - chars_a, output


def fill_in_middle(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output."""
    added = {f.name for f in _ADDED}
    kept = [f for f in docs.schema.fields if f.name not in added]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = [rearranged(text.as_py(), i, seed, cut_percent, spm_percent)
                        for text, i in zip(piece.column("text"), piece.column("doc_id").to_pylist())]
                columns = list(zip(*rows)) or [()] * len(_ADDED)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in names] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names + [f.name for f in _ADDED])

    return docs.select(*names).mapInArrow(run, T.StructType([*kept, *_ADDED]))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  Each sentinel stands once: the
    text holds none, and none can arise where a part meets a sentinel."""
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)

    def part(of: Column, mark: str, i: int) -> Column:
        return F.split_part(of, F.lit(mark), F.lit(i))

    tail = part(rest, SUFFIX, 2)
    psm = F.concat(part(rest, SUFFIX, 1), part(tail, MIDDLE, 2), part(tail, MIDDLE, 1))
    last = part(rest, PREFIX, 2)
    spm = F.concat(part(last, MIDDLE, 1), part(last, MIDDLE, 2), part(rest, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


ORACLE = """WITH d AS (
 SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (
 SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
  CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (
 SELECT doc_id, text, lines, len(lines) AS n,
  least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
   THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
 SELECT doc_id, text, n, form, coalesce(array_to_string(lines[1:a], ''), '') AS prefix,
  coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
 CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
 CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p"""
