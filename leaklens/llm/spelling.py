"""Operator 12: spelling variants of the words of a corpus.

Words are counted over all texts.  Two words are near if one inserted, deleted
or replaced code point turns one into the other.  The counts of a word's
letters in ``LEVELS`` groups of letters (the most frequent letters alone, the
rest together) then differ by at most one surplus and one deficit: that is how
a word is looked up.  Words are arranged in a trie by their length and the
count of one letter group after another; a depth-first search carries the
words it looks up and their budget of one surplus and one deficit, leaves a
branch as soon as no word can pay for it, and the words at the leaves it
reaches are compared letter by letter.

The trie is distributed by its first levels: a cell is a length with the
counts of ``depth`` groups.  Each word is stored in its own cell and looked up
in every cell that its budget reaches ((depth + 1)^2 + 1 of them); cells are
searched in parallel.  The depth grows until no cell holds more than ``CELL``
letters; a cell that is larger at the deepest level is split, and looked up in
every part.  No word, cell or link is left out.

Each word's form is its near word of largest count, if that is at least
``RATIO`` times its own; forms are followed to their root by pointer doubling.

Results in corner cases: a null or empty text has no words; a null doc_id
counts as the empty string; rows with one doc_id all count; of near words with
equal counts the smaller one in code-point order is the form; without words
the result is empty; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaklens.llm.graph import written

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
MARRED = 199            # one in so many (document, run) pairs loses a letter
LEVELS = 16             # letter groups
CELL = 150_000          # letters that one cell of the trie may hold
DEEPEST = 6             # levels that cells may be made of
LEAF = 8                # words that are compared without further branching
BLOCK = 1 << 16         # pairs verified at once

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of every word of ``docs`` (doc_id, text) that is long and frequent enough."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(name.alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", *_LOWER).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % MARRED == 0, short).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).filter(F.length("word") >= least_letters)
            .groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count))


def letter_groups(vocabulary: DataFrame, levels: int = LEVELS) -> list[str]:
    """Groups of letters: the most frequent alone, the rest dealt over the last
    four, so that counts differ often.  One row per letter of the alphabet
    comes to the driver."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    found = letters.groupBy("letter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "letter").collect()
    ranked, alone = [r["letter"] for r in found], max(0, levels - 4)
    return ranked[:alone] + [g for g in ("".join(ranked[alone + i::4]) for i in range(4)) if g]


def _count(group: str) -> Column:
    return F.length("word") - F.length(F.translate("word", group, ""))


def _steps(depth: int) -> list[tuple[int, ...]]:
    """Changes of (length, counts) that lead from a word to the cells that may
    hold a longer or equally long near word."""
    unit = [tuple(int(i == j) for j in range(depth)) for i in range(depth)]
    none = (0,) * depth
    same = {tuple(a - b for a, b in zip(up, down)) for up in [*unit, none] for down in [*unit, none]}
    return sorted({(0, *s) for s in same} | {(1, *up) for up in [*unit, none]})


def _cell(groups: list[str], step: tuple[int, ...]) -> Column:
    parts = [F.length("word"), *[_count(g) for g in groups]]
    return F.concat_ws(",", *[(p + s).cast("string") for p, s in zip(parts, step)])


def _cells(vocabulary: DataFrame, groups: list[str], cell: int, deepest: int) -> tuple[int, DataFrame]:
    """(depth, cells with the number of parts each is split into)."""
    for depth in range(min(deepest, len(groups)) + 1):
        sizes = vocabulary.groupBy(_cell(groups[:depth], (0,) * (depth + 1)).alias("cell")).agg(
            F.sum(F.length("word")).alias("letters"), F.count("*").alias("words"))
        most = sizes.agg(F.max(F.when(F.col("words") > 1, F.col("letters")))).first()[0] or 0
        if most <= cell:
            break
    return depth, sizes.select("cell", F.least("words", F.ceil(F.col("letters") / cell)).cast("int").alias("parts"))


def _matrix(found: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(found).encode("utf-32-le"), "<u4").reshape(len(found), length)


def _vectors(codes: np.ndarray, groups: list[str]) -> np.ndarray:
    return np.column_stack([np.isin(codes, np.array([ord(x) for x in g], "<u4")).sum(axis=1) for g in groups]).astype(np.int32)


def _search(stored: np.ndarray, wanted: np.ndarray, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``wanted``, row of ``stored``) whose vectors differ by at
    most one surplus and ``deficit`` deficits, by depth-first search."""
    order = np.lexsort(stored.T[::-1])
    trie, levels = stored[order], stored.shape[1]
    stack = [(0, len(trie), 0, np.arange(len(wanted)), np.ones(len(wanted), np.int32), np.full(len(wanted), deficit, np.int32))]
    while stack:
        low, high, level, alive, up, down = stack.pop()
        if level == levels or high - low <= LEAF:
            rest = trie[low:high, level:]
            for row, vector in zip(range(low, high), rest):
                if level < levels:
                    change = vector - wanted[alive, level:]
                    fits = (np.maximum(change, 0).sum(axis=1) <= up) & (np.maximum(-change, 0).sum(axis=1) <= down)
                    yield alive[fits], np.full(int(fits.sum()), order[row])
                else:
                    yield alive, np.full(len(alive), order[row])
            continue
        column = trie[low:high, level]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [high - low]])
        have = wanted[alive, level]
        for a, b in zip(cuts[:-1], cuts[1:]):
            change = column[a] - have
            left_up, left_down = up - np.maximum(change, 0), down - np.maximum(-change, 0)
            pays = (left_up >= 0) & (left_down >= 0)
            if pays.any():
                stack.append((low + a, low + b, level + 1, alive[pays], left_up[pays], left_down[pays]))


def _one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``b`` is the row of ``a`` with one code point
    replaced (equal widths) or inserted (``b`` one wider)."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


def _links(stored: pd.DataFrame, wanted: pd.DataFrame, length: int, groups: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Links of one cell as arrays (word, n, near, near_n), the word no longer
    than its near word, and each pair of equal length once."""
    names, counts = stored["word"].to_numpy(object), stored["n"].to_numpy(np.int64)
    codes = _matrix(stored["word"].tolist(), length)
    vectors = _vectors(codes, groups)
    for size, deficit in ((length, 1), (length - 1, 0)):
        mine = wanted[wanted["size"] == size].reset_index(drop=True)
        if not len(mine):
            continue
        own = _matrix(mine["word"].tolist(), size)
        own_names, own_counts = mine["word"].to_numpy(object), mine["n"].to_numpy(np.int64)
        block = max(1, BLOCK * 16 // max(16, length))
        held, many = [], 0

        def verified() -> tuple[np.ndarray, ...]:
            q, s = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            keep = np.zeros(len(q), dtype=bool)
            for at in range(0, len(q), block):
                keep[at:at + block] = _one_apart(own[q[at:at + block]], codes[s[at:at + block]])
            q, s = q[keep], s[keep]
            return own_names[q], own_counts[q], names[s], counts[s]

        for q, s in _search(vectors, _vectors(own, groups), deficit):
            if deficit:         # of two words of one length the smaller one is looked up
                first = own_names[q] < names[s]
                q, s = q[first], s[first]
            if len(q):
                held.append((q, s))
                many += len(q)
            if many > block:
                yield verified()
                held, many = [], 0
        if held:
            yield verified()


def links(vocabulary: DataFrame, levels: int = LEVELS, cell: int = CELL, deepest: int = DEEPEST) -> DataFrame:
    """(word, n, near, near_n), both ways, of all near words of ``vocabulary`` (word, n)."""
    groups = letter_groups(vocabulary, levels)
    if not groups:
        return vocabulary.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    depth, cells = _cells(vocabulary, groups, cell, deepest)
    cells = written(cells, "spelling-cells")
    own = groups[:depth]
    stored = vocabulary.select("word", "n", _cell(own, (0,) * (depth + 1)).alias("cell")).join(cells, "cell")
    stored = stored.select("word", "n", "cell", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("part"), F.lit(True).alias("stored"))
    reached = F.explode(F.array(*[_cell(own, step) for step in _steps(depth)]))
    wanted = vocabulary.select("word", "n", reached.alias("cell")).join(cells, "cell")
    wanted = wanted.select("word", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("stored"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["size"] = pdf["word"].str.len()
        found = []      # of arrays: frames of strings may not be joined into one Arrow array
        for name, rows in pdf.groupby(["cell", "part"], sort=False):
            mine, others = rows[rows["stored"]], rows[~rows["stored"]]
            if len(mine) and len(others):
                found += _links(mine, others, int(name[0].split(",")[0]), groups)
        columns = zip(*found) if found else [[np.zeros(0, object)]] * 4
        return pd.DataFrame({c: np.concatenate(list(x)) for c, x in zip(("word", "n", "near", "near_n"), columns)})

    # several small cells share a call; their number follows the vocabulary
    parts = cells.agg(F.sum("parts")).first()[0] or 1
    batch = F.pmod(F.xxhash64("cell", "part"), F.lit(max(1, parts // 8)))
    once = (stored.union(wanted).withColumn("batch", batch).groupBy("batch")
            .applyInPandas(run, "word string, n long, near string, near_n long"))
    once = written(once, "spelling-links")
    return once.union(once.select("near", "near_n", "word", "n"))


def _roots(forms: DataFrame, most: int, ratio: int, least: int) -> DataFrame:
    """(word, root) from (word, form): every step doubles the way already gone;
    counts grow by ``ratio`` along a chain, which bounds its length."""
    longest = max(1, int(math.log(max(most, least) / least, ratio)) + 1)
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return roots


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
             levels: int = LEVELS, cell: int = CELL, deepest: int = DEEPEST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    vocabulary = written(words(docs, least_letters, least_count), "spelling-words")
    found = links(vocabulary, levels, cell, deepest)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = found.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocabulary.join(near, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                               F.when(strong, F.col("best.near")).alias("form"),
                               F.when(strong, -F.col("best.less")).alias("form_n")), "spelling-forms")
    most = rows.agg(F.max("n")).first()[0] or 0
    roots = _roots(rows.filter("form is not null").select("word", "form"), most, ratio, least_count)
    return (rows.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
