"""Operator 5: toxicity by a subsequence string kernel and a linear SVM.

Strings are the words of a text: lower-cased, with punctuation inside a word
removed ("i.d.i.o.t") and runs of single characters joined ("i d i o t").  The
kernel counts common subsequences of three characters, gaps decayed by
``DECAY``, normalised to 1 for equal strings, so an inserted or missing
character only lowers it.  Landmarks are the words of the training sample most
associated with the label; the Nyström map K(Z,Z)^-1/2 K(Z,w) turns the kernel
into features.  A word takes part in a landmark's kernel only if it holds at
least 70 % of the landmark's character pairs with at most one character
between them (otherwise the kernel counts as zero).

Training sentences carry the label of their document, and a toxic document
needs one toxic word only: the SVM (squared hinge) learns from the words that
stand out in toxic documents, these words with one character inserted, each
toxic document's strongest word (chosen anew in each round), and all words of
the other documents.  A text scores by its strongest word through a logistic
curve fitted on training documents set aside, some with a marred word.

The model is fitted on a bounded sample of labelled rows (``train_rows`` per
class, by hash of the doc_id); fitting and scoring read whole texts.

Results in corner cases: a text without words scores as the weakest training
word does; labels that are null are ignored, a document with several labels is
toxic if one says so; without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaklens.llm.words import without_cycles

DECAY = 0.8
LANDMARKS = 192
TRAIN_ROWS = 1500
PIECE = 20_000          # words whose kernel is computed at once
BLOCK = 512             # pairs of words whose subsequences are counted at once
MARRED = 6              # about so many documents with a marred word fit the logistic curve
FAINT = 0.02            # smaller kernels count as zero in training
LONGEST = 24            # longer words are read in overlapping windows
COST, NEGATIVE = 1000.0, 6.0    # of each kind of toxic words; of each other word
POWER = 3               # of the normalised kernel: sharper, and still a kernel
PAIR_BITS = 256
SHARED_PAIRS = 0.7
SURE_HITS, SURE_ODDS = 4, 30.0

_SINGLES = re.compile(r"(?<!\S)\S(?:\s\S(?!\S)){2,}")
_INNER = re.compile(r"[\W_]+")


def raw_words(text: str | None) -> set[str]:
    """The distinct words of a text, still with their punctuation."""
    if not text:
        return set()
    text = text.lower()
    found = set(text.split())
    for run in _SINGLES.findall(text):
        found.add(re.sub(r"\s", "", run))
    return found


def _windows(word: str) -> list[str]:
    word = _INNER.sub("", word)
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points as a matrix, padded with distinct negatives per side."""
    out = np.frombuffer("".join(w.ljust(width, "\0")[:width] for w in words).encode("utf-32-le"), "<i4")
    return out.reshape(len(words), width)


def _pairs(codes: np.ndarray, gap: int) -> np.ndarray:
    """Bit sets (n, PAIR_BITS/64) of the ordered character pairs with at most
    ``gap`` characters between them."""
    out = np.zeros((len(codes), PAIR_BITS // 64), dtype=np.uint64)
    rows = np.arange(len(codes))
    for step in range(1, gap + 2):
        for i in range(codes.shape[1] - step):
            a, b = codes[:, i].astype(np.uint64), codes[:, i + step].astype(np.uint64)
            bit = ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA77)) >> np.uint64(9)) % np.uint64(PAIR_BITS)
            real = (a > 0) & (b > 0)
            word = (bit // np.uint64(64)).astype(np.int64)
            out[rows[real], word[real]] |= np.uint64(1) << (bit[real] % np.uint64(64))
    return out


def _decays(n: int) -> np.ndarray:
    d = np.arange(n)[:, None] - np.arange(n)[None, :]
    return np.where(d >= 0, DECAY ** np.maximum(d, 0), 0).astype(np.float32)


def _subsequences(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unnormalised kernel (subsequences of length 3) of the rows of two code
    matrices."""
    out = np.empty(len(s), dtype=np.float64)
    a, b = _decays(s.shape[1]), _decays(t.shape[1]).T
    for at in range(0, len(s), BLOCK):
        x, y = s[at:at + BLOCK], t[at:at + BLOCK]
        same = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] > 0)).astype(np.float32)
        grown = same
        for _ in range(2):
            total = np.matmul(np.matmul(a, grown), b) * DECAY**2
            grown = np.zeros_like(same)
            grown[:, 1:, 1:] = same[:, 1:, 1:] * total[:, :-1, :-1]
        out[at:at + BLOCK] = grown.sum(axis=(1, 2)) * DECAY**2
    return out


@dataclass
class Model:
    """A fitted scorer: g(word) = bias + sum of weights[j] * kernel(word, landmarks[j])."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self.codes = _codes(self.landmarks, LONGEST)
        self.need = _pairs(self.codes, 0)
        self.least = np.maximum(2, np.round(np.bitwise_count(self.need).sum(axis=1) * SHARED_PAIRS))
        self.norm = _subsequences(self.codes, self.codes)

    def kernel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, normalised kernel) of the pairs that take part."""
        if len(words) > PIECE:
            parts = [self.kernel(words[a:a + PIECE]) for a in range(0, len(words), PIECE)]
            w = np.concatenate([p[0] + i * PIECE for i, p in enumerate(parts)])
            return w, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        codes = _codes(words, LONGEST)
        have = np.ascontiguousarray(_pairs(codes, 1).T)
        w, z = [], []
        for j in range(len(self.landmarks)):
            n = np.zeros(len(words), dtype=np.uint8)
            for lane in np.flatnonzero(self.need[j]):
                n += np.bitwise_count(have[lane] & self.need[j, lane])
            hit = np.flatnonzero(n >= self.least[j])
            w.append(hit)
            z.append(np.full(len(hit), j))
        w, z = np.concatenate(w), np.concatenate(z)
        value = np.zeros(len(w))
        length = np.array([len(x) for x in words])[w] if len(w) else np.zeros(0)
        wide = max((len(x) for x in self.landmarks), default=1)
        own = np.zeros(len(words))
        for low, high in ((0, 8), (8, 14), (14, LONGEST)):
            pick = np.flatnonzero((length > low) & (length <= high))
            value[pick] = _subsequences(codes[w[pick], :high], self.codes[z[pick], :wide])
            self_pick = np.unique(w[pick])
            own[self_pick] = _subsequences(codes[self_pick, :high], codes[self_pick, :high])
        scale = np.sqrt(own[w] * self.norm[z])
        return w, z, np.divide(value, scale, out=np.zeros_like(value), where=scale > 0) ** POWER

    def margins(self, words: list[str]) -> np.ndarray:
        w, z, k = self.kernel(words)
        return self.bias + np.bincount(w, k * self.weights[z], minlength=len(words))

    def strongest(self, texts, cache: dict[str, float]) -> np.ndarray:
        """The largest margin over the words of each text."""
        bags = [raw_words(t) for t in texts]
        fresh = sorted({w for bag in bags for w in bag if w not in cache})
        if fresh:
            split = [[w] if w.isalnum() and len(w) <= LONGEST else _windows(w) for w in fresh]
            flat = sorted({x for parts in split for x in parts})
            value = dict(zip(flat, self.margins(flat).tolist()))
            cache.update((w, value[parts[0]] if len(parts) == 1 else max(value[x] for x in parts)) for w, parts in zip(fresh, split))
        return np.array([max(map(cache.__getitem__, bag), default=self.bias) for bag in bags])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Squared-hinge SVM by Newton steps; the last column of x is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = np.flatnonzero(y * (x @ w.astype(x.dtype)) < 1)
        gram, right = ridge.copy(), np.zeros(x.shape[1])
        for at in range(0, len(active), 4096):      # slices: no second copy of x
            i = active[at:at + 4096]
            xa = x[i].astype(np.float64)
            gram += xa.T @ (xa * c[i][:, None])
            right += xa.T @ (c[i] * y[i])
        new = np.linalg.solve(gram, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y=1) by Newton steps; targets pulled in from 0
    and 1 by the class counts, so that separable data stays finite."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), a.T @ (target - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(bags: Iterable[list[str]], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Model | None:
    """A model from word lists (one per training document, read once) and labels."""
    toxic = np.asarray(toxic, dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    same: dict[str, str] = {}       # one object per distinct word
    bags = [sorted({same.setdefault(x, x) for w in bag for x in _windows(w) if x}) for bag in bags]
    del same
    # every third document of a class only fits the logistic curve, as its words are new to the SVM
    turn = np.where(toxic == 1, np.cumsum(toxic), np.cumsum(1 - toxic)) % 3
    aside = [(bag, t) for bag, t, i in zip(bags, toxic, turn) if i == 2]
    bags, toxic = [bag for bag, i in zip(bags, turn) if i != 2], toxic[turn != 2]
    hits, rest = Counter(), Counter()
    for bag, t in zip(bags, toxic):
        (hits if t else rest).update(bag)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    p1 = {w: (n + 0.5) / (n1 + 1) for w, n in hits.items()}
    odds = {w: np.log(p1[w] * (n0 + 1) / (rest[w] + 0.5)) for w in hits}
    ranked = sorted((w for w in hits if odds[w] > 0 and len(w) >= 3), key=lambda w: (-hits[w] * odds[w], w))
    chosen = ranked[:landmarks]
    if not chosen:
        return None
    model = Model(chosen, np.zeros(len(chosen)), 0.0, 1.0, 0.0)
    sure = sorted(w for w in hits if hits[w] >= SURE_HITS and odds[w] >= np.log(SURE_ODDS) and len(w) >= 3)
    marred = sorted({x[:i] + "x" + x[i:] for x in sure for i in range(1, len(x))} - set(rest))
    words = sorted(set(hits) | set(rest) | set(marred))
    index = {w: i for i, w in enumerate(words)}
    w, z, k = model.kernel(words)
    near = k >= FAINT
    w, z, k = w[near], z[near], k[near]
    gram = np.zeros((len(chosen), len(chosen)))
    zw, zz, zk = model.kernel(chosen)
    gram[zw, zz] = zk
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    strong = values > 1e-3
    root = vectors[:, strong] / np.sqrt(values[strong])        # Nyström: features = kernel row @ root
    related = np.unique(w)
    row = np.full(len(words), len(related))
    row[related] = np.arange(len(related))
    features = np.ones((len(related) + 1, root.shape[1] + 1), dtype=np.float32)
    dense = np.zeros((len(related) + 1, len(chosen)), dtype=np.float32)
    dense[row[w], z] = k
    features[:, :-1] = dense @ root.astype(np.float32)
    del dense, w, z, k, near
    rows = [np.array([index[x] for x in bag], dtype=np.int64) for bag in bags]
    down = np.unique(np.concatenate([row[r] for r, t in zip(rows, toxic) if not t] or [row[:0]]))
    margin = np.array([odds.get(x, -9.0) + np.log1p(hits[x]) for x in words])
    plain, bent = (row[np.array([index[x] for x in part], dtype=np.int64)] for part in (sure, marred))
    for _ in range(4):
        best = np.array([row[r[np.argmax(margin[r])]] for r, t in zip(rows, toxic) if t and len(r)], dtype=np.int64)
        parts = [best, plain, bent, down]
        x = features[np.concatenate(parts)]
        y = np.concatenate([np.ones(sum(map(len, parts[:3]))), -np.ones(len(down))])
        cost = np.concatenate([np.full(len(part), COST / max(1, len(part))) for part in parts[:3]] + [np.full(len(down), NEGATIVE)])
        weight = _svm(x, y, cost)
        margin = (features @ weight)[row]
    model.weights, model.bias = root @ weight[:-1], float(weight[-1])
    fresh = sorted({x for bag, _ in aside for x in bag})
    value = dict(zip(fresh, model.margins(fresh).tolist())) if fresh else {}
    if len({t for _, t in aside}) == 2:
        peak = np.array([max((value[x] for x in bag), default=model.bias) for bag, _ in aside])
        toxic = np.array([t for _, t in aside])
        # a few toxic documents also with a character inserted into its strongest word
        best = [max(bag, key=value.__getitem__) for bag, t in aside if t and bag]
        best = best[::max(1, len(best) // MARRED)]
        marred = model.margins([w[:len(w) // 2] + "x" + w[len(w) // 2:] for w in best]) if best else np.zeros(0)
        peak, toxic = np.concatenate([peak, marred]), np.concatenate([toxic, np.ones(len(marred), np.int64)])
    else:       # too few documents to set some aside
        peak = np.array([margin[r].max() if len(r) else model.bias for r in rows])
    model.slope, model.offset = _logistic(peak, toxic)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic, words): up to about ``train_rows`` labelled documents of
    each class, chosen by hash, outside the held-out fold, with their distinct
    words.  Of rows with one doc_id the smallest text counts."""
    marks = (labels.filter("doc_id is not null and toxic is not null")
             .select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("toxic").alias("toxic")))
    count = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for kind in (0, 1):
        share = F.when(F.col("toxic") == kind, min(1.0, train_rows / max(1, count.get(kind, 0)))).otherwise(share)
    chosen = marks.filter(draw < share)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": [sorted(raw_words(t)) for t in pdf["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "toxic", "text").mapInPandas(read, f"doc_id {kind}, toxic int, words array<string>")


def held_out(doc_id) -> F.Column:
    """crc32 of the doc_id as text leaves no remainder by 5; a null id is not
    held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    sample = training_sample(docs, labels, train_rows).orderBy("doc_id")
    sample = sample.select("toxic", F.array_join("words", " ").alias("words")).toPandas()     # one text a document: less memory here
    return fit((text.split(" ") for text in sample["words"]), sample["toxic"].to_numpy(), landmarks)


def score(docs: DataFrame, model: Model | None, out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``: the probability that the text is toxic."""
    names = docs.columns
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    # at most LANDMARKS short words; plain values, as a broadcast names the classes it holds
    shipped = docs.sparkSession.sparkContext.broadcast((model.landmarks, model.weights, model.bias, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cache = Model(*shipped.value), {}
        with without_cycles():
            for batch in batches:
                texts, scores, size = batch.column("text").to_pylist(), [], 0
                at = 0
                for to, text in enumerate(texts, 1):
                    size += len(text or "")
                    if size > 2_000_000 or to == len(texts):
                        if len(cache) > 400_000:
                            cache.clear()
                        scores.append(fitted.probability(fitted.strongest(texts[at:to], cache)))
                        at, size = to, 0
                value = np.concatenate(scores) if scores else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(value, pa.float64())], names + [out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    column = "__toxicity"
    while column in docs.columns:
        column += "_"
    return score(docs, train(docs, labels), column).filter(F.col(column) < threshold).drop(column)
