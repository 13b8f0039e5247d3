"""Toxicity: a subsequence string kernel, Nyström landmarks, and a linear SVM.

The kernel of two words counts common subsequences of three letters, each with
weight LAMBDA to the power of the stretches it spans in both words, and is
normalised; so "idxiot" stays close to "idiot". Landmarks are the words that tell
toxic from other labelled texts best (chi-square), and the most frequent words as
contrast. A text's feature for a landmark is the largest kernel value among its
words; features are mapped by the inverse root of the landmarks' kernel matrix
(Nyström), and a squared-hinge SVM is trained on them, with a logistic curve from
margin to score.

What a word is: letters only, lower-cased, signs and digits inside it removed
("i.d.i-o_t"), and single letters that stand apart in a row ("i d i o t") read as
one word too. Longer words are read in overlapping stretches of 24 letters. A word
and a landmark are compared if at most one of the landmark's distinct letters is
missing in the word; below FLOOR the kernel counts as zero.

Training takes at most ``SAMPLE`` labelled texts of each class (those with the
smallest hash of their id), never of the held-out third. Each is seen twice: as it
is, and with a letter inserted into every word, which keeps its label. Word counts
and features of the sample are computed by Spark; the driver gets at most
2 x 2 x SAMPLE rows of LANDMARKS numbers. Scores use the text alone.

Defined cases: null and empty texts get the score of a text without any landmark;
labels that are null are ignored, a document with contradicting labels counts as
toxic; without labels of both classes every score is 0; repeated rows get equal
scores; every word of a long text is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch

SAMPLE = 2000
LANDMARKS = 96
CONTRAST = 16
ORDER = 3
LAMBDA = 0.5
FLOOR = 0.35
LONGEST = 24
THRESHOLD = 0.7
SEEN = 1_000_000

SIGNS = re.compile(r"[^\w\s]+|[\d_]+")
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\s+){2,}[^\W\d_](?!\S)")


def words(text: str | None) -> set[str]:
    """The distinct words of a text, as letters."""
    low = SIGNS.sub("", (text or "").lower())
    out = set(low.split())
    for m in SPELLED.finditer(low):
        out.add("".join(m[0].split()))
    long = [w for w in out if len(w) > LONGEST]
    for w in long:
        out.discard(w)
        out.update(w[i : i + LONGEST] for i in range(0, len(w), LONGEST // 2))
    return out


def codes(ws: list[str], width: int = LONGEST) -> np.ndarray:
    return np.array(ws, f"<U{width}").view(np.uint32).reshape(len(ws), width)


def letters(c: np.ndarray) -> np.ndarray:
    """Bit masks of the letters of words: one bit for each of a-z, six for all others."""
    bit = np.where((c >= 97) & (c < 123), c - 97, 26 + c % 6).astype(np.uint64)
    return np.bitwise_or.reduce(np.where(c > 0, np.uint64(1) << bit, np.uint64(0)), axis=1)


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The unnormalised kernel of word pairs given as rows of codes (0: no letter)."""
    m = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)).astype(np.float32)
    span = lambda n: np.tril(LAMBDA ** np.clip(np.subtract.outer(np.arange(n), np.arange(n)) - 1.0, 0, None), -1).astype(np.float32)
    la, lb = span(a.shape[1]), span(b.shape[1]).T
    k = m * np.float32(LAMBDA**2)
    for _ in range(ORDER - 1):
        k = m * np.float32(LAMBDA**2) * (la @ k @ lb)
    return k.sum(axis=(1, 2))


def _by_length(lens: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    for lo, hi in ((0, 8), (8, 12), (12, 16), (16, LONGEST)):
        i = np.flatnonzero((lens > lo) & (lens <= hi))
        for at in range(0, len(i), 20_000):
            yield i[at : at + 20_000], hi


def self_kernel(c: np.ndarray) -> np.ndarray:
    out = np.zeros(len(c), np.float32)
    for i, w in _by_length((c > 0).sum(axis=1)):
        out[i] = raw_kernel(c[i, :w], c[i, :w])
    return out


@dataclass
class Landmarks:
    """Landmark words and what comparing with them needs; remembers the words it has seen."""

    names: list[str]
    code: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)
    mask: np.ndarray = field(init=False)
    dull: set[str] = field(default_factory=set)
    near: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __post_init__(self):
        self.code = codes(self.names)
        self.own = self_kernel(self.code)
        self.mask = letters(self.code)

    def __getstate__(self):
        return self.__dict__ | {"dull": set(), "near": {}}

    def kernel(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, value) of the pairs with a kernel value of FLOOR or more."""
        c = codes(ws)
        mask = letters(c)
        i, j = np.nonzero(np.bitwise_count(self.mask[None, :] & ~mask[:, None]) <= 1)
        used, back = np.unique(i, return_inverse=True)
        own = self_kernel(c[used])[back]
        value = np.zeros(len(i), np.float32)
        width = int((self.code > 0).sum(axis=1).max(initial=1))
        for k, w in _by_length((c[i] > 0).sum(axis=1)):
            value[k] = raw_kernel(c[i[k], :w], self.code[j[k], :width])
        scale = np.sqrt(own * self.own[j])
        value = np.where(scale > 0, value / np.where(scale > 0, scale, 1), 0)
        keep = value >= FLOOR
        return i[keep], j[keep], value[keep]

    def learn(self, ws: set[str]) -> None:
        fresh = [w for w in ws - self.dull if w not in self.near]
        if not fresh:
            return
        if len(self.dull) > SEEN:
            self.dull.clear()
        if len(self.near) > SEEN // 4:
            self.near.clear()
        for at in range(0, len(fresh), 4096):
            part = fresh[at : at + 4096]
            i, j, v = self.kernel(part)
            cut = np.searchsorted(i, np.arange(len(part) + 1))
            for n, w in enumerate(part):
                if cut[n] < cut[n + 1]:
                    self.near[w] = (j[cut[n] : cut[n + 1]], v[cut[n] : cut[n + 1]])
                else:
                    self.dull.add(w)

    def features(self, each: list[set[str]]) -> np.ndarray:
        """Texts (their words) x landmarks: the largest kernel values."""
        self.learn(set().union(*each))
        out = np.zeros((len(each), len(self.names)), np.float32)
        for row, ws in zip(out, each, strict=True):
            for w in ws - self.dull:
                hit = self.near.get(w)
                if hit is None:  # forgotten meanwhile
                    _, j, v = self.kernel([w])
                    hit = (j, v)
                row[hit[0]] = np.maximum(row[hit[0]], hit[1])
        return out


def inserted(w: str) -> str:
    """The word with one letter inserted in its middle; which one depends on the word."""
    k = len(w) // 2
    return w[:k] + "xqzjkvwy"[(sum(map(ord, w)) + len(w)) % 8] + w[k:] if 4 <= len(w) < LONGEST else w


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights, the bias last, of a class-balanced squared-hinge SVM, by Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    c = cost * np.where(y > 0, 1 / max((y > 0).sum(), 1), 1 / max((y < 0).sum(), 1))
    ridge = np.eye(x1.shape[1]) * 1e-3
    w = np.zeros(x1.shape[1])
    active = np.ones(len(y), bool)
    for _ in range(50):
        a = x1[active] * c[active, None]
        w = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all() or not now.any():
            break
        active = now
    return w


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margin to score (smoothed targets, classes balanced)."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    c = np.where(y > 0, 1 / pos, 1 / neg)
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(100):
        s = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        g = x @ (c * (s - t)) + 1e-4 * p * [1, 0]
        h = (x * (c * s * (1 - s))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


@dataclass
class Model:
    landmarks: Landmarks
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.landmarks.features([words(t) for t in texts]) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(y, w) for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in words(t) if len(w) >= 3]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["y", "w"])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> Model | None:
    """``docs`` has doc_id and text, ``labels`` doc_id and toxic; None without texts of both classes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = reduce_union([known.where(F.col("y") == y).orderBy(order, "doc_id").limit(sample) for y in (1, 0)])
    chosen = scratch.cut(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text"), "sample")
    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return None
    counts = chosen.mapInArrow(_words_of, "y int, w string").groupBy("w").agg(F.count_if(F.col("y") == 1).alias("t"), F.count_if(F.col("y") == 0).alias("o"))
    all_ = n[0] + n[1]
    seen = F.col("t") + F.col("o")
    expect = seen * (n[1] / all_)
    chi = F.pow(F.col("t") - expect, 2) / (expect * (n[0] / all_) * (1 - seen / (all_ + 1)))
    fit = counts.where(F.char_length("w") <= 12)
    best = [r["w"] for r in fit.where(F.col("t") > expect).orderBy(chi.desc(), "w").limit(LANDMARKS).collect()]
    plain = [r["w"] for r in fit.where(F.char_length("w") >= 4).orderBy(F.col("o").desc(), "w").limit(CONTRAST).collect()]
    marks = Landmarks(list(dict.fromkeys(best + plain)))
    size = len(marks.names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [words(t) for t in b.column(1).to_pylist()]
            x = np.vstack([marks.features(each), marks.features([set(map(inserted, ws)) for ws in each])])
            y = pa.array(b.column(0).to_pylist() * 2, pa.int32())
            yield pa.RecordBatch.from_arrays([y, pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])

    rows = chosen.mapInArrow(of, "y int, x array<float>").collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), size)
    y = np.array([1.0 if r["y"] == 1 else -1.0 for r in rows])
    # Sums of rows must not depend on the order in which tasks end.
    turn = np.lexsort(np.vstack([x.T, y]))
    x, y = x[turn], y[turn]
    i, j = np.divmod(np.arange(size * size), size)
    k = raw_kernel(marks.code[i], marks.code[j]).reshape(size, size) / np.sqrt(np.outer(marks.own, marks.own))
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    w = fit_svm(x @ root, y)
    weights = root @ w[:-1]
    slope, offset = fit_curve(x @ weights + w[-1], y)
    return Model(marks, weights, float(w[-1]), slope, offset)


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scratch = Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    fitted = train(own, labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("toxic")), scratch)
    if fitted is None:
        rows = own.select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(fitted)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

        rows = own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
