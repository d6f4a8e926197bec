"""Operator 7, toxicity by gradient-boosted trees with isotonic calibration.

Dense features of a text: densities of a weighted lexicon, of second-person words
near lexicon words, of capitals, of punctuation and of obfuscated spellings. The
lexicon is not given but learned: words whose share among the distinct toxic
training texts is many times that among the others. Boosted stumps and small
trees on binned features give a raw score, and pool-adjacent-violators maps it to
a probability on training rows the trees did not see.

The fit uses a bounded sample: at most ``sample`` labelled rows, those smallest by
hash of the id. Scoring goes over all rows in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Digits and signs that stand for letters in obfuscated spellings.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = re.compile(r"[^\w\s]|_")
#: Second-person words of the four languages of the corpus.
SECOND = frozenset(["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"])
FEATURES = ("hits", "distinct", "density", "weight", "second_near", "second", "capitals", "marks", "hidden", "repeats", "size")


def plain(word: str) -> str:
    return EDGE.sub("", word.lower())


def unmasked(word: str) -> str:
    """The word with look-alike signs read as letters and inner marks dropped."""
    return MARKS.sub("", EDGE.sub("", word.lower().translate(LEET)))


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    cache: dict[str, tuple[str, bool]] = {}
    hit_at, you_at, weight, hidden, met = [], [], 0.0, 0, set()
    for i, raw in enumerate(words):
        known = cache.get(raw)
        if known is None:
            word = plain(raw)
            masked = False
            if word not in lexicon and not word.isalpha():
                other = unmasked(raw)
                if other in lexicon:
                    word, masked = other, True
            known = cache[raw] = (word, masked)
        word, masked = known
        if word in lexicon:
            hit_at.append(i)
            met.add(word)
            weight += lexicon[word]
            hidden += masked
        elif word in SECOND:
            you_at.append(i)
    near = 0
    if hit_at and you_at:
        you = np.array(you_at)
        for i in hit_at:
            j = np.searchsorted(you, i)
            near += min(abs(int(you[k]) - i) for k in (j - 1, j) if 0 <= k < len(you)) <= 5
    letters = max(1, len(text) - n + 1)
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    marks = len(MARKS.findall(text))
    return [float(len(hit_at)), float(len(met)), len(hit_at) / n, weight / n, near / n, len(you_at) / n, upper / letters, marks / letters, float(hidden), 1 - len(cache) / n, float(np.log1p(n))]


def learned_lexicon(texts: list[str], toxic: np.ndarray, share: float = 0.02, lift: float = 20.0) -> dict[str, float]:
    """Words in at least ``share`` of the distinct toxic texts and ``lift`` times as likely there."""
    seen: set[int] = set()
    counts = (Counter(), Counter())
    total = [0, 0]
    for text, bad in zip(texts, toxic, strict=True):
        words = frozenset(plain(w) for w in WORDS.findall(text)) - {""}
        mark = hash(words)
        if mark in seen:
            continue
        seen.add(mark)
        total[bad] += 1
        counts[bad].update(words)
    out = {}
    for word, n in counts[1].items():
        ratio = (n / max(1, total[1])) / ((counts[0][word] + 0.5) / (total[0] + 1))
        if n >= max(3, share * total[1]) and ratio >= lift and len(word) >= 3:
            out[word] = float(np.log(ratio))
    return out


class Boosted:
    """Logistic boosting of small regression trees over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 15):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(mean / (1 - mean))), []
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self.rate * self._walk(tree, binned)
        return self

    def _grow(self, b, g, h, rows, depth):
        value = float(g[rows].sum() / (h[rows].sum() + 1.0))
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        base, best = g[rows].sum() ** 2 / (h[rows].sum() + 1.0), (1e-6, -1, -1)
        for f in range(b.shape[1]):
            size = len(self.edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(b[rows, f], w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1.0) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1.0) - base
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] < 0:
            return value
        left = b[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _walk(self, tree, b):
        if not isinstance(tree, tuple):
            return np.full(len(b), tree)
        left = b[:, tree[0]] <= tree[1]
        out = np.empty(len(b))
        out[left], out[~left] = self._walk(tree[2], b[left]), self._walk(tree[3], b[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        return self.start + self.rate * sum(self._walk(t, binned) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: ascending knots and non-decreasing values. Rows of one raw score are one point."""
    points, where, counts = np.unique(raw, return_inverse=True, return_counts=True)
    means = np.bincount(where, y, len(points)) / counts
    pools: list[list[float]] = []
    for x, value, n in zip(points.tolist(), means.tolist(), counts.tolist(), strict=True):
        pools.append([value, float(n), x, x])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, _, hi = pools.pop()
            q = pools[-1]
            q[0], q[1], q[3] = (q[0] * q[1] + v * w) / (q[1] + w), q[1] + w, hi
    knots = np.array([k for p in pools for k in (p[2], p[3])])
    return knots, np.array([p[0] for p in pools for _ in range(2)])


class Model:
    """Lexicon, trees and calibration; small enough to travel with the tasks."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        toxic = np.asarray(toxic, np.int64)
        self.lexicon = learned_lexicon(texts, toxic)
        if not len(texts):
            self.trees, self.knots, self.values = None, np.zeros(1), np.zeros(1)
            return
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        aside = np.arange(len(texts)) % 4 == 3
        self.trees = Boosted().fit(x[~aside], toxic[~aside].astype(float))
        self.knots, self.values = isotonic(self.trees.raw(x[aside]), toxic[aside].astype(float)) if aside.any() else (np.zeros(1), np.array([toxic.mean() if len(toxic) else 0.0]))

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(FEATURES))
        if self.trees is None or not len(texts):
            return np.zeros(len(texts))
        raw = self.trees.raw(x)
        # A trace of the raw score keeps the order within flat steps of the calibration.
        return np.clip(0.99 * np.interp(raw, self.knots, self.values) + 0.01 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, most_mb: int = 64) -> Model:
    """Fit on at most ``sample`` labelled ids outside the held-out fifth, and ``most_mb`` MB of their texts.

    Conflicting labels of one id count as toxic if any does; of an id's texts the
    first by code point is taken. No labels give a constant score.
    """
    marks = labels.where("toxic is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id")
    one = rows.groupBy("_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    texts, toxic, room = [], [], most_mb << 20
    for row in one.orderBy(F.crc32(F.col("_id").cast("string").cast("binary")), "_id").toLocalIterator():
        room -= len((row["text"] or "").encode())
        if room < 0:
            break
        texts.append(row["text"] or "")
        toxic.append(int(row["toxic"] > 0))
    return Model(texts, np.array(toxic, np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000) -> DataFrame:
    """Toxicity of every whole text.

    Returns (id_col, held_out, score, predicted), one row per input row, in no
    order. Only the text is read for a score; null and empty texts get the score
    of no evidence. Repeated rows get equal scores; an empty table gives an empty
    result. Other columns are ignored, so their names can't clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, sample))

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 500):
                score = model.value.score(texts[at : at + 500])
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = 0.5, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` scored below ``at``; columns stay, nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample=sample))
    where = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(where).to_pylist()]
            good = np.concatenate([model.value.score(texts[i : i + 500]) < at for i in range(0, len(texts), 500)]) if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
