"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text (``NAMES``): densities, counts and the closest packing of hits of two
lexicons (a short general list of insults, and words that the labelled sample shows to be typical of
toxic texts), hits near a second-person word, hits after undoing common letter substitutions,
shares of capitals, of punctuation and of obfuscated words, exclamation runs, longest letter run
and length.  Trees are fitted by boosting the logistic loss on quantile bins; the
monotone map from tree scores to probabilities is learned from scores by models that have not seen the row.

Training reads a bounded sample of rows (``SAMPLE`` of each label) with their whole texts: executors count
its words and compute its features, and only learned words and feature vectors reach the driver.  Null and
empty texts have all features 0.  Training and scoring use nothing but the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, labelled_texts, lean

#: Rows of each label in the training sample.
SAMPLE = 2000
TREES, DEPTH, RATE, BINS, LEAF, FOLDS = 120, 3, 0.1, 32, 10, 3
LEARNED, LEAST_ODDS, STEMS = 300, 1.5, (4, 5, 6, 7)
#: General insults (fixed values).
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless clown clowns fool fools jerk jerks creep creeps imbecile dimwit dumbass bastard bitch asshole shit fuck fucking crap hate kill disgusting filthy ugly freak coward liar pig rat vermin".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tus su sus vosotros".split())
NAMES = ["insults_per_word", "insults", "learned_per_word", "learned", "packed", "near_second", "second_per_word", "hidden", "hidden_per_word", "capitals", "capital_words", "punctuation", "exclaims", "digits", "longest_run", "words"]
_WORD = re.compile(r"[^\W_]+")
_PLAIN = str.maketrans("01345789@$!|+€", "oieastbgasiite")
_RUN = re.compile(r"(.)\1\1+")
_JOINT = re.compile(r"[0-9@$!|+€*.\-_]+[^\W\d_]")
_HIDES = re.compile(r"[^\W\d_]+(?:[0-9@$!|+€*.\-_]+[^\W\d_]+)+")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_PUNCT = re.compile(r"[!?*#$%&@]")


@lru_cache(16)
def _stems(learned: frozenset[str], n: int) -> frozenset[str]:
    """The learned beginnings of n letters."""
    return frozenset(w[:n] for w in learned if len(w) == n + 1 and w[n] == "*")


def _hidden(text: str, lexicon: frozenset[str]) -> tuple[int, int]:
    """(words that hide a lexicon word behind substituted or separated letters, words written so)."""
    n = hits = end = 0
    for joint in _JOINT.finditer(text):
        k = joint.start()
        if k < end or not k or not text[k - 1].isalpha():
            continue
        while k and text[k - 1].isalpha():
            k -= 1
        m = _HIDES.match(text, k)
        end, w = m.end(), m.group()
        n += 1
        a = w.translate(_PLAIN)
        b = re.sub(r"[^\w]|_", "", a)
        hits += any(_RUN.sub(r"\1", x) in lexicon or x in lexicon for x in (b, re.sub(r"\W|[\d_]", "", w)))
    return hits, n


def features(text: str, learned: frozenset[str]) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    both = INSULTS | learned
    stems = [(n, set_) for n in STEMS if (set_ := _stems(learned, n))]
    present = {w for w in set(words) if w in both or any(w[:n] in set_ for n, set_ in stems)}
    insults = known = packed = near = 0
    if present:
        at = [i for i, w in enumerate(words) if w in present]
        insults = sum(words[i] in INSULTS for i in at)
        known = sum(words[i] not in INSULTS or words[i] in learned for i in at)
        second = {i for i, w in enumerate(words) if w in SECOND}
        near = sum(any(j in second for j in range(i - 3, i + 4)) for i in at)
        j = 0
        for i, a in enumerate(at):  # most hits within 50 words
            while a - at[j] >= 50:
                j += 1
            packed = max(packed, i - j + 1)
    seconds = sum(map(SECOND.__contains__, words))
    hidden, odd = _hidden(low, both)
    runs = max((m.end() - m.start() for m in _RUN.finditer(low)), default=0)
    chars = len(text)
    caps = sum(map(len, _UPPER.findall(text)))
    shouted = len(_SHOUT.findall(text))
    per = max(1, n)
    return [insults / per, math.log1p(insults), known / per, math.log1p(known), packed, near, seconds / per, math.log1p(hidden), odd / per, caps / chars, shouted / per, len(_PUNCT.findall(text)) / chars, text.count("!") / chars, sum(map(text.count, "0123456789")) / chars, min(runs, 50), math.log1p(n)]



def words_of(text: str) -> set[str]:
    """The words of a text and their beginnings of STEMS letters, marked by *."""
    ws = set(_WORD.findall(text.lower()))
    return ws.union(*({w[:n] + "*" for w in ws if len(w) > n} for n in STEMS))


def learn_lexicon(counts: DataFrame, n: list[list[int]], apart: int | None) -> frozenset[str]:
    """Words and beginnings in clearly more toxic than other texts of the folds but ``apart``.

    ``counts`` (word, c) has a word's texts by fold and label, ``n`` all texts by them.  The log-odds of document
    frequency must pass LEAST_ODDS by 2 standard errors; the LEARNED words with the most come to the driver.
    """
    folds = [f for f in range(FOLDS) if f != apart]
    n0, n1 = (sum(n[f][y] for f in folds) for y in (0, 1))
    if not n1 or not n0:
        return frozenset()
    b, a = (sum((F.col("c")[2 * f + y] for f in folds), F.lit(0)) for y in (0, 1))
    d = counts.select("word", a.alias("a"), b.alias("b")).where((F.col("a") >= 5) & (F.length("word") > 1))
    cells = [F.col("a") + 0.5, n1 - F.col("a") + 0.5, F.col("b") + 0.5, n0 - F.col("b") + 0.5]
    odds = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    low = F.round(odds - 2 * F.sqrt(sum((1 / c for c in cells[1:]), 1 / cells[0])), 9)
    top = d.select("word", low.alias("low")).where(F.col("low") > LEAST_ODDS).orderBy(F.col("low").desc(), "word").limit(LEARNED)
    return frozenset(r.word for r in top.collect())


class Model:
    """learned words; base score; trees as (feature, threshold, left, right, value) arrays; isotonic knots."""

    def __init__(self, learned, base, trees, knots):
        self.learned, self.base, self.trees, self.knots = learned, base, trees, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in self.trees:  # complete trees: children of k are 2k+1 and 2k+2
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    out, trees = np.full(len(y), base), []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-out))
        g, h = y - q, q * (1 - q)
        feat, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for node in range(inner):
            i = np.flatnonzero(at == node)
            best = (1e-6, None)
            if len(i) >= 2 * LEAF:
                G, H = g[i].sum(), h[i].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = binned[i, f]
                    gl, hl, nl = (np.cumsum(np.bincount(k, w, len(e) + 1))[:-1] for w in (g[i], h[i], None))
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    gain[(nl < LEAF) | (len(i) - nl < LEAF)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, e[j]))
            if best[1]:
                feat[node], cut[node] = best[1]
            at[i] = 2 * node + 1 + (x[i, feat[node]] > cut[node])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        out += value[leaf]
        trees.append((feat, cut, value))
    return base, trees


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators, equal scores pooled first; knots for linear interpolation."""
    u, inv = np.unique(s, return_inverse=True)
    w, v = np.bincount(inv).astype(float), np.bincount(inv, y)
    runs: list[list[float]] = []
    for k in range(len(u)):
        runs.append([u[k], u[k], v[k], w[k]])
        while len(runs) > 1 and runs[-2][2] * runs[-1][3] >= runs[-1][2] * runs[-2][3]:
            b = runs.pop()
            a = runs[-1]
            a[1], a[2], a[3] = b[1], a[2] + b[2], a[3] + b[3]
    xs, ys = [], []
    for lo, hi, got, n in runs:
        # half a row of each label keeps runs of one label off 0 and 1
        xs += [lo, hi] if hi > lo else [lo]
        ys += [(got + 0.5) / (n + 1)] * (2 if hi > lo else 1)
    return np.array(xs), np.maximum.accumulate(ys)


def train(x: np.ndarray, y: np.ndarray, part: np.ndarray, lexicons: list[frozenset[str]]) -> Model:
    """``x`` (rows, FOLDS + 1, features): the features of each row by the lexicon of all folds but one, and by that of all."""
    if len(set(y.tolist())) < 2:
        return Model(frozenset(), 0.0, [], (np.array([0.0]), np.array([1.0 if len(y) and y[0] else 0.0])))
    # every row is scored by a model that has not seen it, lexicon included
    raw = np.zeros(len(y))
    for f in range(FOLDS):
        mine, rest = part == f, part != f
        if mine.any() and rest.any():
            raw[mine] = Model(lexicons[f], *boost(x[rest, f], y[rest]), None).raw(x[mine, f])
    return Model(lexicons[-1], *boost(x[:, -1], y), isotonic(raw, y))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = SAMPLE) -> Model:
    """Learns toxicity from the labelled rows of ``docs`` (doc_id, text) for which ``learn``, a condition on doc_id, holds.

    Labels but 0 and 1 and null ids are not learned from; a repeated label row counts once (the smallest label), a
    repeated document gives one text (the smallest).  Null texts are empty.  Without rows, or with one label only,
    the model is a constant.  Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labelled_texts(lean(docs), labels, "toxic", learn, per_class)
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(29)), F.lit(FOLDS)).cast("int")
    sample = scratch.save(sample.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("y").cast("int"), fold.alias("fold"), F.col("doc_id").cast("long")), "sample")
    n = [[0, 0] for _ in range(FOLDS)]
    for r in sample.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r.fold][r.y] = r.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches, most=4 << 20):
            got: dict[str, list[int]] = {}
            for t, y, f in zip(*(s.column(k).to_pylist() for k in range(3)), strict=True):
                for w in words_of(t):
                    got.setdefault(w, [0] * 2 * FOLDS)[2 * f + y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array(got.values(), pa.list_(pa.int64()))], ["word", "c"])

    counts = sample.mapInArrow(count, "word string, c array<long>").groupBy("word").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(2 * FOLDS)]).alias("c"))
    # a word must be in five toxic texts
    counts = scratch.save(counts.where(sum((F.col("c")[2 * f + 1] for f in range(FOLDS)), F.lit(0)) >= 5), "words")
    lexicons = [learn_lexicon(counts, n, f) for f in [*range(FOLDS), None]]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches):
            x = [np.array([features(t, lex) for lex in lexicons]).tobytes() for t in s.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([s.column(3), s.column(1), s.column(2), pa.array(x, pa.binary())], ["doc_id", "y", "fold", "x"])

    rows = sorted(sample.repartition(max(1, sum(map(sum, n)) // 64), "doc_id").mapInArrow(vectors, "doc_id long, y int, fold int, x binary").collect(), key=lambda r: r.doc_id)
    scratch.drop("sample", "words")
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), FOLDS + 1, len(NAMES))
    return train(x, np.array([r.y for r in rows], float), np.array([r.fold for r in rows], int), lexicons)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``, the calibrated probability of label 1 for every whole text; no shuffle.

    Rows are scored one by one: equal texts get equal scores, null and empty ones that of no words; an empty
    table gives no rows.  Other columns are kept; one named ``score`` is replaced.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("score")
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches, text):
            x = np.array([features(t or "", model.learned) for t in s.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(model.score(x))], [*s.schema.names, "score"])

    return lean(docs).mapInArrow(run, schema)
