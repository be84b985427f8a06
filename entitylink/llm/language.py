"""Language identification by hierarchical discrimination.

A text is lower-cased; everything but letters becomes one space; the bytes' n-grams of length 1 to 3
are hashed into ``DIM`` counts, and the feature vector is the square roots of the counts scaled to
length 1.  A multinomial linear model over families decides the family; within it, one-versus-one
linear support vector machines vote, ties going to the larger sum of margins.

Training reads a bounded sample of about ``SAMPLE`` rows of each language, from which executors send
vectors of fixed size; prediction reads whole texts.  Texts that are null or have no letter are
``und`` with score 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_sample, lean

DIM, SAMPLE, SEED = 8192, 500, 5
EPOCHS, REG = 30, 1e-4
#: Families of ISO 639-1 codes (fixed values); a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
}
FAMILY_OF = {c: f for f, cs in FAMILIES.items() for c in cs}
_ALNUM = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
#: Numbers that are not decimal digits (superscripts, fractions, circled and Roman ones), which word characters cover; the second beyond U+FFFF.
_NUMBERS, _FAR = (re.compile("[" + "".join(c for c in map(chr, codes) if unicodedata.category(c) in ("No", "Nl")) + "]+") for codes in (range(0x10000), range(0x10000, 0x20000)))
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's categories L occurs."""
    return any(m.group().isalpha() for m in _ALNUM.finditer(text))


def letters(text: str) -> str:
    """The text with all but letters as single spaces; the rare numbers are looked for where they may be."""
    out = _OTHER.sub(" ", text)
    if not out.isascii():
        more = _NUMBERS.sub(" ", out)
        if _ASTRAL.search(more):
            more = _FAR.sub(" ", more)
        if more != out:
            out = re.sub(" +", " ", more)
    return out


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"alone-{lang}")


def features(text: str) -> np.ndarray:
    """The vector of a whole text; a long one is counted piece by piece."""
    total = np.zeros(DIM)
    for at in range(0, len(text), 1 << 20):
        b = np.frombuffer((" " + letters(text[at : at + (1 << 20)].lower()) + " ").encode(), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(256) + b[1:]
        three = two[:-1] * np.uint32(256) + b[2:]
        for n, grams in ((1, b), (2, two), (3, three)):
            total += np.bincount((grams + np.uint32(n << 28)) * np.uint32(2654435761) >> np.uint32(32 - DIM.bit_length() + 1), minlength=DIM)
    total[0] = 0
    x = np.sqrt(total)
    return (x / max(1e-12, np.linalg.norm(x))).astype(np.float32)


class Model:
    """langs: sorted; families and their linear model; one weight vector for each pair in a family."""

    def __init__(self, langs, families, w_family, pairs):
        self.langs, self.families, self.w_family, self.pairs = langs, families, w_family, pairs

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x))
        x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
        z = x1 @ self.w_family
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        fam = p.argmax(1)
        out, score = [""] * len(x), p[np.arange(len(x)), fam].astype(float)
        for f, name in enumerate(self.families):
            at = np.flatnonzero(fam == f)
            own = [c for c in self.langs if family(c) == name]
            votes, margins, sure = np.zeros((len(at), len(own))), np.zeros((len(at), len(own))), np.ones((len(at), len(own)))
            for i, j in combinations(range(len(own)), 2):
                m = x1[at] @ self.pairs[own[i], own[j]]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margins[:, i] += m
                margins[:, j] -= m
                q = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
                sure[:, i] *= q
                sure[:, j] *= 1 - q
            best = (votes + 1e-3 * np.tanh(margins)).argmax(1) if len(own) > 1 else np.zeros(len(at), int)
            for k, i in enumerate(at):
                out[i] = own[best[k]]
            score[at] *= sure[np.arange(len(at)), best] if len(own) else 1
        return out, np.clip(score, 0, 1)


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L2-regularised hinge loss, averaged stochastic subgradients over mini-batches; y is -1 or 1, classes weigh alike."""
    rng = np.random.default_rng(SEED)
    w = np.zeros(x.shape[1])
    mean, n = np.zeros_like(w), 0
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            i = order[at : at + 32]
            bad = y[i] * (x[i] @ w) < 1
            rate = 4.0 / (1 + 0.3 * epoch)
            w *= 1 - rate * REG
            if bad.any():
                w += rate * (x[i][bad] * (y[i] * weight[i])[bad, None]).sum(0) / len(i)
            if epoch >= EPOCHS // 2:
                mean += w
                n += 1
    return mean / max(1, n)


def _softmax(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    w = np.zeros((x.shape[1], k))
    hot = np.eye(k)[y] / np.bincount(y, minlength=k)[y][:, None] * len(y) / k
    g2 = np.zeros_like(w)
    for _ in range(150):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * hot.sum(1, keepdims=True)
        g = x.T @ (p - hot) / len(y) + REG * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2 + 1e-12)
    return w


def train(x: np.ndarray, lang: list[str]) -> Model:
    langs = sorted(set(lang))
    fams = sorted({family(c) for c in langs})
    if not langs:
        return Model([], [], np.zeros((DIM + 1, 0)), {})
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(float)
    names = np.array(lang)
    w = _softmax(x1, np.array([fams.index(family(c)) for c in lang]), len(fams)) if len(fams) > 1 else np.zeros((DIM + 1, 1))
    pairs = {}
    for f in fams:
        own = [c for c in langs if family(c) == f]
        for i, j in combinations(own, 2):
            at = (names == i) | (names == j)
            pairs[i, j] = _svm(x1[at], np.where(names[at] == i, 1.0, -1.0))
    return Model(langs, fams, w.astype(np.float32), {k: v.astype(np.float32) for k, v in pairs.items()})


def fit(docs: DataFrame, learn: Column, per_lang: int = SAMPLE) -> Model:
    """Learns from (text, lang) of the ``docs`` for which ``learn``, a condition on doc_id, holds and lang is not null.

    Null texts and ids and texts without a letter are not learned from.  An id that repeats counts once, with its
    smallest language and the smallest text of that.  Without rows, the model predicts ``und`` for all; with one
    language, always that.  Other columns are not looked at.
    """
    rows = lean(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn)
    # equal rows of one id would all be chosen together, so ids count once
    ids = bounded_sample(rows.groupBy("doc_id").agg(F.min("lang").alias("lang")), "doc_id", "lang", per_lang)
    one = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in blocks([batch], "text"):
                v = [features(t).astype(np.float16).tobytes() if has_letter(t) else None for t in s.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(v, pa.binary())], ["doc_id", "lang", "x"])

    got = sorted((r for r in one.select("doc_id", "lang", "text").mapInArrow(vectors, "doc_id long, lang string, x binary").collect() if r["x"]), key=lambda r: (r["doc_id"], r["lang"]))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, DIM), np.float32)
    return train(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to each row, from its whole text alone; no shuffle.

    Texts that are null or have no letter are ``und`` with score 0.  Rows are predicted one by one, so repeated rows
    agree; equal votes go to the larger margin, then to the first language by name.  An empty table gives no rows.
    Other columns are kept; those named ``lang_pred`` and ``score`` are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in blocks(batches, text):
            texts = s.column(at).to_pylist()
            ok = [i for i, t in enumerate(texts) if t and has_letter(t)]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            if ok:
                got, p = model.predict(np.stack([features(texts[i]) for i in ok]))
                for i, c in zip(ok, got, strict=True):
                    lang[i] = c
                score[ok] = p
            yield pa.RecordBatch.from_arrays([*s.columns, pa.array(lang, pa.string()), pa.array(score)], [*s.schema.names, "lang_pred", "score"])

    return lean(docs).mapInArrow(run, schema)
