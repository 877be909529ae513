"""Toxicity (operator 5): a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows (``per_class`` of each label, a documented parameter), the rows whose
hashed id comes first. Features are the presence of hashed character n-grams; those that tell the labels apart best by
chi-square are kept, scaled by their log-count ratio, and weighted by logistic regression. Presence, not frequency,
is what counts, so a long text does not dilute what it holds. The model is a few thousand numbers at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_text, take, texts_of

BITS = 20
ORDERS = (4, 5, 6)


def pieces_of(texts: list[str], chars: int = 250_000) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-case texts between spaces, in groups of about so many characters, with the place of each in the list.

    A longer text is cut into pieces that share as many characters as the longest n-gram has but one, so none is lost.
    """
    places, held, total = [], [], 0
    for i, t in enumerate(texts):
        t = f" {t.lower()} "
        for start in range(0, max(1, len(t) - max(ORDERS) + 1), chars):
            piece = t[start : start + chars + max(ORDERS) - 1]
            if total and total + len(piece) > chars:
                yield places, held
                places, held, total = [], [], 0
            places.append(i)
            held.append(piece)
            total += len(piece)
    if held:
        yield places, held


def features_of(texts: list[str], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) once for each feature that a text holds; ``known`` maps hashed n-grams to features, -1 none.

    An n-gram lies within one text, so a text's features do not depend on the texts beside it.
    """
    pairs = []
    for places, held in pieces_of(texts):
        chars = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, held), np.int64, len(held))
        text = np.repeat(np.array(places, np.int64), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters from here to the end of the piece
        h = mixed = np.where(chars <= 32, np.uint32(32), chars) * np.uint32(2654435761)
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) ^ mixed[n - 1 :]
            if n in ORDERS:
                g = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> np.uint32(32 - BITS)
                f = g if known is None else known[g]
                at = np.flatnonzero((left[: len(f)] >= n) & (f >= 0))
                pairs.append(text[at] << 32 | f[at].astype(np.int64))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def parts_of(texts: list[str], chars: int = 250_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Model:
    """Hashes of the features kept, weight times ratio of each, and the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.known = np.full(1 << BITS, -1, np.int32)
        self.known[model.hashes] = np.arange(len(model.hashes))

    def __call__(self, texts: list[str]) -> np.ndarray:
        doc, feature = features_of(texts, self.known)
        z = self.model.bias + np.bincount(doc, self.model.weights[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_texts(texts: list[str], labels: np.ndarray, features: int = 3000, alpha: float = 1.0, l2: float = 1e-3, steps: int = 250) -> Model:
    """Fit on texts in memory. With one label only, every text gets that label's share as its score."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    # two passes in small parts: the first counts documents for each n-gram, the second keeps the chosen ones only
    size, n1 = 1 << BITS, y.sum()
    n0 = len(y) - n1
    df1, df0 = np.zeros(size), np.zeros(size)
    for a, b in parts_of(texts):
        doc, gram = features_of(texts[a:b])
        toxic = y[a + doc] == 1
        df1 += np.bincount(gram[toxic], minlength=size)
        df0 += np.bincount(gram[~toxic], minlength=size)
    a, b, c, d = df1, df0, n1 - df1, n0 - df0
    chi = np.where(df1 + df0 >= 3, (a * d - b * c) ** 2 / np.maximum(1, (a + b) * (c + d)), 0)
    keep = np.sort(np.argsort(-chi, kind="stable")[:features])
    keep = keep[chi[keep] > 0]
    ratio = np.log((df1[keep] + alpha) / (n1 + 2 * alpha)) - np.log((df0[keep] + alpha) / (n0 + 2 * alpha))
    known = np.full(size, -1, np.int64)
    known[keep] = np.arange(len(keep))
    found = [(a, *features_of(texts[a:b], known)) for a, b in parts_of(texts)]
    doc = np.concatenate([a + d for a, d, _ in found])
    feature = np.concatenate([f for _, _, f in found])
    x = ratio[feature]
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias = np.full(len(keep), 0.01), 0.0
    m, v, mb, vb = np.zeros(len(keep)), np.zeros(len(keep)), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = bias + np.bincount(doc, x * w[feature], minlength=len(y))
        e = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g, gb = np.bincount(feature, x * e[doc], minlength=len(keep)) + l2 * w, e.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        lr = 0.02 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, bias = w - lr * m / (np.sqrt(v) + 1e-9), bias - lr * mb / (np.sqrt(vb) + 1e-9)
    return Model(keep, w * ratio, float(bias))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows kept out of training: crc32 of the id as text leaves 1 when divided by 3 (null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, **options: float) -> Model:
    """Fit on at most ``per_class`` labelled documents of each label outside the held-out third."""
    good = take(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    one = good.groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.where("label = 1").orderBy(*order).limit(per_class).union(one.where("label = 0").orderBy(*order).limit(per_class))
    d = take(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # 2 * per_class ids are broadcast; of repeated ids the largest text counts, so as many texts at most reach the driver
    rows = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit_texts([r.text for r in rows], np.array([r.label for r in rows]), **options)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``carry``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``) of every whole text.

    Null and empty texts are scored as empty; repeated rows alike; other columns are not read. No shuffle.
    """
    names = list(dict.fromkeys([*carry, text_col]))
    d = take(docs, *names)
    schema = ", ".join(f"`{n}` {d.schema[n].dataType.simpleString()}" for n in carry) + ", score double, predicted int"

    def run(batch: pa.RecordBatch) -> dict:
        global _scorer
        if _scorer is None or _scorer.model.bias != model.bias or not np.array_equal(_scorer.model.weights, model.weights):
            _scorer = model.scorer()
        s = _scorer(texts_of(batch, text_col))
        return {n: batch.column(batch.schema.get_field_index(n)) for n in carry} | {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return over_text(d, text_col, schema, run, max_bytes=1 << 19)


_scorer: Scorer | None = None
