"""Vector similarities as Columns: array arithmetic in the JVM, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMENSIONS = 4096


def literal(vector: list[float]) -> Column:
    if not vector or len(vector) > MAX_DIMENSIONS:
        raise ValueError(f"a vector has 1 to {MAX_DIMENSIONS} components")
    if not all(math.isfinite(x) for x in vector):
        raise ValueError("vector components must be finite")
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def similarity(kind: str, column: Column, query: list[float], byte: bool = False) -> Column:
    """Score of a vector column against a query vector; null where dimensions differ or the vector is missing."""
    q = literal(query)
    norm = math.sqrt(sum(x * x for x in query))
    if kind in ("cosine", "normalized_cosine") and norm == 0:
        raise ValueError("a vector without magnitude has no cosine")
    if kind == "dot_product" and not byte and abs(norm * norm - 1) > 1e-4:
        raise ValueError("dot product needs unit vectors")
    if kind == "l2_norm":
        score = 1 / (1 + _sum(F.zip_with(column, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))
    elif kind == "dot_product":
        score = 0.5 + dot(column, q) / (32768.0 * len(query)) if byte else (1 + dot(column, q)) / 2
    elif kind in ("cosine", "normalized_cosine"):
        own = F.sqrt(dot(column, column))
        score = F.when(own > 0, (1 + dot(column, q) / (own * norm)) / 2)
    elif kind == "max_inner_product":
        s = dot(column, q)
        score = F.when(s < 0, 1 / (1 - s)).otherwise(s + 1)
    else:
        raise ValueError(f"unknown similarity: {kind}")
    return F.when(F.size(column) == len(query), score)


def threshold_score(kind: str, raw: float) -> float:
    """The score that a raw similarity stands for."""
    if kind == "l2_norm":
        return 1 / (1 + raw * raw)
    if kind == "max_inner_product":
        return 1 / (1 - raw) if raw < 0 else raw + 1
    return (1 + raw) / 2
