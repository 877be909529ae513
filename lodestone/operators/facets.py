"""Facets over the matched rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.collectors import Terms, bucketed
from lodestone.plans.query import Context, scored_script


@dataclass(frozen=True)
class Facet:
    """``top_n`` labels by count, or just ``labels``; ``paths`` goes down a hierarchy; ``sample`` looks at the best hits only."""

    name: str | None = None
    top_n: int = 0
    labels: tuple[str, ...] = ()
    path: tuple[str, ...] | None = None
    ranges: tuple[Bounds, ...] = ()
    script: object = None
    sample: int = 0


@dataclass(frozen=True)
class Bounds:
    label: str
    low: float
    high: float
    include_low: bool = True
    include_high: bool = True


def values(df: DataFrame, x: Context, f: Facet) -> DataFrame:
    """``label, count, value, child_count``: documents with each label, with any, and how many labels there are.

    Ties go to the smaller label. A script facet's ``value`` is all rows that were matched.
    """
    if not f.top_n and not f.labels:
        raise ValueError("a facet needs top_n or labels")
    rows = bucketed(df, x, Terms(f.name, script=f.script), "label")
    counts = rows.groupBy("label").agg(F.count("*").alias("count"))
    if f.script is not None:
        total = df.agg(F.count("*"))
    else:
        c = x.column(f.name)
        some = F.size(c) > 0 if x.index.field(f.name).multi else c.isNotNull()
        total = df.agg(F.count_if(some))
    shown = counts.where(F.col("label").isin(*f.labels)) if f.labels else counts.orderBy(F.desc("count"), "label").limit(f.top_n)
    return shown.select("label", "count", total.scalar().alias("value"), counts.agg(F.count("*")).scalar().alias("child_count"))


def hierarchy(df: DataFrame, x: Context, f: Facet) -> DataFrame:
    """``label, count``: children of ``path`` in an array-of-parts column."""
    n = len(f.path or ())
    parts = x.column(f.name)
    under = F.size(parts) > n
    for k, p in enumerate(f.path or ()):
        under = under & (parts[k] == p)
    counts = df.where(F.coalesce(under, F.lit(False))).groupBy(F.element_at(parts, n + 1).alias("label")).agg(F.count("*").alias("count"))
    if f.labels:
        return counts.where(F.col("label").isin(*f.labels))
    return counts.orderBy(F.desc("count"), "label").limit(f.top_n) if f.top_n else counts


def ranges(df: DataFrame, x: Context, f: Facet) -> DataFrame:
    """``label, count``: ranges may overlap, so each is a conditional count in one aggregation."""
    if x.index.field(f.name).type == "float":
        raise ValueError("no range facet on float")
    v = x.column(f.name)
    sums = []
    for r in f.ranges:
        low = v >= r.low if r.include_low else v > r.low
        high = v <= r.high if r.include_high else v < r.high
        sums.append(F.count_if(low & high).alias(r.label))
    one = df.agg(*sums)
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(r.label) for r in f.ranges]), F.array(*[F.col(f"`{r.label}`") for r in f.ranges]))).alias("label", "count"))


def facet(df: DataFrame, x: Context, f: Facet) -> DataFrame:
    if f.sample:
        df = df.orderBy(F.desc("_score"), x.index.id).limit(f.sample)
    if f.ranges:
        return ranges(df, x, f)
    if f.path is not None:
        return hierarchy(df, x, f)
    return values(df, x, f)


def script_value(x: Context, source: object) -> object:
    return scored_script(x, source, F.col("_score"))
