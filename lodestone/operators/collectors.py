"""Bucket and metric aggregations over the matched rows, with nesting.

A tree of collectors becomes one plan: buckets group by the keys of all levels at once, so partial aggregation happens
before the shuffle; the top buckets of a level are chosen with a window over the aggregated rows only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.query import Context, Query, scored_script
from lodestone.registry import lookup

UNSET_MIN, UNSET_MAX = 1.7976931348623157e308, -1.7976931348623157e308


@dataclass(frozen=True)
class Metric:
    """``kind`` min, max or sum of a script or field. Nothing collected gives the extreme value, or 0 for a sum."""

    kind: str
    script: object

    def column(self, x: Context) -> Column:
        v = scored_script(x, self.script, F.col("_score"))
        if self.kind == "sum":
            return F.coalesce(F.sum(v), F.lit(0.0))
        if self.kind == "min":
            return F.coalesce(F.min(v), F.lit(UNSET_MIN))
        if self.kind == "max":
            return F.coalesce(F.max(v), F.lit(UNSET_MAX))
        raise ValueError(f"unknown metric: {self.kind}")


@dataclass(frozen=True)
class TopHits:
    """Best ``top_hits`` documents of each bucket, less the first ``start``, by score or by fields."""

    top_hits: int = 3
    start: int = 0
    sort: tuple = ()
    retrieve: tuple[str, ...] = ()


@dataclass(frozen=True)
class Terms:
    """Buckets by a field's values or a script's; the ``size`` largest by count or by a nested metric.

    Texts count a value once in a document, numbers every time. Ties go to the smaller key.
    """

    name: str | None = None
    size: int = 10
    script: object = None
    order_by: str = "_count"
    ascending: bool = False
    nested: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Filter:
    """Count of the rows that match a query (or hold one of a set of values), with nested collectors."""

    query: Query | None = None
    name: str | None = None
    values: tuple = ()
    nested: dict[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Plugin:
    name: str
    params: dict = field(default_factory=dict)


def keys_of(x: Context, c: Terms) -> Column:
    """The bucket keys of a row: one, or an array of them."""
    if c.script is not None:
        return scored_script(x, c.script, F.col("_score"))
    f, v = x.index.field(c.name), x.column(c.name)
    if f.type in ("virtual", "runtime"):
        return v
    if not f.doc_values:
        raise ValueError(f"{c.name} has no doc values")
    return F.array_distinct(v) if f.multi and f.type in ("atom", "text", "_id") else v


def bucketed(df: DataFrame, x: Context, c: Terms, name: str = "key") -> DataFrame:
    """One row for each key of each row; rows without a key are gone."""
    k = keys_of(x, c)
    listed = df.select(k.alias("k")).schema["k"].dataType.typeName() == "array"
    return (df.withColumn(name, F.explode(k)) if listed else df.withColumn(name, k)).where(F.col(name).isNotNull())


def check(nested: dict[str, object]) -> None:
    for c in nested.values():
        if isinstance(c, Metric) and getattr(c, "nested", None):
            raise ValueError("a metric has no nested collectors")
        if isinstance(c, Filter) and not c.nested:
            raise ValueError("a filter collector needs nested collectors")


def terms(df: DataFrame, x: Context, c: Terms, within: tuple[str, ...] = ()) -> DataFrame:
    """``key, count, total_buckets, total_other_counts`` and a column for each nested metric, by rank."""
    check(c.nested)
    metrics = {n: m for n, m in c.nested.items() if isinstance(m, Metric)}
    if c.order_by != "_count" and c.order_by not in metrics:
        raise ValueError(f"buckets cannot be ordered by {c.order_by}")
    rows = bucketed(df, x, c)
    agg = rows.groupBy(*within, "key").agg(F.count("*").alias("count"), *[m.column(x).alias(n) for n, m in metrics.items()])
    by = F.col("count" if c.order_by == "_count" else c.order_by)
    order = (by.asc() if c.ascending else by.desc(), F.col("key"))
    if not within:
        # a bounded top-k over the buckets, however many there are; the totals are scalar subqueries
        top = agg.orderBy(*order).limit(c.size)
        few = Window.partitionBy(F.lit(0))
        top = top.withColumn("rank", F.row_number().over(few.orderBy(*order))).withColumn("_shown", F.sum("count").over(few))
        buckets, counted = agg.agg(F.count("*")).scalar(), agg.agg(F.sum("count")).scalar()
        return top.withColumn("total_buckets", buckets).withColumn("total_other_counts", counted - F.col("_shown")).drop("_shown")
    # ``rank <= size`` lets each task keep its best rows before the shuffle
    best = agg.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col("rank") <= c.size)
    totals = agg.groupBy(*within).agg(F.count("*").alias("total_buckets"), F.sum("count").alias("_all"))
    shown = Window.partitionBy(*within)
    return best.withColumn("_shown", F.sum("count").over(shown)).join(totals, list(within)).withColumn("total_other_counts", F.col("_all") - F.col("_shown")).drop("_all", "_shown")


def level(n: int) -> tuple[str, str]:
    """Names of the key and the count of the ``n``-th level from outside, as inner levels carry them."""
    return ("outer_key", "outer_count") if n == 1 else (f"outer{n}_key", f"outer{n}_count")


def below(rows: DataFrame, x: Context, name: str, c: Terms, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A terms collector and all that is nested in it, to any depth; ``by`` holds keys and counts of the levels outside.

    The best buckets of each level are joined to the rows before the next: at most the product of the sizes.
    """
    out = {name: terms(rows, x, c, by)}
    best = out[name].select(*by, "key", "count")
    for n, inner in c.nested.items():
        at = f"{name}>{n}"
        if isinstance(inner, Metric):
            continue
        if isinstance(inner, (Terms, Filter)):
            key, count = level(len(by) // 2 + 1)
            named = best.withColumnsRenamed({"key": key, "count": count})
            inside = bucketed(rows, x, c, key).join(named, [*by, key])
            if isinstance(inner, Terms):
                out |= below(inside, x, at, inner, (*by, key, count))
                continue
            inside = filtered(inside, x, inner)
            metrics = {k: m for k, m in inner.nested.items() if isinstance(m, Metric)}
            counted = inside.groupBy(*by, key).agg(F.count("*").alias("count"), *[m.column(x).alias(k) for k, m in metrics.items()])
            out[at] = counted.withColumnRenamed(key, "key")
            for k, deeper in inner.nested.items():
                if isinstance(deeper, Terms):
                    out |= below(inside, x, f"{at}>{k}", deeper, (*by, key, count))
                elif isinstance(deeper, TopHits):
                    out[f"{at}>{k}"] = top_hits(inside, x, deeper, (*by, key)).withColumnRenamed(key, "key")
                elif k not in metrics:
                    raise ValueError(f"{type(deeper).__name__} cannot be nested in a filter of buckets")
        elif isinstance(inner, TopHits):
            out[at] = top_hits(bucketed(rows, x, c).join(best.select(*by, "key"), [*by, "key"]), x, inner, (*by, "key"))
        else:
            raise ValueError(f"{type(inner).__name__} cannot be nested in buckets")
    return out


def top_hits(df: DataFrame, x: Context, c: TopHits, by: tuple[str, ...] = ()) -> DataFrame:
    from lodestone.operators.sort import order, sort_value

    names = [f"_s{i}" for i in range(len(c.sort))]
    rows = df.withColumns({n: sort_value(x, s, F.col("_score")) for n, s in zip(names, c.sort)}) if c.sort else df
    ranks = order(x, c.sort, names) if c.sort else [F.col("_score").desc()]
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    if not by:
        rows = rows.orderBy(*ranks, F.col(x.index.id)).limit(c.top_hits)
    rank = F.row_number().over(w.orderBy(*ranks, F.col(x.index.id)))
    score = F.lit(float("nan")) if c.sort else F.col("_score")
    picked = rows.withColumn("hit", rank).where((F.col("hit") > c.start) & (F.col("hit") <= c.top_hits))
    return picked.select(*by, "hit", x.index.id, score.alias("score"), *[x.column(n).alias(n) for n in c.retrieve if n != x.index.id])


def filtered(df: DataFrame, x: Context, c: Filter) -> DataFrame:
    if not c.nested:
        raise ValueError("a filter collector needs nested collectors")
    if c.query is not None:
        return df.where(c.query.compile(x).match)
    f, v = x.index.field(c.name), x.column(c.name)
    return df.where(F.exists(v, lambda t: t.isin(*c.values)) if f.multi else v.isin(*c.values))


def collect(df: DataFrame, x: Context, collectors: dict[str, object]) -> dict[str, DataFrame]:
    """A DataFrame for each collector; nested ones are named ``outer>inner``."""
    out: dict[str, DataFrame] = {}
    for name, c in collectors.items():
        if isinstance(c, Terms):
            out |= below(df, x, name, c)
        elif isinstance(c, Filter):
            rows = filtered(df, x, c)
            metrics = {n: m for n, m in c.nested.items() if isinstance(m, Metric)}
            out[name] = rows.agg(F.count("*").alias("count"), *[m.column(x).alias(n) for n, m in metrics.items()])
            for n, d in collect(rows, x, {n: m for n, m in c.nested.items() if n not in metrics}).items():
                out[f"{name}>{n}"] = d
        elif isinstance(c, Metric):
            out[name] = df.agg(c.column(x).alias("value"))
        elif isinstance(c, TopHits):
            out[name] = top_hits(df, x, c)
        elif isinstance(c, Plugin):
            out[name] = lookup("collector", c.name)(df, x, c.params)
        else:
            raise ValueError(f"not a collector: {c!r}")
    return out
