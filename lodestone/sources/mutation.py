"""Changes of an index's rows, each a DataFrame plan: upserts, partial updates, deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.query import Context, Query, Term, sure
from lodestone.plans.schema import NUMERIC, Index


def latest(rows: DataFrame, id: str, seq: str | None = None) -> DataFrame:
    """The row with the highest ``seq`` for each id: an aggregation with partial maxima, so a hot id does not gather.

    Equal ones are told apart by a hash of all columns, so the same rows give the same row whenever the task runs.
    """
    hashed = F.xxhash64(*[F.col(f"`{n}`") for n, t in rows.dtypes if "map<" not in t])
    best = rows.groupBy(id).agg(F.max_by(F.struct(*rows.columns), F.struct(*[seq] * bool(seq), hashed)).alias("r"))
    return best.select("r.*")


def upsert(base: DataFrame, new: DataFrame, id: str, seq: str | None = None) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same id; with ``seq`` the newest of each id counts."""
    fresh = latest(new, id, seq)
    return base.join(fresh, id, "left_anti").unionByName(fresh.select(*base.columns))


def update_values(index: Index, updates: DataFrame) -> DataFrame:
    """Numbers that are doc values, single and not searchable, replaced by id where the update holds one."""
    for c in updates.columns:
        if c == index.id:
            continue
        f = index.field(c)
        if f.type not in NUMERIC or f.search or f.multi or not f.doc_values:
            raise ValueError(f"{c} cannot be updated in place")
    new = updates.select(index.id, *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != index.id])
    joined = index.df.join(new, index.id, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in updates.columns and c != index.id else F.col(c) for c in index.df.columns])


def delete_by_query(index: Index, queries: list[Query]) -> DataFrame:
    """Rows that match none of the queries."""
    x = Context(index)
    compiled = []
    df = None
    for q in queries:
        df, c = x.prepared(q, whole=True)
        compiled.append(c.match)
    df = x.with_tokens() if len(queries) > 1 else df
    gone = reduce(lambda a, b: a | b, map(sure, compiled))
    return df.where(~gone).select(*index.df.columns)


def delete(index: Index, terms: list[tuple[str, object]]) -> DataFrame:
    """Rows that hold none of the (field, value) pairs."""
    return delete_by_query(index, [Term(f, v) for f, v in terms])


def delete_all(index: Index) -> DataFrame:
    return index.df.limit(0)
