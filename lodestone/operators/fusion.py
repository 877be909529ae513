"""Blending of ranked lists: weighted reciprocal ranks, weighted scores, raw merging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.registry import lookup


@dataclass(frozen=True)
class Ranked:
    """A retriever's hits: a DataFrame with the id and ``score``, and its weight (not above 0: 1)."""

    name: str
    hits: DataFrame
    boost: float = 0.0

    @property
    def weight(self) -> float:
        return self.boost if self.boost > 0 else 1.0


def stacked(lists: list[Ranked], id: str) -> DataFrame:
    """``retriever, id, rank, score, weight`` of all lists; lists are top-k, so the rank window is over few rows."""
    if not lists:
        raise ValueError("there must be a retriever")
    parts = []
    for r in lists:
        w = Window.partitionBy("retriever").orderBy(F.desc("score"), id)
        rows = r.hits.select(F.lit(r.name).alias("retriever"), F.col(id), F.col("score").cast("double").alias("score"), F.lit(r.weight).alias("weight"))
        parts.append(rows.withColumn("rank", F.row_number().over(w)))
    return reduce(DataFrame.unionByName, parts)


def _scores() -> F.Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", F.col("score").alias("v"))))).alias("retriever_scores")


def rrf(lists: list[Ranked], id: str, k: int = 60) -> DataFrame:
    """Sum over lists of weight / (k + rank); k not above 0 is 60."""
    k = k if k > 0 else 60
    return stacked(lists, id).groupBy(id).agg(F.sum(F.col("weight") / (F.col("rank") + k)).alias("score"), _scores())


def score_order(lists: list[Ranked], id: str, mode: str = "max") -> DataFrame:
    """Weighted scores joined by max, sum or avg over the lists that hold the document."""
    how = {"max": F.max, "sum": F.sum, "avg": F.avg}[mode]
    return stacked(lists, id).groupBy(id).agg(how(F.col("score") * F.col("weight")).alias("score"), _scores())


def raw_merge(lists: list[Ranked], id: str) -> DataFrame:
    """Each document once, score 0, with the scores that the lists gave it."""
    return stacked(lists, id).groupBy(id).agg(F.lit(0.0).alias("score"), _scores())


def blend(how: str, lists: list[Ranked], id: str, top_hits: int, start: int = 0, **options: object) -> DataFrame:
    if how == "raw_merge":
        return raw_merge(lists, id)
    fused = {"rrf": rrf, "score_order": score_order}.get(how) or lookup("blender", how)
    return fused(lists, id, **options).orderBy(F.desc("score"), id).limit(top_hits).offset(start)
