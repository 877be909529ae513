"""Approximate nearest neighbours (operator 1): additive quantisation.

A vector is the sum of one code word from each of several full-dimensional codebooks. The codebooks are fitted to
residuals on a bounded sample (``train`` rows), then all of them together by least squares; every row is encoded by
beam search and keeps the squared norm of what its codes stand for. A query's table of products with all code words
estimates a row's distance by as many look-ups as there are codebooks and the stored norm. Waves of queries scan codes and
norms alone; from each block of rows a query takes those whose estimate is within ``slack`` of its ``k``-th best so far, ``keep``
at most. ``slack`` is measured on the sample: all but a small share of true neighbours lie within it. The original vectors
are read once, for the survivors of all waves, which are reranked by exact double-precision distance. Blocks have a fixed
number of rows and the slack is one of estimates, so recall does not fall as the table grows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, ship, take


@dataclass(frozen=True)
class Codebooks:
    """``words``: float32 of shape (codebooks, words, dimensions)."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = 4) -> np.ndarray:
        """Codes of each row by beam search: at each codebook the ``beam`` sums nearest to the vector go on."""
        books, size, _ = self.words.shape
        n = len(x)
        codes = np.zeros((n, 1, 0), np.uint8)
        rest = x[:, None, :].astype(np.float32)
        for m in range(books):
            w = self.words[m]
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ w.T) + (w**2).sum(1)
            width = rest.shape[1]
            flat = cost.reshape(n, width * size)
            k = min(beam if m < books - 1 else 1, width * size)
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            source, word = best // size, best % size
            codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            rest = np.take_along_axis(rest, source[:, :, None], 1) - w[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def fit(x: np.ndarray, books: int = 16, size: int = 256, rounds: int = 8, refits: int = 1, seed: int = 5) -> Codebooks:
    """Residual k-means codebooks, then joint least squares on the codes that beam search finds."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    dims = x.shape[1]
    words, rest = np.zeros((books, size, dims), np.float32), x.copy()
    for m in range(books):
        centre = rest[rng.choice(len(rest), size, replace=len(rest) < size)].copy()
        for _ in range(rounds):
            own = _nearest(rest, centre)
            total = np.zeros((size, dims), np.float64)
            np.add.at(total, own, rest)
            count = np.bincount(own, minlength=size)
            centre[count > 0] = (total[count > 0] / count[count > 0, None]).astype(np.float32)
        words[m] = centre
        rest -= centre[_nearest(rest, centre)]
    book = Codebooks(words)
    for _ in range(refits):
        codes = np.concatenate([book.encode(x[k : k + 1024]) for k in range(0, len(x), 1024)])
        gram, right = np.zeros((books * size, books * size), np.float32), np.zeros((books * size, dims), np.float32)
        for m in range(books):
            np.add.at(right, codes[:, m] + np.int64(size * m), x)
            for o in range(books):
                both = np.bincount(codes[:, m] * np.int64(size) + codes[:, o], minlength=size * size)
                gram[size * m : size * (m + 1), size * o : size * (o + 1)] = both.reshape(size, size)
        gram[np.diag_indices(books * size)] += 0.1
        right += 0.1 * book.words.reshape(-1, dims)
        book = Codebooks(np.linalg.solve(gram, right).reshape(words.shape).astype(np.float32))
    return book


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    norms = (centre**2).sum(1)
    return np.concatenate([np.argmin(norms - 2 * (x[k : k + 2048] @ centre.T), axis=1) for k in range(0, len(x), 2048)])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v``: rows with an id and a vector without null or non-finite components that is not zero."""
    d = take(vectors, id_col, vector_col, into=("vec_id", "v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return d.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def index(rows: DataFrame, dims: int, book: Codebooks, beam: int = 4) -> DataFrame:
    """``vec_id, v, codes, norm`` of all rows with ``dims`` components."""
    ship(rows.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for k in range(0, len(p), 512):
                q = p.iloc[k : k + 512]
                codes = book.encode(np.stack(q["v"].to_numpy()), beam)
                norms = (book.decode(codes).astype(np.float64) ** 2).sum(1)
                yield pd.DataFrame({"vec_id": q["vec_id"].to_numpy(), "v": q["v"].to_numpy(), "codes": [c.tobytes() for c in codes], "norm": norms})

    return rows.where(F.size("v") == dims).mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ", 1).replace(",v:", ", v ") + ", codes binary, norm double")


def slack(x: np.ndarray, book: Codebooks, k: int, share: float = 0.998, queries: int = 256) -> float:
    """How far above the ``k``-th best estimate the estimates of true neighbours reach: a quantile over rows of the sample as queries."""
    n = len(x)
    if n < 2:
        return 0.0
    codes = np.concatenate([book.encode(x[a : a + 1024]) for a in range(0, n, 1024)])
    near = np.concatenate([book.decode(codes[a : a + 4096]) for a in range(0, n, 4096)])
    own, k = np.arange(min(queries, n)), min(k, n - 1)
    q = x[own].astype(np.float32)
    true, estimate = ((y**2).sum(1) - 2 * (q @ y.T) for y in (x.astype(np.float32), near))
    true[own, own] = estimate[own, own] = np.inf
    best = np.partition(estimate, k - 1, axis=1)[:, k - 1]
    over = np.take_along_axis(estimate, np.argpartition(true, k - 1, axis=1)[:, :k], 1) - best[:, None]
    return float(max(0.0, np.quantile(over, share)))


def search(table: DataFrame, query_ids: np.ndarray, queries: np.ndarray, book: Codebooks, k: int, slack: float, keep: int = 128, block: int = 4096) -> DataFrame:
    """``query_id, vec_id, estimate`` of the rows that may be among the ``k`` nearest, by codes and norms alone."""
    ship(table.sparkSession)
    broadcast = table.sparkSession.sparkContext.broadcast((query_ids, queries.astype(np.float32)))
    id_type = table.schema["vec_id"].dataType.simpleString()

    def scored(p: pd.DataFrame, best_so_far: np.ndarray) -> Iterator[pd.DataFrame]:
        order = np.argsort(p["vec_id"].to_numpy(), kind="stable")  # equal estimates: the smaller ids first
        ids, norms = p["vec_id"].to_numpy()[order], p["norm"].to_numpy().astype(np.float32)[order]
        codes = np.ascontiguousarray(np.frombuffer(b"".join(p["codes"]), np.uint8).reshape(len(p), -1)[order].T).astype(np.intp)
        qids, qs = broadcast.value
        n = min(keep, len(ids))
        for a in range(0, len(qs), 64):
            q = qs[a : a + 64]
            near = np.tile(norms, (len(q), 1))
            for m, at in enumerate(codes):
                near -= np.take((2 * q) @ book.words[m].T, at, axis=1)
            near[qids[a : a + 64, None] == ids] = np.inf
            low = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, :k]
            best = best_so_far[a : a + 64] = np.sort(np.concatenate([best_so_far[a : a + 64], low], axis=1), axis=1)[:, :k]
            limit = best[:, -1:] + np.float32(slack)
            if n < len(ids):
                limit = np.minimum(limit, np.partition(near, n - 1, axis=1)[:, n - 1 : n])
            query, row = np.nonzero((near <= limit) & np.isfinite(near))
            crowded = np.bincount(query, minlength=len(q)) > keep
            if crowded.any():  # more rows tie at the bound than a block may give
                ok = ~crowded[query]
                few = [np.argsort(near[i], kind="stable")[:keep] for i in np.flatnonzero(crowded)]
                query, row = np.concatenate([query[ok], np.repeat(np.flatnonzero(crowded), keep)]), np.concatenate([row[ok], *few])
            yield pd.DataFrame({"query_id": qids[a : a + 64][query], "vec_id": ids[row], "estimate": near[query, row].astype(np.float64)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        best = np.full((len(broadcast.value[0]), k), np.inf, np.float32)
        for p in parts:
            for a in range(0, len(p), block):
                held.append(p.iloc[a : a + block])
                n += len(held[-1])
                if n >= block:
                    yield from scored(pd.concat(held), best)
                    held, n = [], 0
        if held:
            yield from scored(pd.concat(held), best)

    return table.select("vec_id", "codes", "norm").mapInPandas(run, f"query_id {id_type}, vec_id {id_type}, estimate double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", train: int = 16384, wave: int = 16384, beam: int = 4, keep: int = 128, size: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, by Euclidean distance.

    Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part;
    nor do null ids. Repeated ids: as queries the smallest vector counts, as candidates the nearest row. Ties go to the
    smaller id; a query is no candidate of its own; empty tables give no rows; other columns are not read. Queries are
    stated by the caller; they meet all rows in waves of ``wave`` queries (fewer where vectors are long: 8 MB of numbers), the
    only data that are broadcast. ``size`` is the number of code words to a codebook, a tenth of the sample at most.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    sample = rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(train).toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    lengths = sample.map(len)
    dims = int(lengths.mode().iloc[0])
    x = np.stack(sample[lengths == dims].to_numpy())
    book = fit(x, size=min(size, max(2, len(x) // 10)))
    slack_of = slack(x, book, k)
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():  # repeated rows would count as several near ones
        rows = rows.distinct()
    table = saved(index(rows, dims, book, beam), "vectors")
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dims).groupBy("vec_id").agg(F.min("v").alias("v"))
    waves = max(1, -(-asked.count() // min(wave, max(1, (2 << 20) // dims))))
    found = None
    for w in range(waves):
        part = (asked if waves == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w)).toPandas()
        if len(part):
            got = search(table, part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), book, k, slack_of, keep)
            found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score double")
    found = saved(found.groupBy("query_id", "vec_id").agg(F.min("estimate").alias("estimate")), "candidates")
    by_estimate = Window.partitionBy("query_id").orderBy("estimate", "vec_id")
    bound = found.withColumn("r", F.row_number().over(by_estimate)).where(F.col("r") <= k).groupBy("query_id").agg(F.max("estimate").alias("bound"))
    near = found.join(bound, "query_id").where(F.col("estimate") <= F.col("bound") + slack_of).select("query_id", "vec_id")
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    difference = F.zip_with(F.col("v"), F.col("q"), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    distance = F.sqrt(F.aggregate(difference, F.lit(0.0), lambda total, x: total + x))
    pairs = near.join(table.select("vec_id", "v"), "vec_id").join(q, "query_id").select("query_id", "vec_id", distance.alias("score"))
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
