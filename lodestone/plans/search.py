"""The search request: query, vectors, sorting, paging, rescoring, fusion, aggregations and the fetched fields."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vector import threshold_score
from lodestone.operators import collectors as col_ops
from lodestone.operators import facets as facet_ops
from lodestone.operators import fusion, highlight
from lodestone.operators.sort import SortField, after, order, sort_value
from lodestone.plans.query import Context, ExactVector, MatchAll, Query, scored_script, sure
from lodestone.plans.schema import Field, Index
from lodestone.registry import lookup


@dataclass(frozen=True)
class Knn:
    """The ``k`` nearest rows by the field's similarity, among those of ``filter``. Search is exact."""

    field_name: str
    vector: tuple[float, ...]
    k: int = 10
    num_candidates: int = 100
    filter: Query | None = None
    boost: float = 0.0
    threshold: float | None = None
    similarity: str | None = None

    def check(self) -> None:
        if not 1 <= self.k <= self.num_candidates <= 10000:
            raise ValueError("1 <= k <= num_candidates <= 10000 must hold")


@dataclass(frozen=True)
class Rescorer:
    """A second query (``query_weight * first + rescore_weight * second``), a script, or a plugin, over the best ``window``."""

    window: int
    query: Query | None = None
    script: object = None
    plugin: str | None = None
    query_weight: float = 1.0
    rescore_weight: float = 1.0
    params: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class InnerHits:
    """The best children of each hit."""

    path: str
    query: Query | None = None
    top_hits: int = 3
    start: int = 0
    sort: tuple[tuple[str, bool], ...] = ()  # (child field, reverse)


@dataclass(frozen=True)
class Retriever:
    """A named list for blending: a query or a knn search, with an optional first rescoring."""

    name: str
    query: Query | None = None
    knn: Knn | None = None
    top_hits: int = 10
    boost: float = 0.0
    rescorer: Rescorer | None = None


@dataclass(frozen=True)
class Request:
    query: Query | None = None
    query_text: str = ""
    knn: tuple[Knn, ...] = ()
    top_hits: int | None = 10  # None: every row that matches, in no order unless one is asked for
    start: int = 0
    sort: tuple[SortField, ...] = ()
    search_after: tuple | None = None  # (values, last id)
    retrieve: tuple[str, ...] = ()
    virtual: dict[str, object] = field(default_factory=dict)
    runtime: dict[str, object] = field(default_factory=dict)
    rescorers: tuple[Rescorer, ...] = ()
    retrievers: tuple[Retriever, ...] = ()
    blend: str = "rrf"
    blend_options: dict[str, object] = field(default_factory=dict)
    collectors: dict[str, object] = field(default_factory=dict)
    facets: dict[str, facet_ops.Facet] = field(default_factory=dict)
    inner_hits: dict[str, InnerHits] = field(default_factory=dict)
    highlights: dict[str, highlight.Highlight] = field(default_factory=dict)
    nested_path: str = ""
    terminate_after: int = 0
    fetch_tasks: tuple[str, ...] = ()
    log_hits: tuple[tuple[str, int], ...] = ()  # (registered logger, hits to log)


@dataclass
class Response:
    """``hits`` is lazy, as are the aggregations; ``total`` runs a count."""

    hits: DataFrame
    matched: DataFrame
    collectors: dict[str, DataFrame]
    facets: dict[str, DataFrame]

    def total(self) -> int:
        return self.matched.count()


def knn_hits(index: Index, k: Knn, boosted: bool = True) -> DataFrame:
    """``id, score`` of the nearest: one scan, scored in the JVM, then a bounded top-k."""
    k.check()
    x = Context(index)
    df, c = x.prepared(ExactVector(k.field_name, k.vector, k.similarity))
    keep = c.match
    if k.filter is not None:
        df, f = x.prepared(k.filter)
        keep = keep & f.match
    score = c.score
    top = df.where(keep).select(index.id, score.alias("score")).orderBy(F.desc("score"), index.id).limit(k.k)
    if k.threshold is not None:
        kind = k.similarity or index.field(k.field_name).vector_similarity
        top = top.where(F.col("score") >= threshold_score(kind, k.threshold))
    return top.withColumn("score", F.col("score") * k.boost) if boosted and k.boost > 0 else top


def nested_knn(index: Index, path: str, k: Knn) -> DataFrame:
    """The best child of each parent, then the ``k`` best parents."""
    k.check()
    x = Context(index)
    kids = x.column(path)
    df = index.df
    if k.filter is not None:
        df, f = x.prepared(k.filter)
        df = df.where(f.match)

    def one(item: Column) -> Column:
        c = ExactVector(k.field_name, k.vector, k.similarity).compile(x.child(path, item))
        return F.when(c.match, c.score)

    best = F.array_max(F.transform(kids, one))
    return df.select(index.id, best.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), index.id).limit(k.k)


def rescored(index: Index, hits: DataFrame, r: Rescorer, shared: dict[str, Column] | None = None) -> DataFrame:
    """``hits`` has all columns of the index and ``_score``; the best ``window`` come back in their new order."""
    window = hits.orderBy(F.desc("_score"), index.id).limit(r.window)
    if r.plugin:
        return lookup("rescorer", r.plugin)(window, index, dict(r.params))
    if r.query is not None:
        x = Context(index)
        x.index = index
        _, c = x.prepared(r.query)
        rows = Context(index.with_df(window)).with_tokens(sorted(x.used(r.query)))
        second = F.when(c.match, c.score * r.rescore_weight).otherwise(0.0)
        return rows.withColumn("_score", F.col("_score") * r.query_weight + second)
    x = Context(index, shared=shared)
    return window.withColumn("_score", scored_script(x, r.script, F.col("_score"), dict(r.params)))


def _fetch(index: Index, req: Request, hits: DataFrame, x: Context) -> DataFrame:
    names = [n for n, f in index.fields.items() if f.stored or f.doc_values] if req.retrieve == ("*",) else list(req.retrieve)
    out: dict[str, Column] = {}
    scored = Context(index, params=x.params, score=F.col("_score"))
    for n in names:
        f = index.field(n)
        if not (f.stored or f.doc_values or f.type in ("virtual", "runtime")):
            raise ValueError(f"{n} cannot be retrieved")
        if n != index.id:
            out[n] = scored.column(n)
    for n, source in (req.virtual | req.runtime).items():
        if n in index.fields and n not in names:
            out[n] = scored.script(source)
    for n, h in req.highlights.items():
        out[n] = highlight.column(x.column(h.field_name), h)
    for n, i in req.inner_hits.items():
        out[n] = inner_hits(x, i)
    extra = [c for c in ("retriever_scores", *(f"_s{i}" for i in range(len(req.sort)))) if c in hits.columns]
    return hits.select(F.col(index.id), F.col("_score").alias("score"), *[c.alias(n) for n, c in out.items()], *extra)


def inner_hits(x: Context, i: InnerHits) -> Column:
    """Array of the best children: by score, or by a child's fields; ties keep the order of the children."""
    kids = x.column(i.path)
    numbered = F.transform(kids, lambda k, n: F.struct(k.alias("child"), n.alias("n")))
    query = i.query or MatchAll()

    def scored(k: Column) -> Column:
        c = query.compile(x.child(i.path, k["child"]))
        return F.struct((c.score if not i.sort else F.lit(0.0)).alias("score"), k["n"].alias("n"), k["child"].alias("child"), c.match.alias("m"))

    hits = F.filter(F.transform(numbered, scored), lambda s: s["m"])

    def compare(a: Column, b: Column) -> Column:
        out = F.when(F.lit(False), 0)
        pairs = [(a["child"][n], b["child"][n], rev) for n, rev in i.sort] or [(a["score"], b["score"], True)]
        for p, q, rev in [*pairs, (a["n"], b["n"], False)]:
            out = out.when(p < q, 1 if rev else -1).when(p > q, -1 if rev else 1)
        return out.otherwise(0)

    best = F.slice(F.array_sort(hits, compare), i.start + 1, max(0, i.top_hits - i.start))
    return F.transform(best, lambda s: s["child"])


def _nested_index(index: Index, path: str) -> Index:
    """Children at ``path`` as documents of their own; ``_PARENT`` columns stay beside them."""
    f = index.field(path)
    rows = index.df.select(F.col(index.id), F.posexplode(f.column or path).alias("_child", "_kid")).select(index.id, "_child", "_kid.*")
    return Index(rows, {index.id: index.fields.get(index.id, Field("long")), "_child": Field("int"), **f.children}, index.id, f"{index.name}/{path}")


def search(index: Index, req: Request) -> Response:
    virtual = {n: Field("virtual", script=s) for n, s in req.virtual.items()}
    runtime = {n: Field("runtime", script=s) for n, s in req.runtime.items()}
    index = index.with_fields(virtual | runtime) if virtual or runtime else index
    if req.nested_path:
        index = _nested_index(index, req.nested_path)
    if req.retrievers:
        return _multi(index, req)
    query = req.query
    if req.query_text:
        from lodestone.plans.querystring import parse

        query = parse(req.query_text, index.text_fields)
    x = Context(index)
    near = None
    for k in req.knn:  # k rows each
        hits = knn_hits(index, k).withColumnRenamed("score", "_near")
        near = hits if near is None else near.unionByName(hits)
    if near is not None:
        near = F.broadcast(near.groupBy(index.id).agg(F.sum("_near").alias("_near")))
    if query is None and near is not None:
        found = index.df.join(near, index.id).withColumnRenamed("_near", "_score")
    else:
        df, c = x.prepared(query or MatchAll(), whole=near is not None)
        match, score = sure(c.match), c.score
        if req.terminate_after:
            first = df.where(match).orderBy(index.id).limit(req.terminate_after)
            if near is not None:  # what is near counts beyond the limit, too
                df = df.join(F.broadcast(first.select(index.id, F.lit(True).alias("_first"))), index.id, "left")
                match = match & F.col("_first").isNotNull()
            else:
                df = first
        if near is None:
            found = df.where(match).withColumn("_score", score)
        else:  # scores add where both find a document: one scan, no shuffle of the index
            total = F.when(match, score).otherwise(0.0) + F.coalesce("_near", F.lit(0.0))
            found = df.join(near, index.id, "left").where(match | F.col("_near").isNotNull()).withColumn("_score", total).drop("_near", "_first")
    cols = col_ops.collect(found, x, req.collectors)
    fcts = {n: facet_ops.facet(found, x, f) for n, f in req.facets.items()}
    hits = found
    for r in req.rescorers:
        hits = rescored(index, hits, r)
    names = [f"_s{i}" for i in range(len(req.sort))]
    if req.sort:
        hits = hits.withColumns({n: sort_value(x, s, F.col("_score")) for n, s in zip(names, req.sort)})
        if req.search_after:
            hits = hits.where(after(x, req.sort, names, *req.search_after))
        ranks = order(x, req.sort, names)
    else:
        if req.search_after:
            (last,), last_id = req.search_after
            hits = hits.where((F.col("_score") < last) | ((F.col("_score") == last) & (F.col(index.id) > last_id)))
        ranks = [F.desc("_score")]
    if req.top_hits is not None:
        page = hits.orderBy(*ranks, F.col(index.id)).limit(req.top_hits).offset(req.start)
    elif req.sort or req.start:
        page = hits.orderBy(*ranks, F.col(index.id)).offset(req.start)
    else:
        page = hits
    out = _fetch(index, req, page, x)
    for t in req.fetch_tasks:
        out = lookup("fetch_task", t)(out)
    for name, n in req.log_hits:
        lookup("hits_logger", name)(out.limit(n))
    return Response(out, found, cols, fcts)


def within(df: DataFrame, seconds: float) -> list:
    """Rows of ``df``, a page with its own limit, or ``TimeoutError`` when they take longer: the jobs are cancelled, and there are no partial results."""
    import threading
    import uuid

    context, group = df.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "search with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no answer within {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)


def _multi(index: Index, req: Request) -> Response:
    if req.query is not None or req.query_text or req.knn or req.sort:
        raise ValueError("retrievers exclude a query, text, vectors and sorting of the request itself")
    if req.top_hits is None:
        raise ValueError("blending needs top_hits")
    lists, union = [], None
    for r in req.retrievers:
        if r.knn is not None:
            hits = knn_hits(index, r.knn, boosted=False)
            all_of = hits
        else:
            if r.top_hits <= 0:
                raise ValueError("a text retriever needs top_hits above 0")
            x = Context(index)
            df, c = x.prepared(r.query or MatchAll())
            found = df.where(c.match).withColumn("_score", c.score)
            all_of = found.select(index.id, F.col("_score").alias("score"))
            if r.rescorer:
                found = rescored(index, found, r.rescorer)
            hits = found.select(index.id, F.col("_score").alias("score")).orderBy(F.desc("score"), index.id).limit(r.top_hits)
        lists.append(fusion.Ranked(r.name, hits, r.boost))
        union = all_of if union is None else union.unionByName(all_of)
    blended = fusion.blend(req.blend, lists, index.id, req.top_hits, req.start, **req.blend_options)
    x = Context(index)
    matched = index.df.join(union.groupBy(index.id).agg(F.sum("score").alias("_score")), index.id)
    hits = x.with_tokens([]).join(blended.withColumnRenamed("score", "_score"), index.id)
    for r in req.rescorers:
        shared = {f"retriever_{p.name}": F.try_element_at(F.col("retriever_scores"), F.lit(p.name)) for p in req.retrievers}
        hits = rescored(index, hits, r, shared)
    return Response(
        _fetch(index, replace(req, retrievers=()), hits, x),
        matched,
        col_ops.collect(matched, x, req.collectors),
        {n: facet_ops.facet(matched, x, f) for n, f in req.facets.items()},
    )
