"""Operators on small inline tables, each against values worked out by hand or by a second way."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.functions import analysis as an
from lodestone.functions import geo, vector
from lodestone.functions.script import compile_script, parse
from lodestone.operators.collectors import Filter, Metric, Plugin, Terms, TopHits, collect
from lodestone.operators.facets import Facet, facet
from lodestone.operators.highlight import Highlight, pieces
from lodestone.operators.sort import SortField
from lodestone.plans.query import (
    Bool, ConstantScore, Context, CrossIndex, Decay, DisMax, ExactVector, Exists, Function, FunctionScore, Fuzzy, GeoPolygon, Match, MatchAll, MatchPhrase, MinScore, MultiFunctionScore, MultiMatch, Nested, Phrase,
    Prefix, Range, SpanFuzzy, SpanNear, SpanTerm, Term, TermInSet, auto_edits,
)
from lodestone.plans.querystring import parse as parse_text
from lodestone.plans.schema import Field, Index, from_strings
from lodestone.plans.search import InnerHits, Knn, Request, Rescorer, Retriever, search
from lodestone.queries import QUERIES


@pytest.fixture(scope="module")
def shops(spark):
    rows = [
        (1, "first vendor and first review", ["red", "blue"], 3, [5, 1], True, [("ann", 30, 2.0), ("bob", 41, 3.0)], [1.0, 0.0], (10.0, 20.0)),
        (2, "second vendor", ["blue", "blue"], None, [], False, [("cid", 25, 1.0)], [0.6, 0.8], (11.0, 21.0)),
        (3, None, None, 7, None, None, None, None, None),
        (4, "vendor of a first class review for a vendor", ["green"], 7, [2, 9, 4], True, [], [0.0, 1.0], (-40.0, 170.0)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, name string, tags array<string>, count int, nums array<int>, open boolean, staff array<struct<who:string,age:int,pay:double>>, vec array<float>, place struct<lat:double,lon:double>")
    fields = {
        "doc_id": Field("long"), "name": Field("text"), "tags": Field("atom", multi=True), "count": Field("int"), "nums": Field("int", multi=True), "open": Field("boolean"), "vec": Field("vector", dimensions=2), "place": Field("lat_lon"),
        "staff": Field("object", nested=True, multi=True, children={"who": Field("atom"), "age": Field("int"), "pay": Field("double")}),
    }
    return Index(df, fields)


def found(ix, q):
    return sorted(r[0] for r in search(ix, Request(query=q)).matched.select(ix.id).collect())


def scores(ix, q, **more):
    return {r.doc_id: r.score for r in search(ix, Request(query=q, top_hits=100, **more)).hits.collect()}


@pytest.mark.parametrize(
    ("q", "ids"),
    [
        (MatchAll(), [1, 2, 3, 4]),
        (Term("name", "first"), [1, 4]),
        (Term("tags", "blue"), [1, 2]),
        (Term("open", "TRUE"), [1, 4]),
        (Term("nums", 9), [4]),
        (TermInSet("count", (3, 8)), [1]),
        (Range("count", 4, None), [3, 4]),
        (Range("nums", 4, 5, True), [1]),
        (Exists("nums"), [1, 4]),
        (Exists("name"), [1, 2, 4]),
        (Bool(must_not=(Term("tags", "blue"),)), [3, 4]),
        (Bool(should=(Term("name", "second"), Term("count", 7), Term("tags", "green")), minimum_should_match=2), [4]),
        (Bool(should=(Term("name", "second"),), minimum_should_match=2), []),
        (Prefix("name", "vend"), [1, 2, 4]),
        (Match("name", "FIRST class", "and"), [4]),
        (Match("name", "..."), []),
        (MatchPhrase("name", "...", zero_terms_all=True), [1, 2, 3, 4]),
        (Phrase("name", ("first", "vendor")), [1]),
        (Phrase("name", ("vendor", "first")), []),
        (Phrase("name", ("vendor", "first"), 2), [1, 4]),
        (Match("name", "frist", fuzzy=Fuzzy(1)), []),
        (Match("name", "frist", fuzzy=Fuzzy(1, transpositions=True)), [1, 4]),
        (SpanFuzzy("name", "secnd"), [2]),
        (SpanNear("name", (SpanTerm("name", "vendor"), SpanTerm("name", "review")), 4), [1, 4]),
        (SpanNear("name", (SpanTerm("name", "review"), SpanTerm("name", "vendor")), 2, False), [1, 4]),
        (SpanNear("name", (SpanTerm("name", "vendor"), SpanTerm("name", "first"), SpanTerm("name", "review")), 1), [1]),
        (Nested("staff", Bool(filter=(Range("age", 30, None), Range("pay", None, 2.5)))), [1]),
        (Nested("staff", Term("who", "cid")), [2]),
        (ExactVector("vec", (1.0, 0.0)), [1, 2, 4]),
    ],
)
def test_matches(shops, q, ids):
    assert found(shops, q) == ids


def test_phrases_do_not_cross_values(spark):
    df = spark.createDataFrame([(1, ["red apple", "pie crust"]), (2, ["red", "apple pie"])], "doc_id long, lines array<string>")
    ix = Index(df, {"doc_id": Field("long"), "lines": Field("text", multi=True)})
    assert found(ix, Phrase("lines", ("apple", "pie"))) == [2]
    assert found(ix, Phrase("lines", ("apple", "pie"), 100)) == [1, 2]
    assert found(ix, Term("lines", "crust")) == [1]


def test_bm25_by_hand(shops):
    n, lengths, tf = 3, {1: 5, 2: 2, 4: 9}, {1: 1, 2: 1, 4: 2}
    idf, average = math.log(1 + (n - 3 + 0.5) / 3.5), sum(lengths.values()) / 3
    want = {d: idf * tf[d] / (tf[d] + 1.2 * (0.25 + 0.75 * lengths[d] / average)) for d in lengths}
    got = scores(shops, Term("name", "vendor"))
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-12 for d in want)


def test_boolean_score_is_the_sum_of_its_clauses(shops):
    a, b = scores(shops, Term("name", "first")), scores(shops, Term("name", "review"))
    both = scores(shops, Bool(should=(Term("name", "first"), Term("name", "review"))))
    assert all(abs(both[d] - a.get(d, 0) - b.get(d, 0)) < 1e-12 for d in both)
    best = scores(shops, DisMax((Term("name", "first"), Term("name", "review")), 0.5))
    assert all(abs(best[d] - max(a[d], b[d]) - 0.5 * min(a[d], b[d])) < 1e-12 for d in best)


def test_constant_min_and_boost(shops):
    assert scores(shops, ConstantScore(Term("name", "first"), boost=3.0)) == {1: 3.0, 4: 3.0}
    assert scores(shops, Bool(must_not=(Term("name", "first"),))) == {2: 0.0, 3: 0.0}
    whole = scores(shops, Term("name", "first"))
    low, high = sorted(whole.values())
    assert len(scores(shops, MinScore(Term("name", "first"), (low + high) / 2, boost=100))) == 1
    for bad in (Term("name", "x", boost=-1), MinScore(None, 1), MinScore(MatchAll(), -1)):
        with pytest.raises(ValueError):
            found(shops, bad)


def test_scripts(spark, shops):
    one = spark.range(1)
    for source, value in (("1 + 2 * 3", 7), ("-(2 - 5)", 3), ("3 > 2 && !(1 > 2) ? 10 : 20", 10), ("max(1, min(5, 3)) + pow(2, 3)", 11), ("7 % 4", 3), ("6 & 3 | 8", 10), ("1 << 4", 16), ("sqrt(16) == 4", 1), ("logn(2, 8)", 3), ("1 / 0 == 0", 0)):
        got = one.select(compile_script(source, lambda n: F.lit(0))).first()[0]
        assert abs((got or 0) - value) < 1e-9, source
    for bad in ("1 +", "(1", "nothing(1)", "1 $ 2"):
        with pytest.raises(ValueError):
            compile_script(bad, lambda n: F.lit(0))
    assert parse("a.b")[0] == "name"
    got = scores(shops, FunctionScore(MatchAll(), "doc['nums'].length * 10 + doc['nums'].empty + nums + count.value"))
    assert got == {1: 24.0, 2: 1.0, 3: 8.0, 4: 39.0}


def test_multi_function_score(shops):
    q = MultiFunctionScore(ConstantScore(MatchAll()), (Function(2.0, Term("count", 7)), Function(3.0, Term("tags", "green"))))
    assert scores(shops, q) == {1: 1.0, 2: 1.0, 3: 2.0, 4: 6.0}
    total = MultiFunctionScore(ConstantScore(MatchAll()), q.functions, "sum", "sum", min_score=2.5)
    assert scores(shops, total) == {3: 3.0, 4: 6.0}
    assert scores(shops, MultiFunctionScore(ConstantScore(MatchAll()), ())) == dict.fromkeys((1, 2, 3, 4), 1.0)
    with pytest.raises(Exception, match="negative"):
        scores(shops, MultiFunctionScore(ConstantScore(MatchAll()), (Function(script="0 - 1"),)))
    far = scores(shops, MultiFunctionScore(ConstantScore(MatchAll()), (Function(decay=Decay("place", "exp", (10.0, 20.0), "200 km")),), boost_mode="replace"))
    assert far[1] == 1.0 and 0 < far[2] < 1 and far[3] == 0.0
    with pytest.raises(ValueError):
        scores(shops, MultiFunctionScore(MatchAll(), (Function(decay=Decay("place", "exp", (0, 0), "1 km", decay=1.0)),)))


def test_geography(shops):
    square = ((9.0, 19.0), (9.0, 22.0), (12.0, 22.0), (12.0, 19.0))
    hole = ((10.5, 20.5), (10.5, 21.5), (11.5, 21.5), (11.5, 20.5))
    assert found(shops, GeoPolygon("place", ((square, ()),))) == [1, 2]
    assert found(shops, GeoPolygon("place", ((square, (hole,)),))) == [1]
    with pytest.raises(ValueError):
        found(shops, GeoPolygon("place", ((square[:2], ()),)))
    assert geo.metres("2 km") == 2000 and geo.metres("1mi") == 1609.344 and geo.metres(5) == 5
    with pytest.raises(ValueError):
        geo.metres("far")


def test_vectors(shops):
    for kind, want in (("cosine", 0.8), ("dot_product", 0.8), ("l2_norm", 1 / 1.8), ("max_inner_product", 1.6)):
        assert abs(scores(shops, ExactVector("vec", (1.0, 0.0), kind))[2] - want) < 1e-6
    for bad in (lambda: vector.similarity("cosine", F.lit(1), [0.0, 0.0]), lambda: vector.similarity("dot_product", F.lit(1), [2.0]), lambda: vector.literal([float("nan")]), lambda: vector.similarity("none", F.lit(1), [1.0])):
        with pytest.raises(ValueError):
            bad()
    for bad in (Knn("vec", (1.0, 0.0), 0), Knn("vec", (1.0, 0.0), 20, 10)):
        with pytest.raises(ValueError):
            search(shops, Request(knn=(bad,)))
    hits = search(shops, Request(knn=(Knn("vec", (1.0, 0.0), 2, boost=2.0),))).hits.collect()
    assert [(r.doc_id, round(r.score, 6)) for r in hits] == [(1, 2.0), (2, 1.6)]


def test_cross_index(spark, shops):
    slots = spark.createDataFrame([(10, [1, 2], 5.0), (11, [1], 7.0), (12, [9], 1.0)], "slot long, shops array<long>, covers double")
    other = Index(slots, {"slot": Field("long"), "shops": Field("long", multi=True), "covers": Field("double")}, "slot")
    q = FunctionScore(Range("covers", 2, None), "covers")
    assert scores(shops, CrossIndex(other, "doc_id", "shops", q, "total")) == {1: 12.0, 2: 5.0}
    assert scores(shops, CrossIndex(other, "doc_id", "shops", q, "avg"))[1] == 6.0
    with pytest.raises(ValueError):
        found(shops, CrossIndex(other, "doc_id", "shops", q, max_terms=1))
    colours = Index(spark.createDataFrame([("red", 1.0), ("blue", 3.0), ("blue", 5.0)], "c string, w double"), {"c": Field("atom"), "w": Field("double")}, "c")
    weight = FunctionScore(MatchAll(), "w")
    assert scores(shops, CrossIndex(colours, "tags", "c", weight, "total")) == {1: 9.0, 2: 8.0}
    assert scores(shops, CrossIndex(colours, "tags", "c", weight, "avg")) == {1: 3.0, 2: 4.0}


def test_child_fields_index_a_value_anew(spark):
    df = spark.createDataFrame([(1, "Red Apples"), (2, "red")], "doc_id long, name string")
    ix = Index(df, {"doc_id": Field("long"), "name": Field("text", children={"keyword": Field("atom"), "english": Field("text", analyzer=an.ENGLISH)})})
    assert found(ix, Term("name.keyword", "Red Apples")) == [1]
    assert found(ix, Match("name.english", "apple")) == [1] and found(ix, Match("name", "apple")) == []


def test_time_limit(spark):
    from lodestone.plans.search import within

    assert len(within(spark.range(3), 60)) == 3
    slow = spark.range(10**12).where("id % 7 = 8").select(F.sum("id"))
    with pytest.raises(TimeoutError):
        within(slow, 1)
    assert spark.range(2).count() == 2


def order_of(ix, *sort, **more):
    return [r.doc_id for r in search(ix, Request(sort=sort, **more)).hits.collect()]


def test_sorting(shops):
    assert order_of(shops, SortField("count")) == [2, 1, 3, 4]
    assert order_of(shops, SortField("count", reverse=True)) == [3, 4, 1, 2]
    assert order_of(shops, SortField("count", missing_last=True)) == [1, 3, 4, 2]
    assert order_of(shops, SortField("count", reverse=True, missing_last=True)) == [2, 3, 4, 1]
    assert order_of(shops, SortField("nums", selector="max", reverse=True)) [:2] == [4, 1]
    assert order_of(shops, SortField("place", reverse=True, origin=(11.0, 21.0))) == [2, 1, 4, 3]
    assert order_of(shops, SortField("docid", reverse=True), start=1, top_hits=3) == [3, 2]
    for s in (SortField("count"), SortField("count", reverse=True), SortField("count", missing_last=True), SortField("count", True, True)):
        whole = search(shops, Request(sort=(s,))).hits.collect()
        for k, r in enumerate(whole[:-1]):
            rest = order_of(shops, s, search_after=((r["_s0"],), r.doc_id))
            assert rest == [x.doc_id for x in whole[k + 1 :]]
    for bad in (SortField("name"), SortField("nums", selector="middle_min"), SortField("place"), SortField("nothing")):
        with pytest.raises(ValueError):
            order_of(shops, bad)


def collected(ix, c, q=None):
    return search(ix, Request(query=q, collectors={"c": c})).collectors


def test_collectors(shops):
    rows = collected(shops, Terms("tags", 2))["c"].orderBy("rank").collect()
    assert [(r.key, r["count"], r.total_buckets, r.total_other_counts) for r in rows] == [("blue", 2, 3, 1), ("green", 1, 3, 1)]
    assert collected(shops, Terms("tags", 0))["c"].count() == 0
    rows = collected(shops, Terms("count", 5, order_by="s", ascending=True, nested={"s": Metric("sum", "doc_id")}))["c"].orderBy("rank").collect()
    assert [(r.key, r.s) for r in rows] == [(3, 1.0), (7, 7.0)]
    assert collected(shops, Metric("min", "count"), Term("doc_id", 99))["c"].first()[0] == 1.7976931348623157e308
    both = collected(shops, Filter(Range("count", 1, None), nested={"t": Terms("tags", 5), "m": Metric("max", "count")}))
    assert both["c"].first()["count"] == 3 and both["c"].first()["m"] == 7.0 and both["c>t"].count() == 3
    hits = collected(shops, Terms("open", 5, nested={"h": TopHits(1, sort=(SortField("docid", reverse=True),))}))["c>h"].collect()
    assert sorted((r.key, r.doc_id) for r in hits) == [(False, 2), (True, 4)]
    for bad in (Terms("tags", 3, order_by="none"), Filter(MatchAll()), "no collector"):
        with pytest.raises(ValueError):
            collected(shops, bad)


def test_plugins(shops):
    @registry.register("collector", "how_many")
    def how_many(df, x, params):
        return df.agg((F.count("*") * params["times"]).alias("n"))

    @registry.register("fetch_task", "mark")
    def mark(hits):
        return hits.withColumn("marked", F.lit(True))

    assert collected(shops, Plugin("how_many", {"times": 10}))["c"].first().n == 40
    assert search(shops, Request(fetch_tasks=("mark",))).hits.first().marked
    @registry.register("script", "twice")
    def twice(source, x, params):
        return x.column(source) * 2

    @registry.register("highlighter", "shout")
    def shout(text, h):
        return F.array(F.upper(text))

    logged = []
    registry.register("hits_logger", "keep")(lambda hits: logged.extend(r.doc_id for r in hits.collect()))
    row = search(shops, Request(query=FunctionScore(Term("doc_id", 2), ("twice", "doc_id")), highlights={"h": Highlight("name", (), plugin="shout")}, log_hits=(("keep", 1),))).hits.first()
    assert row.score == 4.0 and row.h == ["SECOND VENDOR"] and logged == [2]
    for bad in (lambda: registry.lookup("collector", "none"), lambda: registry.register("none", "x")):
        with pytest.raises(ValueError):
            bad()


def test_facets(shops):
    df = shops.df.withColumn("_score", F.lit(1.0))
    rows = facet(df, Context(shops), Facet("tags", 1)).collect()
    assert [(r.label, r["count"], r.value, r.child_count) for r in rows] == [("blue", 2, 3, 3)]
    with pytest.raises(ValueError):
        facet(df, Context(shops), Facet("tags"))


def test_fusion_against_brute_force(shops):
    two = (Retriever("t", Match("name", "first vendor"), boost=2.0), Retriever("v", knn=Knn("vec", (1.0, 0.0), 3)))
    text = sorted(scores(shops, Match("name", "first vendor")).items(), key=lambda x: (-x[1], x[0]))
    near = [1, 2, 4]
    want = {}
    for k, (d, _) in enumerate(text, 1):
        want[d] = want.get(d, 0) + 2 / (60 + k)
    for k, d in enumerate(near, 1):
        want[d] = want.get(d, 0) + 1 / (60 + k)
    hits = search(shops, Request(retrievers=two)).hits.collect()
    assert {r.doc_id: round(r.score, 12) for r in hits} == {d: round(s, 12) for d, s in want.items()}
    assert all(set(r.retriever_scores) <= {"t", "v"} for r in hits)
    again = search(shops, Request(retrievers=two, rescorers=(Rescorer(10, script="_shared_retriever_v * 100"),))).hits.collect()
    assert round({r.doc_id: r.score for r in again}[2], 4) == 80.0
    assert all(r.score == 0 for r in search(shops, Request(retrievers=two, blend="raw_merge")).hits.collect())
    for bad in (Request(query=MatchAll(), retrievers=two), Request(retrievers=(Retriever("t", MatchAll(), top_hits=0),))):
        with pytest.raises(ValueError):
            search(shops, bad)


def test_rescorers(shops):
    assert scores(shops, ConstantScore(MatchAll()), rescorers=(Rescorer(0, script="_score"),)) == {}
    got = scores(shops, ConstantScore(MatchAll()), rescorers=(Rescorer(4, ConstantScore(Term("tags", "blue")), query_weight=2.0, rescore_weight=5.0), Rescorer(3, script="_score + doc_id")))
    assert got == {1: 8.0, 2: 9.0, 3: 5.0}


def test_fetching(shops):
    r = Request(query=Term("doc_id", 1), retrieve=("*",), virtual={"v": "count * 2"}, runtime={"r": lambda x: F.upper(x.column("name"))})
    row = search(shops, r).hits.first()
    assert row.v == 6.0 and row.r.startswith("FIRST") and row.tags == ["red", "blue"]
    for bad in (Request(retrieve=("none",)), Request(virtual={"count": "1"})):
        with pytest.raises(ValueError):
            search(shops, bad)
    hits = search(shops, Request(query=Term("doc_id", 1), inner_hits={"s": InnerHits("staff", sort=(("pay", True),), top_hits=1)})).hits.first()
    assert [k.who for k in hits.s] == ["bob"]
    kids = search(shops, Request(query=Range("age", 30, None), nested_path="staff")).matched
    assert sorted(r.who for r in kids.collect()) == ["ann", "bob"]


def test_highlights():
    h = Highlight("t", ("vendor",), fragment_size=30, fragments=2)
    text = "A vendor sells. " + "filler words here " * 10 + "Another vendor buys, vendor!"
    out = pieces(text, h)
    assert len(out) == 2 and out[0].count("<em>vendor</em>") == 2
    assert pieces("nothing", h) == [] and pieces("", Highlight("t", ())) == []


def test_query_text(shops):
    def ids(text):
        return found(shops, parse_text(text, ["name"]))

    assert ids("first") == [1, 4] and ids('"first vendor"') == [1] and ids("+vendor -first") == [2]
    assert ids("second OR class") == [2, 4] and ids("vendor AND NOT second") == [1, 4]
    assert ids("tags:green") == [4] and ids("count:[4 TO *]") == [3, 4] and ids("count:{3 TO 8]") == [3, 4]
    assert ids("(second class) AND vendor") == [2, 4] and ids("vend*") == [1, 2, 4] and ids("secnd~1") == [2]
    with pytest.raises(ValueError):
        ids("a )")


def test_analysis(spark):
    def terms(a, text):
        return a.terms(text)

    assert terms(an.STANDARD, "Ab-c d1's") == ["ab", "c", "d1", "s"]
    assert terms(an.CLASSIC, "The U.S.A. and AT&T") == ["u.s.a", "at&t"]
    assert terms(an.Analyzer((an.html_strip,), an.standard_tokens), "<b>x</b> &amp; y") == ["x", "y"]
    assert terms(an.Analyzer((), an.keyword_tokens, (an.ngrams(2, 3),)), "abc") == ["ab", "abc", "bc"]
    assert terms(an.Analyzer((), an.standard_tokens, (an.shingle(2, False),)), "a b c") == ["a b", "b c"]
    assert terms(an.Analyzer((), an.standard_tokens, (an.shingle(3, False),)), "a b") == []
    assert terms(an.Analyzer((), an.whitespace_tokens, (an.ascii_folding,)), "Éß ñœ") == ["Ess", "noe"]
    assert terms(an.Analyzer((), an.standard_tokens, (an.plural_stem,)), "ponies horses glass bus cats") == ["pony", "horse", "glass", "bus", "cat"]
    assert terms(an.Analyzer((), an.standard_tokens, (an.synonyms("a,b|c,d", expand=False),)), "b d e") == ["a", "c", "e"]
    assert terms(an.Analyzer((an.mapping_rules(r"a=>b|b=>a"),), an.keyword_tokens), "ab") == ["ba"]
    assert terms(an.Analyzer((), an.path_tokens("/")), "a/b/c") == ["a", "a/b", "a/b/c"]
    assert terms(an.Analyzer((), an.pattern_tokens(",")), "a,,b") == ["a", "b"]
    assert terms(an.Analyzer((), an.url_email_tokens), "see http://x.org/a?b mail q@r.st") == ["see", "http://x.org/a?b", "mail", "q@r.st"]
    assert terms(an.Analyzer((), an.standard_tokens, (an.conditional(lambda t: t == "b", lambda ts: F.transform(ts, F.upper)),)), "a b") == ["a", "B"]
    for bad in (lambda: an.mapping_rules("ab"), lambda: an.synonyms("a")):
        with pytest.raises(ValueError):
            bad()
    assert [auto_edits(t) for t in ("ab", "abc", "abcdef", "éé")] == [0, 1, 2, 1]
    with pytest.raises(ValueError):
        auto_edits("a", 3, 3)


def test_string_documents(spark):
    def doc(**f):
        return ({k: list(v) for k, v in f.items()},)

    fields = {"doc_id": Field("long"), "n": Field("int"), "ok": Field("boolean"), "tags": Field("atom", multi=True), "at": Field("date_time"), "ms": Field("date_time", date_format="epoch_millis"), "place": Field("lat_lon"), "low": Field("atom", normalizer="lowercase"), "short": Field("atom", ignore_above=3), "v": Field("vector", dimensions=2)}

    def parsed(**f):
        return from_strings(spark.createDataFrame([doc(**f)], "fields map<string, array<string>>"), fields).df.first()

    row = parsed(doc_id=["1"], n=["2.9"], ok=["True"], tags=["a", "b"], at=["2020-01-02T03:04:05"], ms=["1000"], place=["1.5", "2.5"], low=["AbC"], short=["long"], v=["[1.0, 2.0]"])
    assert (row.n, row.ok, row.tags, row.low, row.short, row.v) == (2, True, ["a", "b"], "abc", None, [1.0, 2.0])
    assert row.at.isoformat() == "2020-01-02T03:04:05" and row.ms.isoformat() == "1970-01-01T00:00:01" and row.place.lon == 2.5
    for bad in ({"ok": ["yes"]}, {"n": ["1", "2"]}, {"place": ["1"]}, {"none": ["1"]}, {"v": ["[1.0]"]}, {"v": ["[0.0, 0.0]"]}):
        with pytest.raises(Exception):
            parsed(doc_id=["1"], **bad)


def test_validation(shops):
    for bad in (Term("none", 1), Term("vec", 1), TermInSet("open", (True,)), Range("count", 5, 1), Range("name", "a", None), Prefix("count", "1"), Phrase("tags", ("a", "b")), Nested("tags", MatchAll()), ExactVector("vec", (1.0,)), MultiMatch("x", ("tags",), "cross_fields")):
        with pytest.raises(ValueError):
            found(shops, bad)
    for name, f in (("1x", "int"), ("a_boost", "int")):
        with pytest.raises(ValueError):
            Index(shops.df, {name: Field(f)})
    with pytest.raises(ValueError):
        Field("none")


def test_collect_is_the_same_when_rows_are_shuffled(shops):
    moved = shops.with_df(shops.df.repartition(3))
    a = collect(shops.df.withColumn("_score", F.lit(1.0)), Context(shops), {"t": Terms("tags", 3)})["t"].collect()
    b = collect(moved.df.withColumn("_score", F.lit(1.0)), Context(moved), {"t": Terms("tags", 3)})["t"].collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_all_matches_are_fetched(spark, tmp_path):
    spark.range(1200).selectExpr("id AS doc_id", "concat('an idiot number ', id) AS text", "'en' AS lang", "'s' AS source", "20L AS n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["highlight_whole_field"](spark, str(tmp_path)).collect()
    assert len(got) == 1200 and all(r.marked == f"an <em>idiot</em> number {r.doc_id}" for r in got)
    df = spark.range(30).selectExpr("id AS doc_id", "id % 7 AS count")
    ix = Index(df, {"doc_id": Field("long"), "count": Field("int")})
    assert search(ix, Request(query=Range("count", 1, None), top_hits=None)).hits.count() == 25
    ids = [r.doc_id for r in search(ix, Request(query=MatchAll(), sort=(SortField("count"),), top_hits=None, start=2)).hits.collect()]
    assert ids == sorted(range(30), key=lambda i: (i % 7, i))[2:]


def test_marks_of_neighbouring_terms(spark, tmp_path):
    import duckdb

    from lodestone.operators.highlight import whole
    from lodestone.queries import SQL

    texts = ["idiot moron", "An Idiot idiot MORON, moron", "idiot\nmoron\n", "moron  idiot", "idiots moronidiot", "idiot", "\n\nmoron idiot\n\n", "\u00e9idiot moron\u00e9 idiot", "\U0001f600idiot\U0001f600moron", "idiot\r\nidiot\r\n", "moron\u2028", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["highlight_whole_field"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(SQL["highlight_whole_field"]).fetchall())
    h = Highlight("text", ("idiot", "moron"), fragments=0)  # by itself the operator marks every term
    assert df.where("doc_id = 0").select(whole(F.col("text"), h)).first()[0] == "<em>idiot</em> <em>moron</em>"


def test_all_orders_have_inner_hits(spark, tmp_path):
    n = 100_010
    spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "500000D AS o_totalprice", "DATE'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(n).selectExpr("id AS l_orderkey", "id AS l_partkey", "id AS l_suppkey", "1L AS l_linenumber", "20D AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax", "'R' AS l_returnflag", "'F' AS l_linestatus", "DATE'1995-01-01' AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert QUERIES["inner_hits"](spark, str(tmp_path)).count() == n


def test_fuzzy_terms_are_the_closest(spark, tmp_path):
    far = [f"{a}{b}oit" for a in "abcdefgh" for b in "abcefghk"]  # 64 terms two edits from idoit, all before it
    words = [*far, "idoit", "idiot", "zdoit"]
    df = spark.createDataFrame([(i, w, "en", "s", 5) for i, w in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars long")
    ix = Index(df, {"doc_id": Field("long"), "text": Field("text")})
    last = list(range(len(words)))
    assert {64, 66} <= set(found(ix, Match("text", "idoit", fuzzy=Fuzzy(2)))) and len(found(ix, Match("text", "idoit", fuzzy=Fuzzy(2)))) == 50
    assert found(ix, Match("text", "idoit", fuzzy=Fuzzy(2, max_expansions=2))) == [64, 66]
    assert found(ix, Match("text", "idoit", fuzzy=Fuzzy(2, max_expansions=3, transpositions=True))) == [64, 65, 66]
    assert found(ix, SpanFuzzy("text", "idoit", Fuzzy(2, max_expansions=2))) == [64, 66]
    assert found(ix, SpanFuzzy("text", "idoit", Fuzzy(2, max_expansions=None))) == last
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r.doc_id for r in QUERIES["match_fuzzy"](spark, str(tmp_path)).collect()) == last


def test_nested_collectors_of_any_depth_or_an_error(spark):
    from lodestone.operators.collectors import Filter, Metric, Plugin, Terms, TopHits

    rows = [(i, "abc"[i % 3], "xy"[i // 3 % 2], "pq"[i // 6 % 2], float(i)) for i in range(60)]
    ix = Index(spark.createDataFrame(rows, "id long, a string, b string, c string, v double"), {"id": Field("long"), "a": Field("atom"), "b": Field("atom"), "c": Field("atom"), "v": Field("double")}, "id")
    deep = Terms("a", 2, nested={"b": Terms("b", 2, nested={"c": Terms("c", 1, nested={"m": Metric("max", "v"), "h": TopHits(1)}), "f": Filter(Range("v", 30, None), nested={"n": Terms("c", 2)})})})
    got = search(ix, Request(query=MatchAll(), collectors={"t": deep})).collectors
    assert set(got) == {"t", "t>b", "t>b>c", "t>b>c>h", "t>b>f", "t>b>f>n"}
    mine = {(r.outer_key, r.outer2_key, r.key): (r["count"], r.m) for r in got["t>b>c"].collect()}
    for (a, b, c), (n, m) in mine.items():
        inside = [r for r in rows if r[1:4] == (a, b, c)]
        assert (len(inside), max(r[4] for r in inside)) == (n, m)
    assert {k[0] for k in mine} == {"a", "b"} and len(mine) == 4
    assert sum(r["count"] for r in got["t>b>f>n"].collect()) == sum(r["count"] for r in got["t>b>f"].collect()) == sum(r[4] >= 30 and r[1] in "ab" for r in rows)
    with pytest.raises(ValueError):
        search(ix, Request(query=MatchAll(), collectors={"t": Terms("a", nested={"p": Plugin("x")})}))


def test_hybrid_search_does_not_shuffle_the_index(spark):
    from lodestone.plans.search import Knn

    rows = [(i, [float(i), 1.0], "ab"[i % 2]) for i in range(50)]
    ix = Index(spark.createDataFrame(rows, "id long, v array<float>, k string"), {"id": Field("long"), "v": Field("vector", dimensions=2, vector_similarity="l2_norm"), "k": Field("atom")}, "id")
    answer = search(ix, Request(query=Term("k", "a"), knn=(Knn("v", [3.0, 1.0], 3, 10),)))
    found = {r.id: r._score for r in answer.matched.collect()}
    assert set(found) == {i for i in range(50) if i % 2 == 0} | {2, 3, 4} or len(found) == 27
    plan = answer.matched._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan


def test_too_many_clauses_are_an_error(spark):
    from lodestone.plans.query import Prefix

    ix = Index(spark.createDataFrame([(i, f"w{i}") for i in range(1100)], "id long, t string"), {"id": Field("long"), "t": Field("atom")}, "id")
    assert search(ix, Request(query=Prefix("t", "w1", "scoring_boolean"))).matched.count() > 100
    with pytest.raises(ValueError):
        search(ix, Request(query=Prefix("t", "w", "scoring_boolean"))).matched.count()


@pytest.mark.parametrize("n", [900, 1100])
def test_scoring_prefix_over_many_terms(spark, tmp_path, n):
    import duckdb

    from lodestone.queries import SQL

    rows = [(i, " ".join([f"Thoro{i:04d}"] * (1 + i % 3) + [f"thoro{i * 7 % n:04d}", "thor"] + ["word"] * (i % 5))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, f"thoro{n - 1:04d}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("prefix_scoring_boolean", "prefix_top_terms", "prefix_top_terms_boost", "prefix_top_terms_blended_freqs"):
        got = QUERIES[name](spark, str(tmp_path)).collect()
        assert [(r.doc_id, round(r.score, 5)) for r in got] == [(i, round(x, 5)) for i, x in duck.execute(SQL[name]).fetchall()]
    ix = Index(df, {"doc_id": Field("long"), "text": Field("text")})
    matched = search(ix, Request(query=Prefix("text", "thoro", "scoring_boolean", 1024))).matched
    assert matched.count() == len([r for r in rows if any(w < "thoro1024" for w in (r[1] or "").lower().split() if w.startswith("thoro"))])
    assert len(matched._jdf.queryExecution().optimizedPlan().toString()) < 100_000  # no clause for each term


def test_polygon_fields_meet_shapes_by_corners_and_edges(spark):
    from lodestone.plans.query import GeoBox, GeoRadius

    def ring(points):
        return [[float(x), float(y)] for y, x in [*points, points[0]]]

    shapes = {1: [ring([(0, 0), (0, 10), (10, 10), (10, 0)])], 2: [ring([(4, -20), (4, 30), (6, 30), (6, -20)])], 3: [ring([(0, 0), (0, 10), (10, 10), (10, 0)]), ring([(2, 2), (2, 8), (8, 8), (8, 2)])], 4: [ring([(50, 50), (50, 60), (60, 55)])], 5: None}
    import json

    df = spark.createDataFrame([(i, r and json.dumps({"type": "Polygon", "coordinates": r})) for i, r in shapes.items()], "id long, shape string")
    ix = Index(df, {"id": Field("long"), "shape": Field("polygon")}, "id")

    def found(q):
        return sorted(r.id for r in search(ix, Request(query=q)).matched.collect())

    assert found(GeoBox("shape", (6.5, 3.0), (3.5, 7.0))) == [1, 2]  # in 1, crossed by 2 without a corner, in the hole of 3
    assert found(GeoBox("shape", (80.0, -80.0), (-80.0, 80.0))) == [1, 2, 3, 4]
    assert found(GeoBox("shape", (6.0, 29.0), (4.0, -179.0))) == [2]
    assert found(GeoRadius("shape", (5.0, 5.0), "50 km")) == [1, 2]
    assert found(GeoRadius("shape", (5.0, 5.0), "400 km")) == [1, 2, 3]
    triangle = ((4.9, 4.0), (5.1, 4.0), (5.0, 6.0))
    assert found(GeoPolygon("shape", ((triangle, ()),))) == [1, 2]
    assert found(GeoPolygon("shape", ((((-30, -30), (-30, 45), (45, 45), (45, -30)), (((-25, -25), (-25, 40), (40, 40), (40, -25)),)),))) == []
