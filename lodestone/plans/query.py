"""The query tree. Each node compiles to two Columns over an index: does a document match, and with which score.

Compilation runs twice when scores need corpus statistics: the first pass notes the terms, one aggregation job reads
their document frequencies with all field lengths, the second pass puts the numbers in as literals. A missing value
never matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geo, vector
from lodestone.functions.analysis import NORMALIZERS, Analyzer
from lodestone.functions.script import compile_script
from lodestone.plans.schema import NUMERIC, Field, Index
from lodestone.registry import lookup

K1, B = 1.2, 0.75


class Compiled(NamedTuple):
    match: Column
    score: Column


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def once(c: Column) -> Column:
    """A column that the optimizer does not copy into what reads it: tokens are made once for a row, not once for each use.

    The condition always holds; depending on the row's place, it keeps filters and projections from taking the expression over.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def tokens_name(field_name: str) -> str:
    return "_tok_" + field_name.replace(".", "__")


class Context:
    """What compilation knows: the index, where its columns are, statistics, and joins that the query asked for."""

    def __init__(self, index: Index, root: Callable[[str], Column] | None = None, params: dict | None = None, shared: dict[str, Column] | None = None, score: Column | None = None):
        self.index, self.root, self.params, self.shared, self.score = index, root, params or {}, shared or {}, score
        self.wanted: set[tuple[str, str]] = set()
        self.lengths: set[str] = set()
        self.stats: dict | None = None
        self.known: dict[tuple, dict[str, int]] = {}
        self.joins: list[tuple[DataFrame, str, str]] = []
        self.parent: Context | None = None

    # columns

    def column(self, name: str) -> Column:
        f = self.index.field(name)
        if f.type in ("virtual", "runtime"):
            return self.script(f.script)
        at = f.column or name
        return self.root(at) if self.root else F.col(at)

    def tokens(self, name: str) -> Column:
        f = self.index.field(name)
        if f.type == "text":
            if self.root is None:
                return F.col(tokens_name(name))
            return f.analyzer.column(self.column(name))
        if f.type in ("atom", "_id"):
            c = self.column(name)
            return c if f.multi else F.array(c)
        raise ValueError(f"{name} has no terms")

    def with_tokens(self, names: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """The index, less rows that fail ``where``, with a column of tokens for each text field."""
        df = self.index.df if where is None else self.index.df.where(where)
        for n in self.index.text_fields if names is None else names:
            f = self.index.field(n)
            c = F.col(f.column or n)
            toks = f.analyzer.column(c)
            if f.multi:  # the values' tokens with a gap of nulls between, so that phrases do not cross
                gap = F.array_repeat(F.lit(None).cast("string"), f.analyzer.position_gap)
                toks = F.aggregate(F.transform(c, f.analyzer.column), F.array().cast("array<string>"), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.concat(a, gap, x)))
            df = df.withColumn(tokens_name(n), once(F.coalesce(toks, F.array().cast("array<string>"))))
        return df

    def script(self, source: object) -> Column:
        """A script as a Column: source text, a callable of this context, or (language, source) of a registered language."""
        if callable(source):
            return source(self)
        if isinstance(source, tuple):
            return lookup("script", source[0])(source[1], self, self.params)

        def resolve(name: str) -> Column:
            if name == "_score":
                return self.score if self.score is not None else F.lit(1.0)
            if name.startswith("_shared_") and name[8:] in self.shared:
                return F.coalesce(self.shared[name[8:]], F.lit(0.0))
            if name in self.params:
                v = self.params[name]
                return F.lit(float(v))
            part = ""
            if name.startswith("doc["):
                name, _, part = name[5:].partition(name[4] + "]")
            elif "." in name and name.rpartition(".")[2] in ("value", "length", "empty"):
                name, _, part = name.rpartition(".")
            part = part.lstrip(".")
            if name.startswith("_PARENT.") and self.parent:
                c, f = self.parent.column(name[8:]), self.parent.index.field(name[8:])
            else:
                c, f = self.column(name), self.index.field(name)
            many = f.multi
            if part == "length":
                return F.greatest(F.size(c), F.lit(0)) if many else c.isNotNull().cast("int")
            if part == "empty":
                return (F.greatest(F.size(c), F.lit(0)) == 0).cast("int") if many else c.isNull().cast("int")
            c = F.array_min(c) if many else c
            c = F.unix_millis(c.cast("timestamp")) if f.type == "date_time" else c
            return F.coalesce(c.cast("double"), F.lit(0.0))

        return compile_script(source, resolve)

    # statistics

    def prepared(self, query: Query, whole: bool = False) -> tuple[DataFrame, Compiled]:
        """The index with tokens and joined columns, and the query compiled over it. Rows that cannot match may be
        gone already, unless the ``whole`` index is asked for."""
        query.compile(self)
        self._count()
        self.joins = []
        compiled = query.compile(self)
        # what plain columns decide is filtered first, where the scan can use it
        df = self.with_tokens(sorted(self.used(query)), query.plain(self) if self.root is None and not whole else None)
        for n, (other, left, right) in enumerate(self.joins):
            df = df.join(other.select(F.col(right).alias(f"_k{n}"), F.col("score").alias(f"_x{n}")), F.col(left) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
        return df, compiled

    def used(self, query: Query) -> set[str]:
        return {n for n in query.fields(self) if self.index.field(n).type == "text"}

    def _count(self) -> None:
        if self.stats is not None and not (self.wanted - set(self.stats["df"])) and not (self.lengths - set(self.stats["n"])):
            return
        texts = [n for n in self.lengths if self.index.field(n).type == "text"]
        df = self.with_tokens(texts)
        aggs, keys = [], []
        for n in sorted(self.lengths):
            if n in texts:
                size = F.size(F.filter(F.col(tokens_name(n)), lambda t: t.isNotNull()))
                aggs += [F.count_if(size > 0), F.sum(size)]
            else:
                c = self.column(n)
                aggs += [F.count(c), F.count(c)]
            keys.append(("n", n))
        for n, term in sorted(self.wanted):
            has = F.array_contains(F.col(tokens_name(n)), term) if n in texts else self._has(n, term)
            aggs.append(F.count_if(sure(has)))
            keys.append(("df", (n, term)))
        self.stats = {"n": {}, "df": {}}
        if not aggs:
            return
        row = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())
        for kind, key in keys:
            if kind == "n":
                n, total = row.pop(0), row.pop(0)
                self.stats["n"][key] = (n, (total or 0) / n if n else 1.0)
            else:
                self.stats["df"][key] = row.pop(0)

    def _has(self, name: str, term: str) -> Column:
        f, c = self.index.field(name), self.column(name)
        if f.type == "boolean":
            return c == (term == "true")
        return F.array_contains(c, term) if f.multi else c == term

    def idf(self, name: str, term: str, df: float | None = None) -> float:
        """A frequency that is given is not counted."""
        self.lengths.add(name)
        if df is None:
            self.wanted.add((name, term))
        if self.stats is None or name not in self.stats["n"] or (df is None and (name, term) not in self.stats["df"]):
            return 1.0
        n, found = self.stats["n"][name][0], self.stats["df"][name, term] if df is None else df
        if self.index.field(name).similarity == "classic":
            return 1 + math.log((n + 1) / (found + 1))
        return math.log(1 + (n - found + 0.5) / (found + 0.5))

    def document_frequency(self, name: str, term: str) -> int:
        self.idf(name, term)
        return self.stats["df"].get((name, term), 0) if self.stats else 0

    def term_score(self, name: str, idf: float | Column, tf: Column) -> Column:
        """Score of a frequency under the field's similarity; a term without length norms counts as one in a text of one."""
        f = self.index.field(name)
        if f.similarity == "boolean":
            return F.lit(1.0)
        if f.type != "text":
            return F.lit(idf / (1 + K1))
        length = F.size(F.filter(self.tokens(name), lambda t: t.isNotNull())) if f.multi else F.size(self.tokens(name))
        if f.similarity == "classic":
            return F.lit(idf * idf) * F.sqrt(tf.cast("double")) / F.sqrt(length.cast("double"))
        if f.similarity != "bm25":
            return lookup("similarity", f.similarity)(idf, tf, length)
        average = self.stats["n"].get(name, (0, 1.0))[1] if self.stats else 1.0
        return F.lit(idf) * tf / (tf + K1 * ((1 - B) + B * length / F.lit(float(average or 1.0))))

    def term(self, name: str, term: str, df: float | None = None) -> Compiled:
        f = self.index.field(name)
        idf = self.idf(name, term, df)
        if f.type == "text":
            toks = self.tokens(name)
            return Compiled(F.array_contains(toks, term), self.term_score(name, idf, F.size(F.filter(toks, lambda t: t == term))))
        return Compiled(sure(self._has(name, term)), self.term_score(name, idf, F.lit(1)))

    def expand(self, name: str, test: Callable[[Column], Column], limit: int, rank: Callable[[Column], Column] | None = None) -> list[str]:
        """The first ``limit`` terms of the dictionary that pass, by ``rank`` if given and then in order: a distinct over the tokens, then a small collect."""
        df = self.with_tokens([name] if self.index.field(name).type == "text" else [])
        terms = df.select(F.explode(self.tokens(name)).alias("t")).where(test(F.col("t"))).distinct().orderBy(*([rank(F.col("t"))] if rank else []), "t").limit(limit)
        return [r[0] for r in terms.collect()]

    def dictionary(self, name: str, label: str, test: Callable[[Column], Column], limit: int) -> dict[str, int]:
        """The first ``limit`` terms that pass, with their document frequencies: one grouped aggregation, kept under ``label`` for the second pass."""
        key = (name, label, limit)
        if key not in self.known:
            df = self.with_tokens([name] if self.index.field(name).type == "text" else [])
            found = F.array_distinct(F.filter(self.tokens(name), lambda t: sure(test(t))))
            self.known[key] = {t: n for t, n in df.select(F.explode(found).alias("t")).groupBy("t").count().orderBy("t").limit(limit).collect()}
        return self.known[key]

    def child(self, path: str, item: Column) -> Context:
        f = self.index.field(path)
        kids = Index(self.index.df.select(F.explode(f.column or path).alias("c")).select("c.*"), f.children, self.index.id, path)
        c = Context(kids, root=lambda at: item[at], params=self.params)
        c.parent = self
        return c


@dataclass(frozen=True)
class Query:
    """``boost``: negative is an error, zero means none, otherwise it multiplies the score."""

    boost: float = field(default=0.0, kw_only=True)

    def compile(self, x: Context) -> Compiled:
        if self.boost < 0:
            raise ValueError("a boost must not be negative")
        match, score = self.build(x)
        return Compiled(match, score * self.boost if self.boost > 0 else score)

    def build(self, x: Context) -> Compiled:
        raise NotImplementedError

    def plain(self, x: Context) -> Column | None:
        """A condition on columns other than texts that every match meets; None where there is none to tell."""
        return None

    def fields(self, x: Context) -> set[str]:
        """Fields that the tree reads."""
        out = set()
        for v in self.__dict__.values():
            for q in v if isinstance(v, (list, tuple)) else [v]:
                if isinstance(q, Query):
                    out |= q.fields(x)
                elif isinstance(q, Function) and q.filter is not None:
                    out |= q.filter.fields(x)
        name = getattr(self, "field_name", None)
        if name:
            out.add(name)
        many = getattr(self, "field_names", None)
        if many is not None:
            out |= set(many) or set(x.index.text_fields)
        return out


ONE, ZERO = 1.0, 0.0


def constant(match: Column) -> Compiled:
    return Compiled(sure(match), F.lit(1.0))


@dataclass(frozen=True)
class MatchAll(Query):
    def build(self, x: Context) -> Compiled:
        return Compiled(F.lit(True), F.lit(1.0))


@dataclass(frozen=True)
class MatchNone(Query):
    def build(self, x: Context) -> Compiled:
        return Compiled(F.lit(False), F.lit(0.0))


def combine(must: list[Compiled], should: list[Compiled], filters: list[Column], nots: list[Column], least: int) -> Compiled:
    if not (must or should or filters or nots):
        return Compiled(F.lit(True), F.lit(1.0))
    match, score = F.lit(True), F.lit(0.0)
    for c in must:
        match, score = match & c.match, score + c.score
    for f in filters:
        match = match & f
    for n in nots:
        match = match & ~n
    if should and not (must or filters):
        least = max(least, 1)
    hits = F.lit(0)
    for c in should:
        score = score + F.when(c.match, c.score).otherwise(0.0)
        hits = hits + c.match.cast("int")
    if least > len(should):
        match = F.lit(False)
    elif least == 1 and should:
        any_of = should[0].match
        for c in should[1:]:
            any_of = any_of | c.match
        match = match & any_of
    elif least > 1:
        match = match & (hits >= least)
    return Compiled(match, score)


@dataclass(frozen=True)
class Bool(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    minimum_should_match: int = 0

    def build(self, x: Context) -> Compiled:
        return combine([q.compile(x) for q in self.must], [q.compile(x) for q in self.should], [q.compile(x).match for q in self.filter], [q.compile(x).match for q in self.must_not], self.minimum_should_match)

    def plain(self, x: Context) -> Column | None:
        out = None
        for q in (*self.must, *self.filter):
            p = q.plain(x)
            if p is not None:
                out = p if out is None else out & p
        return out


def typed(f: Field, value: object) -> Column:
    """A literal of the field's type from a value or from text."""
    if f.type == "date_time":
        return F.timestamp_millis(F.lit(int(value))).cast("timestamp_ntz") if f.date_format == "epoch_millis" else F.lit(str(value)).cast("timestamp_ntz")
    if f.type in ("atom", "_id") and f.normalizer:
        return NORMALIZERS[f.normalizer](F.lit(value))
    kinds = {"int": int, "long": int, "float": float, "double": float, "boolean": lambda v: v if isinstance(v, bool) else str(v).lower() == "true"}
    return F.lit(kinds.get(f.type, str)(value))


def raw_value(c: Column, f: Field, test: Callable[[Column], Column]) -> Column:
    """The test on a value, or on any of several; null where there is none, so that a filter by it can reach the scan."""
    return F.exists(c, test) if f.multi else test(c)


def any_value(c: Column, f: Field, test: Callable[[Column], Column]) -> Column:
    return sure(raw_value(c, f, test))


@dataclass(frozen=True)
class Term(Query):
    """Exact value. Texts, atoms, ids and booleans are scored as terms, numbers and dates as a constant."""

    field_name: str
    value: object

    def plain(self, x: Context) -> Column | None:
        return None if x.index.field(self.field_name).type in ("text", "virtual", "runtime") else self.condition(x)

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.field_name)
        if f.type in ("text", "atom", "_id"):
            v = self.value
            if f.normalizer == "lowercase":
                v = v.lower()
            return x.term(self.field_name, v)
        if f.type == "boolean":
            return x.term(self.field_name, str(self.value).lower())
        if f.type not in (*NUMERIC, "date_time"):
            raise ValueError(f"no term query on {f.type}")
        return constant(self.condition(x))

    def condition(self, x: Context) -> Column:
        f = x.index.field(self.field_name)
        v = typed(f, self.value)
        return raw_value(x.column(self.field_name), f, lambda c: c == v)


@dataclass(frozen=True)
class TermInSet(Query):
    field_name: str
    values: tuple

    def plain(self, x: Context) -> Column | None:
        return None if x.index.field(self.field_name).type in ("text", "virtual", "runtime") else self.condition(x)

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.field_name)
        if f.type not in (*NUMERIC, "text", "atom", "_id", "date_time"):
            raise ValueError(f"no set query on {f.type}")
        if f.type == "text":
            return constant(F.arrays_overlap(x.tokens(self.field_name), F.array(*[typed(f, v) for v in self.values])))
        return constant(self.condition(x))

    def condition(self, x: Context) -> Column:
        f = x.index.field(self.field_name)
        values = [typed(f, v) for v in self.values]
        return raw_value(x.column(self.field_name), f, lambda c: c.isin(*values))


@dataclass(frozen=True)
class Range(Query):
    """Bounds are read by the field's type; None is open; a lower above the upper bound is an error."""

    field_name: str
    lower: object = None
    upper: object = None
    lower_exclusive: bool = False
    upper_exclusive: bool = False

    def plain(self, x: Context) -> Column | None:
        return None if x.index.field(self.field_name).type in ("text", "virtual", "runtime") else self.condition(x)

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.field_name)
        if f.type not in (*NUMERIC, "date_time", "atom", "_id"):
            raise ValueError(f"no range query on {f.type}")
        number = float if f.type in NUMERIC else str
        if self.lower is not None and self.upper is not None and number(self.lower) > number(self.upper):
            raise ValueError("the lower bound is above the upper one")
        return constant(self.condition(x))

    def condition(self, x: Context) -> Column:
        f = x.index.field(self.field_name)

        def inside(c: Column) -> Column:
            ok = c.isNotNull()
            if self.lower is not None:
                low = typed(f, self.lower)
                ok = ok & (c > low if self.lower_exclusive else c >= low)
            if self.upper is not None:
                high = typed(f, self.upper)
                ok = ok & (c < high if self.upper_exclusive else c <= high)
            return ok

        return raw_value(x.column(self.field_name), f, inside)


@dataclass(frozen=True)
class Exists(Query):
    field_name: str

    def plain(self, x: Context) -> Column | None:
        return None if x.index.field(self.field_name).type in ("text", "virtual", "runtime") else self.condition(x)

    def build(self, x: Context) -> Compiled:
        return constant(self.condition(x))

    def condition(self, x: Context) -> Column:
        f, c = x.index.field(self.field_name), x.column(self.field_name)
        return c.isNotNull() & (F.size(c) > 0) if f.multi else c.isNotNull()


#: Most clauses of a query over terms that are found in the dictionary.
CLAUSES = 1024
#: Terms of the rewrites by top terms, where a query gives no number.
TOP_TERMS = 50
REWRITES = ("constant_score", "constant_score_boolean", "scoring_boolean", "top_terms_blended_freqs", "top_terms_boost", "top_terms")


def any_of(x: Context, name: str, test: Callable[[Column], Column], terms: dict[str, float], score: Callable[[Column, Column], Column]) -> Compiled:
    """Terms with their numbers as clauses of one disjunction; ``score`` takes a term's number and its frequency in the row.

    The expression is as large for a thousand terms as for one: tokens become places in a list of the terms, and each
    place found in a row adds its score, in order.
    """
    words, numbers = F.array(*map(F.lit, terms)), F.array(*map(F.lit, terms.values()))
    toks = x.tokens(name)
    passed = F.filter(toks, lambda t: sure(test(t)))
    hits = F.filter(F.transform(passed, lambda t: F.array_position(words, t)), lambda p: p > 0)

    def total(places: Column) -> Column:
        return F.aggregate(F.array_sort(F.array_distinct(places)), F.lit(0.0), lambda a, p: a + score(F.get(numbers, (p - 1).cast("int")), F.size(F.filter(places, lambda q: q == p))))

    return Compiled(sure(F.exists(toks, lambda t: sure(test(t)) & F.array_contains(words, t))), F.coalesce(let(hits, total), F.lit(0.0)))


def rewritten(x: Context, name: str, label: str, test: Callable[[Column], Column], rewrite: str, top: int | None) -> Compiled:
    """A query over all terms that pass ``test``, by one of the six rewrite methods."""
    if rewrite not in REWRITES:
        raise ValueError(f"unknown rewrite: {rewrite}")
    if rewrite.startswith("constant"):
        return constant(F.exists(x.tokens(name), lambda t: sure(test(t))))
    terms = x.dictionary(name, label, test, top if top is not None else CLAUSES + 1 if rewrite == "scoring_boolean" else TOP_TERMS)
    if rewrite == "scoring_boolean" and len(terms) > CLAUSES:
        raise ValueError(f"more than {CLAUSES} terms of {name} would be clauses; use another rewrite, or ask for the first so many")
    if not terms:
        return MatchNone().build(x)
    if rewrite == "top_terms_boost":
        return any_of(x, name, test, dict.fromkeys(terms, 1.0), lambda one, tf: one)
    shared = max(terms.values()) if rewrite == "top_terms_blended_freqs" else None
    found = {t: n if shared is None else shared for t, n in terms.items()}
    if x.index.field(name).similarity not in ("bm25", "classic", "boolean"):  # an extension takes a number, not a column
        return combine([], [x.term(name, t, n) for t, n in found.items()], [], [], 1)
    return any_of(x, name, test, {t: x.idf(name, t, n) for t, n in found.items()}, lambda idf, tf: x.term_score(name, idf, tf))


@dataclass(frozen=True)
class Prefix(Query):
    """Terms that start alike. A scoring rewrite takes the first ``top_terms`` of the dictionary; ``scoring_boolean`` takes
    all if no number is given, and more than ``CLAUSES`` are an error."""

    field_name: str
    prefix: str
    rewrite: str = "constant_score"
    top_terms: int | None = None

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.field_name)
        if f.type not in ("text", "atom", "_id"):
            raise ValueError(f"no prefix query on {f.type}")
        p = self.prefix.lower() if f.normalizer == "lowercase" else self.prefix
        return rewritten(x, self.field_name, p, lambda t: F.startswith(t, F.lit(p)), self.rewrite, self.top_terms)


def positions(toks: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(toks, lambda t, i: F.when(test(t), i)), lambda i: i.isNotNull())


def phrase(x: Context, name: str, terms: list[str], slop: int = 0) -> Compiled:
    """Terms in order. With slop, the terms' places less their places in the phrase spread by ``slop`` at most."""
    if x.index.field(name).type != "text":
        raise ValueError("a phrase needs a text field")
    if not terms:
        return MatchNone().build(x)
    if len(terms) == 1:
        return x.term(name, terms[0])
    toks, n = x.tokens(name), len(terms)
    idf = sum(x.idf(name, t) for t in terms)
    if slop == 0:

        def here(t: Column, i: Column) -> Column:
            ok = t == terms[0]
            for k, w in enumerate(terms[1:], 1):
                ok = ok & (F.get(toks, i + k) == w)
            return ok

        tf = F.size(F.filter(toks, here))
        match = F.array_contains(toks, terms[0])
        for t in terms[1:]:  # cheap tests first
            match = match & F.array_contains(toks, t)
        return Compiled(sure(match & (tf > 0)), x.term_score(name, idf, tf))

    def places_of(word: str, k: int) -> Column:
        return F.transform(positions(toks, lambda t: t == word), lambda i: i - k)

    places = [places_of(w, k) for k, w in enumerate(terms)]

    n = let(F.array(*places), lambda all_of: F.size(F.filter(F.array_distinct(F.flatten(all_of)), lambda m: F.forall(all_of, lambda p: F.exists(p, lambda a: (a >= m) & (a <= m + slop))))))
    match = F.array_contains(toks, terms[0])
    for t in terms[1:]:
        match = match & F.array_contains(toks, t)
    return Compiled(sure(match & (n > 0)), x.term_score(name, idf, n))


@dataclass(frozen=True)
class Phrase(Query):
    field_name: str
    terms: tuple[str, ...]
    slop: int = 0

    def build(self, x: Context) -> Compiled:
        return phrase(x, self.field_name, list(self.terms), self.slop)


def analysed(x: Context, name: str, text: str, analyzer: Analyzer | None = None) -> list[str]:
    f = x.index.field(name)
    if f.type != "text":
        if f.type in ("atom", "_id"):
            return [text.lower() if f.normalizer == "lowercase" else text]
        raise ValueError(f"{name} is no text")
    return (analyzer or f.search_analyzer or f.analyzer).terms(text)


def fuzzy_test(term: str, edits: int, prefix: int = 0, transpositions: bool = False) -> Callable[[Column], Column]:
    """Tokens within ``edits`` of a term that share its first ``prefix`` characters; a swap of neighbours may count as one edit."""
    q = F.lit(term)

    def test(t: Column) -> Column:
        near = (F.abs(F.length(t) - len(term)) <= edits) & (F.levenshtein(t, q) <= edits)
        if transpositions and edits:
            swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.levenshtein(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(1)), F.substring(t, i, F.lit(1)), F.substring(t, i + 2, F.length(t))), q) <= edits - 1)
            near = near | (F.abs(F.length(t) - len(term)) <= edits) & swapped
        return near & F.startswith(t, F.lit(term[:prefix])) if prefix else near

    return test


def fuzzy_rank(term: str, edits: int, transpositions: bool = False) -> Callable[[Column], Column]:
    """The fewest edits, up to ``edits``, by which a token passes ``fuzzy_test``."""

    def rank(t: Column) -> Column:
        out = F.when(t == term, 0)
        for n in range(1, edits):
            out = out.when(fuzzy_test(term, n, 0, transpositions)(t), n)
        return out.otherwise(edits)

    return rank


def auto_edits(term: str, low: int = 3, high: int = 6) -> int:
    """0, 1 or 2 edits by the term's bytes."""
    if low < 0 or low >= high:
        raise ValueError("automatic fuzziness needs 0 <= low < high")
    n = len(term.encode())
    return 0 if n < low else 1 if n < high else 2


@dataclass(frozen=True)
class Fuzzy:
    """Options of fuzzy matching; ``edits`` None is automatic.

    The closest ``max_expansions`` terms count; with None every term within the edits does, at a constant score.
    """

    edits: int | None = None
    prefix_length: int = 0
    max_expansions: int | None = 50
    transpositions: bool = False
    low: int = 3
    high: int = 6

    def of(self, term: str) -> int:
        return auto_edits(term, self.low, self.high) if self.edits is None else self.edits


@dataclass(frozen=True)
class Match(Query):
    """Analysed text: any term, or with ``operator`` "and" all of them. An analysis without terms matches nothing."""

    field_name: str
    text: str
    operator: str = "or"
    minimum_should_match: int = 0
    analyzer: Analyzer | None = None
    fuzzy: Fuzzy | None = None

    def build(self, x: Context) -> Compiled:
        terms = analysed(x, self.field_name, self.text, self.analyzer)
        if not terms:
            return MatchNone().build(x)
        one = [self._one(x, t) for t in terms]
        return combine(one, [], [], [], 0) if self.operator == "and" else combine([], one, [], [], self.minimum_should_match)

    def _one(self, x: Context, term: str) -> Compiled:
        if self.fuzzy is None or not (edits := self.fuzzy.of(term)):
            return x.term(self.field_name, term)
        test = fuzzy_test(term, edits, self.fuzzy.prefix_length, self.fuzzy.transpositions)
        if self.fuzzy.max_expansions is None:
            return constant(F.exists(x.tokens(self.field_name), lambda t: sure(test(t))))
        terms = x.expand(self.field_name, test, self.fuzzy.max_expansions, fuzzy_rank(term, edits, self.fuzzy.transpositions))
        return combine([], [x.term(self.field_name, t) for t in terms], [], [], 1) if terms else MatchNone().build(x)


@dataclass(frozen=True)
class MatchPhrase(Query):
    field_name: str
    text: str
    slop: int = 0
    analyzer: Analyzer | None = None
    zero_terms_all: bool = False

    def build(self, x: Context) -> Compiled:
        terms = analysed(x, self.field_name, self.text, self.analyzer)
        if not terms:
            return (MatchAll() if self.zero_terms_all else MatchNone()).build(x)
        return phrase(x, self.field_name, terms, self.slop)


@dataclass(frozen=True)
class MatchPhrasePrefix(Query):
    """A phrase whose last term is a prefix, expanded to the first ``max_expansions`` terms of the dictionary."""

    field_name: str
    text: str
    max_expansions: int = 50
    analyzer: Analyzer | None = None

    def build(self, x: Context) -> Compiled:
        terms = analysed(x, self.field_name, self.text, self.analyzer)
        if not terms:
            return MatchNone().build(x)
        *head, last = terms
        found = x.expand(self.field_name, lambda t: F.startswith(t, F.lit(last)), self.max_expansions)
        if not found:
            return MatchNone().build(x)
        toks, n = x.tokens(self.field_name), len(terms)
        idf = sum(x.idf(self.field_name, t) for t in head) + sum(x.idf(self.field_name, t) for t in found)
        ends = positions(toks, lambda t: t.isin(found))
        if head:
            wanted = F.array(*map(F.lit, head))
            ends = F.filter(ends, lambda i: (i >= n - 1) & (F.slice(toks, F.greatest(i - n + 2, F.lit(1)), n - 1) == wanted))
        tf = F.size(ends)
        return Compiled(sure(tf > 0), x.term_score(self.field_name, idf, tf))


def dis_max(parts: list[Compiled], tie: float = 0.0) -> Compiled:
    """The best score and ``tie`` times the others."""
    if not parts:
        return Compiled(F.lit(False), F.lit(0.0))
    scores = [F.when(c.match, c.score).otherwise(0.0) for c in parts]
    match, total = parts[0].match, scores[0]
    for c, s in zip(parts[1:], scores[1:]):
        match, total = match | c.match, total + s
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return Compiled(match, best + tie * (total - best) if tie else best)


@dataclass(frozen=True)
class DisMax(Query):
    queries: tuple[Query, ...]
    tie: float = 0.0

    def build(self, x: Context) -> Compiled:
        return dis_max([q.compile(x) for q in self.queries], self.tie)


@dataclass(frozen=True)
class MultiMatch(Query):
    """One text over several fields (all text fields if none are named).

    ``best_fields`` and ``phrase_prefix`` take the best field and ignore the tie; ``cross_fields`` looks for each term in all
    fields with blended document frequencies and uses it.
    """

    text: str
    field_names: tuple[str, ...] = ()
    kind: str = "best_fields"
    boosts: tuple[tuple[str, float], ...] = ()
    operator: str = "or"
    minimum_should_match: int = 0
    tie: float = 0.0
    slop: int = 0

    def build(self, x: Context) -> Compiled:
        names = list(self.field_names) or x.index.text_fields
        boosts = dict(self.boosts)
        if any(b < 0 for b in boosts.values()):
            raise ValueError("a boost must not be negative")
        if self.kind == "cross_fields":
            return self._cross(x, names, boosts)
        if self.kind == "best_fields":
            parts = [Match(n, self.text, self.operator, self.minimum_should_match, boost=boosts.get(n, 0.0)) for n in names]
        elif self.kind == "phrase_prefix":
            parts = [MatchPhrasePrefix(n, self.text, boost=boosts.get(n, 0.0)) for n in names]
        else:
            raise ValueError(f"unknown kind: {self.kind}")
        return dis_max([p.compile(x) for p in parts])

    def _cross(self, x: Context, names: list[str], boosts: dict[str, float]) -> Compiled:
        if any(x.index.field(n).type != "text" for n in names):
            raise ValueError("cross fields needs text fields")
        terms = analysed(x, names[0], self.text)
        clauses = []
        for t in terms:
            dfs = {n: x.document_frequency(n, t) for n in names}
            # all fields share the highest frequency, one more for each strictly lower step down
            blended, now, last = {}, max(dfs.values()), None
            for n in sorted(names, key=lambda n: -dfs[n]):
                if last is not None and dfs[n] < last:
                    now += 1
                last = dfs[n]
                blended[n] = now
            parts = [x.term(n, t, blended[n]) for n in names]
            clauses.append(dis_max([Compiled(c.match, c.score * boosts[n] if boosts.get(n) else c.score) for c, n in zip(parts, names)], self.tie))
        if not clauses:
            return MatchNone().build(x)
        if self.operator == "and":
            return combine(clauses, [], [], [], 0)
        return combine([], clauses, [], [], min(self.minimum_should_match, len(clauses)))


@dataclass(frozen=True)
class ConstantScore(Query):
    filter: Query

    def build(self, x: Context) -> Compiled:
        return constant(self.filter.compile(x).match)


@dataclass(frozen=True)
class MinScore(Query):
    query: Query | None
    minimum: float

    def build(self, x: Context) -> Compiled:
        if self.query is None or self.minimum < 0:
            raise ValueError("a minimum score needs a query and must not be negative")
        c = self.query.compile(x)
        return c if self.minimum == 0 else Compiled(c.match & (c.score >= self.minimum), c.score)


def scored_script(x: Context, script: object, score: Column | None, params: dict | None = None) -> Column:
    inner = Context(x.index, x.root, {**x.params, **(params or {})}, x.shared, score)
    inner.parent = x.parent
    return inner.script(script)


@dataclass(frozen=True)
class FunctionScore(Query):
    """The inner query's score replaced by a script that sees it as ``_score``."""

    query: Query
    script: object
    params: tuple[tuple[str, object], ...] = ()

    def build(self, x: Context) -> Compiled:
        c = self.query.compile(x)
        return Compiled(c.match, scored_script(x, self.script, c.score, dict(self.params)))


@dataclass(frozen=True)
class FunctionFilter(Query):
    script: object
    params: tuple[tuple[str, object], ...] = ()

    def build(self, x: Context) -> Compiled:
        v = scored_script(x, self.script, F.lit(1.0), dict(self.params))
        return Compiled(sure(v > 0), v)


@dataclass(frozen=True)
class Decay:
    """Score by distance from ``origin``: ``exp``, ``linear`` or ``gauss``; a missing point scores 0."""

    field_name: str
    kind: str
    origin: tuple[float, float]
    scale: str
    offset: str = "0"
    decay: float = 0.5

    def column(self, x: Context) -> Column:
        if not 0 < self.decay < 1:
            raise ValueError("a decay lies between 0 and 1")
        f = x.index.field(self.field_name)
        if f.type != "lat_lon" or f.multi:
            raise ValueError("decay needs one point")
        p = x.column(self.field_name)
        s = geo.metres(self.scale)
        away = geo.haversine(p["lat"], p["lon"], *self.origin) - geo.metres(self.offset)
        far = F.when(away > 0, away).when(away.isNotNull(), 0.0)
        if self.kind == "exp":
            v = F.exp(math.log(self.decay) / s * far)
        elif self.kind == "linear":
            s = s / (1 - self.decay)
            v = F.when(far < s, (s - far) / s).otherwise(0.0)
        elif self.kind == "gauss":
            v = F.exp(-far * far / (2 * (-(s * s) / (2 * math.log(self.decay)))))
        else:
            raise ValueError(f"unknown decay: {self.kind}")
        return F.coalesce(v, F.lit(0.0))


@dataclass(frozen=True)
class Function:
    """``script``, ``decay`` or the weight alone, for documents of ``filter``."""

    weight: float = 0.0
    filter: Query | None = None
    script: object = None
    decay: Decay | None = None
    params: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class MultiFunctionScore(Query):
    query: Query
    functions: tuple[Function, ...] = ()
    score_mode: str = "multiply"
    boost_mode: str = "multiply"
    min_score: float = 0.0
    min_excluded: bool = False

    def build(self, x: Context) -> Compiled:
        if self.min_score < 0:
            raise ValueError("a minimum score must not be negative")
        c = self.query.compile(x)
        score = c.score
        if self.functions:
            total, matched = F.lit(1.0 if self.score_mode == "multiply" else 0.0), F.lit(False)
            for f in self.functions:
                v = f.decay.column(x) if f.decay else scored_script(x, f.script, c.score, dict(f.params)) if f.script is not None else F.lit(1.0)
                v = v * (f.weight or 1.0)
                on = f.filter.compile(x).match if f.filter else F.lit(True)
                total = F.when(on, total * v if self.score_mode == "multiply" else total + v).otherwise(total)
                matched = matched | on
            total = F.when(matched, total).otherwise(1.0)
            score = {"multiply": c.score * total, "sum": c.score + total, "replace": total}[self.boost_mode]
            score = F.when(~c.match, 0.0).when((score < 0) | F.isnan(score), F.raise_error(F.lit("a function score is negative or not a number"))).otherwise(score)
        if self.min_score > 0 or self.min_excluded:
            keep = score > self.min_score if self.min_excluded else score >= self.min_score
            return Compiled(c.match & keep, score)
        return Compiled(c.match, score)


@dataclass(frozen=True)
class GeoBox(Query):
    field_name: str
    top_left: tuple[float, float]
    bottom_right: tuple[float, float]

    def build(self, x: Context) -> Compiled:
        (top, left), (bottom, right) = self.top_left, self.bottom_right
        if x.index.field(self.field_name).type == "polygon":  # a box over the date line is two
            parts = [(left, right)] if left <= right else [(left, 180.0), (-180.0, right)]
            polygon, out = geo.rings(x.column(self.field_name)), F.lit(False)
            for west, east in parts:
                ring = [(top, west), (top, east), (bottom, east), (bottom, west)]
                out = out | geo.polygon_meets(polygon, lambda lat, lon, w=west, e=east: geo.in_box(lat, lon, top, w, bottom, e), [ring])
            return constant(sure(out))
        return _geo(x, self.field_name, lambda p: geo.in_box(p["lat"], p["lon"], top, left, bottom, right))


def _geo(x: Context, name: str, test: Callable[[Column], Column]) -> Compiled:
    f = x.index.field(name)
    if f.type != "lat_lon":
        raise ValueError(f"{name} is no place")
    return constant(any_value(x.column(name), f, test))


@dataclass(frozen=True)
class GeoRadius(Query):
    field_name: str
    centre: tuple[float, float]
    radius: str

    def build(self, x: Context) -> Compiled:
        r = geo.metres(self.radius)
        if x.index.field(self.field_name).type == "polygon":
            return constant(sure(geo.polygon_near(geo.rings(x.column(self.field_name)), *self.centre, r)))
        degrees = math.degrees(r / geo.EARTH) * 1.0001

        def near(p: Column) -> Column:  # the band of latitudes is cheap and prunes
            return (p["lat"] >= self.centre[0] - degrees) & (p["lat"] <= self.centre[0] + degrees) & (geo.haversine(p["lat"], p["lon"], *self.centre) <= r)

        return _geo(x, self.field_name, near)


@dataclass(frozen=True)
class GeoPolygon(Query):
    """``polygons``: (shell, holes), corners as (lat, lon)."""

    field_name: str
    polygons: tuple

    def build(self, x: Context) -> Compiled:
        if x.index.field(self.field_name).type == "polygon":
            polygon, out = geo.rings(x.column(self.field_name)), F.lit(False)
            for shell, holes in self.polygons:
                rings = [list(shell), *map(list, holes)]
                out = out | geo.polygon_meets(polygon, lambda lat, lon, r=rings: geo.in_polygon(lat, lon, r[0], r[1:]), rings)
            return constant(sure(out))

        def inside(p: Column) -> Column:
            out = F.lit(False)
            for shell, holes in self.polygons:
                out = out | geo.in_polygon(p["lat"], p["lon"], list(shell), [list(h) for h in holes])
            return out

        return _geo(x, self.field_name, inside)


@dataclass(frozen=True)
class GeoPoint(Query):
    """Documents whose polygon holds the point."""

    field_name: str
    point: tuple[float, float]

    def build(self, x: Context) -> Compiled:
        if x.index.field(self.field_name).type != "polygon":
            raise ValueError(f"{self.field_name} is no polygon")
        return constant(geo.rings_contain(geo.rings(x.column(self.field_name)), *self.point))


@dataclass(frozen=True)
class Nested(Query):
    """Parents with a child at ``path`` that matches; the score is none, or avg, max, min or sum of the children's."""

    path: str
    query: Query
    score_mode: str = "none"

    def fields(self, x: Context) -> set[str]:
        return set()

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.path)
        if not f.nested:
            raise ValueError(f"{self.path} is not nested")
        kids = x.column(self.path)
        stats = x.__dict__.setdefault("nested_stats", {})

        def inside(item: Column) -> Compiled:
            c = x.child(self.path, item)
            if self.path in stats:
                c.stats = stats[self.path]
            out = self.query.compile(c)
            x.__dict__.setdefault("nested_wanted", {}).setdefault(self.path, []).append(c)
            return out

        hits = F.filter(kids, lambda k: sure(inside(k).match))
        wanted = x.__dict__["nested_wanted"][self.path][-1]
        if wanted.lengths and self.path not in stats:
            wanted.root = None
            wanted._count()
            stats[self.path] = wanted.stats
        match = sure(F.size(hits) > 0)
        if self.score_mode == "none":
            return Compiled(match, F.lit(0.0))
        scores = F.transform(hits, lambda k: inside(k).score)
        total = F.aggregate(scores, F.lit(0.0), lambda a, b: a + b)
        score = {"sum": total, "avg": total / F.size(scores), "max": F.array_max(scores), "min": F.array_min(scores)}[self.score_mode]
        return Compiled(match, F.when(match, score).otherwise(0.0))


@dataclass(frozen=True)
class CrossIndex(Query):
    """Documents whose key is the key of a document of another index that matches ``query``.

    The other side is filtered and aggregated to one row for each key before the join. ``max_terms`` bounds the matching
    documents there; more are an error.
    """

    index: Index
    field_name: str
    other_field: str
    query: Query
    score_mode: str = "none"
    max_terms: int | None = None

    def build(self, x: Context) -> Compiled:
        if not self.field_name or not self.other_field or self.query is None:
            raise ValueError("a cross-index query needs both fields and a query")
        x.index.field(self.field_name)
        other = Context(self.index)
        df, c = other.prepared(self.query)
        f = self.index.field(self.other_field)
        key = other.column(self.other_field)
        rows = df.where(c.match).select((F.explode(F.array_distinct(key)) if f.multi else key).alias("k"), c.score.alias("s"))
        if self.max_terms is not None and x.stats is None and df.where(c.match).limit(self.max_terms + 1).count() > self.max_terms:
            raise ValueError("more documents match than max_terms allows")
        if self.score_mode not in ("none", "avg", "max", "min", "total"):
            raise ValueError(f"unknown score mode: {self.score_mode}")
        keys = rows.where("k IS NOT NULL").groupBy("k").agg(F.sum("s").alias("total"), F.count("s").alias("n"), F.max("s").alias("max"), F.min("s").alias("min"))
        own, n = x.index.field(self.field_name), len(x.joins)
        on, key = own.column or self.field_name, "k"
        if own.multi:  # a document's keys meet the other side one by one and come back as one row
            pairs = x.index.df.select(F.col(x.index.id).alias("_id"), F.explode(F.array_distinct(x.column(self.field_name))).alias("k"))
            keys = pairs.join(keys, "k").groupBy("_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("max").alias("max"), F.min("min").alias("min"))
            on, key = x.index.id, "_id"
        score = {"none": F.lit(0.0), "avg": F.col("total") / F.col("n")}.get(self.score_mode, F.col(self.score_mode) if self.score_mode in ("total", "max", "min") else None)
        x.joins.append((keys.select(key, score.alias("score")), on, key))
        at = F.col(f"_x{n}")
        return Compiled(at.isNotNull(), F.coalesce(at, F.lit(0.0)))

    def fields(self, x: Context) -> set[str]:
        return set()


@dataclass(frozen=True)
class ExactVector(Query):
    """Every document with a vector, scored by its similarity to the query vector."""

    field_name: str
    vector: tuple[float, ...]
    similarity: str | None = None

    def build(self, x: Context) -> Compiled:
        f = x.index.field(self.field_name)
        if f.type != "vector":
            raise ValueError(f"{self.field_name} is no vector")
        if f.dimensions and f.dimensions != len(self.vector):
            raise ValueError("the query vector has another length")
        s = vector.similarity(self.similarity or f.vector_similarity, x.column(self.field_name), list(self.vector))
        return Compiled(s.isNotNull(), F.coalesce(s, F.lit(0.0)))


# spans: arrays of (s, e), e exclusive


@dataclass(frozen=True)
class Span(Query):
    field_name: str

    def spans(self, x: Context) -> Column:
        toks = x.tokens(self.field_name)
        return F.transform(positions(toks, self.test(x)), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))

    def test(self, x: Context) -> Callable[[Column], Column]:
        raise NotImplementedError

    def build(self, x: Context) -> Compiled:
        if x.index.field(self.field_name).type != "text":
            raise ValueError("spans need a text field")
        return Compiled(sure(self.possible(x) & (F.size(self.spans(x)) > 0)), F.lit(1.0))

    def possible(self, x: Context) -> Column:
        """A cheap test that every match passes."""
        return F.lit(True)


@dataclass(frozen=True)
class SpanTerm(Span):
    value: str

    def possible(self, x: Context) -> Column:
        return F.array_contains(x.tokens(self.field_name), self.value)

    def test(self, x: Context) -> Callable[[Column], Column]:
        return lambda t: t == self.value


@dataclass(frozen=True)
class SpanPrefix(Span):
    prefix: str

    def test(self, x: Context) -> Callable[[Column], Column]:
        return lambda t: F.startswith(t, F.lit(self.prefix))


@dataclass(frozen=True)
class SpanWildcard(Span):
    """``*`` stands for any run, ``?`` for one character, a backslash for the next as it is."""

    pattern: str

    def test(self, x: Context) -> Callable[[Column], Column]:
        import re

        parts = re.findall(r"\\.|.", self.pattern, re.S)
        rx = "".join(".*" if p == "*" else "." if p == "?" else re.escape(p[-1]) for p in parts)
        return lambda t: t.rlike(f"(?s)^(?:{rx})$")


@dataclass(frozen=True)
class SpanFuzzy(Span):
    term: str
    fuzzy: Fuzzy = Fuzzy(2, transpositions=True)

    def test(self, x: Context) -> Callable[[Column], Column]:
        edits = self.fuzzy.of(self.term)
        test = fuzzy_test(self.term, edits, self.fuzzy.prefix_length, self.fuzzy.transpositions)
        if self.fuzzy.max_expansions is None:
            return test
        terms = x.expand(self.field_name, test, self.fuzzy.max_expansions, fuzzy_rank(self.term, edits, self.fuzzy.transpositions))
        return lambda t: t.isin(terms) if terms else F.lit(False)


@dataclass(frozen=True)
class SpanRegexp(Span):
    """A pattern that covers the whole token; ``#`` nothing, ``@`` anything, ``<m-n>`` a number of that range."""

    pattern: str

    def test(self, x: Context) -> Callable[[Column], Column]:
        import re

        def numbers(m: re.Match) -> str:
            return "(?:" + "|".join(map(str, range(int(m[1]), int(m[2]) + 1))) + ")"

        rx = re.sub(r"<(\d+)-(\d+)>", numbers, self.pattern)
        rx = re.sub(r"(?<!\\)@", ".*", re.sub(r"(?<!\\)#", "(?!)", rx))
        return lambda t: t.rlike(f"^(?:{rx})$")


@dataclass(frozen=True)
class SpanRange(Span):
    lower: str | None = None
    upper: str | None = None
    include_lower: bool = True
    include_upper: bool = True

    def test(self, x: Context) -> Callable[[Column], Column]:
        def inside(t: Column) -> Column:
            ok = t.isNotNull()
            if self.lower is not None:
                ok = ok & (t >= self.lower if self.include_lower else t > self.lower)
            if self.upper is not None:
                ok = ok & (t <= self.upper if self.include_upper else t < self.upper)
            return ok

        return inside


@dataclass(frozen=True)
class SpanNear(Span):
    """Spans of all clauses with at most ``slop`` unmatched places between, in order or in any."""

    clauses: tuple[Span, ...]
    slop: int = 0
    in_order: bool = True

    def possible(self, x: Context) -> Column:
        out = F.lit(True)
        for c in self.clauses:
            out = out & c.possible(x)
        return out

    def spans(self, x: Context) -> Column:
        def wide(c: Column) -> Column:
            return F.transform(c, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), (s["e"] - s["s"]).alias("n")))

        def joined(p: Column, q: Column) -> Column:
            return F.struct(F.least(p["s"], q["s"]).alias("s"), F.greatest(p["e"], q["e"]).alias("e"), (p["n"] + q["n"]).alias("n"))

        def apart(p: Column, q: Column) -> Column:
            after = q["s"] >= p["e"]
            free = after if self.in_order else after | (q["e"] <= p["s"])
            return free & (F.greatest(p["e"], q["e"]) - F.least(p["s"], q["s"]) - p["n"] - q["n"] <= self.slop)

        def apart_later(p: Column, q: Column) -> Column:  # places between may yet be filled by later clauses
            return (q["s"] >= p["e"]) | (q["e"] <= p["s"])

        def paired(found: Column, other: Column, test: Callable[[Column, Column], Column]) -> Column:
            return let(other, lambda o: F.array_distinct(F.flatten(F.transform(found, lambda p: F.transform(F.filter(o, lambda q: test(p, q)), lambda q: joined(p, q))))))

        found = wide(self.clauses[0].spans(x))
        for k, c in enumerate(self.clauses[1:], 2):
            found = paired(found, wide(c.spans(x)), apart if k == len(self.clauses) or self.in_order else apart_later)
        return F.transform(found, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e")))


@dataclass(frozen=True)
class Completion(Query):
    """Prefix (or fuzzy prefix) of a suggestion, filtered by any of ``contexts``; scored by weight."""

    field_name: str
    text: str
    contexts: tuple[str, ...] = ()
    fuzzy: Fuzzy | None = None

    def build(self, x: Context) -> Compiled:
        f, c = x.index.field(self.field_name), x.column(self.field_name)
        if f.type != "context_suggest":
            raise ValueError(f"{self.field_name} holds no suggestions")
        q = self.text.lower()

        def hit(s: Column) -> Column:
            v = F.lower(s["value"])
            ok = F.startswith(v, F.lit(q)) if self.fuzzy is None else F.levenshtein(F.substring(v, 1, len(q)), F.lit(q)) <= self.fuzzy.of(q)
            return ok & F.arrays_overlap(s["contexts"], F.array(*map(F.lit, self.contexts))) if self.contexts else ok

        values = c if f.multi else F.array(c)
        hits = F.filter(values, lambda s: sure(hit(s)))
        return Compiled(sure(F.size(hits) > 0), F.coalesce(F.array_max(F.transform(hits, lambda s: s["weight"])).cast("double"), F.lit(0.0)))


def boosted(q: Query, boost: float) -> Query:
    return replace(q, boost=boost)
