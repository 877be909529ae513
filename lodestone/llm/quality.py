"""Quality rules (operator 6): a short-circuit cascade ordered by rejection per cost.

Each rule reads one or more features of a text; features are computed only when a rule first asks for them. The cost
and the share of rejections of each rule are estimated on a bounded sample, and rules run in the order of rejections per
cost, so that most bad texts leave after the cheapest test that can tell. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, column_at, numbered, over_text, ship, take, texts_of

SYMBOLS = "#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Features:
    """Features of one text, each computed at first use."""

    def __init__(self, text: str):
        self.text = text

    def __getattr__(self, name: str) -> object:
        value = COMPUTE[name](self)
        setattr(self, name, value)
        return value


def _repeat_words(f: Features) -> int:
    w = f.words
    n = len(w)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = [number.setdefault(x, len(number)) for x in w]
    if len(number) == n:
        return 0
    size = len(number)
    windows = [(a * size + b) * size + c for a, b, c in zip(ids, ids[1:], ids[2:])]
    first: dict[int, int] = {}
    twice: set[int] = set()
    for x in windows:
        if first.setdefault(x, 0):
            twice.add(x)
        first[x] = 1
    if not twice:
        return 0
    covered, end = 0, 0
    for i, x in enumerate(windows):
        if x in twice:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def _dup_lines(f: Features) -> int:
    seen: set[str] = set()
    n = 0
    for line in f.text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(ASCII_SPACE):
            seen.add(line)
    return n


COMPUTE: dict[str, Callable[[Features], object]] = {
    # bytes.split() splits on exactly the six ASCII white-space characters
    "raw": lambda f: f.text.encode("utf-8", "surrogatepass"),
    "words": lambda f: f.raw.split(),
    "n_words": lambda f: len(f.words),
    "word_chars": lambda f: len(f.text) - sum(map(f.text.count, ASCII_SPACE)),
    "n_symbols": lambda f: sum(map(f.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "base_failed": lambda f: f.n_words < 50 or 100 * f.n_repeat_words > 50 * f.n_words,
    "n_lines": lambda f: sum(1 for x in f.text.split("\n") if x.strip(ASCII_SPACE)),
    "n_upper": lambda f: len(f.raw) - len(f.raw.translate(None, UPPER)),
    "n_lower": lambda f: len(f.raw) - len(f.raw.translate(None, UPPER.lower())),
}


@dataclass(frozen=True)
class Rule:
    """A text is rejected where ``rejects`` holds."""

    name: str
    rejects: Callable[[Features], bool]


#: The first two are the base rules; the others keep ordinary prose and reject what is mostly signs, shouting or copies.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 5 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 15 * f.n_words),
    Rule("shouting", lambda f: f.n_upper > f.n_lower and f.n_upper > f.n_words),
    Rule("copied_lines", lambda f: f.n_lines > 3 and 2 * f.n_dup_lines > f.n_lines),
)


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[int]:
    """Places of the rules by rejections per second on a sample, greedily among the texts that earlier rules left."""
    left, todo, order = [Features(t) for t in texts], list(range(len(rules))), []
    while todo:
        best = None
        for k in todo:
            fresh = [Features(f.text) for f in left]
            for f, old in zip(fresh, left):
                f.__dict__.update(old.__dict__)
            began = time.perf_counter()
            hit = [rules[k].rejects(f) for f in fresh]
            cost = time.perf_counter() - began + 1e-9
            gain = (sum(hit) + 1e-3) / cost
            if best is None or gain > best[0]:
                best = gain, k, [f for f, h in zip(fresh, hit) if not h]
        _, k, left = best
        order.append(k)
        todo.remove(k)
    return order


def sample_texts(docs: DataFrame, sample: int = 256, text_col: str = "text") -> list[str]:
    """About ``sample`` texts, each row with the same chance, on which costs are measured; they only decide the order."""
    d = take(docs, text_col)
    rows = d.count()
    return [r[0] or "" for r in d.sample(min(1.0, sample / rows), seed=11).collect()] if rows else []


def verdict(f: Features, order: list[int], rules: tuple[Rule, ...] = RULES) -> str | None:
    """Name of the first rule of the cascade that rejects the text; None keeps it."""
    return next((rules[k].name for k in order if rules[k].rejects(f)), None)


def assess(docs: DataFrame, order: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 256) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` of each whole text.

    A report of every feature, so here the cascade spares only the rules after the first that rejects; ``keep_good`` also spares
    their features. Null and empty texts have no words, so they fail the base; repeated rows give repeated results; an
    empty table gives no rows; other columns are not read. No shuffle.
    """
    order = order_rules(sample_texts(docs, sample, text_col)) if order is None else order
    d = take(docs, id_col, text_col)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

    def run(batch: pa.RecordBatch) -> dict:
        kept, out = [], {n: [] for n in names}
        for t in texts_of(batch, text_col):
            f = Features(t)
            kept.append(verdict(f, order) is None)  # the cascade first, then what of the report it left open
            for n in names:
                out[n].append(getattr(f, n))
        return {id_col: batch.column(0), "kept": kept} | out

    schema = f"{id_col} {d.dtypes[0][1]}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    return over_text(d, text_col, schema, run)


def keep_good(docs: DataFrame, order: list[int] | None = None, text_col: str = "text", sample: int = 256) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule of the cascade rejects; a text leaves at the first rule."""
    order = order_rules(sample_texts(docs, sample, text_col)) if order is None else order
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([verdict(Features(t or ""), order) is None for t in texts])

    return numbered(docs).where(good(F.col(f"_{column_at(docs, text_col)}"))).toDF(*docs.columns)

