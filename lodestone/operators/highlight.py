"""Highlighting of hits: whole fields as a Column, fragments by an Arrow-batched function over the top hits only."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.registry import lookup


@dataclass(frozen=True)
class Highlight:
    """``fragments`` 0 marks the whole field. Every term is marked; with ``parted`` a whole field's mark takes the characters
    on both sides of the term, so that the next term needs a separator of its own to be marked."""

    field_name: str
    terms: tuple[str, ...]
    pre: str = "<em>"
    post: str = "</em>"
    fragment_size: int = 100
    fragments: int = 5
    boundary: str = "word"
    by_score: bool = True
    plugin: str | None = None
    parted: bool = False


def pattern(terms: tuple[str, ...], parted: bool = False) -> str:
    any_of = "(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in sorted(terms, key=len, reverse=True)) + ")"
    return r"(?i)(^|[^\p{L}\p{N}])" + any_of + r"(\z|[^\p{L}\p{N}])" if parted else r"(?i)(?<![\p{L}\p{N}])" + any_of + r"(?![\p{L}\p{N}])"


def whole(text: Column, h: Highlight) -> Column:
    if not h.terms:
        return text
    return F.regexp_replace(text, pattern(h.terms, h.parted), f"$1{h.pre}$2{h.post}$3" if h.parted else h.pre + "$1" + h.post)


def pieces(text: str, h: Highlight) -> list[str]:
    """Fragments of about ``fragment_size`` characters around marks, best first, cut at words or sentences."""
    marks = [m.span() for m in re.finditer(r"(?i)(?<!\w)(" + "|".join(map(re.escape, sorted(h.terms, key=len, reverse=True))) + r")(?!\w)", text)] if h.terms else []
    out, at = [], 0
    while at < len(marks):
        start = max(0, marks[at][0] - h.fragment_size // 4)
        if h.boundary == "sentence":
            start = max((m.end() for m in re.finditer(r"[.!?]\s+|\n", text[: marks[at][0]])), default=0)
        elif h.boundary == "word":
            while start and not text[start - 1].isspace():
                start -= 1
        end = min(len(text), max(start + h.fragment_size, marks[at][1]))
        if h.boundary != "simple":
            while end < len(text) and not text[end].isspace():
                end += 1
        inside = []
        while at < len(marks) and marks[at][1] <= end:
            inside.append(marks[at])
            at += 1
        if not inside:
            at += 1
            continue
        cut, last = "", start
        for a, b in inside:
            cut += text[last:a] + h.pre + text[a:b] + h.post
            last = b
        out.append((len({text[a:b].lower() for a, b in inside}), len(inside), cut + text[last:end]))
    if h.by_score:
        out.sort(key=lambda x: (-x[0], -x[1]))
    return [x[2] for x in out[: h.fragments]]


def fragments(text: Column, h: Highlight) -> Column:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([pieces(t or "", h) for t in texts])

    return cut(text)


def column(text: Column, h: Highlight) -> Column:
    if h.plugin:
        return lookup("highlighter", h.plugin)(text, h)
    return fragments(text, h) if h.fragments else F.array(whole(text, h))
