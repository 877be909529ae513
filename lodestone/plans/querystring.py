"""A query string: terms, "phrases"~slop, field:term, AND OR NOT + -, prefixes*, fuzzy~, ranges [a TO b] {a TO b}, ^boost, ( )."""

from __future__ import annotations

import re
from dataclasses import replace

from lodestone.plans.query import Bool, DisMax, Fuzzy, Match, MatchAll, MatchPhrase, Prefix, Query, Range

TOKEN = re.compile(r'\s*(?:(?P<op>AND\b|OR\b|NOT\b|&&|\|\||[()!+-])|(?P<field>[A-Za-z_][\w.]*):(?=\S)|(?P<phrase>"[^"]*")(?:~(?P<slop>\d+))?|(?P<range>[\[{][^\]}]+[\]}])|(?P<word>[^\s()"^~]+))(?:~(?P<fuzz>\d?))?(?:\^(?P<boost>[0-9.]+))?')


def parse(text: str, fields: list[str]) -> Query:
    """Terms without a field are looked for in all ``fields``, best field first. Clauses are optional unless marked."""
    pos, parts = 0, []
    while text[pos:].strip():
        m = TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"query text cannot be read at {text[pos:]!r}")
        parts.append(m)
        pos = m.end()
    at = 0

    def leaf(m: re.Match, names: list[str]) -> Query:
        def one(n: str) -> Query:
            if m["phrase"]:
                return MatchPhrase(n, m["phrase"][1:-1], int(m["slop"] or 0))
            if m["range"]:
                low, _, high = m["range"][1:-1].partition(" TO ")
                return Range(n, None if low.strip() == "*" else low.strip(), None if high.strip() == "*" else high.strip(), m["range"][0] == "{", m["range"][-1] == "}")
            w = m["word"]
            if w.endswith("*") and len(w) > 1:
                return Prefix(n, w[:-1].lower())
            return Match(n, w, fuzzy=Fuzzy(int(m["fuzz"] or 2), transpositions=True) if m["fuzz"] is not None else None)

        q = one(names[0]) if len(names) == 1 else DisMax(tuple(one(n) for n in names))
        return replace(q, boost=float(m["boost"])) if m["boost"] else q

    def group(names: list[str], closed: bool) -> Query:
        nonlocal at
        clauses: list[list] = []  # [occur, query]
        mark, joined = None, None
        while at < len(parts):
            m = parts[at]
            at += 1
            op = m["op"]
            if op == ")":
                if not closed:
                    raise ValueError("query text: a bracket was not opened")
                break
            if op in ("AND", "&&"):
                if clauses and clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                joined = "must"
                continue
            if op in ("OR", "||"):
                joined = "should"
                continue
            if op in ("NOT", "!", "-", "+"):
                mark = "must" if op == "+" else "must_not"
                continue
            here = names
            if m["field"]:
                here = [m["field"]]
                m = parts[at] if at < len(parts) else None
                if m is None:
                    raise ValueError("query text: a field without a term")
                at += 1
            q = group(here, True) if m["op"] == "(" else leaf(m, here)
            clauses.append([mark or joined or "should", q])
            mark = joined = None
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        by = {o: tuple(q for k, q in clauses if k == o) for o in ("must", "should", "must_not")}
        return Bool(must=by["must"], should=by["should"], must_not=by["must_not"]) if clauses else MatchAll()

    return group(fields, False)
