"""Personal data (operator 3): anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. From each
anchor a deterministic parser walks left and right to the boundaries and validates what it finds. The kinds ``email``,
``ip``, ``card`` and ``phone`` are exactly those of their regular expressions, leftmost and non-overlapping; ``url`` and
``account`` are what the anchors add.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_at, numbered, over_text, ship, take, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
SCHEMES = ("http://", "https://", "ftp://")
#: Words after which an identifier follows.
CUES = ("iban", "account", "acct", "ssn", "passport", "password", "token", "secret", "api_key", "user_id", "licence no", "license no")
Span = tuple[int, int, int]  # start, place in KINDS, end


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    for words, what in ((SCHEMES, "s"), (CUES, "c")):
        for w in words:
            for x in {w, w.upper(), w.capitalize()}:
                a.add_word(x, (what, len(x)))
    a.make_automaton()
    return a


def _email(t: str, at: int, after: int) -> tuple[int, int] | None:
    """Boundaries of the address whose sign is at ``at`` and that begins at ``after`` at the earliest."""
    start = at
    while start > after and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, i = len(t), 0, at + 1
    labels = 0
    while i < n and t[i] in LABEL:
        while i < n and t[i] in LABEL:
            i += 1
        labels += 1
        end = i
        if i < n and t[i] == ".":
            i += 1
        else:
            break
    return (start, end) if labels >= 2 else None


def _digits_end(t: str, i: int) -> int:
    n = len(t)
    while i < n and t[i] in DIGITS:
        i += 1
    return i


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ip(t: str, start: int, out: list[Span]) -> int:
    """Addresses in the chain of runs of digits, joined by single full stops, from ``start``; where the chain ends."""
    n, i, runs = len(t), start, []
    while True:
        end = _digits_end(t, i)
        runs.append((i, end))
        if end + 1 < n and t[end] == "." and t[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    for k in range(0, len(runs) - 3, 4):
        four = runs[k : k + 4]
        if all(_octet(t[a:b]) for a, b in four):
            out.append((four[0][0], 1, four[3][1]))
    return runs[-1][1]


def _card(t: str, start: int, out: list[Span]) -> int:
    """The card number in the chain of digits, with single spaces or hyphens between, from ``start``."""
    n, i, digits = len(t), start, []
    while True:
        end = _digits_end(t, i)
        digits.append(t[i:end])
        if end + 1 < n and t[end] in " -" and t[end + 1] in DIGITS:
            i = end + 1
        else:
            break
    all_digits = "".join(digits)
    if 14 <= len(all_digits) <= 19 and luhn(all_digits):
        out.append((start, 2, end))
    return end


def _phone(t: str, plus: int, out: list[Span]) -> int:
    """The number after a plus sign; where the search for the next goes on."""
    n, i = len(t), plus + 1
    if i >= n or t[i] not in DIGITS:
        return i
    end = i + 1
    while end < n and t[end] in PHONE:
        end += 1
    while end > i + 2 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= i + 2:
        return i
    if 10 <= sum(c in DIGITS for c in t[i:end]) <= 15:
        out.append((plus, 3, end))
    return end


def _url(t: str, start: int, end: int) -> int | None:
    n = len(t)
    while end < n and t[end] not in URL_END:
        end += 1
    while t[end - 1] in ".,;:!?)]":
        end -= 1
    host = t[start:end].partition("://")[2].split("/")[0].split("?")[0]
    return end if "." in host.strip(".") or host.startswith("localhost") else None


def _account(t: str, cue: int, length: int) -> tuple[int, int] | None:
    """Identifier after a cue: at most 16 signs between them, six letters or digits at least, four of them digits."""
    if cue and (t[cue - 1].isalnum()):
        return None
    n, i = len(t), cue + length
    if i < n and t[i].isalnum():
        return None
    stop = min(n, i + 16)
    while i < stop and t[i] in " \t\"'=:#.-":
        i += 1
    for word in ("number", "no", "nr", "is"):
        if t[i : i + len(word)].lower() == word and i + len(word) < n and t[i + len(word)] in " .:=#":
            i += len(word)
            while i < n and i < stop + 16 and t[i] in " .:=#\"'":
                i += 1
            break
    end = i
    while end < n and (t[end] in LABEL or t[end] in "_/+" or t[end] == " " and t[end - 1] in DIGITS and end + 1 < n and t[end + 1] in DIGITS):
        end += 1
    while end > i and t[end - 1] in "-_/+":
        end -= 1
    body = t[i:end]
    if sum(c in DIGITS for c in body) < 4 or sum(c.isalnum() for c in body) < 6:
        return None
    return i, end


def find(t: str) -> list[Span]:
    """All spans (start, place in KINDS, end) of a text by start, then kind."""
    out: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (what, length) in automaton().iter(t):
        if what == "0":
            if last >= ip_end:
                ip_end = _ip(t, last, out)
            if last >= card_end:
                card_end = _card(t, last, out)
        elif what == "@":
            if got := _email(t, last, email_end):
                out.append((got[0], 0, got[1]))
                email_end = got[1]
        elif what == "+":
            if last >= phone_end:
                phone_end = _phone(t, last, out)
        elif what == "s":
            start = last + 1 - length
            if start >= url_end and (end := _url(t, start, last + 1)):
                out.append((start, 4, end))
                url_end = end
        elif last + 1 - length >= account_end and (got := _account(t, last + 1 - length, length)):
            out.append((got[0], 5, got[1]))
            account_end = got[1]
    out.sort()
    return out


def written(spans: Iterable[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redact(t: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, at = [], 0
    for start, k, end in find(t):
        if start >= at:
            out += [t[at:start], f"[{KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join([*out, t[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each whole text.

    Null and empty texts have no spans (``base_sha256`` is that of nothing); repeated rows give repeated results; an
    empty table gives no rows; other columns are not read. Places are code points, ends exclusive. No shuffle.
    """
    d = take(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> dict:
        found = [find(t) for t in texts_of(batch, text_col)]
        base = [[s for s in spans if s[1] < 4] for spans in found]
        counts = {f"n_{BASE[k]}": [sum(s[1] == k for s in spans) for spans in base] for k in range(4)}
        return {id_col: batch.column(0), "base_sha256": [hashlib.sha256(written(s).encode()).hexdigest() for s in base], "spans": [written(s) for s in found]} | counts

    return over_text(d, text_col, f"{id_col} {d.dtypes[0][1]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", run)


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in its texts replaced by the names of their kinds; a null text stays null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else redact(t))

    at = f"_{column_at(docs, text_col)}"
    return numbered(docs).withColumn(at, clean(at)).toDF(*docs.columns)
