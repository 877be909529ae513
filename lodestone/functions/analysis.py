"""Text analysis as Column pipelines: character filters, a tokenizer, token filters.

Everything is built from JVM-side functions, so analysis stays inside the generated code of the scan. The same pipeline
analyses query text: as a projection of one literal row, which the optimizer folds without a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Step = Callable[[Column], Column]
WORD = r"[\p{L}\p{N}]+"
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


@dataclass(frozen=True)
class Analyzer:
    """Steps applied in order; ``position_gap`` parts the values of a multi-valued field."""

    char_filters: tuple[Step, ...] = ()
    tokenizer: Step = None
    filters: tuple[Step, ...] = ()
    position_gap: int = 100

    def column(self, text: Column) -> Column:
        for f in self.char_filters:
            text = f(text)
        tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens

    def terms(self, text: str) -> list[str]:
        one = SparkSession.active().sql("SELECT 1 AS one")
        return list(one.select(self.column(F.lit(text)).alias("t")).first()[0] or [])


# character filters


def html_strip(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def mapping(pairs: dict[str, str]) -> Step:
    def step(c: Column) -> Column:
        for a, b in pairs.items():
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return step


def mapping_rules(rules: str, separator: str = "|") -> Step:
    r"""Rules ``a=>b`` parted by ``separator``; ``\n``, ``\t`` and ``\uXXXX`` in a rule stand for that character.

    The longest source wins where several match, and a replacement is not looked at again.
    """
    pairs = {}
    for rule in rules.split(separator):
        source, arrow, target = (re.sub(r"\\u([0-9A-Fa-f]{4})|\\([nt])", lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t"}[m[2]], x) for x in re.fullmatch(r"(.*?)(=>)(.*)", rule, re.S).groups()) if "=>" in rule else (rule, "", "")
        if not arrow or not source:
            raise ValueError(f"not a mapping rule: {rule!r}")
        pairs[source] = target
    ordered = sorted(pairs, key=len, reverse=True)

    def step(c: Column) -> Column:
        # private-use marks keep one replacement out of the next
        for k, a in enumerate(ordered):
            c = F.replace(c, F.lit(a), F.lit(chr(0xE000 + k)))
        for k, a in enumerate(ordered):
            c = F.replace(c, F.lit(chr(0xE000 + k)), F.lit(pairs[a]))
        return c

    return step


def pattern_replace_chars(pattern: str, replacement: str) -> Step:
    return lambda c: F.regexp_replace(c, pattern, replacement)


# tokenizers


def _found(pattern: str, group: int = 0) -> Step:
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


standard_tokens = _found(WORD)
letter_tokens = _found(r"\p{L}+")
classic_tokens = _found(r"[\p{L}\p{N}]+(?:[.@'&-][\p{L}\p{N}]+)*")
url_email_tokens = _found(r"(?:https?|ftp)://[^\s<>\"]+|[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|[\p{L}\p{N}]+")
wikipedia_tokens = _found(r"[\p{L}\p{N}]+(?:'[\p{L}]+)?")


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def keyword_tokens(c: Column) -> Column:
    return F.array(c)


def pattern_tokens(pattern: str, group: int = -1) -> Step:
    """Split on ``pattern``, or take a group of each match."""
    return _found(pattern, group) if group >= 0 else lambda c: F.filter(F.split(c, pattern), lambda t: t != "")


def ngram_tokens(low: int = 1, high: int = 2) -> Step:
    return lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(i + n - 1 <= F.length(c), F.substring(c, i, n))), lambda g: g.isNotNull())))


def edge_ngram_tokens(low: int = 1, high: int = 2) -> Step:
    return lambda c: edge_ngrams(low, high)(F.array(c))


def path_tokens(delimiter: str = "/") -> Step:
    def step(c: Column) -> Column:
        parts = F.split(c, re.escape(delimiter))
        return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), delimiter)), lambda t: t != "")

    return step


# token filters


def each(f: Step) -> Step:
    return lambda ts: F.transform(ts, f)


lowercase, uppercase, trim, reverse_string = each(F.lower), each(F.upper), each(F.trim), each(F.reverse)


def stop(words: list[str] | None = None) -> Step:
    listed = list(ENGLISH_STOP if words is None else words)
    return lambda ts: F.filter(ts, lambda t: ~t.isin(listed)) if listed else ts


def keep(words: list[str]) -> Step:
    return lambda ts: F.filter(ts, lambda t: t.isin(list(words)))


def length(low: int, high: int) -> Step:
    return lambda ts: F.filter(ts, lambda t: F.length(t).between(low, high))


def truncate(n: int) -> Step:
    return each(lambda t: F.substring(t, 1, n))


def limit(n: int) -> Step:
    return lambda ts: F.slice(ts, 1, n)


def remove_duplicates(ts: Column) -> Column:
    return F.array_distinct(ts)


def pattern_replace(pattern: str, replacement: str) -> Step:
    return each(lambda t: F.regexp_replace(t, pattern, replacement))


def fingerprint(separator: str = " ") -> Step:
    return lambda ts: F.array(F.array_join(F.array_sort(F.array_distinct(ts)), separator))


_FOLD = {"ÀÁÂÃÄÅàáâãäåĀāĂăĄą": "AAAAAAaaaaaaAaAaAa", "ÈÉÊËèéêëĒēĖėĘęĚě": "EEEEeeeeEeEeEeEe", "ÌÍÎÏìíîïĪī": "IIIIiiiiIi", "ÒÓÔÕÖØòóôõöøŌōŐő": "OOOOOOooooooOoOo", "ÙÚÛÜùúûüŪūŮů": "UUUUuuuuUuUu", "ÇçĆćČč": "CcCcCc", "ÑñŃńŇň": "NnNnNn", "ÝýŸÿ": "YyYy", "ŚśŠš": "SsSs", "ŹźŻżŽž": "ZzZzZz", "ŁłĎďŤťŘř": "LlDdTtRr"}


def ascii_folding(ts: Column) -> Column:
    source, target = "".join(_FOLD), "".join(_FOLD.values())
    return F.transform(ts, lambda t: F.replace(F.replace(F.replace(F.translate(t, source, target), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe")))


def plural_stem(ts: Column) -> Column:
    """Light English plural stemming: -ies to -y, -es and -s off, -us and -ss kept."""
    return F.transform(ts, lambda t: F.when(F.length(t) < 4, t).when(t.rlike("(?<![ae])ies$"), F.regexp_replace(t, "ies$", "y")).when(t.rlike("(?<![aeo])es$"), F.regexp_replace(t, "s$", "")).when(t.rlike("(?<![us])s$"), F.regexp_replace(t, "s$", "")).otherwise(t))


def ngrams(low: int, high: int) -> Step:
    return lambda ts: F.flatten(F.transform(ts, ngram_tokens(low, high)))


def edge_ngrams(low: int, high: int) -> Step:
    return lambda ts: F.flatten(F.transform(ts, lambda t: F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(n <= F.length(t), F.substring(t, 1, n))), lambda g: g.isNotNull())))


def shingle(size: int = 2, unigrams: bool = True, separator: str = " ") -> Step:
    def step(ts: Column) -> Column:
        grams = F.when(F.size(ts) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.size(ts) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(ts, i, size), separator))).otherwise(F.array().cast("array<string>"))
        return F.concat(ts, grams) if unigrams else grams

    return step


def synonyms(rules: str, ignore_case: bool = True, expand: bool = True, separator: str = "|") -> Step:
    """Groups ``a,b`` parted by ``separator``. Each member stands for all of its group, or for the first when not expanded."""
    table: dict[str, list[str]] = {}
    for group in rules.split(separator):
        members = [m.strip() for m in group.split(",") if m.strip()]
        if len(members) < 2:
            raise ValueError(f"a group of synonyms needs two members: {group!r}")
        for m in members:
            key = m.lower() if ignore_case else m
            table[key] = list(dict.fromkeys([*table.get(key, []), *([m, *members] if expand else members[:1])]))

    def step(ts: Column) -> Column:
        known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        return F.flatten(F.transform(ts, lambda t: F.coalesce(F.try_element_at(known, F.lower(t) if ignore_case else t), F.array(t))))

    return step


STANDARD = Analyzer(tokenizer=standard_tokens, filters=(lowercase,))
CLASSIC = Analyzer(tokenizer=classic_tokens, filters=(lowercase, stop()))
KEYWORD = Analyzer(tokenizer=keyword_tokens)
WHITESPACE = Analyzer(tokenizer=whitespace_tokens)
ENGLISH = Analyzer(tokenizer=standard_tokens, filters=(lowercase, stop(), plural_stem))
NAMED = {"standard": STANDARD, "classic": CLASSIC, "keyword": KEYWORD, "whitespace": WHITESPACE, "english": ENGLISH}
NORMALIZERS: dict[str, Step] = {"lowercase": F.lower}


def conditional(test: Step, inner: Step) -> Step:
    """Apply a token-wise filter only where ``test`` holds for the token."""
    return lambda ts: F.flatten(F.transform(ts, lambda t: F.when(test(t), inner(F.array(t))).otherwise(F.array(t))))
