"""Expression scripts compiled to Columns: arithmetic, comparison, logic, the ternary and named functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(?P<number>0[xX][0-9a-fA-F]+|[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)|(?P<name>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*|\[['\"][^'\"]*['\"]\])*)|(?P<op>&&|\|\||<<|>>>|>>|<=|>=|==|!=|[-+*/%<>!~?:(),&|^]))")
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%")]
FUNCTIONS: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in "abs acos acosh asin asinh atan atan2 atanh ceil cos cosh exp floor pow sin sinh sqrt tan tanh".split()},
    "ln": F.log,
    "log": F.log,
    "log10": F.log10,
    "logn": lambda base, x: F.log(x) / F.log(base),
    "min": F.least,
    "max": F.greatest,
    "haversin": lambda a, b, c, d: 2 * 6371008.7714 / 1000 * F.asin(F.sqrt(F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2))),
}


@lru_cache(maxsize=512)
def parse(source: str) -> tuple:
    """Tree of a script: ("num", x), ("name", s), ("call", f, args), ("op", o, args)."""
    tokens, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise ValueError(f"script cannot be read at {source[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek() -> str:
        return tokens[pos][1] if tokens[pos][0] == "op" else ""

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal pos
        kind, text = tokens[pos]
        if value is not None and (kind != "op" or text != value):
            raise ValueError(f"script: {value!r} expected, {text!r} found")
        pos += 1
        return kind, text

    def ternary() -> tuple:
        test = binary(0)
        if peek() == "?":
            take("?")
            yes = ternary()
            take(":")
            return ("op", "?:", (test, yes, ternary()))
        return test

    def binary(level: int) -> tuple:
        if level == len(LEVELS):
            return unary()
        left = binary(level + 1)
        while peek() in LEVELS[level]:
            o = take()[1]
            left = ("op", o, (left, binary(level + 1)))
        return left

    def unary() -> tuple:
        if peek() in ("-", "+", "!", "~") and peek():
            o = take()[1]
            return ("op", "u" + o, (unary(),))
        kind, text = take()
        if kind == "number":
            return ("num", float(int(text, 16)) if text[:2].lower() == "0x" else float(text))
        if kind == "name":
            if peek() != "(":
                return ("name", text)
            take("(")
            args = []
            while peek() != ")":
                args.append(ternary())
                if peek() == ",":
                    take(",")
            take(")")
            return ("call", text, tuple(args))
        if (kind, text) == ("op", "("):
            inner = ternary()
            take(")")
            return inner
        raise ValueError(f"script: {text!r} is not expected")

    tree = ternary()
    if tokens[pos][0] != "end":
        raise ValueError(f"script: {tokens[pos][1]!r} is left over")
    return tree


def names(tree: tuple) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    return set().union(*[names(x) for x in tree[2]]) if tree[0] in ("op", "call") else set()


def compile_script(source: str, resolve: Callable[[str], Column]) -> Column:
    """A double Column; comparisons and logic give 1 and 0. ``resolve`` turns a name into a Column."""

    def truth(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0)) != 0

    def number(b: Column) -> Column:
        return F.when(b, 1.0).otherwise(0.0)

    def go(t: tuple) -> Column:
        if t[0] == "num":
            return F.lit(t[1])
        if t[0] == "name":
            return resolve(t[1]).cast("double")
        args = [go(x) for x in t[2]]
        if t[0] == "call":
            if t[1] not in FUNCTIONS:
                raise ValueError(f"script: no function {t[1]}")
            return FUNCTIONS[t[1]](*args).cast("double")
        o, a, b = t[1], args[0], args[-1]
        if o == "?:":
            return F.when(truth(args[0]), args[1]).otherwise(args[2])
        if o in ("&&", "||"):
            return number(truth(a) & truth(b) if o == "&&" else truth(a) | truth(b))
        if o == "u!":
            return number(~truth(a))
        if o in ("u-", "u+"):
            return -a if o == "u-" else a
        if o == "u~":
            return F.bitwise_not(a.cast("long")).cast("double")
        if o in ("&", "|", "^"):
            x, y = a.cast("long"), b.cast("long")
            return {"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[o].cast("double")
        if o in ("<<", ">>", ">>>"):
            f = {"<<": "shiftleft", ">>": "shiftright", ">>>": "shiftrightunsigned"}[o]
            return F.call_function(f, a.cast("long"), b.cast("int")).cast("double")
        if o in ("==", "!=", "<", "<=", ">", ">="):
            return number({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[o])
        return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b), "%": F.try_mod(a, b)}[o]

    return go(parse(source))
