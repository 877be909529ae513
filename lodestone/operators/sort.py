"""Sorting with missing values, selectors for several values, distances, and keyset paging."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.plans.query import Context

NULL_VALUE = "%NULL_SORT_VALUE%"


@dataclass(frozen=True)
class SortField:
    """``name`` is a field, ``docid`` or ``score``. A score sorts downwards by nature; ``reverse`` turns that.

    Missing values count as the smallest, or with ``missing_last`` as the largest, before the order is reversed.
    """

    name: str
    reverse: bool = False
    missing_last: bool = False
    selector: str = "min"
    origin: tuple[float, float] | None = None
    unit: str = "m"


def sort_value(x: Context, s: SortField, score: Column) -> Column:
    if s.name == "docid":
        return F.col(x.index.id)
    if s.name == "score":
        return score
    f, c = x.index.field(s.name), x.column(s.name)
    if f.type == "lat_lon":
        if s.origin is None:
            raise ValueError("a distance sort needs an origin")
        far = (lambda p: geo.haversine(p["lat"], p["lon"], *s.origin) / geo.UNITS[s.unit])
        return F.array_min(F.transform(c, far)) if f.multi else far(c)
    if f.type in ("text", "object", "polygon", "vector"):
        raise ValueError(f"{s.name} cannot be sorted by")
    if not f.multi:
        return c
    if s.selector in ("min", "max"):
        return F.array_min(c) if s.selector == "min" else F.array_max(c)
    if f.type not in ("atom", "_id") or s.selector not in ("middle_min", "middle_max"):
        raise ValueError(f"no selector {s.selector} for {f.type}")
    n = F.size(c)
    at = F.floor((n - 1) / 2) if s.selector == "middle_min" else F.floor(n / 2)
    return F.when(n > 0, F.try_element_at(F.array_sort(c), (at + 1).cast("int")))


def down(x: Context, s: SortField) -> bool:
    if s.name == "score":
        return not s.reverse
    distance = s.name != "docid" and x.index.field(s.name).type == "lat_lon"
    return s.reverse and not distance


def order(x: Context, sort: tuple[SortField, ...], names: list[str]) -> list[Column]:
    out = []
    for s, n in zip(sort, names):
        c, distance = F.col(n), s.name not in ("docid", "score") and x.index.field(s.name).type == "lat_lon"
        if distance:
            out.append(c.asc_nulls_last())
        elif down(x, s):
            out.append(c.desc_nulls_first() if s.missing_last else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_last() if s.missing_last else c.asc_nulls_first())
    return out


def after(x: Context, sort: tuple[SortField, ...], names: list[str], last: tuple, last_id: object) -> Column:
    """Rows that come after the last one seen, whose sort values are ``last``."""
    out, same = F.lit(False), F.lit(True)
    for s, n, v in zip(sort, names, last):
        c, falls = F.col(n), down(x, s)
        nulls_last = s.missing_last != falls
        if v is None or v == NULL_VALUE:
            beyond = F.lit(False) if nulls_last else c.isNotNull()
            equal = c.isNull()
        else:
            beyond = c < F.lit(v) if falls else c > F.lit(v)
            beyond = F.coalesce(beyond, F.lit(nulls_last))
            equal = F.coalesce(c == F.lit(v), F.lit(False))
        out = out | (same & beyond)
        same = same & equal
    return out | (same & (F.col(x.index.id) > F.lit(last_id)))
