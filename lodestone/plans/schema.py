"""Field types, typed parsing of ingested strings, and the index: a DataFrame with registered fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import analysis
from lodestone.functions.analysis import Analyzer
from lodestone.registry import lookup

NAME = re.compile(r"[a-zA-Z_][a-zA-Z_0-9]*")
NUMERIC = ("int", "long", "float", "double")
TYPES = {"atom": "string", "text": "string", "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "date_time": "timestamp_ntz", "lat_lon": "struct<lat:double,lon:double>", "polygon": "string", "object": "string", "_id": "string", "vector": "array<float>", "context_suggest": "struct<value:string,contexts:array<string>,weight:int>", "virtual": "double", "runtime": None, "custom": None}


@dataclass(frozen=True)
class Field:
    """One registered field; ``column`` defaults to its name."""

    type: str
    column: str | None = None
    multi: bool = False
    search: bool = True
    stored: bool = True
    doc_values: bool = True
    analyzer: Analyzer = analysis.STANDARD
    search_analyzer: Analyzer | None = None
    normalizer: str | None = None
    similarity: str = "bm25"
    date_format: str = "strict_date_optional_time"
    dimensions: int | None = None
    vector_similarity: str = "cosine"
    ignore_above: int | None = None
    script: object = None
    nested: bool = False
    children: dict[str, Field] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown field type: {self.type}")


def parse_column(values: Column, f: Field) -> Column:
    """Typed column of the strings that one document gives for a field; errors as in ``ValueError`` are raised per row."""
    kind = f.type

    def one(v: Column) -> Column:
        if kind == "boolean":
            low = F.lower(v)
            return F.when(low.isin("true", "false"), low == "true").when(v.isNotNull(), F.raise_error(F.concat(F.lit("not a boolean: "), v)))
        if kind == "int":
            return F.when(v.contains("."), v.cast("double").cast("int")).otherwise(v.cast("int"))
        if kind in NUMERIC:
            return v.cast(TYPES[kind])
        if kind == "date_time":
            if f.date_format == "epoch_millis":
                return F.timestamp_millis(v.cast("long")).cast("timestamp_ntz")
            if f.date_format == "strict_date_optional_time":
                return F.regexp_replace(v, "Z$", "").cast("timestamp_ntz")
            return F.to_timestamp_ntz(v, F.lit(f.date_format))
        if kind == "vector":
            parsed = F.from_json(v, "array<float>")
            bad = F.size(parsed) != (f.dimensions or -1) if f.dimensions else F.lit(False)
            broken = bad | F.exists(parsed, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            if f.vector_similarity in ("cosine", "normalized_cosine"):
                broken = broken | ~F.exists(parsed, lambda x: x != 0)
            return F.when(broken, F.raise_error(F.concat(F.lit("not a vector of this field: "), v))).otherwise(parsed)
        if kind == "context_suggest":
            return F.from_json(v, TYPES[kind])
        if kind in ("atom", "text", "_id", "polygon"):
            if f.normalizer:
                v = analysis.NORMALIZERS[f.normalizer](v)
            return F.when(F.length(v) <= f.ignore_above, v) if f.ignore_above else v
        if kind == "object":
            child = ",".join(f"{n}:{f'array<{TYPES[c.type]}>' if c.multi else TYPES[c.type]}" for n, c in f.children.items())
            return F.from_json(v, f"struct<{child}>")
        return lookup("field_type", f.column or kind)(v)

    if kind == "lat_lon":
        odd = F.size(values) % 2 != 0
        n = F.size(values) / 2
        pairs = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(values[2 * i].cast("double").alias("lat"), values[2 * i + 1].cast("double").alias("lon")))
        pairs = F.when(odd, F.raise_error(F.lit("latitudes and longitudes come in pairs"))).when(F.size(values) > 0, pairs)
        return pairs if f.multi else pairs[0]
    if f.multi:
        return F.transform(values, one)
    too_many = F.when(F.size(values) > 1, F.raise_error(F.lit("a single-valued field has several values")))
    return F.coalesce(too_many, one(F.try_element_at(values, F.lit(1))))


@dataclass(frozen=True)
class Index:
    """Documents with registered fields. ``id`` orders ties; it should be unique."""

    df: DataFrame
    fields: dict[str, Field]
    id: str = "doc_id"
    name: str = "index"

    def __post_init__(self) -> None:
        for n in self.fields:
            if not NAME.fullmatch(n.replace(".", "_")) or n.endswith("_boost"):
                raise ValueError(f"not a field name: {n}")

    def field(self, name: str) -> Field:
        if name in self.fields:
            return self.fields[name]
        parent, _, child = name.partition(".")
        if child and parent in self.fields:
            f = self.fields[parent]
            at = f.column or parent
            for part in child.split("."):
                if part not in f.children:
                    break
                # a child of an object is a part of its value; a child of any other field is the same value indexed anew
                inside = f.type == "object"
                f = f.children[part]
                at = f"{at}.{f.column or part}" if inside else f.column or at
            else:
                return replace(f, column=at)
        raise ValueError(f"unknown field: {name}")

    def with_fields(self, extra: dict[str, Field]) -> Index:
        clash = set(extra) & set(self.fields)
        if clash:
            raise ValueError(f"fields are registered already: {sorted(clash)}")
        return replace(self, fields={**self.fields, **extra})

    def with_df(self, df: DataFrame) -> Index:
        return replace(self, df=df)

    @property
    def text_fields(self) -> list[str]:
        return [n for n, f in self.fields.items() if f.type == "text" and f.search]


def from_strings(docs: DataFrame, fields: dict[str, Field], id: str = "doc_id", values: str = "fields", name: str = "index") -> Index:
    """Index of rows with a ``map<string, array<string>>`` of values; a name that is not registered is an error."""
    unknown = F.array_except(F.map_keys(values), F.array(*map(F.lit, fields)))
    checked = docs.where(F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))).isNull())
    typed = checked.select(*[parse_column(F.try_element_at(F.col(values), F.lit(n)), f).alias(f.column or n) for n, f in fields.items() if f.type not in ("virtual", "runtime")])
    return Index(typed, fields, id, name)
