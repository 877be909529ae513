"""Files of documents: values arrive as strings, several values as lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """``fields map<string, array<string>>`` of a CSV file with a header; ``separator`` parts several values, JSON stays whole."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)

    def values(c: str) -> F.Column:
        v = F.col(f"`{c}`")
        return F.when(v.isNull(), F.array().cast("array<string>")).when(F.ltrim(v).rlike(r"^[\[{]"), F.array(v)).otherwise(F.split(v, f"\\Q{separator}\\E"))

    pairs = F.map_from_arrays(F.array(*map(F.lit, rows.columns)), F.array(*map(values, rows.columns)))
    return rows.select(F.map_filter(pairs, lambda k, v: F.size(v) > 0).alias("fields"))


def read_json_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The same of a file with one JSON document on each line; an array gives several values, an object stays JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")

    def values(c: str) -> F.Column:
        v = F.get_json_object("value", f"$.{c}")
        listed = F.from_json(v, "array<string>")
        return F.when(v.isNull(), F.array().cast("array<string>")).when(F.ltrim(v).startswith("["), listed).otherwise(F.array(v))

    pairs = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(values, columns)))
    return lines.select(F.map_filter(pairs, lambda k, v: F.size(v) > 0).alias("fields"))
