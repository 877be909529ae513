"""Small tables with nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""

from pyspark.sql import DataFrame, SparkSession

PROSE = "The committee met on Tuesday to discuss the new road through the valley and heard from farmers, teachers and drivers who use it daily. "
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score double, block int"


def odd_docs(spark: SparkSession) -> DataFrame:
    """`TEXT`, `score` and `block` clash with names that operators use; with a case-insensitive session so does `TEXT`."""
    texts = [(1, PROSE * 2), (2, None), (3, ""), (4, " \n\t "), (5, PROSE * 2), (5, PROSE * 2), (None, "no id, but text: a@b.example.org"), (7, "long " * 40_000), (8, "mail x.y@example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, ip 10.0.0.1"), (9, "ünï çødé 😀 \x1c text"), (-3, "negative id")]
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "clash", 0.5, 3) for i, t in texts], SCHEMA)


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def same(a: list, b: list) -> None:
    assert sorted(a, key=repr) == sorted(b, key=repr)
