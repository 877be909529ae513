"""Ingestion, versions, snapshots and streams."""

import pytest
from pyspark.sql import functions as F

from lodestone.plans.query import Range
from lodestone.plans.schema import Field, Index
from lodestone.sources import mutation
from lodestone.sources.catalog import Catalog
from lodestone.sources.files import read_csv, read_json_lines
from lodestone.streaming.ingest import ingest

FIELDS = {"id": Field("long"), "v": Field("double", search=False), "k": Field("atom"), "seq": Field("long")}


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "catalog"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_take_the_newest(spark):
    base = spark.createDataFrame([(1, 1.0, "a", 0), (2, 2.0, "b", 0)], "id long, v double, k string, seq long")
    new = spark.createDataFrame([(2, 3.0, "c", 1), (2, 4.0, "d", 2), (3, 5.0, "e", 1)], base.schema)
    assert rows(mutation.upsert(base, new, "id", "seq")) == [(1, 1.0, "a", 0), (2, 4.0, "d", 2), (3, 5.0, "e", 1)]
    assert rows(mutation.upsert(base, base.limit(0), "id")) == rows(base)


def test_ties_of_upserts_do_not_depend_on_order(spark):
    new = spark.createDataFrame([(1, float(k), f"k{k}", 7) for k in range(20)], "id long, v double, k string, seq long")
    for seq in ("seq", None):
        got = {tuple(rows(mutation.latest(d, "id", seq))) for d in (new, new.orderBy(F.desc("v")).coalesce(1), new.repartition(5, "v"))}
        assert len(got) == 1 and len(next(iter(got))) == 1


def test_another_session_opens_the_index(spark, catalog):
    catalog.create_index("x", FIELDS | {"place": Field("object", children={"p": Field("lat_lon")})}, "id", sort=["k"])
    catalog.commit("x", spark.range(3).selectExpr("id", "1.0D AS v", "'a' AS k", "0L AS seq"))
    other = Catalog(spark, catalog.root)
    assert other.schemas == catalog.schemas and other.sorts == catalog.sorts and other.open("x").df.count() == 3


def test_a_writer_that_dies_or_comes_late_changes_nothing(spark, catalog):
    catalog.create_index("x", FIELDS, "id")
    one = spark.range(1).selectExpr("id", "1.0D AS v", "'a' AS k", "0L AS seq")
    catalog.commit("x", one)
    meta = catalog._meta("x")
    fs, p = catalog._fs(f"{catalog.root}/x/pointers/2.json")
    fs.create(p, False).close()  # died between creating and writing
    assert catalog.open("x").df.count() == 1 and catalog.commit("x", one.union(one)) == 2 and catalog.open("x").df.count() == 2
    with pytest.raises(RuntimeError):
        catalog._put("x", meta | {"version": 9})
    assert catalog._meta("x")["version"] == 2


def test_partial_updates(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 0), (2, 2.0, "b", 0)], "id long, v double, k string, seq long")
    ix = Index(df, FIELDS, "id")
    new = spark.createDataFrame([(2, 9.0), (7, 1.0)], "id long, v double")
    assert rows(mutation.update_values(ix, new).select("id", "v")) == [(1, 1.0), (2, 9.0)]
    with pytest.raises(ValueError):
        mutation.update_values(ix, new.withColumnRenamed("v", "k"))


def test_versions_snapshots_and_deletes(spark, catalog):
    catalog.create_index("x", FIELDS, "id", sort=["k"])
    with pytest.raises(ValueError):
        catalog.open("x")
    with pytest.raises(ValueError):
        catalog.create_index("x", {})
    with pytest.raises(ValueError):
        catalog.register_fields("x", {"k": Field("atom")})
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"), F.lit("a").alias("k"), F.lit(0).cast("long").alias("seq"))
    assert catalog.commit("x", df) == 1 and catalog.create_snapshot("x") == 1
    assert catalog.commit("x", mutation.delete_by_query(catalog.open("x"), [Range("id", 5, None)])) == 2
    assert catalog.force_merge("x") == 3
    assert catalog.clean("x") == [2]
    assert catalog.open("x", 1).df.count() == 10 and catalog.stats("x")["documents"] == 5
    catalog.release_snapshot("x", 1)
    assert catalog.clean("x") == [1]
    catalog.commit("x", mutation.delete_all(catalog.open("x")))
    assert catalog.open("x").df.count() == 0
    catalog.delete_index("x")
    assert catalog.indices() == []


def test_stream_gives_what_a_batch_gives(spark, catalog, tmp_path):
    schema = "id long, v double, k string, seq long"
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    batches = [[(1, 1.0, "a", 1), (1, 2.0, "b", 3), (2, 1.0, "c", 1)], [(1, 9.0, "late", 2), (2, 5.0, "d", 4), (3, 1.0, "e", 1)]]
    catalog.create_index("s", FIELDS, "id")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(schema).parquet(source), catalog, "s", "seq", progress).awaitTermination()
    everything = spark.createDataFrame(sum(batches, []), schema)
    assert rows(catalog.open("s").df) == rows(mutation.latest(everything, "id", "seq"))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,tags,v\n1,x;y,"[1.0, 2.0]"\n2,,\n')
    (tmp_path / "a.jsonl").write_text('{"id": 1, "tags": ["x", "y"], "o": {"a": 1}}\n\n{"id": 2}\n')
    got = {r.fields["id"][0]: r.fields for r in read_csv(spark, str(tmp_path / "a.csv")).collect()}
    assert got["1"] == {"id": ["1"], "tags": ["x", "y"], "v": ["[1.0, 2.0]"]} and got["2"] == {"id": ["2"]}
    got = {r.fields["id"][0]: r.fields for r in read_json_lines(spark, str(tmp_path / "a.jsonl"), ["id", "tags", "o"]).collect()}
    assert got["1"] == {"id": ["1"], "tags": ["x", "y"], "o": ['{"a":1}']} and got["2"] == {"id": ["2"]}
