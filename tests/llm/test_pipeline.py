"""Each stage against brute force on its own input."""

import random

import corpus_pipeline
from lodestone.llm import pii, quality, toxicity
from tests.llm.test_structures import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "personal_data", "packing"]

    before = docs.collect()
    first = stages["toxicity"](spark, docs, SF).cache()
    assert first.columns == columns
    scorer = toxicity.fit(docs, labels).scorer()
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r, s in zip(before, scorer([r.text for r in before])) if s < 0.7}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & {r.doc_id for r in first.collect()}) <= 0.3 * len(toxic)  # six toxic rows to learn from

    second = stages["quality"](spark, first, SF).cache()
    assert second.columns == columns
    keep = {r.doc_id for r in first.collect() if all(not rule.rejects(quality.Features(r.text)) for rule in quality.RULES)}
    assert {r.doc_id for r in second.collect()} == keep

    third = stages["near_duplicates"](spark, second, SF).cache()
    assert third.columns == columns
    rows = sorted(second.collect(), key=lambda r: r.doc_id)
    own = brute_components([brute_fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in third.collect()} == {rows[i].doc_id for i in set(own)}

    fourth = stages["personal_data"](spark, third, SF).cache()
    assert fourth.columns == columns
    redacted = {r.doc_id: pii.redact(r.text) for r in third.collect()}
    assert {r.doc_id: r.text for r in fourth.collect()} == redacted
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    last = stages["packing"](spark, fourth, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(redacted)


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_clashing_columns_and_an_empty_table_pass_the_stages(spark):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    extra = first.selectExpr("*", "'mine' AS predicted", "0.5 AS score", "'clash' AS `TEXT`", "1 AS `_0`", "'b' AS block")
    want = {name: stage for name, stage in corpus_pipeline.STAGES}
    plain, odd, none = first, extra, extra.limit(0)
    for name in list(want)[:-1]:
        plain, odd, none = (want[name](spark, d, SF) for d in (plain, odd, none))
        assert odd.columns == none.columns == extra.columns
    kept = odd.toDF(*first.columns, "x1", "x2", "x3", "x4", "x5")
    assert sorted(map(tuple, kept.select("doc_id", "text", "n_chars").collect())) == sorted(map(tuple, plain.select("doc_id", "text", "n_chars").collect()))
    assert kept.select("x1", "x3").distinct().collect() == [("mine", "clash")] and none.count() == 0
    assert want["packing"](spark, none, SF).count() == 0 and want["packing"](spark, odd, SF).count() == want["packing"](spark, plain, SF).count()


def test_nulls_pass_the_stages(spark, tmp_path):
    rng = random.Random(1)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    rows = [(1, text, "en", "s", 10), (1, text, "en", "s", 10), (None, None, None, None, None), (None, text + " more", None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() >= 1


def test_toxicity_stage_loses_few_of_many_toxic_rows(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    left = dict(corpus_pipeline.STAGES)["toxicity"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    survivors = toxic & {r.doc_id for r in left.select("doc_id").collect()}
    assert len(toxic) >= 20 and len(survivors) <= 0.1 * len(toxic), (len(toxic), len(survivors))
