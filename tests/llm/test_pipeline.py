import ast

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontaminate, jaccard, mixing

from . import helpers as H


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10_000, "12 34 !!"), (10_001, None)], "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.lit(8).cast("long").alias("n_chars"))
    at = docs.unionByName(extra)
    seen = [at.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, at, data).cache()
        assert sorted(at.columns) == sorted(docs.columns), name
        seen.append(at.count())
        if name == "language_id":
            assert {r[0] for r in before.select("doc_id").subtract(at.select("doc_id")).collect()} >= {10_000, 10_001} and seen[-1] >= seen[0] - 4
        elif name == "near_duplicates":
            assert {r["doc_id"] for r in at.collect()} == {r["component_id"] for r in jaccard.jaccard_components(before).collect()}
        elif name == "decontamination":
            bad = decontaminate.judge(before, spark.read.parquet(f"{data}/benchmark.parquet")).where("contaminated").count()
            assert bad and seen[-1] == seen[-2] - bad
        elif name == "mixing":
            want = {r["source"]: r["t"] for r in mixing.mix_documents(before).join(before.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t")).collect()}
            size = F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
            got = {r["source"]: r["t"] for r in at.groupBy("source").agg(F.sum(size).alias("t")).collect()}
            most = {r["source"]: r["t"] for r in before.groupBy("source").agg(F.max(size).alias("t")).collect()}  # a handful of texts a source
            assert set(got) == set(want) and all(abs(got[k] - want[k]) <= most[k] for k in want)
            assert at.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, at, data)
    assert out.count() == seen[-1] and set(out.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def test_run_is_the_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    rows = sorted(tuple(r) for r in out.collect())
    assert rows and rows == sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect())
    assert len({(r[4], r[5]) for r in rows}) == len(rows)


def test_no_import_is_swallowed():
    for path in (corpus_pipeline.__file__, jaccard.__file__, mixing.__file__, decontaminate.__file__):
        tree = ast.parse(open(path).read())
        caught = {getattr(h.type, "id", "") for n in ast.walk(tree) if isinstance(n, ast.Try) for h in n.handlers}
        assert not caught & {"ImportError", "ModuleNotFoundError"}


CLASH = ["_d", "_m", "_i", "_t", "_h", "_th", "_copies", "m", "d", "n", "row", "id", "hash", "k_id", "k_hash", "i", "copies", "text_hash", "_source", "_doc_id", "label", "a.b", "w", "items"]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_columns_of_any_name_come_along(spark, data, stage):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60")
    docs = docs.union(docs.where("doc_id % 10 = 0")).withColumn("n_chars", F.col("n_chars").cast("long"))
    more = docs.select("*", *[F.lit(-5).alias(c) for c in CLASH], F.create_map(F.lit("k"), F.col("doc_id")).alias("map"))
    plain = [tuple(r) for r in stage[1](spark, docs, data).collect()]
    got = stage[1](spark, more, data)
    if stage[0] == "sharding":
        assert sorted(tuple(r) for r in got.collect()) == sorted(plain)
        return
    assert got.columns == more.columns
    rows = got.collect()
    assert all(r[c] == -5 for r in rows for c in CLASH) and all(r["map"] == {"k": r["doc_id"]} for r in rows)
    if stage[0] != "mixing":  # there the draws hash all columns
        assert sorted(str(tuple(r)[:5]) for r in rows) == sorted(map(str, plain))


def test_odd_rows_pass_the_stages(spark, data):
    at = H.odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    kept = [len(H.ODD)]
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data)
        kept.append(at.count())
    assert 0 < kept[-1] <= 2 * kept[0] and kept[1] < kept[0]


def test_empty_input(spark, data):
    at = H.empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data)
    assert at.count() == 0
