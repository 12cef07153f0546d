import json

import pytest

from foliant.config import ChunkConfig
from foliant.operators import chunking, summary, validate
from foliant.sources import files
from foliant.streaming import incremental


def test_json_arrays(spark, tmp_path):
    for i, rows in enumerate(([{"doc_id": 1, "summary": "a"}, {"doc_id": 2, "error": "x"}], [{"doc_id": 3, "extra": 1}])):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=1))
    at = [f"file://{tmp_path}/{i}.json" for i in range(3)]
    got = files.read_json_arrays(spark, at[:2])
    assert sorted((r["file_ord"], r["doc_id"], r["summary"], r["error"]) for r in got.collect()) == [(0, 1, "a", None), (0, 2, None, "x"), (1, 3, None, None)]
    with pytest.raises(FileNotFoundError):
        files.read_json_arrays(spark, at)
    assert files.read_json_arrays(spark, at, skip_missing=True).count() == 3 and files.read_json_arrays(spark, at[2:], skip_missing=True).count() == 0


def test_csv_and_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc, d', 0.5), (2, None, -1.0)], "doc_id long, t string, v double")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j")
    want = sorted(tuple(r) for r in df.collect())
    assert sorted(tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", "doc_id long, t string, v double").collect()) == want
    assert sorted(tuple(r) for r in spark.read.schema(df.schema).json(f"{tmp_path}/j").collect()) == want
    assert json.loads(df.select(files.indexed_json(df, "doc_id")).first()[0]) == {"1": {"t": 'a "b"\nc, d', "v": 0.5}, "2": {"v": -1.0}}


def test_export_report_and_metadata(spark, tmp_path):
    d = spark.createDataFrame([(1, "One two. Three.")], "doc_id long, text string")
    c = chunking.greedy_chunks(d).drop("sentences")
    cfg = ChunkConfig()
    out = json.loads(files.chunk_export(c, validate.chunk_stats(c), cfg.to_json()).first()["export"])
    assert out["config"]["max_tokens"] == 256 and out["statistics"]["num_chunks"] == 1 and out["chunks"][0]["text"] == "One two. Three."
    sweep = spark.createDataFrame([(0.1, "f", 1.0)], "alpha double, metric string, value double")
    lines = files.report_lines(sweep, summary.best_setting(sweep))
    files.save_text(spark, f"{tmp_path}/r", lines)
    assert [r[0] for r in spark.read.text(f"{tmp_path}/r").collect()] == lines and lines[-1] == "best f: 0.1 (1.000000)"
    m = files.run_metadata(spark, d, 3.0, "cpu", [0.1]).first()
    assert (m["num_samples"], m["time_per_sample_avg"], m["alpha_values"]) == (1, 3.0, "[0.1]")


def test_checkpoints_resume(spark, tmp_path):
    kind = "doc_id long, summary string"
    c = files.Checkpoints(spark, f"{tmp_path}/ck")
    todo = spark.createDataFrame([(i, f"s{i}") for i in range(5)], kind)
    assert c.done(kind).count() == 0
    c.append(todo.where("doc_id < 2"), 0)
    left = todo.join(c.done(kind), "doc_id", "left_anti")
    assert left.count() == 3
    c.append(left, 1)
    c.finish(f"{tmp_path}/out", kind)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5 and not files.exists(spark, f"{tmp_path}/ck")


def test_stream_chunks_like_a_batch(spark, data, tmp_path):
    src = incremental.read_documents(spark, data)
    q = incremental.flat_chunk_stream(src).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = chunking.flat_chunks(spark.read.parquet(f"{data}/documents.parquet"), 1024, 128)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o").collect())) == sorted(map(tuple, batch.collect()))


def test_append_new_skips_what_is_done(spark, data, tmp_path):
    d = spark.read.parquet(f"{data}/documents.parquet")
    run = incremental.append_new(f"{tmp_path}/o")
    run(d.where("doc_id < 50"), 0)
    run(d.where("doc_id < 80"), 1)
    run(d.where("doc_id < 80"), 1)
    got = spark.read.parquet(f"{tmp_path}/o")
    assert got.select("doc_id").distinct().count() == 80 and got.where("batch = 1").select("doc_id").distinct().count() == 30


def test_windowed_counts(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    at = next(n for n, t in e.dtypes if t.startswith("timestamp"))
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(data)
    q = incremental.windowed_counts(stream, at).writeStream.outputMode("complete").format("memory").queryName("seen_events").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen_events").selectExpr("sum(n)").first()[0] == e.count()
