"""Files in, files out, and streams."""

import json
import zipfile

from pyspark.sql import functions as F

from uttera import schemas
from uttera.sources import models, readers, writers
from uttera.streaming import incremental


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('ID,duration,wav,tun_transcription\n1,2.5,a.wav,"he said ""hi"", ok"\n2,x,,"two\nlines"\n', encoding="utf-8")
    r = {x.ID: x for x in readers.csv_splits(spark, [str(p), str(tmp_path / "none.csv")]).collect()}
    assert r["1"].tun_transcription == 'he said "hi", ok' and r["2"].tun_transcription == "two\nlines"
    assert r["2"].duration is None and r["1"].intent is None
    assert readers.csv_splits(spark, [str(tmp_path / "none.csv")]).count() == 0
    writers.csv_manifest(readers.csv_manifest(spark, str(p)), str(tmp_path / "out"))
    again = {x.ID: x.tun_transcription for x in readers.csv_manifest(spark, str(tmp_path / "out")).collect()}
    assert again == {k: v.tun_transcription for k, v in r.items()}


def test_lists(spark, tmp_path):
    p = tmp_path / "l.txt"
    p.write_text("b\n# c\n\n a \nb\n", encoding="utf-8")
    assert [r.label for r in readers.label_list(spark, str(p)).collect()] == ["a", "b"]
    assert [r.label for r in readers.ordered_labels(spark, str(p)).orderBy("pos").collect()] == ["b", "# c", "a", "b"]
    (tmp_path / "ids").write_text("x y\n\nz x")
    assert sorted(r.id for r in readers.id_set(spark, str(tmp_path / "ids")).collect()) == ["x", "y", "z"]
    (tmp_path / "p.tsv").write_text("w1\ta b\tc\nw2\td\n")
    assert [(r.wav, r.text) for r in readers.tsv_pool(spark, str(tmp_path / "p.tsv")).orderBy("pos").collect()] == [("w1", "a b\tc"), ("w2", "d")]
    writers.label_list(spark.createDataFrame([("b",), ("a",)], "label string"), str(tmp_path / "o"))
    assert [r.label for r in readers.label_list(spark, str(tmp_path / "o")).collect()] == ["a", "b"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "run1.jsonl").write_text('{"response": "é", "meta": {"id": "1"}}\n\n  \n{"response": null, "meta": {"id": "2"}}\n', encoding="utf-8")
    r = readers.runs(spark, str(tmp_path / "*.jsonl"), schemas.RESULT)
    assert {(x.run, x.meta.id) for x in r.collect()} == {("run1", "1"), ("run1", "2")}
    out = str(tmp_path / "out")
    writers.jsonl(r.select("response"), out, nulls=True)
    writers.append_new(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("a",)], "id string"), "id", str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 1
    assert spark.read.text(out).where("value like '%null%'").count() == 1


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(writers.wav_bytes([0.5, -0.5, 0.0, 0.25], 8000))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    h = {x.path.rsplit("/", 1)[1]: (x.rate, x.duration) for x in readers.wav_headers(spark, str(tmp_path / "*.wav")).collect()}
    assert h == {"a.wav": (8000, 0.001), "b.wav": (None, 0.0)}
    x = spark.read.format("binaryFile").load(str(tmp_path / "*.wav")).select(F.regexp_extract("path", "([ab])[.]wav", 1).alias("n"), readers.pcm(F.col("content")).alias("x"))
    got = {r.n: r.x for r in x.collect()}
    assert got == {"a": [0.5, -0.5, 0.0, 0.25], "b": None}
    writers.wav_files(spark.createDataFrame([("c", [0.5])], "name string, samples array<double>"), str(tmp_path), 8000)
    assert (tmp_path / "c.wav").stat().st_size == 46


def test_submission_zip(spark, tmp_path):
    df = spark.createDataFrame([("10-x", "a"), ("9-x", "é")], "id string, hyp string")
    assert writers.submission(df, str(tmp_path / "s.zip")) == 2
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        assert [json.loads(x)["id"] for x in z.read("predictions.jsonl").decode().splitlines()] == ["9-x", "10-x"]
    m = writers.metrics(spark.createDataFrame([(0.123456, 3)], "accuracy double, scored int"), str(tmp_path / "m.json"))
    assert m == {"accuracy": 0.1235, "scored": 3}
    assert "note" in writers.metrics(spark.createDataFrame([(None, 3)], "accuracy double, scored int"), str(tmp_path / "m.json"))


def test_models(spark):
    calls = []

    def flaky(p):
        calls.append(1)
        raise OSError

    assert models.with_retries(flaky, 3, sleep=lambda s: None)(["a", "b"]) == [None, None] and len(calls) == 3
    df = spark.createDataFrame([("a",), (None,), ("b",)], "p string")
    got = [r.response for r in models.respond(df, "p", models.stub(["x", "y"]), batch=1).collect()]
    assert got[1] is None and json.loads(got[0])["intent"] in ("x", "y")


def test_stream(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "id string, v int"
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.json(src)

    def run():
        q = incremental.process(incremental.new_files(spark, src, spark.createDataFrame([], schema).schema), lambda d: d.withColumn("w", F.col("v") * 2), out, state)
        q.awaitTermination(60)

    run()
    assert sorted(r.w for r in spark.read.parquet(out).collect()) == [2, 4]
    spark.createDataFrame([("c", 3)], schema).write.mode("append").json(src)
    run()
    assert sorted(r.w for r in spark.read.parquet(out).collect()) == [2, 4, 6]


def test_stream_dedup(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, v int").coalesce(1).write.json(src)
    s = incremental.first_seen(incremental.new_files(spark, src, spark.createDataFrame([], "id string, v int").schema), "id")
    q = s.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("seen").collect()) == ["a", "b"]


def test_tensors(spark, tmp_path):
    from uttera.sources import tensors

    rows = [("a", r, c, float(r * 3 + c)) for r in range(2) for c in range(3)] + [("b", 0, 0, 7.0), ("c", 0, 1, -1.5)]
    df = spark.createDataFrame(rows, tensors.ENTRIES)
    where = tensors.write_tensors(df, str(tmp_path / "t"), 2)
    assert set(where) == {"a", "b", "c"} and len(set(where.values())) == 2
    got = {tuple(r) for r in tensors.read_tensors(spark, str(tmp_path / "t")).where("val <> 0").collect()}
    assert got == {r for r in rows if r[3]}


def test_prompt_book(tmp_path):
    from uttera.sources import prompt_book

    p = str(tmp_path / "book.txt")
    assert not prompt_book.is_current({"x": "y"}, p)
    prompt_book.write({"x": "y", "a": "b\n"}, p)
    assert prompt_book.is_current({"a": "b", "x": "y"}, p) and not prompt_book.is_current({"a": "c", "x": "y"}, p)


def test_stage(spark):
    from uttera.session import shared_dir, stage

    df = stage(spark.range(5).withColumn("x", F.array(F.col("id"))))
    assert df.count() == 5 and shared_dir(spark) == shared_dir(spark)
    assert stage(df.limit(0)).count() == 0


def test_resampled():
    import numpy as np

    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t).astype("float32")
    up = readers.resampled(x, 8000, 16000)
    assert len(up) == 16000 and np.abs(up[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 0.01
    high = np.sin(2 * np.pi * 3500 * t).astype("float32")  # above what 4,000 samples a second can hold
    assert np.abs(readers.resampled(high, 8000, 4000)[100:-100]).max() < 0.05
    assert readers.resampled(x, 8000, 8000) is x and len(readers.resampled(x[:0], 8000, 4000)) == 0


def test_queries_of_files(spark):
    """Each query that writes and reads back runs on the smallest tables."""
    from uttera.plans import files

    d = "/root/testdata/sf0.001"
    for name in ("csv_round_trip", "jsonl_round_trip", "training_logs", "tsv_round_trip", "sound_round_trip", "tensor_round_trip", "sounds_spoken", "stream_first_seen"):
        assert files.QUERIES[name](spark, d).count() > 0, name


def test_staging_cleans_up(spark):
    import os

    from uttera import session

    with session.staging(spark):
        t = session.stage(spark.range(10))
        at = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 10 and os.path.exists(at)
    assert not os.path.exists(at)
    assert session.stage(spark.range(3)).count() == 3
    small, large = session.bounded(spark.range(3), 3), session.bounded(spark.range(4), 3)
    plan = lambda x: spark.range(9).join(x, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(small) and "broadcast" not in plan(large)
