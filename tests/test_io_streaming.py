import datetime
import json

import pytest

from quarrycrest.sources import readers, schemas, sinks
from quarrycrest.streaming import jobs


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"url": "u", "text": "é"}, {"url": "v", "chunk_index": 2}]))
    got = readers.json_array(spark, str(tmp_path / "a.json"), schemas.CHUNK).orderBy("url").collect()
    assert [(r.url, r.text, r.chunk_index) for r in got] == [("u", "é", None), ("v", None, 2)]
    found = readers.chunk_sources(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "gone.json")})
    assert found["a"].count() == 2 and found["b"] is None
    (tmp_path / "l.txt").write_text("x\n\ny")
    assert [(r.ord, r.line) for r in readers.text_lines(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == [(0, "x"), (1, ""), (2, "y")]
    pages = spark.createDataFrame([("f", 1, "b"), ("f", 0, "a"), ("f", 2, None)], "file string, page int, text string")
    assert readers.concat_pages(pages).first().text == "a\nb\n\n"


def test_written_arrays_and_lines_are_read_again(spark, tmp_path):
    rows = [(i, None if i % 3 else f"t{i}\n\"é", [("M", None)]) for i in range(25)]
    schema = "id int, text string, days array<struct<a:string,b:string>>"
    df = spark.createDataFrame(rows, schema)
    sinks.write_json_array(df, str(tmp_path / "j"), per_array=10)
    got = readers.json_array(spark, str(tmp_path / "j"), schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    sinks.write_json_array(df.limit(0), str(tmp_path / "e"))
    assert readers.json_array(spark, str(tmp_path / "e"), schema).count() == 0
    sinks.write_text(spark.createDataFrame([("x",), (None,)], "line string"), str(tmp_path / "t"))
    assert sorted(r.line for r in readers.text_lines(spark, str(tmp_path / "t")).collect())[-1] == "x"


def test_versions(spark, tmp_path):
    base = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, base)
    sinks.create_if_missing(spark, base, "id string")
    assert sinks.read_latest(spark, base).count() == 0
    sinks.write_version(spark.createDataFrame([("1",)], "id string"), base)
    (tmp_path / "t" / "v=9").mkdir()  # a write that never ended
    sinks.create_if_missing(spark, base, "id string")
    assert sinks.read_latest(spark, base).count() == 1 and sinks.versions(spark, base) == [1, 2]
    sinks.write_json(sinks.read_latest(spark, base), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_session_stream(spark, tmp_path):
    base, t = str(tmp_path / "s"), datetime.datetime(2026, 1, 1)
    sinks.create_if_missing(spark, base, schemas.SESSION)
    schema = f"session_id string, messages {schemas.MESSAGES}, at timestamp"
    for k in range(2):
        spark.createDataFrame([("a", [("user", str(k))], t + datetime.timedelta(hours=k))], schema).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.keep_sessions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), base, str(tmp_path / "c")).awaitTermination()
    r = sinks.read_latest(spark, base).first()
    assert (r.messages[0].content, r.started_at, r.last_active) == ("1", t, t + datetime.timedelta(hours=1))


def test_ingest_is_resumable(spark, tmp_path):
    schema = f"rec_id bigint, {schemas.CHUNK}"
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: jobs.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "ix"), str(tmp_path / "c")).awaitTermination()
    put([(1, "u", "", "", 0, "x", "old", 0, 1), (2, "v", "", "", 0, "x", "t", 0, 1)])
    run()
    run()
    put([(3, "u", "", "", 0, "x", "new", 0, 1)])
    run()
    assert sorted((r.url, r.text) for r in sinks.read_latest(spark, str(tmp_path / "ix")).collect()) == [("u", "new"), ("v", "t")]
    assert sinks.versions(spark, str(tmp_path / "ix")) == [1, 2]


def test_request_counts_close_windows(spark, tmp_path):
    t = datetime.datetime(2026, 1, 1)
    rows = [(1, t), (1, t), (2, t), (1, t + datetime.timedelta(hours=2)), (1, t + datetime.timedelta(hours=5))]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("user_id bigint, ts timestamp_ntz").parquet(str(tmp_path / "e"))
    q = jobs.request_counts(stream, limit=1).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.window_start, r.user_id, r.n, r.over_limit) for r in spark.table("counts").collect()}
    assert {(t, 1, 2, True), (t, 2, 1, False)} <= got
