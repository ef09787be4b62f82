"""Transcripts, sinks and streaming variants."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.sources import sinks, transcripts
from palimpsest.streaming import turns as st

LINES = [
    {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"role": "user", "content": "hello <relevant-memories>old</relevant-memories>there"}},
    {"type": "assistant", "uuid": "2", "timestamp": "2024-01-01T00:00:01Z", "sessionId": "s", "message": {"role": "assistant", "content": json.dumps([{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "part one"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "part two"}])}},
    {"type": "assistant", "uuid": "3", "timestamp": "2024-01-01T00:00:02Z", "sessionId": "s", "message": {"role": "assistant", "content": json.dumps([{"type": "tool_use", "name": "x"}])}},
    {"type": "user", "uuid": "4", "timestamp": "2024-01-01T00:00:03Z", "sessionId": "s", "message": {"role": "user", "content": ""}},
    {"type": "summary", "uuid": "5", "timestamp": "2024-01-01T00:00:04Z", "sessionId": "s"},
]


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, LINES), "{not json"]))
    records = transcripts.read_transcripts(spark, str(tmp_path)).cache()
    assert records.where("_corrupt_record is not null").count() == 1
    assert [(r["uuid"], r["text"]) for r in transcripts.turns(records).orderBy("uuid").collect()] == [("1", "hello there"), ("2", "part one\npart two")]


def test_arrays_in_content_are_read_as_text(spark, tmp_path):
    line = dict(LINES[1], message={"role": "assistant", "content": [{"type": "text", "text": "nested"}]})
    (tmp_path / "b.jsonl").write_text(json.dumps(line))
    assert transcripts.turns(transcripts.read_transcripts(spark, str(tmp_path))).first()["text"] == "nested"


def test_sinks(spark, tmp_path):
    current = spark.createDataFrame([(1, "A", "a"), (2, "B", "b")], "id long, text string, text_norm string")
    incoming = spark.createDataFrame([(2, " New "), (3, "  "), (4, "D")], "id long, text string")
    sinks.upsert(current, incoming, "id", str(tmp_path / "v2"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "v2")).collect())) == [(1, "A", "a"), (2, " New ", "new"), (4, "D", "d")]
    out = str(tmp_path / "turns")
    sinks.append_new(current.limit(0), current, ["id"], out)
    sinks.append_new(spark.read.parquet(out), current, ["id"], out)
    assert spark.read.parquet(out).count() == 2


def test_vault_and_report(spark, sf_dir):
    from palimpsest.sources.tables import memory_units

    notes = sinks.vault(memory_units(spark, sf_dir))
    assert notes.columns == ["folder", "day", "note"] and notes.count() == 180
    gaps = spark.createDataFrame([("list", "x", 3, 0.3, "f1"), ("list", "mail a@b.com", 9, 0.9, "f2")], "kind string, item string, n long, score double, fingerprint string")
    assert [r["line"] for r in sinks.report(gaps).collect()] == ["| list | mail [email] | 9 | 0.9 |", "| list | x | 3 | 0.3 |"]


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    st.to_table(st.new_turns(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    events.write.mode("append").parquet(str(source))  # delivered again
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    st.to_table(st.new_turns(stream, ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_stream_sessions_close(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    st.to_table(st.sessions(stream, ["user_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    closed = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {tuple(r) for r in st.sessions(events, ["user_id"]).collect()}
    assert closed and closed <= whole


def test_store_batches(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(10).write.parquet(str(source))
    seen = []
    st.to_store(spark.readStream.schema("id long").parquet(str(source)), lambda batch, batch_id: seen.append((batch_id, batch.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, 10)]
