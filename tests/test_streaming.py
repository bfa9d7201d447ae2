"""Streams agree with batches."""

import json
import uuid

from mnemoloom.streaming import ingest


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    notes = [{"user_id": "u", "ts": "2024-01-01T00:00:00Z", "title": "t", "raw_text": f"A first sentence that is long enough to count {i}. Another sentence that is long enough as well."} for i in range(5)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, notes)))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    run()
    (tmp_path / "in" / "b.json").write_text("\n".join(map(json.dumps, notes[:3] + [notes[0] | {"raw_text": "Short."}, notes[0] | {"raw_text": "  "}])))
    run()
    got = spark.read.parquet(str(tmp_path / "store"))
    assert got.count() == 6 and got.select("episode_id").distinct().count() == 6
    assert sorted(len(r.sentences) for r in got.collect()) == [1, 2, 2, 2, 2, 2]


def collect(stream, mode):
    name = "q" + uuid.uuid4().hex
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(180)
    return stream.sparkSession.table(name)


def test_strengths_agree_with_the_batch(spark, tmp_path):
    rows = [(1, "u", "1", "NEW"), (2, "u", "1", "SUPPORT"), (3, "u", "1", "STRENGTHENED"), (4, "u", "2", "SUPPORT"), (5, "u", "2", "NEW"), (6, "v", "1", "NEW"), (7, "v", "1", "PRUNED")]
    spark.createDataFrame(rows, "seq long, user_id string, claim_id string, type string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("seq long, user_id string, claim_id string, type string").parquet(str(tmp_path / "e"))
    got = {(r.user_id, r.claim_id): r.strength for r in collect(ingest.strengths(stream), "update").collect()}
    assert got == {("u", "1"): 1.75, ("u", "2"): 1.0, ("v", "1"): 0.0}


def test_recency_agrees_with_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(user_id as string) user_id", "cast(ts as timestamp) ts")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = collect(ingest.recency(stream), "update")
    last = {(r.user_id, r.start): r.n for r in got.collect()}
    want = {(r.user_id, r.start): r.n for r in ingest.recency(events).collect()}
    assert sum(last.values()) == sum(want.values()) and last == want
