"""Folds of the event log."""

import json

from mnemoloom.operators import log as G


def build(spark, events):
    rows = [(i, "u", "", run, kind, json.dumps(p)) for i, (run, kind, p) in enumerate(events)]
    return spark.createDataFrame(rows, G.LOG_SCHEMA)


def runs(spark, **status):
    return spark.createDataFrame(list(status.items()) or [("none", "done")], "run_id string, status string")


def state(df):
    return {(r.concept_id, r.claim_id, r.kind) for r in df.collect()}


CREATE = [("r1", "CONCEPT_CREATED", {"concept_id": "a", "claim_ids": ["1", "2"]}), ("r1", "CONCEPT_CREATED", {"concept_id": "b", "claim_ids": ["3"]})]


def test_merge_keeps_what_is_kept(spark):
    log = build(spark, [*CREATE, ("r2", "MERGED", {"winner_id": "a", "loser_id": "b", "fold_claim_ids": ["3"], "kept_claim_ids": []})])
    assert state(G.rebuild(log, runs(spark))) == {("a", "1", "primary"), ("a", "2", "primary"), ("a", "3", "primary")}
    assert state(G.rebuild(log, runs(spark, r2="rolled_back"))) == {("a", "1", "primary"), ("a", "2", "primary"), ("b", "3", "primary")}


def test_split_drops_unlisted_members(spark):
    log = build(spark, [*CREATE, (None, "SPLIT", {"concept_id": "a", "into": [{"concept_id": "c", "claim_ids": ["1"]}]})])
    assert state(G.rebuild(log, runs(spark))) == {("b", "3", "primary"), ("c", "1", "primary")}


def test_primary_wins_over_redundant_and_sets_are_replaced(spark):
    log = build(spark, [*CREATE, ("r", "CHANNEL_REDUNDANCY", {"pairs": {"3": ["a"], "1": ["b"]}}), ("r", "ATTACHED", {"concept_id": "a", "claim_ids": ["3"]}), ("r", "CHANNEL_REDUNDANCY", {"pairs": {"2": ["b"]}})])
    assert state(G.rebuild(log, runs(spark))) == {("a", "1", "primary"), ("a", "2", "primary"), ("a", "3", "primary"), ("b", "3", "primary"), ("b", "2", "redundant")}


def test_claim_state_agrees_with_a_fold(spark):
    rows = [(1, "u", "NEW", "1"), (2, "u", "SUPPORT", "1"), (3, "u", "PRUNED", "1"), (4, "u", "SUPPORT", "1"), (5, "u", "NEW", "1"), (6, "u", "STRENGTHENED", "1"), (1, "v", "SUPPORT", "2")]
    got = G.claim_state(spark.createDataFrame(rows, "seq long, user_id string, type string, claim_id string")).collect()
    assert [(r.user_id, r.claim_id, r.strength, r.last_seq) for r in got] == [("u", "1", 1.25, 6)]


def test_append_numbers_after_the_log(spark):
    log = build(spark, CREATE)
    new = spark.range(100).selectExpr("99 - id as id").repartition(7)
    got = [(r.seq, r.id) for r in G.append(log, new, ["id"]).orderBy("seq").collect()]
    assert got == [(2 + i, i) for i in range(100)]
