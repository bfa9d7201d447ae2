"""Written intermediate tables."""

import os

from mnemoloom import session


def test_stash_reads_back_and_unstash_deletes(spark):
    kept = session.stash(spark.range(10), "a")
    assert sorted(r.id for r in kept.collect()) == list(range(10))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    session.unstash(kept)
    assert not os.path.exists(folder)


def test_unstash_leaves_other_tables_alone(spark, sf):
    session.unstash(spark.read.parquet(f"{sf}/nation.parquet"))
    assert os.path.exists(f"{sf}/nation.parquet")
