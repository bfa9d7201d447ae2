"""Query over all documents: encode, decode, digest.

Defined cases: null texts are empty; an empty text has no tokens; a very long text is encoded whole; repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.llm.bpe import codec
from mnemoloom.session import table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, by the vocabulary in ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = codec(path)
        for frame in frames:
            packed = [bpe.encode(t) for t in frame["__text"]]
            yield pd.DataFrame({
                key: frame["__key"],
                "n_tokens": [len(p) // 4 for p in packed],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(bpe.decode(p).encode("utf-8")).hexdigest() for p in packed],
            })

    rows = by_bytes(docs.select(F.col(key).cast("string").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")))
    made = rows.mapInPandas(run, f"{key} string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return made.withColumn(key, F.col(key).cast(dict(docs.dtypes)[key]))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {"op9_bpe_automaton": op9_bpe_automaton}
ORACLE_SQL: dict[str, str] = {}
