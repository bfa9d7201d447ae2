"""Relational operators of the memory model: tenant-keyed joins, first- and last-wins upserts, top-n per group, set forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items without a done marker."""
    return items.join(done.select(*key), list(key), "left_anti")


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_wins(df: DataFrame, key: Sequence[str], seq: str, values: Sequence[str]) -> DataFrame:
    """INSERT .. DO NOTHING: for each key the values of its first row. An aggregate, so it combines before the shuffle."""
    return df.groupBy(*key).agg(*[F.min_by(v, seq).alias(v) for v in values])


def last_wins(df: DataFrame, key: Sequence[str], seq: str, values: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """INSERT .. DO UPDATE: updated columns come from the last row, ``keep_first`` from the first."""
    return df.groupBy(*key).agg(*[F.max_by(v, seq).alias(v) for v in values], *[F.min_by(v, seq).alias(v) for v in keep_first])


def partial_update(df: DataFrame, key: Sequence[str], seq: str, skip_null: Sequence[str] = (), write_null: Sequence[str] = ()) -> DataFrame:
    """Partial updates: the last value that isn't null, or the last value whatever it is."""
    return df.groupBy(*key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in skip_null], *[F.max_by(F.struct(c), seq)[c].alias(c) for c in write_null]
    )


def replace_sets(df: DataFrame, owner: str, seq: str) -> DataFrame:
    """Replace-whole sets: only the rows of each owner's last event."""
    last = df.groupBy(F.col(owner).alias("__o")).agg(F.max(seq).alias("__s"))
    return df.join(last, (F.col(owner) == F.col("__o")) & (F.col(seq) == F.col("__s")), "left_semi")


def best_of(frames: Sequence[DataFrame], key: Sequence[str], score: str, values: Sequence[str]) -> DataFrame:
    """Union of candidate lists; each key keeps its greatest score and the values that came with it."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*key).agg(F.max(score).alias(score), *[F.max_by(v, score).alias(v) for v in values])


def undirected(df: DataFrame, a: str, b: str, seq: str, values: Sequence[str]) -> DataFrame:
    """One row for each unordered pair: the first."""
    return first_wins(df.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)), ["lo", "hi"], seq, values)


def keyset_page(df: DataFrame, key: str, before, n: int, tie: str) -> DataFrame:
    """The next page of a descending listing."""
    return df.where(F.col(key) < before).orderBy(F.desc(key), tie).limit(n)


def coverage_of(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows by table and user."""
    frames = [df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tombstoned(inserts: DataFrame, deletes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Rows inserted after the last delete of their key, the first of these for each key."""
    gone = deletes.groupBy(*key).agg(F.max(seq).alias("__gone"))
    live = inserts.join(gone, list(key), "left").where(F.col("__gone").isNull() | (F.col(seq) > F.col("__gone"))).drop("__gone")
    return live.groupBy(*key).agg(F.min(seq).alias(seq))
