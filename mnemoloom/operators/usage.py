"""What use says about claims: exposure, votes, recurrence, strengthening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def net_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy("user_id", "claim_id").agg(F.sum("vote").alias("net"))


def exposure(signals: DataFrame, support: DataFrame) -> DataFrame:
    """(user_id, claim_id, seen, fetched): shown and fetched counts of the episodes that support each claim.

    Signals are counted by episode before the join, so a hot episode joins as one row.
    """
    shown = signals.groupBy("user_id", "episode_id").agg(F.count(F.lit(1)).alias("seen"), F.sum("fetched").alias("fetched"))
    return support.join(shown, ["user_id", "episode_id"]).groupBy("user_id", "claim_id").agg(F.sum("seen").alias("seen"), F.sum("fetched").alias("fetched"))


def exposed_never_fetched(signals: DataFrame, support: DataFrame, votes: DataFrame, least: int = 3) -> DataFrame:
    """Claims often shown, never fetched, and not voted for."""
    e = exposure(signals, support).where((F.col("seen") >= least) & (F.col("fetched") == 0))
    return e.join(net_votes(votes), ["user_id", "claim_id"], "left").where(F.coalesce("net", F.lit(0)) <= 0).select("user_id", "claim_id", "seen")


def feedback_changes(votes: DataFrame, claims: DataFrame, margin: int = 1) -> DataFrame:
    """Claims that votes bring back from the background, or send there."""
    j = net_votes(votes).join(claims.select("user_id", "claim_id", "background"), ["user_id", "claim_id"])
    change = F.when((F.col("net") > 0) & (F.col("background") == 1), "UNBACKGROUNDED").when((F.col("net") <= -margin) & (F.col("background") == 0), "BACKGROUNDED")
    return j.select("user_id", "claim_id", change.alias("type")).where("type is not null")


def recurrent(support: DataFrame, claims: DataFrame, members: DataFrame, repeats: int = 2) -> DataFrame:
    """Claims repeated by so many further episodes that they are background, unless they are already or have no home."""
    n = support.groupBy("claim_id").agg(F.countDistinct("episode_id").alias("n")).where(F.col("n") - 1 >= repeats)
    housed = members.where("kind = 'primary'").select("claim_id")
    return claims.where("background = 0").join(housed, "claim_id", "left_semi").join(n, "claim_id").select("claim_id", "n")


def strengthened(events: DataFrame, top: int = 3) -> DataFrame:
    """The claims that grew most often; ties keep the order of first growth."""
    grew = events.where(F.col("type").isin("STRENGTHENED", "CANONICALIZED"))
    return grew.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").limit(top).select("claim_id", "n")
