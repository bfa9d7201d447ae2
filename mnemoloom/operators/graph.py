"""The concept graph: adjacency, degrees, spreading activation, salience."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.operators import kernels as K
from mnemoloom.session import stash

CAP, SEED_CLAIMS, SEED_CONCEPTS, SEED_SIM, HOPS, FAN_OUT, LEAST, LIT, VOI, GAMMA = 25, 12, 5, 0.15, 2, 0.5, 0.04, 0.10, 0.05, 0.5


def adjacency(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, w), both directions: membership weighs 1, relations at most 1 and 1 if they have none; parallel edges keep the greatest."""
    weight = F.least(F.lit(1.0), F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight")))
    edges = members.select(F.col("concept_id").alias("a"), F.col("claim_id").alias("b"), F.lit(1.0).alias("w")).unionByName(
        relations.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), weight.alias("w"))
    )
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("e"))
    return both.select("e.*").where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))


def capped(adj: DataFrame, cap: int = CAP) -> DataFrame:
    """Each node's ``cap`` heaviest neighbours, with its degree before the cap."""
    degree = adj.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    w = Window.partitionBy("src").orderBy(F.desc("w"), "dst")
    kept = adj.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")
    return kept.join(degree, "src")


def related(relations: DataFrame, seeds: DataFrame, prefix: str = "cpt_") -> DataFrame:
    """Neighbours of a seed set that are concepts outside it, by their best edge."""
    ends = relations.select(F.explode(F.array(F.struct(F.col("from_id").alias("s"), F.col("to_id").alias("o")), F.struct(F.col("to_id").alias("s"), F.col("from_id").alias("o")))).alias("e"), "weight").select("e.*", "weight")
    near = ends.join(seeds.select(F.col("concept_id").alias("s")), "s", "left_semi").where(F.startswith("o", F.lit(prefix)))
    return near.join(seeds.select(F.col("concept_id").alias("o")), "o", "left_anti").groupBy(F.col("o").alias("concept_id")).agg(F.max("weight").alias("weight"))


def spread(seeds: DataFrame, edges: DataFrame, hops: int = HOPS, condition=None) -> DataFrame:
    """(query, node, probe, value) after at most ``hops`` synchronous hops from ``seeds`` of the same columns.

    A hop deposits value * w * condition / degree(src)^FAN_OUT on each neighbour, keeps the greatest for each node and
    probe, and drops what is below ``LEAST``. ``condition(deposits, lit)`` may weaken deposits by what is lit already.
    Spreading ends early once a hop adds less than ``VOI`` of what there is; the driver sees that sum alone.
    """
    lit = stash(seeds.groupBy("query", "node", "probe").agg(F.max("value").alias("value")), "lit")
    front = lit
    for _ in range(hops):
        step = front.join(edges, front["node"] == edges["src"]).select("query", F.col("dst").alias("node"), "probe", (F.col("value") * F.col("w") / F.pow(F.col("degree"), F.lit(FAN_OUT))).alias("value"))
        if condition is not None:
            step = condition(step, lit)
        step = step.groupBy("query", "node", "probe").agg(F.max("value").alias("value")).where(F.col("value") >= LEAST)
        held = lit.select("query", "node", "probe", F.col("value").alias("held"))
        front = stash(step.join(held, ["query", "node", "probe"], "left").where("held is null or value > held").drop("held"), "front")
        total = lit.agg(F.sum("value").alias("s")).first()["s"] or 0.0
        gain = front.agg(F.sum("value").alias("s")).first()["s"] or 0.0
        lit = stash(lit.unionByName(front).groupBy("query", "node", "probe").agg(F.max("value").alias("value")), "lit")
        if gain < VOI * total:
            break
    return lit


def unexplained(vectors: DataFrame):
    """A condition for :func:`spread`: deposits times the residual of their node against the query's lit nodes.

    Lit nodes count from a value of ``LIT``; with fewer than two that have vectors (node, v), or for nodes without, deposits
    stay whole. A query's lit nodes are bounded by its seeds and the cap on neighbours.
    """

    def run(key: tuple, targets: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        nodes = dict(zip(pool["lit_node"], pool["lit_v"]))
        names = sorted(nodes)
        held = np.array([nodes[n] for n in names], dtype=float)
        factor = [K.residual(np.asarray(v, dtype=float), held) if len(held) >= 2 else 1.0 for v in targets["v"]]
        return pd.DataFrame({"query": key[0], "node": targets["node"], "factor": factor})

    def condition(step: DataFrame, lit: DataFrame) -> DataFrame:
        targets = step.select("query", "node").distinct().join(vectors, "node")
        pool = lit.groupBy("query", "node").agg(F.max("value").alias("value")).where(F.col("value") >= LIT).join(vectors, "node")
        pool = pool.select(F.col("query").alias("lit_query"), F.col("node").alias("lit_node"), F.col("v").alias("lit_v"))
        factors = targets.groupBy("query").cogroup(pool.groupBy("lit_query")).applyInPandas(run, "query string, node string, factor double")
        weak = step.join(factors, ["query", "node"], "left")
        return weak.select("query", "node", "probe", (F.col("value") * F.coalesce("factor", F.lit(1.0))).alias("value"))

    return condition


def salience(lit: DataFrame, edges: DataFrame, sum_probes: bool = False) -> DataFrame:
    """(query, node, strength, confluence, salience): strength over probes, more for confluence, less for hubs."""
    how = F.sum if sum_probes else F.max
    nodes = lit.groupBy("query", "node").agg(how("value").alias("strength"), F.countDistinct("probe").alias("confluence"))
    degree = edges.select(F.col("src").alias("node"), "degree").distinct()
    d = F.coalesce("degree", F.lit(0))
    score = F.col("strength") * (1 + F.log(F.col("confluence").cast("double"))) * F.pow(1 + F.log(1 + d), F.lit(-GAMMA))
    return nodes.join(degree, "node", "left").select("query", "node", "strength", "confluence", score.alias("salience"))


def headline(claims: DataFrame, strength: str = "strength") -> F.Column:
    """How much a claim's own strength and background flag change its score."""
    factor = F.least(F.lit(2.0), 0.5 + F.col(strength) / 2)
    return factor * F.when(F.col("background") == 1, 0.5).otherwise(1.0)
