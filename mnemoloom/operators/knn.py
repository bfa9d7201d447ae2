"""Exact nearest neighbours by tenant, in blocks.

Corpus and probes are packed into blocks of rows of one user, as many as that user's own rows need. Every pair of a probe
block and a corpus block of a user is a key of its own, to which both blocks are sent; each pair is one matrix product that
keeps k hits for each probe, and a window merges the hits. A user with a third of all rows has many pairs, which spread over
all tasks; many small users have one pair each. Nothing is broadcast and no row is dropped. Python holds one pair at a time
beside the Arrow batch that it came in, and some hundred rows of the pair's product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
ROWS = 256  # of a product


def blocks(df: DataFrame, key: str, vector: str, user: str, size: int | None = None) -> DataFrame:
    """(user, n, b, ids, flat): a user's rows in n blocks of about ``size``, else ``BLOCK``, b from 0."""
    rows = df.select(F.col(user).alias("user"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    sizes = rows.groupBy("user").agg(F.ceil(F.count(F.lit(1)) / (size or BLOCK)).cast("int").alias("n"))
    dealt = rows.join(sizes, "user").withColumn("b", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    return dealt.groupBy("user", "n", "b").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select("user", "n", "b", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def tagged_blocks(df: DataFrame, key: str, vector: str, user: str, tag: str) -> DataFrame:
    """``blocks`` with each row's tag (tags). Rows of one tag lie in one block, or in as many as they fill."""
    rows = df.select(F.col(user).alias("user"), F.col(key).cast("string").alias("id"), F.col(tag).cast("string").alias("tag"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    counts = rows.groupBy("user", "tag").agg(F.count(F.lit(1)).alias("c"))
    n = F.ceil(F.sum("c").over(Window.partitionBy("user")) / BLOCK).cast("int")
    counts = counts.select("user", F.col("tag").alias("t"), n.alias("n"), F.ceil(F.col("c") / BLOCK).alias("pieces"))
    dealt = rows.join(counts.withColumnRenamed("user", "u"), (F.col("user") == F.col("u")) & F.col("tag").eqNullSafe(F.col("t")))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("tag", F.pmod(F.xxhash64("id"), "pieces")), F.col("n")).cast("int"))
    g = dealt.groupBy("user", "n", "b").agg(F.collect_list(F.struct("id", "v", "tag")).alias("rows"))
    return g.select("user", "n", "b", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"), F.col("rows.tag").alias("tags"))


def block_pairs(probes: DataFrame, corpus: DataFrame, probe_key: str, corpus_key: str, vector: str, user: str) -> DataFrame:
    """(user, pb, cb, pid, pflat, cid, cflat): all pairs of a user's probe and corpus blocks."""
    return paired(blocks(probes, probe_key, vector, user), blocks(corpus, corpus_key, vector, user))


def paired(p: DataFrame, c: DataFrame) -> DataFrame:
    np_, nc = (d.select("user", "n").distinct().withColumnRenamed("n", "m") for d in (p, c))
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    left = p.join(nc, "user").select("user", F.col("b").alias("pb"), every.alias("cb"), F.col("ids").alias("pid"), F.col("flat").alias("pflat"))
    right = c.join(np_, "user").select("user", every.alias("pb"), F.col("b").alias("cb"), F.col("ids").alias("cid"), F.col("flat").alias("cflat"), *[x for x in c.columns if x == "tags"])
    return left.join(right, ["user", "pb", "cb"])


def each_pair(pairs: DataFrame, schema: str, product: Callable) -> DataFrame:
    """What ``product`` yields of each pair as lists of Arrow columns that follow the user; it gets the pair's columns."""
    names, given = [x.split()[0] for x in schema.split(", ")], [c for c in ("pid", "pflat", "cid", "cflat", "tags") if c in pairs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                who = batch.column("user")[i]
                for made in product(*[batch.column(c)[i].values for c in given]):
                    yield pa.RecordBatch.from_arrays([pa.repeat(who, len(made[0])), *made], ["user", *names])

    return pairs.mapInArrow(run, f"user {dict(pairs.dtypes)['user']}, {schema}")


def matrix(flat: pa.Array, rows: int) -> np.ndarray:
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` greatest of each row, equal ones by column; infinite ones don't count."""
    keep = min(k, sims.shape[1])
    least = np.partition(sims, -keep, axis=1)[:, -keep, None]
    i, j = np.nonzero((sims >= least - 2e-9) & (sims > -np.inf))
    order = np.lexsort((j, -np.round(sims[i, j], 9), i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < keep
    return i[first], j[first]


def nearest(probes: DataFrame, corpus: DataFrame, k: int, probe_key: str, corpus_key: str, vector: str = "embedding", user: str = "user_id", exclude_self: bool = False) -> DataFrame:
    """(user, probe, hit, sim, rn): the ``k`` rows of greatest cosine for each probe, ties by id. Vectors are unit length."""

    def product(pid, pflat, cid, cflat):
        order = pc.sort_indices(cid)  # ties go by id
        cid, b = cid.take(order), matrix(cflat, len(cid))[order.to_numpy()]
        a = matrix(pflat, len(pid))
        if exclude_self:
            known = pc.unique(cid)
            own, names = (pc.fill_null(pc.index_in(x, value_set=known), n).to_numpy() for x, n in ((cid, -1), (pid, -2)))
        for at in range(0, len(pid), ROWS):
            sims = a[at : at + ROWS] @ b.T
            if exclude_self:
                sims[names[at : at + ROWS, None] == own[None, :]] = -np.inf
            i, j = top(sims, k)
            yield pid.take(pa.array(at + i)), cid.take(pa.array(j)), pa.array(sims[i, j])

    hits = each_pair(block_pairs(probes, corpus, probe_key, corpus_key, vector, user), "probe string, hit string, sim double", product)
    w = Window.partitionBy("user", "probe").orderBy(F.desc(F.round("sim", 9)), "hit")
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def products(probes: DataFrame, corpus: DataFrame, probe_key: str, corpus_key: str, tag: str, vector: str = "embedding", user: str = "user_id") -> DataFrame:
    """(user, probe, hit, tag, sim): the cosine of every probe with every row of its user."""

    def product(pid, pflat, cid, cflat, tags):
        a, b = matrix(pflat, len(pid)), matrix(cflat, len(cid))
        for at in range(0, len(pid), 16):
            some = pid.slice(at, 16)
            every = pa.array(np.tile(np.arange(len(cid)), len(some)))
            yield some.take(pa.array(np.repeat(np.arange(len(some)), len(cid)))), cid.take(every), tags.take(every), pa.array((a[at : at + 16] @ b.T).ravel())

    # small probe blocks over all tasks: a pair's product has far more rows than the pair has
    pairs = paired(blocks(probes, probe_key, vector, user, 256), tagged_blocks(corpus, corpus_key, vector, user, tag))
    pairs = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "user", "pb", "cb")
    return each_pair(pairs, "probe string, hit string, tag string, sim double", product)


def greatest(probes: DataFrame, corpus: DataFrame, probe_key: str, corpus_key: str, tag: str, vector: str = "embedding", user: str = "user_id") -> DataFrame:
    """(user, probe, tag, sim): the greatest cosine of every probe with the rows of each tag of its user."""

    def product(pid, pflat, cid, cflat, tags):
        codes = tags.dictionary_encode(null_encoding="encode")
        number = codes.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        first = np.flatnonzero(np.diff(number[order], prepend=-1))
        a, b, names = matrix(pflat, len(pid)), matrix(cflat, len(cid))[order], codes.dictionary.take(pa.array(number[order][first]))
        for at in range(0, len(pid), ROWS):
            best = np.maximum.reduceat(a[at : at + ROWS] @ b.T, first, axis=1)
            n = len(best)
            yield pid.slice(at, n).take(pa.array(np.repeat(np.arange(n), len(first)))), names.take(pa.array(np.tile(np.arange(len(first)), n))), pa.array(best.ravel())

    pairs = paired(blocks(probes, probe_key, vector, user), tagged_blocks(corpus, corpus_key, vector, user, tag))
    return each_pair(pairs, "probe string, tag string, sim double", product).groupBy("user", "probe", "tag").agg(F.max("sim").alias("sim"))


PLACES = 4096


def nearest_before(rows: DataFrame, k: int, vector: str = "embedding", user: str = "user_id") -> DataFrame:
    """(user, place, near): the places of the ``k`` rows of greatest cosine among those of lesser place, in order, ties by place.

    ``rows`` has place, from 0 and without gaps for each user, and asked: whether the row is a probe.
    """
    b = F.floor(F.col("place") / PLACES).cast("int").alias("b")
    dealt = rows.select(F.col(user).alias("user"), b, "asked", F.col("place").cast("long").alias("place"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    pack = lambda df: df.groupBy("user", "b").agg(F.collect_list(F.struct("place", "v")).alias("rows")).select("user", "b", F.col("rows.place").alias("ids"), F.flatten("rows.v").alias("flat"))
    last = rows.groupBy(F.col(user).alias("user")).agg(F.floor(F.max("place") / PLACES).cast("int").alias("last"))
    left = pack(dealt.where("asked")).select("user", F.col("b").alias("pb"), F.explode(F.sequence(F.lit(0), "b")).alias("cb"), F.col("ids").alias("pid"), F.col("flat").alias("pflat"))
    right = pack(dealt).join(last, "user").select("user", F.explode(F.sequence("b", "last")).alias("pb"), F.col("b").alias("cb"), F.col("ids").alias("cid"), F.col("flat").alias("cflat"))

    def product(pid, pflat, cid, cflat):
        order = np.argsort(held := cid.to_numpy())
        held, b, asked, a = held[order], matrix(cflat, len(cid))[order], pid.to_numpy(), matrix(pflat, len(pid))
        for at in range(0, len(asked), ROWS):
            sims = a[at : at + ROWS] @ b.T
            if held[-1] >= asked[at : at + ROWS].min():
                sims[held[None, :] >= asked[at : at + ROWS, None]] = -np.inf
            i, j = top(sims, k)
            yield pa.array(asked[at + i]), pa.array(held[j]), pa.array(sims[i, j])

    hits = each_pair(left.join(right, ["user", "pb", "cb"]), "place long, hit long, sim double", product)
    w = Window.partitionBy("user", "place").orderBy(F.desc(F.round("sim", 9)), "hit")
    best = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return best.groupBy("user", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "hit"))), lambda x: x["hit"]).alias("near"))


def similarity(a: F.Column, b: F.Column) -> F.Column:
    """Dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
