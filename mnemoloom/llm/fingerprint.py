"""Document fingerprints by consistent weighted sampling.

A document is its words, each weighted by how often it occurs. For every word and each of ``SAMPLES`` samples, hashing the
word draws r and c from Gamma(2, 1) and b from the uniform distribution. For a weight w they give t = floor(ln w / r + b)
and ln a = ln c - r (t - b) - r; the word of least a is the sample, recorded as (word, t). Two documents agree in a sample
with a chance that equals their generalised Jaccard similarity, the sum of least weights over the sum of greatest. The
fingerprint keeps 16 bits of a hash of each sample, so unlike samples look alike once in 65,536.

A (word, weight) pair always gives the same row of candidates, so rows are remembered in each worker. A row packs a (as
order-preserving bits) above the 16 bits of the sample, and a document's fingerprint is the minimum over its rows.

Defined cases: a null text is empty; a very long one counts whole; null ids come last, in one bucket; a text without words has a fingerprint of zeros, alike to another such (1) and to
nothing else (0); documents of one id are ordered by text; an empty table gives an empty result; a single document is its
own next one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes

SAMPLES = 64
#: Rows of one bucket of the order, and the most buckets that the driver keeps the first keys of; larger buckets are streamed alike.
BUCKET_ROWS, MAX_BUCKETS = 2000, 100_000
EMPTY = "0" * (4 * SAMPLES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles(levels: int = 1 << 16) -> np.ndarray:
    """Gamma(2, 1) at the middles of ``levels`` equal shares of probability, by bisection of 1 - (1 + x) e^-x."""
    p = (np.arange(levels) + 0.5) / levels
    low, high = np.zeros(levels), np.full(levels, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class _Rows(dict):
    """Places of pairs in the table: a word by itself has weight 1. New keys wait in ``new`` for their draws."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        at = self[key] = len(self)
        self.new.append((key, 1) if isinstance(key, str) else key)
        return at


class Sampler:
    """Fingerprints of texts, with the rows of (word, weight) pairs remembered up to ``max_rows``."""

    def __init__(self, samples: int = SAMPLES, seed: int = 1, max_rows: int = 250_000):
        self.samples, self.max_rows = samples, max_rows
        self.salt = _mixed((np.arange(samples, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))
        gamma = _gamma_quantiles()
        self.gamma, self.log_gamma = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.rows = _Rows()
        self.table = np.empty((1024, samples), dtype=np.uint64)

    def _draw(self, pairs: list[tuple[str, int]]) -> np.ndarray:
        """Rows of new (word, weight) pairs; one hash for each sample yields r, c and b, 16 bits each."""
        h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w, _ in pairs], dtype=np.uint64)[:, None]
        bits, low = _mixed(h ^ self.salt), np.uint64(0xFFFF)
        r, log_c = self.gamma[bits & low], self.log_gamma[bits >> np.uint64(16) & low]
        b = ((bits >> np.uint64(32) & low).astype(np.float32) + np.float32(0.5)) / np.float32(65536)
        t = np.floor(np.log(np.array([w for _, w in pairs], dtype=np.float64)).astype(np.float32)[:, None] / r + b)
        a = log_c - r * (t - b) - r
        order = a.view(np.uint32)
        ordered = np.where(order >> np.uint32(31), ~order, order | np.uint32(0x80000000)).astype(np.uint64)
        sample = _mixed(h + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & low
        return ordered << np.uint64(16) | sample

    def signatures(self, texts: list[str]) -> np.ndarray:
        """One row of 16-bit samples for each text; zeros where there is no word."""
        if len(self.rows) > self.max_rows:
            self.rows.clear()
        rows, picked, sizes = self.rows, [], []
        for text in texts:
            counts = Counter(text.split())
            sizes.append(len(counts))
            picked += map(rows.__getitem__, [w if n == 1 else (w, n) for w, n in counts.items()])
        new, rows.new = rows.new, []
        picked = np.array(picked, dtype=np.int64)
        if len(rows) > len(self.table):
            grown = np.empty((max(len(rows), 2 * len(self.table)), self.samples), dtype=np.uint64)
            grown[: len(rows) - len(new)] = self.table[: len(rows) - len(new)]
            self.table = grown
        for at in range(0, len(new), 512):
            part = new[at : at + 512]
            first = len(rows) - len(new) + at
            self.table[first : first + len(part)] = self._draw(part)
        out = np.zeros((len(texts), self.samples), dtype=np.uint16)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(texts):  # bounded gathers, single long texts aside
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 20_000)))
            lo, hi = (ends[begin - 1] if begin else 0), ends[end - 1]
            full = [i for i in range(begin, end) if sizes[i]]
            if full:
                starts = [ends[i] - sizes[i] - lo for i in full]
                out[full] = np.minimum.reduceat(self.table[picked[lo:hi]], starts, axis=0) & np.uint64(0xFFFF)
            begin = end
        return out


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; rows of zeros stand for texts without words."""
    if not a.any() or not b.any():
        return float(not a.any() and not b.any())
    return float((a == b).mean())


def _placer(firsts: np.ndarray):
    """A column function: twice the bucket of a key, plus one if it is the first key there. ``firsts`` descend from the greatest key."""
    ascending = -firsts

    @F.pandas_udf("bigint")
    def place(keys: pd.Series) -> pd.Series:
        k = -keys.to_numpy(dtype=np.int64)
        at = np.searchsorted(ascending, k, side="right") - 1
        return pd.Series(2 * at + (ascending[at] == k))

    return place


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows dealt out by buckets of descending ``key``, ready to be streamed: (__b, __guest, __key, __text).

    Each bucket ends with a guest, the first row of the bucket after it (of the first bucket, after the last one). A text
    is shuffled once. Buckets are range partitions of the keys alone; the driver sees the first key of each, and Python
    workers look keys up in these, no literals in the plan.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    ids = rows.select("__key").where("__key is not null")
    buckets = min(MAX_BUCKETS, max(1, ids.count() // BUCKET_ROWS))
    tops = ids.repartitionByRange(buckets, F.desc("__key")).groupBy(F.spark_partition_id().alias("p")).agg(F.max("__key").alias("m")).collect()
    firsts = np.array(sorted({r["m"] for r in tops}, reverse=True), dtype=np.int64)
    nulls = 0 if rows.where("__key is null").isEmpty() else 1
    last = len(firsts) - 1 + nulls
    n = F.lit(len(firsts))
    if len(firsts):
        code = _placer(firsts)(F.coalesce("__key", F.lit(0).cast("bigint")))
        rows = rows.withColumn("__code", F.when(F.col("__key").isNotNull(), code).otherwise(2 * n + 1))
    else:
        rows = rows.withColumn("__code", F.lit(1))
    home, first = F.floor(F.col("__code") / 2).cast("int"), F.col("__code") % 2 == 1
    own = F.struct(home.alias("b"), F.lit(False).alias("guest"))
    before = F.struct(F.when(home == 0, F.lit(last)).otherwise(home - 1).alias("b"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("__to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("__to.b").alias("__b"), F.col("__to.guest").alias("__guest"), "__key", "__text")
    return dealt.repartition("__b").sortWithinPartitions("__b", "__guest", F.desc_nulls_last("__key"), "__text")


SCHEMA = "doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprint of every text and of its edited form, and their likeness to one another and to the next text's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, held = Sampler(samples), None
        for frame in frames:
            rows = list(zip(frame["__b"], frame["__guest"], frame["key"], frame["__text"]))
            signs = sampler.signatures([r[3] for r in rows])
            pairs = []  # (row, its signature, next text, next signature)
            for row, sign in zip(rows, signs):
                if held is not None and held[0][0] == row[0] and not held[0][1]:
                    pairs.append((*held, row[3], sign))
                held = (row, sign)
            edited = [edit(p[0][3], p[2]) for p in pairs]
            out = []
            for (row, sign, _, other), changed, new in zip(pairs, edited, sampler.signatures(edited)):
                digest = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                out.append((row[2], len(row[3]), digest, hexed(sign), hexed(new), likeness(sign, new), likeness(sign, other)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    dealt = by_bytes(with_next(docs, key, text)).select("__b", "__guest", F.col("__key").cast("string").alias("key"), "__text")
    made = dealt.mapInPandas(run, SCHEMA)
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumnRenamed("doc_id", key)
