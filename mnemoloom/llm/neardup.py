"""Near-duplicate detection by a containment ensemble of MinHash indexes.

A document is the set of its shingles of ``WORDS`` words. Two documents are linked if the smaller set is contained in the
larger by ``CONTAINMENT`` or more, whatever their sizes. Links up to ``RATIO`` = 1 / ``CONTAINMENT`` times apart in size can
hold both ways; the components of these make classes. A link to a larger text holds one way: the class is joined to one
class that contains a member of it, that of the least container, so a short common text doesn't tie together all texts that
quote it. Every text that is contained anywhere is in a class with one of its containers; the others are listed.

1. Documents with equal shingle sets collapse to one representative.
2. Set sizes are cut into partitions, each ``RATIO`` times as wide as its lower bound. A document is indexed in its own
   partition and is a query in its own and the next, so each pair that can be linked both ways meets with the smaller as the
   query. For each partition the containment bound becomes the least Jaccard similarity that such a pair can have, and rows
   and bands are tuned to it separately: as many rows as still find a pair at that bound with probability ``RECALL``.
3. In every band bucket the representative with most company in all its buckets is the hub; (member, hub) pairs are the
   first candidates, so a bucket of n documents makes n - 1 pairs. Each member first checks the hub that it shares most
   buckets with; pairs whose ends are in one class already need no check, as no answer could change the classes. Hubs that
   have met all members of their bucket leave it, and rounds with other hubs follow for the buckets that still hold several
   classes. Members with most company come first, as a text that many are copies of shares buckets with all of these. In the
   buckets that hold several classes after the last round, all members of different classes are checked against each other,
   block by block.
4. In all partitions beyond the next, the converted similarity is too low for bands: a query of q shingles has it at least
   at 0.8 q / (x + 0.2 q) with an indexed set of x, for x = 50 q at 0.016. There every set is asked for by its shingles, and all
   links are found, each container of each set (:func:`_containers`). They are listed beside the classes, on the row of the
   container, as a short text can be in any number of larger ones.
5. A check compares whole shingle sets, computed from the texts: exact, no estimate takes part.

Texts are shuffled for documents in candidate pairs alone, and a hub's text goes to each ``CHUNK`` of its members once.
Labels spread through the links in joins until none changes, with the lineage cut by written tables. The driver gathers
counts and bitmaps of at most 2^``FILTER_BITS`` bits that spare shingles a shuffle; where they are full these shuffle.

Defined cases: a null or empty text has no shingles, and all such documents form one class; a text of fewer than ``WORDS``
words is one shingle; very long texts count whole; repeated rows are members of their class each; rows of one id are one
document, linked by any of its texts; null ids are kept and can't represent a class unless all of its ids are null; of
equally good containers the least id is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.session import stash, unstash

WORDS, CONTAINMENT, RECALL = 5, 0.8, 0.97
#: Sizes of sets up to this far apart can contain one another by ``CONTAINMENT`` both ways.
RATIO = 1 / CONTAINMENT
HASHES = 160
#: The most bits, as a power of two, of a filter of shingles that the driver and all workers hold: 64 MiB.
FILTER_BITS = 29
#: Sizes of sets are compared in steps of this factor; so many steps, or more, lie between any two beyond ``RATIO``.
SIZE_STEP, SIZE_STEPS = 1.09, 2
#: Shingles of a range of hashes, which meet in one task, and those that are dealt out in one go.
RANGE, DEALT = 1 << 20, 1 << 20
#: Members of a hub that are checked in one go.
CHUNK = 256
#: Rounds of hubs after the first.
MORE_ROUNDS = 3
P = "__n_"
#: Characters of texts that are hashed in one go, few enough to stay in a processor's cache.
GROUP = 1 << 17
#: White space beyond ASCII as str.split has it: its UTF-8, three bytes or two and a zero byte, as a number.
_BLANKS = np.array([int.from_bytes(chr(i).encode().ljust(3, b"\0")) for i in range(128, 0x3001) if chr(i).isspace()])
#: Tasks that the rows of one shingle set are dealt out to.
SALTS = 16
#: Members of a bucket, and their shingles, that make up a block.
BLOCK, BLOCK_SHINGLES = 256, 400_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                grow = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))])
                self.up, self.down = grow(np.uint64(_BASE)), grow(np.uint64(pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hashed(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of all ``texts``, one text after the other, and where each text's begin and the last one's end.

    A rolling hash over the bytes of the words with single blanks: a run's hash is a difference of two prefix sums.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([*parts, b"  "]), dtype=np.uint8)
    within = lambda low, high: data - np.uint8(low) <= high - low
    blank = within(9, 13) | within(28, 32)
    at = np.flatnonzero((data == 0xC2) | within(0xE1, 0xE3))  # the bytes that begin one of _BLANKS
    if len(at):
        code = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | np.where(data[at] < 0xE0, 0, data[at + 2])
        at, code = at[held := np.isin(code, _BLANKS)], code[held]
        blank[at] = blank[at + 1] = True
        blank[at[code & 255 > 0] + 2] = True
    after = np.append(True, blank[:-1])
    first = np.searchsorted(np.flatnonzero(after & ~blank), np.cumsum([0, *(len(x) + 1 for x in parts)]))
    keep = ~(after & blank)
    data, ends = data[keep], np.flatnonzero(blank[keep])
    data[ends] = 32
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    starts = np.append(0, ends + 1)
    n = np.diff(first)
    n = np.where(n > 0, np.maximum(1, n - words + 1), 0)
    offsets = np.append(0, np.cumsum(n))
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], n)
    begin, end = starts[at], ends[np.minimum(at + words, np.repeat(first[1:], n)) - 1]
    size = (end - begin).astype(np.uint64)
    return _mixed((total[end] - total[begin]) * down[begin] + size * np.uint64(0xD6E8FEB86659FD93)), offsets


def grouped(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(which texts, hashes, offsets): 64-bit hashes of the runs of ``words`` words in order, of the whole text if it is shorter.

    Text i of a group has those from offsets[i] to offsets[i + 1]. Groups have about ``GROUP`` characters; a longer text is one by itself.
    """
    lo = n = 0
    for hi, t in enumerate(texts):
        if n and n + len(t or "") > GROUP:
            yield slice(lo, hi), *_hashed(texts[lo:hi], words)
            lo, n = hi, 0
        n += len(t or "") + 1
    if lo < len(texts):
        yield slice(lo, len(texts)), *_hashed(texts[lo:], words)


def grouped_sets(texts: list[str | None], words: int = WORDS) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """As :func:`grouped`, with the sorted distinct hashes of each text."""
    for at, found, offsets in grouped(texts, words):
        for i, j in zip(offsets, offsets[1:]):
            found[i:j].sort()
        new = np.append(True, found[1:] != found[:-1])[: len(found)]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        yield at, found[new], np.append(0, np.cumsum(new))[offsets]


def sets_of(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the runs of each text."""
    for _, found, offsets in grouped_sets(texts, words):
        yield from (found[i:j] for i, j in zip(offsets, offsets[1:]))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; many times as fast as np.unique, which hashes them."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of one text."""
    return next(sets_of([text], words))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(a: np.ndarray, b: np.ndarray, containment: float = CONTAINMENT, ratio: float = RATIO) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or large > ratio * small:
        return small == large
    return overlap(a, b) >= containment * small - 1e-9


def partition_of(size: int, ratio: float = RATIO) -> int:
    """Partition p holds the sizes from ratio^p up to below ratio^(p + 1)."""
    p = int(math.log(size) / math.log(ratio) + 1e-9)
    while ratio ** (p + 1) <= size:
        p += 1
    while ratio**p > size:
        p -= 1
    return p


@lru_cache(maxsize=None)
def bands_of(partition: int, containment: float = CONTAINMENT, ratio: float = RATIO, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """(rows, bands) of an index partition: the most rows that still find the least similar linked pair with ``recall``.

    A query of q shingles and an indexed set of x >= q, x in the partition, q >= x / ratio, share at least
    ceil(containment * q) shingles, so their Jaccard similarity is at least that over q + x - that.
    """
    low, high = math.ceil(ratio**partition - 1e-9), math.ceil(ratio ** (partition + 1) - 1e-9) - 1
    least = 1.0
    for x in {low, max(low, (low + high) // 2), max(low, high)}:
        for q in {max(1, math.ceil(x / ratio - 1e-9)), x}:
            common = math.ceil(containment * q - 1e-9)
            least = min(least, common / (q + x - common))
    for rows in range(8, 1, -1):
        bands = hashes // rows
        if 1 - (1 - least**rows) ** bands >= recall:
            break
    else:
        rows, bands = 1, hashes
    while bands > 1 and 1 - (1 - least**rows) ** (bands - 1) >= recall:
        bands -= 1
    return rows, bands


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return _mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


_PRODUCTS = np.empty((512, HASHES), dtype=np.uint64)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of shingle hashes, scrambled by multiplication with odd numbers."""
    out = np.full(HASHES, np.uint64(_MASK))
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512]
        products = _PRODUCTS[: len(part)]
        np.multiply(part[:, None], _multipliers(), out=products)
        np.minimum(out, products.min(axis=0), out=out)
    return out


def band_keys(signature: np.ndarray, partition: int) -> np.ndarray:
    """A 64-bit key for each band of ``partition``'s index, of one signature or of each row of several."""
    rows, bands = bands_of(partition)
    values = signature[..., : rows * bands].reshape(*signature.shape[:-1], bands, rows)
    key = np.full(bands, np.uint64(partition + 1)) * np.uint64(_BASE) + np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = _mixed(key ^ values[..., j])
    return key.view(np.int64)


def _sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, set_hash, size, bands) of every row; bands of its own partition, then of the next."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for frame in frames:
            names, sizes, signatures = [], [], np.empty((len(frame), HASHES), dtype=np.uint64)
            for i, found in enumerate(sets_of(frame["__text"].tolist())):
                names.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                sizes.append(len(found))
                signatures[i] = minhash(found)
            bands = [[] for _ in sizes]
            parts = np.array([partition_of(n) if n else -1 for n in sizes])
            for p in np.unique(parts[parts >= 0]).tolist():
                at = np.flatnonzero(parts == p)
                for i, keys in zip(at, np.hstack([band_keys(signatures[at], p), band_keys(signatures[at], p + 1)])):
                    bands[i] = keys
            yield pd.DataFrame({"key": frame["__key"], "set_hash": names, "size": sizes, "bands": bands})

    rows = by_bytes(docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")))
    made = rows.mapInPandas(run, "key string, set_hash string, size int, bands array<bigint>")
    return made.select(F.col("key").cast("bigint").alias("key"), "set_hash", "size", "bands")


def contained(small: np.ndarray, large: np.ndarray) -> bool:
    """Whether ``large``, which is beyond ``RATIO`` times the other's size, contains it by ``CONTAINMENT``."""
    return len(large) > RATIO * len(small) and overlap(small, large) >= CONTAINMENT * len(small) - 1e-9


def _check(pairs: DataFrame, texts: DataFrame, test=linked) -> DataFrame:
    """The pairs (a, b) of representatives whose whole shingle sets pass ``test``, by their ``texts`` (id, text).

    The members a of each b are dealt out in chunks; b's text goes to each chunk once, ahead of its members.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, hubs = None, []
        for frame in frames:
            out = []
            for a, b, chunk, member, found in zip(frame["a"], frame["b"], frame["chunk"], frame["member"], sets_of(frame["text"].tolist())):
                if (b, chunk) != group:
                    group, hubs = (b, chunk), []
                if not member:
                    hubs.append(found)
                elif any(test(found, hub) for hub in hubs):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.select("a", "b").join(many, "b").withColumn("chunk", F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int")).select("a", "b", "chunk")
    members = dealt.select("a", "b", "chunk", F.lit(True).alias("member"))
    hubs = dealt.select(F.col("b").alias("a"), "b", "chunk", F.lit(False).alias("member")).distinct()
    rows = members.unionByName(hubs).join(texts.select(F.col("id").alias("a"), "text"), "a")  # one pass over the texts for both
    rows = rows.repartition("b", "chunk").sortWithinPartitions("b", "chunk", "member")
    return by_bytes(rows).mapInPandas(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of each node's connected component; nodes are the ends of ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that label, until none changes.
    """
    edges = stash(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stash(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        best = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("best"))
        up = labels.select(F.col("id").alias("best"), F.col("label").alias("above"))
        new = stash(best.join(up, "best", "left").select("id", F.col("label").alias("old"), F.least("best", F.coalesce("above", "best")).alias("label")), "labels")
        unstash(labels)
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            unstash(edges)
            return labels


def _close(a: str, b: str) -> Column:
    return F.greatest(a, b) <= RATIO * F.least(a, b)


def _hubs(rows: DataFrame, round_: int) -> DataFrame:
    """(bucket, hub, hub_size, hub_label): of each bucket the member with most company in all its buckets, then of least hash."""
    company = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").groupBy("id").agg(F.sum("n").alias("company"))
    hub = F.struct(F.negate("company").alias("c"), F.xxhash64("id", F.lit(round_)).alias("h"), F.col("id").alias("hub"), F.col("size").alias("hub_size"), F.col("label").alias("hub_label"))
    return rows.join(company, "id").groupBy("bucket").agg(F.min(hub).alias("m")).select("bucket", "m.hub", "m.hub_size", "m.hub_label")


def _mixed_buckets(rows: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (bucket, id, size) without ``hubs``, which have met all members of theirs, of the buckets that still hold several classes.

    Of buckets with the same members, by count and 128 bits of their hashes, one stays: it makes the same pairs.
    """
    rest = rows.select("bucket", "id", "size").join(hubs.select("bucket", F.col("hub").alias("id")), ["bucket", "id"], "left_anti")
    named = rest.join(labels, "id", "left").select("bucket", "id", "size", F.coalesce("label", "id").alias("label"))
    of = named.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed"), F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64("id", "size", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    mixed = of.where("mixed").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return stash(named.join(mixed, "bucket", "left_semi"), "mixed")


def _unasked(pairs: DataFrame, asked: list[DataFrame]) -> DataFrame:
    """Distinct (a, b), less those that ``asked`` holds in either order."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for old in asked:
        pairs = pairs.join(old.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return pairs


def _check_all(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked pairs (a, b) among all members of each bucket of ``rows`` (bucket, id, size, label) that are of different classes.

    A bucket is dealt out to blocks of about ``BLOCK`` members, fewer of long texts, and each two blocks meet in a group of their own.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = list(sets_of(frame["text"].tolist()))
        at = [i for i, x in enumerate(sets) if len(x)]
        frame, sets = frame.iloc[at], [sets[i] for i in at]
        if len(sets) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, labels, mine = (frame[c].to_numpy() for c in ("id", "label", "mine"))
        size = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(size)])
        known, codes = np.unique(np.concatenate(sets), return_inverse=True)
        within, out = frame["i"].iloc[0] == frame["j"].iloc[0], []
        for x in range(len(sets) - 1):
            small, large = np.minimum(size[x], size[x + 1 :]), np.maximum(size[x], size[x + 1 :])
            meets = (labels[x + 1 :] != labels[x]) & (large <= RATIO * small) & (within | (mine[x + 1 :] != mine[x]))
            if meets.any():
                has = np.zeros(len(known), dtype=bool)
                has[codes[starts[x] : starts[x + 1]]] = True
                common = np.add.reduceat(has[codes[starts[x + 1] :]], starts[x + 1 : -1] - starts[x + 1], dtype=np.int64)
                out += [(ids[x], ids[x + 1 + y]) for y in np.flatnonzero(meets & (common >= CONTAINMENT * small - 1e-9))]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)
    blocks = rows.groupBy("bucket").agg(F.ceil(size).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "label", "mine")
    return by_bytes(met.join(texts, "id")).groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint").distinct()


def _filter(probes: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the hashes in ``probes`` (h): a Bloom filter of two places for each, by its lower and upper half.

    Built in partial bitmaps of 4 KiB. It only spares rows a shuffle: where it is full, more rows pass, and the join decides.
    """
    bits = min(FILTER_BITS, max(15, int(16 * probes.count()).bit_length()))
    mask = (1 << bits) - 1
    places = probes.select(F.explode(F.array(F.expr(f"h & {mask}L"), F.expr(f"shiftrightunsigned(h, 32) & {mask}L"))).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = places.groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    bitmap = np.zeros(1 << bits - 3, dtype=np.uint8)
    for row in parts.collect():
        bitmap[(row["at"] - 1) * 4096 : row["at"] * 4096] = np.frombuffer(row["map"], dtype=np.uint8)
    return bits, bitmap


def _held(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the bits ``p`` of a flat bitmap are set."""
    return bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def _passing(found: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass; the second place is looked up for those that pass by the first."""
    mask = np.uint64((1 << bits) - 1)
    has = _held(bitmap, found & mask)
    has[has] = _held(bitmap, found[has] >> np.uint64(32) & mask)
    return has


def _passes(found: np.ndarray, bits: int, bitmap: np.ndarray) -> np.ndarray:
    """The hashes that the filter lets pass."""
    return found[_passing(found, bits, bitmap)]


def _sightings(docs: DataFrame, reps: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(b, larger, h): where the hashes ``wanted`` (h), and a few others, stand among all shingles of the sets ``reps``; larger is the set's size."""
    bits, bitmap = _filter(wanted)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, out = frame["id"].tolist(), []
            for at, found, offsets in grouped(frame["text"].tolist()):
                where = np.flatnonzero(_passing(found, bits, held.value))
                cuts = np.searchsorted(where, offsets)
                out += [(ids[at.start + i], distinct(found[where[cuts[i] : cuts[i + 1]]]).view(np.int64)) for i in np.flatnonzero(np.diff(cuts))]
            yield pd.DataFrame(out, columns=["id", "hits"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    made = by_bytes(rows).mapInPandas(run, "id bigint, hits array<bigint>")
    seen = stash(made.join(reps.select("id", "size"), "id"), "sightings")
    return seen.select(F.col("id").alias("b"), F.col("size").alias("larger"), F.explode("hits").alias("h"))


def _ends(packed: np.ndarray) -> np.ndarray:
    """Of numbers hash * 256 + code the least and the greatest of each hash, sorted."""
    packed = distinct(packed)
    new = packed[1:] >> np.uint64(8) != packed[:-1] >> np.uint64(8)
    keep = np.ones(len(packed), dtype=bool)
    keep[1:-1] = new[1:] | new[:-1]
    return packed[keep]


def _slots(low: np.ndarray, width: int, which: int) -> np.ndarray:
    """The first or the second place of each 32-bit number in a slice of 2^width bits."""
    return (low * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF) if which else low) >> np.uint64(32 - width)


def _uneven(rows: DataFrame, total: int) -> tuple[int, int, np.ndarray]:
    """(ranges, width, bitmaps): the shingles that stand in sets more than ``RATIO`` apart in size, and a few others, by range of hashes.

    ``rows`` (id, text) hold about ``total`` shingles, of which none is left out. They shuffle in blocks of five bytes each: 32 bits of
    the hash besides its range, and the logarithm of the set's size; a block holds at most two of each hash.
    """
    ranges = max(6, (total // RANGE).bit_length())
    width = max(3, min(FILTER_BITS - ranges, 32, (total // 2).bit_length() - ranges))

    def deal(packed: list) -> pd.DataFrame:
        found = _ends(np.concatenate(packed))
        at = np.searchsorted(found, np.arange((1 << ranges) + 1, dtype=np.uint64) << np.uint64(40))
        low, codes = (found >> np.uint64(8)).astype(np.uint32), found.astype(np.uint8)
        rows = [(r, low[i:j].tobytes(), codes[i:j].tobytes()) for r, (i, j) in enumerate(zip(at, at[1:])) if i < j]
        return pd.DataFrame(rows, columns=["r", "low", "codes"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in frames:
            for _, found, offsets in grouped_sets(frame["text"].tolist()):
                sizes = np.diff(offsets)
                codes = (np.log(np.maximum(sizes, 1)) / math.log(SIZE_STEP)).astype(np.uint64)
                held.append(found >> np.uint64(32 - ranges) << np.uint64(8) | np.repeat(codes, sizes))
                n += len(found)
                if n >= DEALT:
                    yield deal(held)
                    held, n = [], 0
        if held:
            yield deal(held)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(frame["low"]), dtype=np.uint32).astype(np.uint64)
        found = _ends(low << np.uint64(8) | np.frombuffer(b"".join(frame["codes"]), dtype=np.uint8))
        apart = (found[1:] >> np.uint64(8) == found[:-1] >> np.uint64(8)) & ((found[1:] & np.uint64(255)) - (found[:-1] & np.uint64(255)) >= np.uint64(SIZE_STEPS))
        bits = np.zeros(1 << width, dtype=bool)
        for which in (0, 1):
            bits[_slots(found[1:][apart] >> np.uint64(8), width, which)] = True
        return pd.DataFrame([(frame["r"].iloc[0], np.packbits(bits, bitorder="little").tobytes())] if apart.any() else [], columns=["r", "map"])

    parts = by_bytes(rows).mapInPandas(run, "r int, low binary, codes binary").groupBy("r").applyInPandas(fill, "r int, map binary")
    bitmaps = np.zeros((1 << ranges, 1 << width - 3), dtype=np.uint8)
    for row in parts.collect():
        bitmaps[row["r"]] = np.frombuffer(row["map"], dtype=np.uint8)
    return ranges, width, bitmaps


def _in_uneven(found: np.ndarray, ranges: int, width: int, bitmaps: np.ndarray) -> np.ndarray:
    """Which of the hashes ``bitmaps`` may hold; the second slot is looked up for those that have the first."""
    at, low, flat = found >> np.uint64(64 - ranges) << np.uint64(width), found >> np.uint64(32 - ranges) & np.uint64(0xFFFFFFFF), bitmaps.reshape(-1)
    has = _held(flat, at | _slots(low, width, 0))
    has[has] = _held(flat, at[has] | _slots(low[has], width, 1))
    return has


def _containers(docs: DataFrame, reps: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """All (a, b, size): representatives a and sets b, of ``size``, beyond ``RATIO`` times theirs, that contain them.

    Every step lets pass what can be a link, by all shingles of the sets. What a container may hold stands in sets far apart in size:
    a set with too few such shingles is done. The others look theirs up among all shingles of all sets; those with too few in larger
    sets are done. Of a set's rarest shingles, as many as any container must hold one of, name the larger sets, and all these are
    checked.
    """
    reps = stash(reps, "representatives")
    total = reps.agg(F.sum("size")).first()[0] or 0
    nothing = reps.select(F.col("id").alias("a"), F.col("id").alias("b"), "size").limit(0)
    if not total:
        return nothing
    keyed = texts.where("id is not null")
    ranges, width, bitmaps = _uneven(keyed, total)
    uneven = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, out = frame["id"].tolist(), []
            for at, found, offsets in grouped_sets(frame["text"].tolist()):
                sizes = np.diff(offsets)
                inside = np.diff(np.append(0, np.cumsum(_in_uneven(found, ranges, width, uneven.value)))[offsets])
                for i in np.flatnonzero((sizes > 0) & (inside >= CONTAINMENT * sizes - 1e-9)):
                    out.append((ids[at.start + i], int(sizes[i]), found[offsets[i] : offsets[i + 1]].view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "size", "hs"])

    asks = by_bytes(keyed).mapInPandas(ask, "id bigint, size int, hs array<bigint>").join(reps.select("id", "size").distinct(), ["id", "size"], "left_semi")
    whole = stash(asks.select("id", "size", F.explode("hs").alias("h")).distinct(), "questions")
    if whole.isEmpty():
        return nothing
    where = _sightings(docs, reps, whole.select("h").distinct(), key, text)
    tops = where.groupBy("h").agg(F.max("larger").alias("top"), F.count(F.lit(1)).alias("n"))
    found = stash(whole.join(tops, "h").where(F.col("top") > RATIO * F.col("size")).select("id", "size", "h", "n"), "sighted")
    share = F.ceil(F.col("size") * CONTAINMENT - 1e-9)
    sure = found.groupBy("id", "size").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= share)
    # a container lacks at most a fifth: of so many of the shingles that stand in larger sets it holds one
    rarest = Window.partitionBy("id", "size").orderBy("n", "h")
    few = found.join(sure, ["id", "size"]).withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= F.col("m") - share + 1)
    pairs = few.select("id", "size", "h").join(where, "h").where(F.col("larger") > RATIO * F.col("size")).select(F.col("id").alias("a"), "b").distinct()
    held = stash(_check(stash(pairs, "pairs"), texts, contained), "containers")
    return held.join(reps.select(F.col("id").alias("b"), "size"), "b").select("a", "b", "size")


def _attach(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` (id, label) with each class joined to one class that contains a member of it: that of the least container, then id.

    The classes so joined take the label of the one among them that nothing contains; of the least, if there is none.
    """
    mine = lambda c, as_: labels.select(F.col("id").alias(c), F.col("label").alias(as_))
    up = found.join(mine("a", "la"), "a", "left").join(mine("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"), "size", F.col("b").alias("id"))
    up = stash(up.where("a <> b").groupBy("a").agg(F.min(F.struct("size", "id", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "containers")
    if up.isEmpty():
        return labels
    joined = components(up)
    core = joined.join(up.select(F.col("a").alias("id"), F.lit(1).alias("inside")), "id", "left")
    core = core.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("inside").isNull(), F.col("id"))), F.min("id")).alias("core"))
    new = stash(joined.join(core, "label").select(F.col("id").alias("label"), "core"), "cores")
    every = labels.unionByName(new.select(F.col("label").alias("id"), "label")).distinct()
    return every.join(new, "label", "left").select("id", F.coalesce("core", "label").alias("label"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", links_too: bool = True) -> DataFrame:
    """(key, class_id, set_id, contains) of every row of ``docs``; class_id is the least key of the class's core.

    set_id is the least key of the rows with the same shingle set. The row of that key names in ``contains`` all sets that its set
    contains beyond ``RATIO``, so each link is there once; null if there are none. Without ``links_too`` these two are left out.
    """
    sketches = stash(_sketches(docs, key, text), "sketches")
    sets = sketches.groupBy("set_hash").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("n"))
    reps = sketches.where("size > 0 and key is not null").join(sets.select("id", F.col("set_hash").alias("h")), (F.col("h") == F.col("set_hash")) & (F.col("key") == F.col("id")), "left_semi")
    reps = reps.dropDuplicates(["key", "set_hash"]).withColumnRenamed("key", "id")
    # most keys stand in one bucket alone: one shuffle and sort by bucket finds the others
    rows, mates = reps.select("id", "size", F.explode("bands").alias("bucket")), Window.partitionBy("bucket")
    rows = rows.withColumn("least", F.min("id").over(mates)).withColumn("most", F.max("id").over(mates)).where("least <> most")
    rows = stash(rows.select("id", "size", "bucket").distinct(), "buckets")
    near = rows.select("id").distinct()
    plain = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    texts = plain.join(near, "id", "left_semi")
    links, labels, left, asked = None, None, rows, []
    for round_ in range(1 + MORE_ROUNDS):
        if labels is None:
            hubs = stash(_hubs(rows.withColumn("label", F.col("id")), round_), "hubs")
            pairs = rows.join(hubs, "bucket").where("id <> hub").where(_close("size", "hub_size")).groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("n"))
            pairs = stash(pairs, "pairs")
            fresh = pairs.groupBy("a").agg(F.max(F.struct("n", F.negate("b").alias("b"))).alias("m")).select("a", F.negate("m.b").alias("b"))
        elif round_ == 1:
            mine = lambda c, as_: labels.select(F.col("id").alias(c), F.col("label").alias(as_))
            fresh = pairs.join(mine("a", "la"), "a", "left").join(mine("b", "lb"), "b", "left")
            fresh = fresh.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
        else:
            left = _mixed_buckets(left, hubs, labels)
            if left.isEmpty():
                break
            hubs = stash(_hubs(left, round_), "hubs")
            met = left.join(hubs, "bucket").where("label <> hub_label").where(_close("size", "hub_size"))
            fresh = _unasked(met.select(F.col("id").alias("a"), F.col("hub").alias("b")), asked)
        if round_:
            fresh = stash(fresh, "fresh")
            asked.append(fresh)
        more = stash(_check(fresh, texts), "links")
        if links is None or not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            labels = components(links)
    else:
        left = _mixed_buckets(left, hubs, labels)
        if not left.isEmpty():
            more = stash(_check_all(left, texts), "links")
            if not more.isEmpty():
                labels = components(links.unionByName(more))
    unstash(rows)
    containers = _containers(docs, reps.select("id", "set_hash", "size"), plain, key, text)
    labels = _attach(labels, containers)
    named = sets.join(labels, "id", "left").select("set_hash", "id", "n", F.coalesce("label", "id").alias("label"))
    # rows of one set are dealt out over SALTS tasks; only sets of several rows are repeated for that, others join by their one row
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    dups = named.where("n > 1").select(F.col("set_hash").alias("__h"), F.lit(True).alias("__dup"), F.col("label").alias("__d"), F.col("id").alias("__s"), salts)
    alone = named.where("n = 1").select(F.col("id").alias("__k"), F.col("set_hash").alias("__h"), F.col("label").alias("__a"))
    rows = sketches.select(F.col("key").alias("__k"), F.col("set_hash").alias("__h"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("__salt"))
    out = rows.join(dups, ["__h", "__salt"], "left").join(alone, ["__k", "__h"], "left")
    class_id = F.when(F.col("__dup"), F.col("__d")).otherwise(F.coalesce("__a", "__k"))
    out = out.select(F.col("__k").alias(key), class_id.alias("class_id"), F.when(F.col("__dup"), F.col("__s")).otherwise(F.col("__k")).alias("set_id"))
    if not links_too:
        return out.select(key, "class_id")
    held = containers.groupBy(F.col("b").alias("__b")).agg(F.sort_array(F.collect_set("a")).alias("contains"))
    return out.join(held, (F.col(key) == F.col("__b")) & (F.col("set_id") == F.col("__b")), "left").select(key, "class_id", "set_id", "contains")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the class's id; of rows that repeat this id, the one of least text.

    Rows of a null id can't be named by a class: of these, one of each text stays.
    """
    found = classes(docs.where(F.col(key).isNotNull()), key, text, links_too=False).where(F.col(key) == F.col("class_id")).select(F.col(key).alias(f"{P}k")).distinct()
    kept = docs.join(found, F.col(key) == F.col(f"{P}k"), "left_semi")
    if docs.where(F.col(key).isNull()).isEmpty() and kept.groupBy(key).agg(F.count(F.lit(1)).alias(f"{P}n")).where(F.col(f"{P}n") > 1).isEmpty():
        return kept
    least = kept.groupBy(F.col(key).alias(f"{P}k")).agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias(f"{P}t"))
    first = kept.join(least, (F.col(key) == F.col(f"{P}k")) & (F.coalesce(F.col(text), F.lit("")) == F.col(f"{P}t")), "left_semi")
    return first.dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()).dropDuplicates([text]))
