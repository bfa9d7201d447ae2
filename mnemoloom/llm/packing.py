"""Sum-of-squares packing of tokenized documents into sequences of a fixed length.

``pieces`` tokenizes: a document's ids, then an end id; only documents longer than a sequence are cut, into full pieces and
a rest. ``pack`` places the pieces. N(g) counts the open sequences with g tokens left; a piece goes where the sum of N(g)^2
over all gaps ends up smallest, so that no gap piles up and most get filled. Ties take the tightest gap. A new sequence is
begun only for a piece that no open one has room for: where new sequences compete with open ones, lengths that can't fill
sequences anyhow take some 2 to 4 % more.

Scale: texts never move, only (document, piece, length) rows do. They are packed in shards of about ``SHARD`` pieces, longest
first in each. Sequences that a shard leaves with a gap give their pieces back, and these are packed again in the next
round, dealt out anew; each round accepts a little more slack, so that what is left soon fits one shard, whose packer sees
all that the others filled badly.

Defined cases: a null text is empty and has the end id alone; a very long text becomes as many pieces as it needs; pieces of
one length are placed by document, piece and checksum; repeated rows are pieces of their own; null ids stay null; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.llm.bpe import byte_alphabet
from mnemoloom.session import stash

CAPACITY = 2048
#: Pieces that one task packs.
SHARD = 40_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Letters whose small form is one of them.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: Characters beyond which, and strings at which, a text is left to the tokenizer as a whole.
_FOREIGN = re.compile(rf"[^\t-\r\x20-\x7f{_LATIN}‐-‧]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")


def little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Words(dict):
    """Packed ids by word; a new word goes through the tokenizer's model once."""

    def __init__(self, model):
        self.model = model
        stand_in = {b: c for c, b in byte_alphabet().items()}
        #: Letters and marks beyond ASCII as the stand-ins of their UTF-8 bytes.
        self.bytes = {c: "".join(stand_in[b] for b in chr(c).encode()) for c in (*range(0xC0, 0x180), *range(0x2010, 0x2028))}

    def __missing__(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.translate(self.bytes)
        packed = self[word] = little_endian([t.id for t in self.model.tokenize(mapped)])
        return packed


class WordTokenizer:
    """The tokenizer of ``path`` with its words remembered: texts of Latin letters are split here, each new word encoded once."""

    def __init__(self, path: str, max_cached: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.max_cached = _Words(self.tokenizer.model), max_cached

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if "<|" in text or _CONTROL.search(text) or not text.isascii() and _FOREIGN.search(text):
            return little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.words) > self.max_cached:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, _WORD.findall(text.lower())))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document by the tokenizer in ``path``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(path)
        for frame in frames:
            out: list[tuple] = []
            for doc, packed in zip(frame["__key"], map(words.encode, frame["__text"])):
                view = memoryview(packed + end)
                for k, at in enumerate(range(0, len(view), 4 * capacity)):
                    part = view[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = by_bytes(docs.select(F.col(key).cast("string").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")))
    made = rows.mapInPandas(run, PIECES.replace("doc_id bigint", "doc_id string"))
    return made.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, sparing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length, placed in the order given. If ``sparing``, a new sequence is no choice while an open one has room."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # count[g]: open sequences with g tokens left
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    opened, never = 0, np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        # moving a sequence from gap g to g - s changes the sum by 2 * (N(g - s) - N(g)) + 2; filling one by 1 - 2 * N(g)
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        change[count[s:capacity] == 0] = never
        if s < capacity:
            change[0] = 1 - 2 * count[s] if count[s] else never
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(np.argmin(change)) if len(change) else 0
        if len(change) and (change[best] < never if sparing else change[best] <= fresh):
            gap = best + s
            seq = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, seq = capacity, opened
            opened += 1
        sequence[i], offset[i] = seq, capacity - gap
        if left := gap - s:
            count[left] += 1
            stacks[left].append(seq)
    return sequence, offset


PLACED = PIECES + ", sequence_id bigint, offset bigint, gap bigint"


def repack(lengths: np.ndarray, capacity: int = CAPACITY, passes: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """:func:`sum_of_squares` over descending ``lengths``, then again over what stands in unfilled sequences, while fewer sequences are possible."""
    sequence, offset = sum_of_squares(lengths, capacity, sparing=True)
    least = -(-int(lengths.sum()) // capacity)
    for _ in range(passes):
        if sequence.max() + 1 <= least:
            break
        filled = np.bincount(sequence, weights=lengths).astype(np.int64)
        loose = np.flatnonzero(filled[sequence] < capacity)
        before = len(np.unique(sequence[loose]))
        again, offset_again = sum_of_squares(lengths[loose], capacity, sparing=True)
        if again.max() + 1 >= before:
            break
        sequence[loose], offset[loose] = len(filled) + again, offset_again
        sequence = np.unique(sequence, return_inverse=True)[1]
    return sequence, offset


def _place(frame: pd.DataFrame, capacity: int, base: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    lengths = frame["length"].to_numpy()
    sequence, offset = repack(lengths, capacity)
    filled = np.bincount(sequence, weights=lengths).astype(np.int64)
    return frame.assign(sequence_id=base + sequence, offset=offset, gap=capacity - filled[sequence])


def _placer(capacity: int, round_: int):
    """What packs one shard: ids of different rounds and shards never meet."""
    columns = [c.split()[0] for c in PLACED.split(", ")]

    def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _place(frame, capacity, (round_ << 58) + (int(key[0]) << 28))[columns]

    return place


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = 6) -> DataFrame:
    """``items`` (columns of ``pieces``) with sequence_id and offset; every row once, every sequence gapless from 0."""
    todo, done, n = items, [], items.count()
    for round_ in range(rounds):
        shards = max(1, -(-n // shard))
        last = shards == 1 or round_ == rounds - 1
        place = _placer(capacity, round_)
        dealt = todo.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(round_)), F.lit(shards)))
        placed = stash(dealt.groupBy("__shard").applyInPandas(place, PLACED), "packing")
        if last:
            done.append(placed)
            break
        slack = 0 if not round_ else min(capacity, 2 << round_)
        done.append(placed.where(F.col("gap") <= slack))
        todo = placed.where(F.col("gap") > slack).drop("sequence_id", "offset", "gap")
        left = todo.count()
        if not left:
            break
        n = left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("gap")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    return pack(stash(pieces(docs, path, key, text, capacity, end_id), "pieces"), capacity)
