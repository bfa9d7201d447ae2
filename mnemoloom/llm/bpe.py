"""Byte-level BPE as a deterministic automaton.

Merges apply in rank order, so the automaton is the result of adding one merge gadget after the other. Before any gadget
there is one state in which every byte may follow every byte. The gadget of merge (u, v) -> uv forbids the arc v after u
from then on, lets uv follow whatever u could follow at that time, and lets whatever could follow v at that time follow
uv. After the last gadget a token sequence is a path of the automaton exactly if it is the BPE encoding of its bytes.

The arcs over tokens would fill a table of (vocabulary size)^2, most of which no text reaches. So the successive
construction is unrolled the other way for a pair of tokens that a text brings together: undo the youngest gadget that made
one of the two, and ask whether the older pair was still an arc then (:meth:`Automaton.arc`). The byte automaton over it is
determinised on demand: a state is a node of the vocabulary's trie with suffix links, plus the last token of each prefix
inside the node's window; ``table`` maps (state, byte) to the next state, and each state holds the token that ends there.
Encoding a word is one table look-up per byte and a walk back over the ending tokens. Decoding emits the arc labels, which
are the tokens' bytes.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import regex

#: White space as the pre-tokenizer's pattern means it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORD = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
#: The same for texts of ASCII, Latin letters and common punctuation, in the faster engine; _ODD finds what else there is.
_LATIN = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u024f"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_WS}{_LATIN}0-9]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ODD = re.compile(rf"[^\x00-\x7f{_LATIN}\u2010-\u2027]")
START = -1


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stays, the rest moves to 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Automaton:
    """Compiled from ``labels`` (bytes by token id) and ``merges`` (left id, right id, product id) in rank order."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], max_states: int = 200_000):
        self.labels, self.max_states = labels, max_states
        self.rank = dict.fromkeys(labels, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for k, (u, v, uv) in enumerate(merges):
            self.merge_rank.setdefault((u, v), k)
            if self.rank[uv] < 0 and len(labels[uv]) > 1:
                self.rank[uv], self.left[uv], self.right[uv] = k, u, v
        #: Tokens that some text reaches: both parts are, and they stand side by side when their merge comes.
        self.live = {t for t, label in labels.items() if len(label) == 1}
        for k, (u, v, uv) in enumerate(merges):
            if u in self.live and v in self.live and self.rank[uv] == k and self._stands(u, v, k):
                self.live.add(uv)
        self._trie()
        self._reset()

    def _trie(self) -> None:
        """Trie of the tokens that merges reach, with suffix links and, by node, the tokens that end there."""
        step: list[dict[int, int]] = [{}]
        depth, token = [0], [None]
        for t, label in self.labels.items():
            if t not in self.live:
                continue
            node = 0
            for b in label:
                if (nxt := step[node].get(b)) is None:
                    nxt = step[node][b] = len(step)
                    step.append({})
                    depth.append(depth[node] + 1)
                    token.append(None)
                node = nxt
            token[node] = t
        link, order = [0] * len(step), [0]
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(step)
        for node in order:
            for b, nxt in step[node].items():
                back = link[node]
                while node and back and b not in step[back]:
                    back = link[back]
                link[nxt] = step[back].get(b, 0) if node else 0
                order.append(nxt)
            if node:
                own = ((token[node], depth[node]),) if token[node] is not None else ()
                ends[node] = own + ends[link[node]]
        self.step, self.depth, self.link, self.ends = step, depth, link, ends

    def _reset(self) -> None:
        self.table: dict[int, int] = {}
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (START,))]
        self.ending = [START]
        self.known = {self.states[0]: 0}
        self.arcs: dict[tuple[int, int], bool] = {}

    def _stands(self, x: int, y: int, before: int) -> bool:
        """Whether token y may follow token x once the gadgets of rank below ``before`` stand."""
        rank, left, right, merges = self.rank, self.left, self.right, self.merge_rank
        while True:
            if (k := merges.get((x, y))) is not None and k < before:
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                before, x = rx, right[x]
            else:  # of two equal pairs that overlap, the left one is merged
                before, y = ry + 1, left[y]

    def arc(self, a: int, b: int) -> bool:
        """Whether token b may follow token a once all gadgets stand."""
        if a == START:
            return True
        if (known := self.arcs.get((a, b))) is None:
            known = self.arcs[a, b] = self._stands(a, b, len(self.merge_rank) + 1)
        return known

    def _next(self, state: int, byte: int) -> int:
        """Add the transition from ``state`` on ``byte`` to the table."""
        node, held = self.states[state]
        back = node
        while back and byte not in self.step[back]:
            back = self.link[back]
        target = self.step[back].get(byte, 0)
        window = held[len(held) - 1 - (self.depth[target] - 1) :] if target else held[len(held) :]
        for token, size in self.ends[target]:
            if self.arc(window[len(window) - size], token):
                break
        else:
            raise ValueError(f"no token ends in byte {byte}")
        key = (target, (*window, token))
        if (found := self.known.get(key)) is None:
            found = self.known[key] = len(self.states)
            self.states.append(key)
            self.ending.append(token)
        self.table[state << 8 | byte] = found
        return found

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word."""
        if len(self.states) > self.max_states or len(self.arcs) > 4 * self.max_states:
            self._reset()
        table, ending, state, last = self.table, self.ending, 0, []
        for byte in word:
            state = table.get(state << 8 | byte) or self._next(state, byte)
            last.append(ending[state])
        out, at = [], len(word)
        while at:
            out.append(last[at - 1])
            at -= len(self.labels[out[-1]])
        out.reverse()
        return out


class _Words(dict):
    """Packed ids by pre-split word; a new word is encoded once."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.automaton.encode(word.encode("utf-8")))
        if sys.byteorder == "big":
            ids.byteswap()
        packed = self[word] = ids.tobytes()
        return packed


class Codec:
    """Texts to packed ids (little-endian unsigned 32-bit) and back, with special strings as single ids."""

    def __init__(self, path: str, max_cached: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        labels = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.labels = dict(labels) | {i: s.encode() for s, i in self.special.items()}
        self.words, self.max_cached = _Words(self.automaton), max_cached

    def _plain(self, text: str) -> bytes:
        if len(self.words) > self.max_cached:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, (_WORD if _ODD.search(text) else _FAST).findall(text)))

    def encode(self, text: str) -> bytes:
        """Packed ids of ``text``; none for an empty one."""
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], dtype="<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, packed: bytes) -> str:
        """The text whose tokens are ``packed``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary file."""
    return Codec(path)
