"""Language identification as inference of a mixture, by expectation-maximisation.

Training reads a bounded sample of labelled documents and yields, for each language, smoothed log-likelihoods of character
trigrams inside words. A document is a bag of words, each from one unknown language; a word's likelihood in a language is
the product over its trigrams. EM estimates the shares of the languages in the document. Then the languages are ranked by
share, each leading set of them is refitted, larger ones as long as any document gains, and the set of greatest
log-likelihood less ``PENALTY`` * ln(words) for each language beyond the first is selected. The prediction is the language
with the largest share in it.

Words' likelihoods are remembered in each worker, and EM runs over all documents of a batch at once.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is everything when nothing could be
learned; ties take the language first in alphabetical order; very long texts count whole; repeated rows are judged each for itself; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoloom.llm.batches import by_bytes
from mnemoloom.session import stash

#: Labelled documents that the model is fitted on, for each language: the one bound of training; their whole texts count.
TRAIN_DOCS = 400
#: Picked rows up to which they are broadcast.
BROADCAST_ROWS = 100_000
SMOOTHING, PENALTY, ITERATIONS = 0.5, 2.0, 10
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if the text has no letter."""
    words = _WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


class Model:
    """``weights[g, l]``: log-likelihood of trigram g in language l; row 0 is for trigrams never seen."""

    def __init__(self, languages: list[str], grams: dict[str, int], weights: np.ndarray):
        self.languages, self.grams, self.weights = languages, grams, weights


def trigrams(texts) -> Counter:
    """How often each trigram stands in the words of ``texts``."""
    seen: Counter = Counter()
    for word, n in Counter(w for t in texts for w in letters(t)).items():
        padded = f" {word} "
        for i in range(len(padded) - 2):
            seen[padded[i : i + 3]] += n
    return seen


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of texts by language."""
    return model_of({lang: trigrams(texts) for lang, texts in samples.items()})


def model_of(counts: dict[str, dict[str, int]]) -> Model:
    """A model of trigram counts by language."""
    languages = sorted(counts)
    grams = {g: i + 1 for i, g in enumerate(sorted(set().union(*counts.values())))}
    table = np.zeros((len(grams) + 1, len(languages)))
    for j, lang in enumerate(languages):
        for g, n in counts[lang].items():
            table[grams[g], j] = n
    table += SMOOTHING
    return Model(languages, grams, np.log(table / table.sum(axis=0)).astype(np.float32))


class Mixture:
    """Shares of languages in documents under ``model``."""

    def __init__(self, model: Model, max_words: int = 300_000):
        self.model, self.max_words = model, max_words
        self.words: dict[str, int] = {}
        self.table = np.empty((1024, len(model.languages)), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        """Likelihoods of new words, relative to the likeliest language of each."""
        known = len(self.words) - len(new)
        if len(self.words) > len(self.table):
            grown = np.empty((max(len(self.words), 2 * len(self.table)), self.table.shape[1]), dtype=np.float32)
            grown[:known] = self.table[:known]
            self.table = grown
        get, flat, sizes = self.model.grams.get, [], []
        for word in new:
            padded = f" {word} "
            flat += [get(padded[i : i + 3], 0) for i in range(len(padded) - 2)]
            sizes.append(len(padded) - 2)
        starts = np.cumsum([0, *sizes[:-1]])
        for at in range(0, len(new), 20_000):
            lo, hi = starts[at], starts[at + 20_000] if at + 20_000 < len(new) else len(flat)
            ll = np.add.reduceat(self.model.weights[flat[lo:hi]], starts[at : at + 20_000] - lo, axis=0)
            self.table[known + at : known + at + len(ll)] = np.exp(ll - ll.max(axis=1, keepdims=True))

    def _em(self, p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(shares, log-likelihoods): ``rounds`` steps from ``share``."""
        total = np.add.reduceat(n, starts)[:, None]
        for _ in range(rounds):
            r = p * share[doc]
            r *= (n / np.maximum(r.sum(axis=1), 1e-30))[:, None]
            share = np.add.reduceat(r, starts, axis=0) / total
        mixed = np.maximum((p * share[doc]).sum(axis=1), 1e-30)
        return share, np.add.reduceat(n * np.log(mixed), starts)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its share) of each text."""
        langs = self.model.languages
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not langs:
            return out
        if len(self.words) > self.max_words:
            self.words.clear()
        words, new, picked, times, starts, docs = self.words, [], [], [], [], []
        for i, text in enumerate(texts):
            if not (bag := Counter(letters(text))):
                continue
            docs.append(i)
            starts.append(len(picked))
            for w in bag:
                if (at := words.get(w)) is None:
                    at = words[w] = len(words)
                    new.append(w)
                picked.append(at)
            times += bag.values()
        if not docs:
            return out
        if new:
            self._learn(new)
        p, n, first = self.table[picked].astype(np.float64), np.array(times, dtype=np.float64), np.array(starts)
        doc = np.repeat(np.arange(len(docs)), np.diff([*starts, len(picked)]))
        share, _ = self._em(p, n, doc, first, np.full((len(docs), len(langs)), 1 / len(langs)), ITERATIONS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
        size = np.add.reduceat(n, first)
        best, chosen = np.full(len(docs), -np.inf), share
        for m in range(1, len(langs) + 1):
            held = np.where(rank < m, share + 1e-9, 0.0)
            fitted, ll = self._em(p, n, doc, first, held / held.sum(axis=1, keepdims=True), 0 if m == 1 else 3)
            worth = ll - PENALTY * (m - 1) * np.log(size + 1)
            better = worth > best
            if m > 2 and not better.any():
                break  # no document gains by a larger set
            best = np.where(better, worth, best)
            chosen = np.where(better[:, None], fitted, chosen)
        top = chosen.argmax(axis=1)
        for k, i in enumerate(docs):
            out[i] = (langs[top[k]], float(min(1.0, chosen[k, top[k]])))
        return out


def train(docs: DataFrame, labelled: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """A model of the rows where ``labelled``: at most ``per_language`` documents each, those of least hash of their key.

    Picking reads keys and labels alone, with partial tops by language; trigrams of the whole picked texts are counted where
    they are read, and the driver gets the counts.
    """
    usable = labelled & F.col(lang).isNotNull() & F.col(key).isNotNull()
    pool = docs.where(usable).select(F.col(key).alias("k"), F.col(lang).alias("l")).distinct()
    first = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    picked = stash(pool.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language).select("k", "l"), "training")
    if picked.count() <= BROADCAST_ROWS:
        picked = F.broadcast(picked)
    texts = docs.where(usable).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).join(picked, ["k", "l"], "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for l, own in frame.groupby("l"):
                found = trigrams(own["t"])
                yield pd.DataFrame({"l": l, "g": list(found.keys()), "n": list(found.values())})

    counts: dict[str, dict[str, int]] = {}
    for row in by_bytes(texts.select("l", "t")).mapInPandas(count, "l string, g string, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row["l"], {})[row["g"]] = row["n"]
    return model_of(counts)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""
    shared = (model.languages, model.grams, model.weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixture = Mixture(Model(*shared))
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                found = mixture.predict(part["__text"].tolist())
                yield pd.DataFrame({"__key": part["__key"].to_numpy(), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    kind = dict(docs.dtypes)[key]
    rows = by_bytes(docs.select(F.col(key).cast("string").alias("__key"), F.col(text).alias("__text")))
    made = rows.mapInPandas(run, "__key string, lang_pred string, score double")
    return made.select(F.col("__key").cast(kind).alias(key), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose main language is known and holds a share of at least ``least``."""
    shared, names = (model.languages, model.grams, model.weights), list(docs.columns)

    def run(frames):
        import pyarrow as pa

        mixture = Mixture(Model(*shared))
        for batch in frames:
            texts = batch.column(names.index(text)).to_pylist()
            keep = [lang != UNKNOWN and score >= least for at in range(0, len(texts), 200) for lang, score in mixture.predict(texts[at : at + 200])]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return by_bytes(docs).mapInArrow(run, docs.schema)


def training_rows(key: str = "doc_id") -> Column:
    """The fold that may be learned from: crc32 of the key as text is not 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))
