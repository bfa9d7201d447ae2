"""Keyword search: an index of the queries' terms by document, BM25 over batches of it; as joins where there are many queries."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mnemoloom.functions.text import words
from mnemoloom.operators.knn import top
from mnemoloom.session import stash

K1, B = 1.2, 0.75
#: Queries and their terms that go to every task; more are joined.
QUERIES, TERMS = 5000, 500_000
#: Scores that numpy holds at once.
SCORES = 2_000_000


def postings(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, length) of all terms or those in ``wanted`` (term), which others leave before they are counted."""
    toks = docs.select(key, words(F.col(text)).alias("w"))
    exploded = toks.select(key, F.size("w").alias("length"), F.explode("w").alias("term"))
    if wanted is not None:
        exploded = exploded.join(wanted, "term", "left_semi")
    return exploded.groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def index(docs: DataFrame, key: str, text: str, wanted: dict[str, int]) -> DataFrame:
    """(key, length, terms, tfs): how many words each document has, and which of ``wanted`` how often."""

    def run(batches):
        word = re.compile("[a-z0-9]+")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for t in part.column(1).to_pylist():
                    found = Counter(words := word.findall(t or ""))
                    held = [(wanted[w], c) for w, c in found.items() if w in wanted]
                    rows.append((None if t is None else len(words), [x for x, _ in held], [c for _, c in held]))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "length", "terms", "tfs"])

    # lower case is Spark's
    return docs.select(key, F.lower(text).alias("text")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, length long, terms array<int>, tfs array<int>")


def search(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query: str, n: int = 20) -> DataFrame:
    """(query, key, score, rn): the ``n`` best documents for each query; any of its words may match, ties go by key.

    Every document's score for every query is computed where the document is, and the best of each batch alone leave it.
    """
    asked = queries.select(query_key, F.array_distinct(words(F.col(query))).alias("terms"))
    rows = asked.limit(QUERIES + 1).collect()
    by_query: dict = {}
    for r in rows:
        by_query.setdefault(r[0], {}).update(dict.fromkeys(r[1] or []))
    if len(rows) > QUERIES or sum(map(len, by_query.values())) > TERMS:
        return search_by_joins(docs, queries, key, text, query_key, query, n)
    wanted = {w: i for i, w in enumerate(dict.fromkeys(w for terms in by_query.values() for w in terms))}
    kept = stash(index(docs, key, text, wanted), "index")
    total, mean, keys = kept.agg(F.count(F.lit(1)), F.avg("length"), F.count_distinct(key)).first()
    if keys < total:
        return search_by_joins(docs, queries, key, text, query_key, query, n)
    df = np.zeros(len(wanted))
    for term, count in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
    names = pa.array(list(by_query), to_arrow_type(queries.schema[query_key].dataType))
    pairs = sorted((wanted[w], q) for q, terms in enumerate(by_query.values()) for w in terms)
    owner, first = np.array([q for _, q in pairs], dtype=np.int64), np.searchsorted([t for t, _ in pairs], np.arange(len(wanted) + 1))

    def run(batches):
        step = max(1, SCORES // max(1, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                part = part.take(pc.sort_indices(part.column(0)))  # ties go by key
                held = part.column("terms")
                term, tf, doc = held.flatten().to_numpy(), part.column("tfs").flatten().to_numpy(), np.repeat(np.arange(len(part)), held.value_lengths().to_numpy())
                if not len(term):
                    continue
                length = part.column("length").fill_null(0).to_numpy()[doc]
                gain = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                times = (first[1:] - first[:-1])[term]
                ask = owner[np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(times.sum())]
                score = np.bincount(ask * len(part) + np.repeat(doc, times), np.repeat(gain, times), len(names) * len(part)).reshape(len(names), -1)
                i, j = top(np.where(score > 0, np.round(score, 6), -np.inf), n)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), part.column(0).take(pa.array(j)), pa.array(score[i, j])], [query_key, key, "score"])

    best = kept.mapInArrow(run, f"{query_key} {dict(queries.dtypes)[query_key]}, {key} {dict(docs.dtypes)[key]}, score double")
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 6)), key)
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def search_by_joins(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query: str, n: int = 20) -> DataFrame:
    """``search`` for any number of queries: an inverted index as rows, BM25 as columns."""
    stats = docs.select(F.size(words(F.col(text))).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    terms = queries.select(query_key, F.explode(F.array_distinct(words(F.col(query)))).alias("term"))
    wanted = terms.select("term").distinct()
    index = postings(docs, key, text, wanted)
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = terms.join(index, "term").join(df, "term").join(F.broadcast(stats))  # stats is one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    ranked = scored.groupBy(query_key, key).agg(F.sum(gain).alias("score"))
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 6)), key)
    return ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
