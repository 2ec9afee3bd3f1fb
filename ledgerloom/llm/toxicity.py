"""Toxicity of documents by multiple-instance learning: sentences scored, combined by noisy-or."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import MEMO_WORDS, saved

#: Labelled documents the model is fitted on, at most, half of either label.
SAMPLE = 8_000
#: Features kept: those that stand in most documents of one label beyond their share.
BITS = 24
FEATURES = 4_000
LEAST_DOCS = 3
ROUNDS, RATE, DECAY = 300, 0.15, 2e-3
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings; a beginning covers forms never seen."""
    low = word.lower()
    return [int.from_bytes(blake2b(f"{len(p)}{p}".encode("utf-8", "replace"), digest_size=4).digest(), "little") & ((1 << BITS) - 1) for p in dict.fromkeys((low + "$", low[:4], low[:5], low[:6]))]


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text or "") if _WORD.search(text, *m.span())]


class _Weights(dict):
    """word -> sum of the weights of its features."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        w = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w


def _sentence_features(text: str | None, memo: dict[str, list[int]]) -> list[np.ndarray]:
    """The features of each sentence of a text, each once."""
    own = []
    for a, b in sentences(text):
        found: set[int] = set()
        for w in set(_WORD.findall(text, a, b)):
            if w not in memo:
                if len(memo) >= MEMO_WORDS // 5:
                    memo.clear()
                memo[w] = features(w)
            found.update(memo[w])
        own.append(np.fromiter(found, np.int32, len(found)))
    return own


def select_features(rows: DataFrame) -> list[int]:
    """Of labelled texts (text, toxic) the FEATURES features that tell the labels apart best.

    Tasks count in how many documents of either label a feature stands; sums, the ranking and its head are Spark's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], []]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own := _sentence_features(text, memo):
                    parts[y].append(np.unique(np.concatenate(own)))
            for y, part in enumerate(parts):
                ids, n = np.unique(np.concatenate(part), return_counts=True) if part else (np.empty(0, np.int32), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.full(len(ids), y, np.int32)), pa.array(n.astype(np.int64))], ["feature", "toxic", "n"])

    of = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = rows.select("text", "toxic").mapInArrow(count, "feature int, toxic int, n long").groupBy("feature")
    side = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    counts = counts.agg(side(1).alias("pos"), side(0).alias("neg")).filter(F.col("pos") + F.col("neg") >= LEAST_DOCS)
    p, q = F.col("pos") / of.get(1, 1), F.col("neg") / of.get(0, 1)
    best = counts.orderBy(F.desc(F.abs(p - q) / F.sqrt(p + q + 1e-9)), "feature").limit(FEATURES).select("feature")
    return sorted(r.feature for r in best.collect())


def sentence_hits(rows: DataFrame, chosen: list[int]) -> list[tuple[list[np.ndarray], int]]:
    """For each labelled text (doc_id, text, toxic) the places in ``chosen`` of every sentence's features, and its label.

    Tasks read the texts; what reaches the driver are two bytes for each place, at most SAMPLE documents of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = np.array(chosen, np.int32), {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                own = [np.searchsorted(known, s[np.isin(s, known)]).astype("<u2") for s in _sentence_features(text, memo)]
                out.append((b"".join(np.sort(h).tobytes() for h in own), np.array([len(h) for h in own], "<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h for h, _ in out], pa.binary()), pa.array([n for _, n in out], pa.binary())], ["doc_id", "toxic", "hits", "sizes"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, hits binary, sizes binary").collect()
    found.sort(key=lambda r: (r.doc_id, r.toxic, bytes(r.sizes), bytes(r.hits)))
    return [(np.split(np.frombuffer(r.hits, "<u2"), np.cumsum(np.frombuffer(r.sizes, "<i4"))[:-1]) if r.sizes else [], r.toxic) for r in found]


def fit(found: list[tuple[list[np.ndarray], int]], chosen: list[int], prior: float) -> tuple[dict[int, float], float]:
    """Weights and bias from document labels alone; ``prior``: share of toxic documents to allow for."""
    labels = np.array([y for _, y in found], np.int64)
    sents = [h for own, _ in found for h in own]
    owner = np.repeat(np.arange(len(found)), [len(own) for own, _ in found])
    n_pos, n_neg = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    rows = np.repeat(np.arange(len(sents)), [len(h) for h in sents])
    cols = np.concatenate(sents).astype(np.int64) if sents else np.empty(0, np.int64)
    del sents
    w, b = np.zeros(len(chosen)), -4.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    y = labels[owner].astype(bool)
    weight = np.where(y, prior / n_pos, (1 - prior) / n_neg)
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(rows, w[cols], len(owner))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(s, 1 - 1e-12)), len(found)))[owner]
        g = weight * np.where(y, -s * clean / np.maximum(1 - clean, 1e-9), s)
        grad = np.r_[np.bincount(cols, g[rows], len(chosen)) + DECAY * w / max(1, len(chosen)) ** 0.5, g.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - change[:-1], b - change[-1]
    return dict(zip(chosen, w.tolist())), float(b)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Fit on at most SAMPLE labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    Ids are picked by hash, so the pick doesn't depend on order; rows with null ids or labels and labels without
    a document are left out; repeated rows count once. Without labels of both kinds, as with empty tables, the model is a
    constant that calls nothing toxic. Texts are read in tasks alone; the driver gets the places of chosen features.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    total = known.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in total}
    if not n.get(0) or not n.get(1):
        return {}, -8.0
    picked = None
    for label in (0, 1):
        half = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2)
        picked = half if picked is None else picked.union(half)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = saved(rows.dropDuplicates())
    chosen = select_features(rows)
    return fit(sentence_hits(rows, chosen), chosen, n[1] / (n[0] + n[1]))


def score(docs: DataFrame, model: tuple[dict[int, float], float]) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1), predicted (1 if score >= 0.5) and offending sentences.

    ``offending`` lists (start, end, score) of the sentences that score 0.5 or more, in code points. Texts
    without a sentence, null or empty, score 0; equal texts score alike, so repeated rows and ties do; an empty table gives
    no rows. Columns of these names that ``docs`` has already give way.
    """
    docs = docs.drop("score", "predicted", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers at most
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        memo = _Weights(weights)
        for batch in batches:
            scores, bad = [], []
            for text in batch.column(at).to_pylist():
                spans = sentences(text)
                z = np.array([bias + sum(map(memo.__getitem__, {w.lower() for w in _WORD.findall(text, a, b)})) for a, b in spans])
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                scores.append(float(1 - np.prod(1 - s)))
                bad.append([{"start": a, "end": b, "score": float(x)} for (a, b), x in zip(spans, s) if x >= 0.5])
            s = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(bad, span)], [*batch.schema.names, "score", "predicted", "offending"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("offending", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])
    return docs.mapInArrow(run, schema)
