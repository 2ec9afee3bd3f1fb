"""Concatenate-and-cut packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import saved
from ledgerloom.llm._tokens import word_encoder

SEQUENCE = 2048
END_ID = 1


def tokenise(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """First pass: (doc_id, chunk, start, n_tokens, ids), ids as little-endian unsigned 32-bit bytes.

    ``chunk`` is the task that read the document, ``start`` the tokens before it in that chunk: the prefix sum
    within a chunk costs no shuffle, because a task reads its rows one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        before, chunk = 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = [encode(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), chunk, np.int32)), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "chunk", "start", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, chunk int, start long, n_tokens long, ids binary")


def pack(docs: DataFrame, vocabulary: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pack documents (doc_id, text) by concatenate and cut; one row per piece (the boundary records).

    Pass one tokenises and sums within chunks; the chunk totals, one row per task, give each chunk its global
    offset; pass two cuts every document at the multiples of ``length`` that fall into it. Only the very last
    sequence is padded: to ``length``, unless its token count is a power of two already.

    Null text counts as empty; an empty document is its end id alone. Repeated rows are packed as often as they
    come, a null doc_id stays null, an empty table gives no rows, further columns are ignored.
    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length.
    """
    tokens = saved(tokenise(docs, vocabulary, end_id))
    totals = [(r.chunk, r.n) for r in tokens.groupBy("chunk").agg(F.sum("n_tokens").alias("n")).orderBy("chunk").collect()]
    base = dict(zip((c for c, _ in totals), itertools.accumulate([0, *(n for _, n in totals)])))
    total = sum(n for _, n in totals)
    last = total % length
    tail = last if last and last & (last - 1) == 0 else length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, chunk, start, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                here, ids = base[chunk] + start, memoryview(ids)
                at = 0
                while at < n:
                    seq, offset = divmod(here + at, length)
                    size = min(n - at, length - offset)
                    out.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, seq, offset, tail if seq == total // length else length))
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 8, NAMES)

    return tokens.select("doc_id", "chunk", "start", "n_tokens", "ids").mapInArrow(cut, ", ".join(f"`{x}` long" for x in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]
