"""Token ids of documents as compressed, checksummed frames, in ascending order of doc_id."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._codec import decode_frame, encode_frame
from ledgerloom.llm._tokens import ByteTable

END_ID = 2
#: Ids of a frame: whole documents until it is full. A frame holds some two thousand blocks.
FRAME = 4_000_000
#: Documents cut into ids in one go; the next ones follow when these are in a frame.
ROWS = 1000
_TABLES: dict[tuple[str, int], ByteTable] = {}
_FILE = "chunk int, first long, doc_ids binary, known binary, lengths binary, frame binary"


def _table(vocabulary: str, end_id: int) -> ByteTable:
    """A Python worker keeps its table from task to task."""
    if (vocabulary, end_id) not in _TABLES:
        _TABLES[vocabulary, end_id] = ByteTable(vocabulary, end_id)
    return _TABLES[vocabulary, end_id]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, frame_ids: int = FRAME) -> None:
    """Encode documents (doc_id, text), append ``end_id`` to each and write them to ``path``.

    Ranges of doc_id make the chunks, so their order is the order of documents; within a chunk rows are sorted.
    A row of the files is a frame: whole documents, their ids and lengths, the ids before it in its chunk, and
    the coded ids. A task holds one frame at a time. Frames travel in Parquet files, whose own compression is off.

    Null text counts as empty (its end id alone); null doc_ids come first; repeated rows are written as often
    as they come; an empty table gives files without frames; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, chunk, first = _table(vocabulary, end_id), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def frame() -> pa.RecordBatch:
            row = (chunk, first, np.array([i or 0 for i in docs], "<i8").tobytes(), np.array([i is not None for i in docs], np.uint8).tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), encode_frame(np.concatenate(parts)))
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["chunk", "first", "doc_ids", "known", "lengths", "frame"])

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                own, texts = (c.slice(a, ROWS).to_pylist() for c in batch.columns[:2])
                ids, n = table.encode([x or "" for x in texts])
                ends = np.cumsum(n)
                while len(own):
                    # documents up to the one that fills the frame
                    k = min(int(np.searchsorted(ends, frame_ids - held)) + 1, len(own))
                    size = int(ends[k - 1])
                    docs += own[:k]
                    sizes.append(n[:k])
                    parts.append(ids[:size])
                    held += size
                    own, n, ids, ends = own[k:], n[k:], ids[size:], ends[k:] - size
                    if held >= frame_ids:
                        yield frame()
                        first, held = first + held, 0
                        docs.clear()
                        sizes.clear()
                        parts.clear()
        if docs:
            yield frame()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    docs.mapInArrow(run, _FILE).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files at ``path``: doc_id, start (ids of all documents before), n_tokens, ids (binary).

    Every block is checked against its checksum; a damaged one fails the read.
    """
    files = spark.read.schema(_FILE).parquet(path)
    ends = files.select("chunk", "lengths").mapInArrow(_frame_totals, "chunk int, ids long")
    totals = ends.groupBy("chunk").agg(F.sum("ids").alias("ids")).orderBy("chunk").collect()  # a row for each chunk
    base = dict(zip((r.chunk for r in totals), itertools.accumulate([0, *(r.ids for r in totals)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, first, docs, known, lengths, frame in zip(*(c.to_pylist() for c in batch.columns)):
                ids, n = decode_frame(frame), np.frombuffer(lengths, "<i8")
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                known = np.frombuffer(known, np.uint8).astype(bool)
                for a in range(0, len(n), 1000):
                    b = min(a + 1000, len(n))
                    start = ends[a:b] - n[a:b]
                    own = [bytes(raw[4 * s : 4 * e]) for s, e in zip(start.tolist(), ends[a:b].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, "<i8")[a:b], mask=~known[a:b]), pa.array(base[chunk] + first + start), pa.array(n[a:b]), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _frame_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [int(np.frombuffer(x, "<i8").sum()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], ["chunk", "ids"])


def with_checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
