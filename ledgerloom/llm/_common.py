"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a per-task memo of words may hold before it starts afresh.
MEMO_WORDS = 250_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def short_batches(spark: SparkSession) -> None:
    """Hand fewer rows at a time to Python: texts are long, and a batch is held several times over."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name under the shared checkpoint folder of the session (a local one only for a local master)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            found = spark.sparkContext.getCheckpointDir()
        base = found
    return f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, lost executors cost nothing."""
    spark = df.sparkSession
    short_batches(spark)
    path = scratch(spark)
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")  # once the table is there, the shuffle files behind it can go
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def map_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fn`` once for all rows of each value of ``key``; groups must be of bounded size.

    Rows are dealt out and sorted by Spark; one task then cuts its sorted rows into groups, which costs far
    less for many tiny groups than one Python call per group does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(keys)]
            out = []
            for a, b in zip(bounds, bounds[1:]):
                if rest and rest[0][key].iloc[0] != keys[a]:
                    out.append(fn(rest[0] if len(rest) == 1 else pd.concat(rest, ignore_index=True)))
                    rest = []
                piece = batch.iloc[a:b]
                if b < len(keys):
                    out.append(fn(pd.concat([*rest, piece], ignore_index=True) if rest else piece.reset_index(drop=True)))
                    rest = []
                else:
                    rest.append(piece)
            if out := [x for x in out if len(x)]:
                yield pd.concat(out, ignore_index=True)
        if rest:
            yield fn(pd.concat(rest, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def map_runs(df: DataFrame, key: str, order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fn`` for many whole groups of rows with the same ``key`` at a time, sorted by it and ``order``.

    For groups that are mostly tiny, so that ``fn`` can treat all of them in the same few array operations. Groups
    must be of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = batch[key].to_numpy()
            last = int(np.flatnonzero(keys == keys[-1])[0])
            if last:
                yield fn(batch.iloc[:last].reset_index(drop=True))
            rest = batch.iloc[last:]
        if rest is not None:
            yield fn(rest.reset_index(drop=True))

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


class WordCodes(dict):
    """bytes of a word -> signed 64-bit hash, remembered while the memo is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)
        return code


def word_codes(texts: list[bytes | None], codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts one after another, and where each text starts (with the end).

    ``bytes.split`` cuts at exactly the six ASCII white-space characters.
    """
    get = codes.__getitem__
    parts = []
    for text in texts:
        words = text.split() if text else []
        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)).view(np.uint64), starts


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 2_500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``size`` bytes (a longer text stands alone), so that
    arrays over all words of a batch stay small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(codes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive codes."""
    n = max(0, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for j, m in enumerate(_odd(seed * 1000 + size, size)):
        h += codes[j : j + n] * m
    return mix(h)


def window_starts(starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows that stay inside their text: where they start, and the number of their text."""
    counts = np.maximum(np.diff(starts) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[owner] + starts[:-1][owner], owner


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): one row (id, root) for each id in an edge, root its smallest.

    Alternates large-star and small-star steps. Minima are combined before they are shuffled and written to the
    shared folder, so that joins with them have a shuffle of their own on either side and Spark can split the edges
    of a node that has very many. Every step is written to the shared folder.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")))
        large = saved(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = saved(small.select("e.u", "e.v").filter("u <> v").distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
