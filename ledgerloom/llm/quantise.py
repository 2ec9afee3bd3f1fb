"""Vectors as codes of their parts' nearest entries, learned by Elkan's form of Lloyd's rounds in whole numbers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._common import saved

#: fixed values of the rounds: what a component is multiplied by, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Whole components below this are squared and summed up in 64 bits (parts of up to 2,048 components); others as Python's integers.
SMALL = 1 << 25
#: Lower bounds are kept in 16 bits, rounded down; a greater distance is a greater bound than any of these.
_MOST = (1 << 16) - 1
_STATE = "vec_id long, label string, x array<double>, near binary, upper binary, lower binary, error decimal(38,0)"


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: int64, or Python's integers if any is beyond SMALL."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(SCALE))  # a power of two: nothing is rounded
    if y.size == 0 or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 1e300 else int(v) * SCALE for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, one with one."""
    if x.dtype == object or c.dtype == object or x.shape[-1] > 2048:
        d = x.astype(object) - c.astype(object)
        return (d * d).sum(axis=-1) if d.shape[-1] else np.zeros(d.shape[:-1], object)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _root(d: np.ndarray, up: bool) -> np.ndarray:
    """Roots of whole numbers, rounded outwards, so that a bound stays a bound."""
    r = np.sqrt(np.array([float(v) if v < 10**300 else math.inf for v in d.tolist()]) if d.dtype == object else d.astype(np.float64))
    return r * (1 + 1e-14) if up else np.where(np.isinf(r), 1e150, r * (1 - 1e-14))


class Codebook:
    """The entries of one part, how far they moved in the last round, and half of the distances between them."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        n = len(entries)
        i, j = np.divmod(np.arange(n * n), n)
        self.half = _root(squared(entries[i], entries[j]), up=False).reshape(n, n) / 2
        self.moved = np.zeros(n) if before is None else _root(squared(entries, before), up=True)

    def assign(self, x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Nearest entries (ties to the lower index) of the rows of ``x``; changes near, upper, lower; gives squared distances.

        An entry is left out only if a bound proves it to be farther than the one the row has, strictly; for all
        others, ties included, whole numbers decide. Rows come with an upper bound of the distance to the entry they
        had and a lower bound for each entry, as of the round before; first of all, the entries' moves are added.
        """
        rows = np.arange(len(x))
        upper += self.moved[near]
        np.maximum(lower - np.ceil(self.moved), 0, out=lower)
        ask = (lower <= upper[:, None]) & (self.half[near] <= upper[:, None])
        ask[rows, near] = True
        i, j = np.nonzero(ask)
        found = np.concatenate([squared(x[i[a : a + 1_000_000]], self.entries[j[a : a + 1_000_000]]) for a in range(0, max(1, len(i)), 1_000_000)])
        lower[i, j] = np.minimum(np.floor(_root(found, up=False)), _MOST)
        # rows are in order and so are the entries asked for: the first of the least is the lowest index
        first = np.searchsorted(i, rows)
        best = np.minimum.reduceat(found, first) if len(rows) else found
        at = np.flatnonzero(found == best[i])
        near[:] = j[at[np.searchsorted(i[at], rows)]]
        upper[:] = _root(best, up=True)
        return best


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.array_split(x, PARTS, axis=1)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, which rows, their vectors as a matrix) of a batch."""
    x = batch.column(column)
    lengths = np.diff(x.offsets.to_numpy())
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield d, at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _rows(column: pa.Array, at: np.ndarray, kind: type, *shape: int) -> np.ndarray:
    """Numbers kept as bytes, one row for each of ``at``, in an array that can be changed."""
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(len(at), *shape).copy()


def _assigned(state: DataFrame, books: dict[int, list[Codebook]], first: bool) -> DataFrame:
    """The rows with new nearest entries and bounds. Rows of the first round have no bounds yet."""
    shared = state.sparkSession.sparkContext.broadcast(books)  # ENTRIES rows of each length and part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for big in batches:
            for batch in (big.slice(a, 2_000) for a in range(0, len(big), 2_000)):
                for d, at, x in _by_length(batch, "x"):
                    n, k = len(at), len(known[d][0].entries)
                    if first:
                        near, upper, lower = np.zeros((n, PARTS), np.uint8), np.full((n, PARTS), np.inf), np.zeros((n, PARTS, k), np.uint16)
                    else:
                        near, upper, lower = _rows(batch.column("near"), at, np.uint8, PARTS), _rows(batch.column("upper"), at, np.float64, PARTS), _rows(batch.column("lower"), at, np.uint16, PARTS, k)
                    error = np.zeros(n, object)
                    for p, part in enumerate(_parts(whole(x))):
                        own, bound, floor = near[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].astype(np.float64)
                        error = error + known[d][p].assign(part, own, bound, floor).astype(object)
                        near[:, p], upper[:, p], lower[:, p] = own, bound, floor
                    took = pa.array(at)
                    blobs = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (near, upper, lower)]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(took), batch.column("label").take(took), batch.column("x").take(took), *blobs, pa.array([v if v < 10**38 else None for v in error.tolist()], pa.decimal128(38, 0))], names=[f.split()[0] for f in _STATE.split(", ")])

    return state.mapInArrow(run, _STATE)


def _replaced(state: DataFrame, books: dict[int, list[Codebook]]) -> dict[int, list[Codebook]]:
    """Codebooks whose entries are the floors of their parts' means. Tasks sum up what they hold, then the sums of an
    entry meet: no task holds more than running sums, and the driver gets the entries."""
    sizes = {d: [len(b.entries) for b in book] for d, book in books.items()}
    schema = "length int, part int, entry int, n long, total array<string>"

    def emit(sums: dict) -> Iterator[pa.RecordBatch]:
        rows = [(d, p, e, n, [str(v) for v in total]) for (d, p, e), (n, total) in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["length", "part", "entry", "n", "total"])

    def add(sums: dict, key: tuple, n: int, total: np.ndarray) -> None:
        n0, total0 = sums.get(key, (0, 0))
        sums[key] = n0 + n, total0 + total.astype(object)  # Python's integers: no sum overflows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for d, at, x in _by_length(batch, "x"):
                near = _rows(batch.column("near"), at, np.uint8, PARTS)
                for p, part in enumerate(_parts(whole(x))):
                    total = np.zeros((sizes[d][p], part.shape[1]), part.dtype)
                    np.add.at(total, near[:, p], part)
                    count = np.bincount(near[:, p], minlength=sizes[d][p])
                    for e in np.flatnonzero(count).tolist():
                        add(sums, (d, p, e), int(count[e]), total[e])
        yield from emit(sums)

    def whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                add(sums, (row["length"], row["part"], row["entry"]), row["n"], np.array([int(v) for v in row["total"]], object))
        yield from emit(sums)

    sums = state.select("x", "near").mapInArrow(partial, schema).repartition("length", "part", "entry").mapInArrow(whole_sums, schema).collect()
    new = {d: [b.entries.astype(object) for b in book] for d, book in books.items()}
    for r in sums:
        new[r.length][r.part][r.entry] = [int(v) // r.n for v in r.total]
    return {d: [Codebook(_narrow(e), old.entries) for e, old in zip(new[d], books[d])] for d in books}


def _narrow(entries: np.ndarray) -> np.ndarray:
    """Python's integers as int64 where they are SMALL."""
    return entries if entries.size and max(abs(v) for v in entries.ravel().tolist()) >= SMALL else entries.astype(np.int64)


def digest(book: list[Codebook]) -> str:
    """sha256 (hex) of all components by part, entry, position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in book for v in b.entries.ravel().tolist()).encode()).hexdigest()


def _drop(spark: SparkSession, table: DataFrame) -> None:
    """Removes a table of bounds that no later step reads."""
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """For every row (vec_id, embedding, label) with a vector of finite numbers: vec_id, code, error, label_error, codebooks_sha256.

    Components become whole numbers, vectors are cut into PARTS consecutive parts, and each part position has a
    codebook that starts as the parts of the ENTRIES smallest vec_ids. ``rounds`` times every part gets its nearest
    entry (squared Euclidean distance, ties to the lower index) and each entry the floored mean of its parts; unused
    entries stay. Then parts are assigned once more. Between rounds every part keeps, in a table in the shared folder,
    an upper bound of the distance to its entry and a lower bound for each entry; entries that these or the distances
    between entries rule out strictly are not looked at, and moves of entries shift the bounds.

    Vectors that are null or hold null or non-finite components are dropped; an empty table gives no rows. Rows that
    share a vec_id are rows of their own: among the smallest, equal vec_ids come in the order of their vectors, null
    ones last. Vectors of each length have codebooks of their own; a length that PARTS does not divide is cut into
    parts that differ by one component. An error that 64 bits can't hold is null. Equal labels, nulls together, share
    label_error; a table without label has nulls there. Further columns are ignored.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter("x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('inf'))")
    small = _smallest(rows)
    books = {d: [Codebook(_narrow(part.astype(object))) for part in _parts(whole(np.array(xs, np.float64).reshape(len(xs), d)))] for d, xs in small.items()}
    state, first = rows, True
    for _ in range(rounds):
        now = saved(_assigned(state, books, first))
        books = _replaced(now, books)
        if not first:
            _drop(spark, state)
        state, first = now, False
    last = saved(_assigned(state, books, first).select("vec_id", "label", "x", "near", "error"))
    if not first:
        _drop(spark, state)
    sums = last.groupBy("label").agg(F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("total"))
    hashes = F.create_map(*(x for d, book in books.items() for x in (F.lit(d), F.lit(digest(book))))) if books else F.create_map().cast("map<int,string>")
    out = last.alias("v").join(sums.alias("s"), F.col("v.label").eqNullSafe(F.col("s.label")))
    return out.select("vec_id", F.lower(F.hex("near")).alias("code"), F.expr("try_cast(error as long)").alias("error"), F.expr("try_cast(total as long)").alias("label_error"), hashes[F.size("x")].alias("codebooks_sha256"))


def _smallest(rows: DataFrame) -> dict[int, list]:
    """The vectors of the ENTRIES smallest vec_ids of each length, a job for each: tasks keep as many of theirs."""
    lengths = [r.n for r in rows.groupBy(F.size("x").alias("n")).count().collect()]
    order = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    return {d: [r.x for r in rows.filter(F.size("x") == d).orderBy(*order).limit(ENTRIES).collect()] for d in sorted(lengths)}
