"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._blocks import bucket_blocks, settle, stars
from ledgerloom.llm._common import map_runs, saved

THRESHOLD = 0.95
#: Vectors, and numbers in them, that the rotations are learned from, at most; every vector is indexed.
SAMPLE, SAMPLE_NUMBERS = 20_000, 2_000_000
#: Vectors of a length that are all compared with each other, in blocks, instead of by codes.
FEW = 2_048
#: Chance that a pair right at the threshold meets in a table, and that its codes differ in no more than ``radius`` bits.
TARGET, WITHIN = 0.99, 0.9995
ROUNDS = 30


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _partners(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each row of unit length another one whose cosine with it is the threshold."""
    away = rng.normal(size=x.shape)
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    return threshold * x + math.sqrt(1 - threshold**2) * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)


def thinned(x: np.ndarray, cosine: float = 0.8, block: int = 1_000) -> np.ndarray:
    """Rows that stand for all: of rows nearer to each other than ``cosine`` the first, so that copies don't outweigh others."""
    kept, n = np.empty_like(x), 0
    for a in range(0, len(x), block):
        part = x[a : a + block]
        for b in range(0, n, block):  # a block with a block, so that the table of cosines stays small
            part = part[(part @ kept[b : min(n, b + block)].T < cosine).all(axis=1)]
        near = np.triu(part @ part.T >= cosine, 1)
        own = np.ones(len(part), bool)
        for k in np.flatnonzero(near.any(axis=1)):
            if own[k]:
                own[near[k]] = False
        part = part[own]
        kept[n : n + len(part)] = part
        n += len(part)
    return kept[:n]


def learn_rotations(x: np.ndarray, count: int, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """``count`` rotations (d x d) whose signs lose little of ``x`` (rows of unit length), and where every bit is cut.

    Rotations and cuts are learned from rows that stand for all, so a large group of near copies counts once. A cut at
    the median balances a bit, but where it runs through a group it parts its members: so each row is given a partner at
    the threshold, and the medians are taken only if no row's bits differ from its partner's in clearly more places than
    the angle allows, and all rows' on the whole in no more than a tenth more; else half of them, else 0, where the angle alone decides. A rotation that fails even so is
    replaced by a random one, of which that is known for any pair.
    """
    d = x.shape[1]
    rng = np.random.default_rng(5)
    few = thinned(x)
    y = _partners(x, threshold, rng)
    flips = math.acos(threshold) / math.pi
    most = d * flips + 5 * math.sqrt(d * flips) + 1
    turns, cuts = [], []
    for _ in range(count):
        start, _ = np.linalg.qr(rng.normal(size=(d, d)))
        r = start
        for _ in range(rounds):
            bits = np.where(few @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(few.T @ bits)
            r = u @ v
        median = np.median(few @ r, axis=0) if len(few) > 8 else np.zeros(d)
        for share, turn in ((1.0, r), (0.5, r), (0.0, r), (0.0, start)):
            cut = share * median
            parted = ((x @ turn > cut) != (y @ turn > cut)).sum(axis=1)
            if not len(x) or (parted <= most).all() and parted.mean() <= 1.1 * flips * d:
                break
        turns.append(turn)
        cuts.append(cut)
    return np.concatenate(turns, axis=1), np.concatenate(cuts)


def _stacked(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """Vectors by their length, one below the other."""
    out: dict[int, list] = {}
    for chunk in column.chunks:
        lengths = np.diff(chunk.offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            part = chunk.take(pa.array(np.flatnonzero(lengths == d)))
            out.setdefault(d, []).append(part.flatten().to_numpy().reshape(-1, d))
    return {d: np.concatenate(parts) for d, parts in out.items()}


def _chance(bits: int, flips: float, most: int) -> float:
    """The chance that at most ``most`` of so many bits differ."""
    return sum(math.comb(bits, k) * flips**k * (1 - flips) ** (bits - k) for k in range(most + 1))


def plan_tables(n: int, d: int, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[int, int]:
    """Bits of a stretch of a code, and stretches (tables): stretches grow with log2 n, so that unrelated vectors seldom meet.

    Two vectors meet in a table if their stretches differ in one bit at most, and half of those that differ in two.
    """
    width = min(d, 62, max(8, math.ceil(math.log2(max(2, n))) + 5))
    flips = 1.1 * math.acos(threshold) / math.pi
    meet = (_chance(width, flips, 1) + _chance(width, flips, 2)) / 2
    return width, max(1, math.ceil(math.log(1 - target) / math.log(1 - min(meet, 1 - 1e-9))))


def radius(bits: int, threshold: float = THRESHOLD) -> int:
    """Codes of ``bits`` bits that differ in more are not compared further."""
    flips = math.acos(threshold) / math.pi
    return next(r for r in range(bits + 1) if _chance(bits, flips, r) >= WITHIN or r == bits)


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which stretches of a pair meet: equal, one bit apart, or each with one bit that the other lacks."""
    x = a ^ b
    n = np.bitwise_count(x)
    return (n <= 1) | (n == 2) & (np.bitwise_count(x & a) == 1)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For every row (vec_id, embedding): vec_id, n_links, component_id, kept.

    Rotations learned on a bounded sample turn vectors into balanced binary codes. Disjoint stretches of the codes
    index them in Hamming tables, one for each stretch; every vector stands under its own stretch and probes those
    that lack one of its bits, so stretches at distance 1 (and half of those at distance 2) meet. Of the vectors that
    meet, those whose whole codes differ in few bits are compared by cosine in double precision; vectors travel only
    to calls where such a pair is. Equal vectors are compared once and counted as often as they come.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing. Vectors of
    different lengths never link; each length has tables of its own, and one of at most FEW vectors has all of them
    compared, in blocks. Rows with null vec_id link with nothing;
    repeated rows count as copies. An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.withColumn("x", F.expr("if(vec_id is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(x, v -> v <> 0), x, null)"))
    rows = rows.withColumn("cls", F.when(F.col("x").isNotNull(), F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("x").alias("x"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()))
    sizes = {r.d: r.n for r in classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}
    large = {d: n for d, n in sizes.items() if n > FEW}
    numbers = sum(d * n for d, n in large.items())
    share = min(1.0, 0.95 * SAMPLE / max(1, sum(large.values())), 0.95 * SAMPLE_NUMBERS / max(1, numbers))
    some = classes.filter(F.size("x").isin(*large) & (F.pmod(F.xxhash64("class_id"), F.lit(1 << 20)) < int((1 << 20) * share)))
    by_length = _stacked(some.select("x").limit(SAMPLE).toArrow()["x"]) if large else {}

    def plan(d: int) -> tuple[int, int, int]:
        """Bits and number of the stretches of vectors of length d, and stretches of one rotation."""
        width, tables = plan_tables(large[d], d, threshold)
        return width, tables, max(1, d // width)

    learned = {d: learn_rotations(unit(x), math.ceil(plan(d)[1] / plan(d)[2]), threshold=threshold) for d, x in by_length.items()}
    shared = spark.sparkContext.broadcast(learned)  # for each length of the sample d x d numbers a rotation

    def batch_of(batch: pa.RecordBatch, at: np.ndarray, d: int, own: np.ndarray, codes: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array(list(own), pa.list_(pa.int64())), pa.array([k.tobytes() for k in own], pa.binary()), pa.array(codes, pa.binary())], ["id", "d", "keys", "stretch", "code"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                if d not in large:  # one bucket; codes of no bits never differ
                    own, codes = np.zeros((len(at), 1), np.int64), [b""] * len(at)
                    yield batch_of(batch, at, d, own, codes)
                    continue
                x = np.stack([v.values.to_numpy() for v in batch.column(1).take(pa.array(at))])
                width, tables, each = plan(d)
                if d not in known:  # a length that the sample did not hold: rotations that were not learned
                    known[d] = learn_rotations(np.zeros((0, d)), math.ceil(tables / each), 0)
                turn, median = known[d]
                bits = unit(x) @ turn > median
                own = bits.reshape(len(at), -1, d)[:, :, : each * width].reshape(len(at), -1, width)[:, :tables] @ (1 << np.arange(width, dtype=np.int64))
                codes = [c.tobytes() for c in np.packbits(bits, axis=1)]
                yield batch_of(batch, at, d, own, codes)

    coded = saved(classes.select("id", "x").mapInArrow(encode, "id long, d int, keys array<long>, stretch binary, code binary"))
    codes = coded.drop("keys")
    # a probed stretch lacks one of the bits of the vector's own
    keys = coded.select("id", "d", F.posexplode("keys").alias("tree", "own"))
    keys = keys.selectExpr("id", "d", "tree", "explode(concat(array(struct(own as key, 0 as probe)), transform(filter(sequence(0, 61), b -> own & shiftleft(1L, b) <> 0), b -> struct(own ^ shiftleft(1L, b) as key, 1 as probe)))) as e")
    keys = keys.selectExpr("id", "tree", "struct(d, e.key) as key", "e.probe as probe", "cast(d as long) as weight")
    calls = saved(bucket_blocks(keys)[0])

    def close(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (as places of rows) of whole calls whose codes differ in few bits and that meet here first."""
        grp, own, other, tree, probe, d = (rows[c].to_numpy() for c in ("grp", "own", "other", "tree", "probe", "d"))
        lengths, first, which = np.unique(d, return_index=True, return_inverse=True)
        within = {int(v): radius(8 * len(rows["code"].iat[k]), threshold) for v, k in zip(lengths, first)}
        limit = np.array(list(within.values()), np.int64)[which] if len(d) else np.empty(0, np.int64)
        # all rows of a call have one length of vector; shorter codes and fewer stretches are filled up alike
        code = np.zeros((len(rows), max(map(len, rows["code"]), default=0)), np.uint8)
        stretch = np.zeros((len(rows), max(map(len, rows["stretch"]), default=0) // 8), np.int64)
        for v in within:
            at = np.flatnonzero(d == v)
            part = [np.frombuffer(b"".join(rows[name].array[at]), kind).reshape(len(at), -1) for name, kind in (("code", np.uint8), ("stretch", np.int64))]
            code[at, : part[0].shape[1]], stretch[at, : part[1].shape[1]] = part
        found, shift = [], 1
        at = np.arange(len(rows))
        while len(at := at[at + shift < len(rows)]) and len(at := at[grp[at] == grp[at + shift]]):
            i, j = at, at + shift
            fit = ((own[i] == other[i]) | (own[i] != own[j])) & (np.bitwise_count(code[i] ^ code[j]).sum(axis=1, dtype=np.int64) <= limit[i])
            i, j = i[fit], j[fit]
            # equal stretches meet under their own key, not under those that both probe, and each pair in its first table
            met = _meet(stretch[i], stretch[j])
            right = met[np.arange(len(i)), tree[i]] & (np.argmax(met, axis=1) == tree[i]) & ((stretch[i, tree[i]] != stretch[j, tree[j]]) | (probe[i] == 0))
            found.append((i[right], j[right]))
            shift += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2

    def sift(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.loc[np.unique(np.concatenate(close(rows))), ["grp", "id", "tree", "probe", "own", "other"]]

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = close(rows)
        lengths = rows["d"].to_numpy()
        near = np.zeros(len(i), bool)
        for v in np.unique(lengths[i]):
            rank = np.cumsum(lengths == v) - 1
            x = unit(np.stack(rows["x"][lengths == v]))
            for a in range(0, len(i), 20_000):
                part = np.flatnonzero(lengths[i[a : a + 20_000]] == v) + a
                near[part] = np.einsum("ij,ij->i", x[rank[i[part]]], x[rank[j[part]]]) >= threshold
        i, j = i[near], j[near]
        ids, copies, links = rows["id"].to_numpy(), rows["copies"].to_numpy(), np.zeros(len(rows), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        return pd.DataFrame({"id": ids, "links": links, "root": stars(len(ids), i, j, ids)})[links > 0]

    named = "grp long, id long, tree int, probe int, own int, other int"
    calls = saved(map_runs(calls.join(codes.hint("merge"), "id"), "grp", "id", sift, named))
    payload = classes.select("id", "copies", "x").join(codes.hint("merge"), "id")
    found = saved(map_runs(calls.join(payload.hint("merge"), "id"), "grp", "id", verify, "id long, links long, root long"))
    of_class = settle(classes, found).join(classes.select("id", "cls").hint("merge"), "id")
    ids = rows.select("vec_id", "cls")
    out = ids.filter("cls is not null").join(of_class.hint("merge"), "cls").select("vec_id", "n_links", F.col("group_id").alias("component_id"))
    rest = ids.filter("cls is null").selectExpr("vec_id", "0L as n_links", "vec_id as component_id")
    return out.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
