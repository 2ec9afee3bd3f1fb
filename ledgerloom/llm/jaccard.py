"""N-gram Jaccard self-join of documents by MinHash LSH with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._blocks import bucket_blocks, pair_mask, settle, stars
from ledgerloom.llm._common import WordCodes, map_groups, mix, saved, slices, window_hashes, window_starts, word_codes

WORDS, THRESHOLD = 5, 0.8
#: Tries, the values of a signature in each, and the lengths of prefixes that are tried, longest first.
TREES, DEPTH = 24, 11
DEPTHS = (11, 8, 7, 6)
#: Prefixes are shortened until this share of all links is found by estimate (the shortest finds 99.93 % at the threshold).
TARGET = 0.998
#: Lower edges of the bands of similarity in which links found are counted for the estimate.
BANDS = (0.8, 0.85, 0.9, 0.95)
_CHUNK, _PAIRS, _COLUMNS = 1 << 16, 1 << 14, 1 << 12
#: Texts of a block of a large bucket; blocks of long texts hold fewer.
BLOCK = 512


def recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair of this similarity shares a prefix of ``depth`` values in one of the tries."""
    return 1 - (1 - similarity**depth) ** trees


def enough(found: list[int], depth: int) -> bool:
    """Whether prefixes of ``depth`` are estimated to have found TARGET of all links, from those found in each band.

    A link found stands for 1 / recall of them, with recall at its band's lower edge; every band counts one more link
    than was found, so that an empty one tells what it can't tell.
    """
    all_links = sum((n + 1) / recall(edge, depth) for n, edge in zip(found, BANDS))
    return sum(n + 1 for n in found) >= TARGET * all_links


def shingles(codes: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams, text after text, and their number in each; a shorter text is one n-gram."""
    n = np.diff(starts)
    at, owner = window_starts(starts, words)
    out = window_hashes(codes, words)[at]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        extra = np.concatenate([window_hashes(codes[starts[i] : starts[i + 1]], n[i]) for i in short])
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, np.bincount(owner, minlength=len(n))


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values of texts that all have n-grams: one row of TREES * DEPTH a text. The least of 32 bits is hashed
    to 16, so that values of very long texts, which are all small, differ as well."""
    rng = np.random.default_rng(11)
    xors = rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
    odds = rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    h = (mix(h) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), TREES * DEPTH), np.uint16)
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        piece, cuts = h[base : ends[b - 1]], np.r_[0, ends[a : b - 1] - base]
        for j in range(TREES * DEPTH):
            out[a:b, j] = np.minimum.reduceat((piece ^ xors[j]) * odds[j], cuts) * np.uint32(0x9E3779B1) >> np.uint32(16)
        a = b
    return out


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordCodes()
    for batch in slices(batches, 1):
        texts = batch.column(1).to_pylist()
        codes, starts = word_codes(texts, memo)
        full = np.flatnonzero(np.diff(starts) > 0)
        h, counts = shingles(codes, starts)
        keys: list[bytes | None] = [None] * len(texts)
        for i, row in zip(full, signatures(h, counts[full])):
            keys[i] = row.astype(">u2").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t.split()) if k else None for t, k in zip(texts, keys)], pa.binary()), pa.array(keys, pa.binary()), pa.array(counts.astype(np.int64))], ["doc_id", "cls", "keys", "grams"])


def _verifier(depth: int, longer: int | None):
    """Checks the pairs of one call of prefixes of ``depth``; pairs that a ``longer`` prefix brought together are done."""
    memo = WordCodes()

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("id").sort_values("id", ignore_index=True)
        n, tree = len(rows), int(rows["tree"].iloc[0])
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        sets = []
        for p in rows["packed"]:
            codes, starts = word_codes([zstandard.decompress(p)], memo)
            sets.append(np.unique(shingles(codes, starts)[0]))
        sizes = np.array([len(s) for s in sets], np.float64)
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes.astype(np.int64))
        shared = times[col] > 1
        row, col = row[shared], (np.cumsum(times > 1) - 1)[col[shared]]
        both = np.zeros((n, n), np.float64)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for a in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
            x, y = np.searchsorted(col, [a, a + _COLUMNS])
            m = np.zeros((n, _COLUMNS), np.float32)
            m[row[x:y], col[x:y] - a] = 1
            both += m @ m.T
        jaccard = both / (sizes[:, None] + sizes[None, :] - both)
        i, j = np.nonzero(pair_mask(rows["own"].to_numpy(), rows["other"].to_numpy()) & (jaccard >= THRESHOLD - 1e-12))
        keys = np.stack([np.frombuffer(k, ">u2").reshape(TREES, DEPTH) for k in rows["keys"]])
        # a pair counts in the first trie that brings it together
        new = np.zeros(len(i), bool)
        for a in range(0, len(i), _PAIRS):
            alike = keys[i[a : a + _PAIRS]] == keys[j[a : a + _PAIRS]]
            same = alike[:, :, :depth].all(2)
            new[a : a + _PAIRS] = same[:, tree] & (np.argmax(same, axis=1) == tree)
            if longer:
                new[a : a + _PAIRS] &= ~alike[:, :, :longer].all(2).any(1)
        i, j = i[new], j[new]
        links = np.zeros(n, np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        bands = np.zeros((n, len(BANDS)), np.int64)
        np.add.at(bands, (i, np.searchsorted(BANDS, jaccard[i, j] + 1e-9, "right") - 1), 1)
        out = pd.DataFrame({"id": ids, "links": links, "root": stars(n, i, j, ids)} | {f"band{k}": bands[:, k] for k in range(len(BANDS))})
        return out[links > 0]

    return verify


def similar_documents(docs: DataFrame) -> DataFrame:
    """For every row (doc_id, text): doc_id, class_id, n_links, group_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared as sets of 5-grams (a shorter text is one n-gram); texts
    link at Jaccard similarity 0.8 or more. Texts with the same words form a class, named by its smallest
    doc_id, and only one text of a class is compared; n_links still counts every other document linked.
    group_id is the smallest doc_id that links lead to; kept marks the documents that bear that id.

    Each text has signatures of 11 MinHash values in 24 tries. Texts that share a prefix are compared exactly, first
    with whole signatures, then with prefixes of 8, 7 and 6 values, until the links found, by their similarities, are
    estimated to be 99.8 % of all. Members that met already are not compared again. At 8 values the chance that
    a link is found is 98.8 % at similarity 0.8 itself and over 99.9 % at 0.85; at 6 it is 99.9 % at 0.8.

    Null or wordless texts and rows with null doc_id link with nothing and are their own class and group.
    Repeated rows count as copies. An empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    sketched = saved(docs.mapInArrow(_sketch, "doc_id long, cls binary, keys binary, grams long"))
    lone = "doc_id is null or cls is null"
    classes = sketched.filter(f"not ({lone})").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.min("keys").alias("keys"), F.min("grams").alias("grams"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t.split()) for t in texts], pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary())], ["doc_id", "cls", "packed"])

    packed = docs.mapInArrow(pack, "doc_id long, cls binary, packed binary")
    found, met, longer = None, None, None
    schema = "id long, links long, root long, " + ", ".join(f"band{k} long" for k in range(len(BANDS)))
    for depth in DEPTHS:
        prefixes = F.array(*(F.substring("keys", 1 + 2 * DEPTH * t, 2 * depth) for t in range(TREES)))
        calls, taken = bucket_blocks(classes.select("id", F.posexplode(prefixes).alias("tree", "key"), F.lit(0).alias("probe"), F.col("grams").alias("weight")), BLOCK, met)
        calls = saved(calls)
        wanted = calls.select("id").distinct().join(classes, "id").select("id", F.col("class_id").alias("doc_id"), "cls", "copies", "keys")
        texts = packed.join(wanted, ["doc_id", "cls"]).select("id", "copies", "keys", "packed")
        level = saved(map_groups(calls.join(texts, "id"), "grp", _verifier(depth, longer), schema))
        found, met, longer = level if found is None else found.union(level), taken if met is None else met.union(taken), depth
        counts = found.agg(*(F.coalesce(F.sum(f"band{k}"), F.lit(0)) for k in range(len(BANDS)))).first()
        if enough(list(counts), depth):
            break
    of_class = settle(classes, found).join(classes.select("id", "cls", "class_id"), "id")
    out = sketched.select("doc_id", "cls").filter(f"not ({lone})").join(of_class, "cls").select("doc_id", "class_id", "n_links", "group_id")
    rest = sketched.filter(lone).selectExpr("doc_id", "doc_id as class_id", "0L as n_links", "doc_id as group_id")
    return out.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))
