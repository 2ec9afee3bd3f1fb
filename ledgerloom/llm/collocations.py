"""Phrases of words that stand together more often than their words would: contiguous pattern growth."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import MEMO_WORDS, mix, saved, slices

#: fixed values: least count of a phrase, most words of it, share (of 100) at which a longer phrase stands for it, rows of each language.
LEAST, MOST_WORDS, SHARE, TOP = 10, 3, 50, 2000
#: Parts in which a language's phrases are ranked before they meet.
PARTS = 16
#: What ends a piece; a letter A-Z becomes small, a tab a blank.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Different words, or words, that a task gathers before it hands on what it has counted.
GATHER_WORDS, GATHER_TOKENS = 400_000, 4_000_000
#: Pointers that a task looks at together.
BLOCK_ROWS = 200_000
#: Bits of the filter of pairs, at most; hashes of a bucket of it, about.
FILTER_BITS, BUCKET = 1 << 28, 1_000_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words of some texts of it, pieces apart by line feeds) for batches of (lang, text)."""
    for batch in slices(batches, "text"):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            words = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
            yield lang, list(filter(None, words))


class _Codes(dict):
    """word -> 64-bit code (the line feed: 0), remembered while the memo is small; the same as xxhash64(concat(salt, word)) in SQL."""

    def __init__(self, salt: bytes):
        super().__init__()
        self.salt = salt

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = 0 if word == b"\n" else xxhash.xxh64_intdigest(self.salt + word, 42)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _vocabulary(docs: DataFrame, salt: str) -> DataFrame:
    """(lang, word, n, code) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, of_lang in counts.items():
                of_lang.pop(b"\n", None)
                words = list(of_lang)
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([of_lang[w] for w in part], pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for lang, words in _pieces(batches):
            counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > GATHER_WORDS:
                yield from counted()
        yield from counted()

    found = docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.withColumn("code", F.xxhash64(F.concat(F.lit(salt), F.col("word"))))


def _gathered(batches: Iterator[pa.RecordBatch], codes: _Codes, use: Callable[[str, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``use`` of the codes of many texts of a language at a time (0 between pieces and at both ends)."""
    held: dict[str, list[np.ndarray]] = {}
    for lang, words in _pieces(batches):
        held.setdefault(lang, [np.zeros(1, np.uint64)]).extend((codes.of(words), np.zeros(1, np.uint64)))
        if sum(len(x) for y in held.values() for x in y) > GATHER_TOKENS:
            for k, parts in held.items():
                yield from use(k, np.concatenate(parts))
            held.clear()
    for k, parts in held.items():
        yield from use(k, np.concatenate(parts))


def _pairs(lang: str, c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place whether a word and its next stand there, and what the filter knows the pair by: ``bits`` of a bucket and 32 more."""
    real = (c[:-1] != 0) & (c[1:] != 0)
    start = np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))
    h = mix(c[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(c[1:] + start))
    return real, h >> np.uint64(32 - bits)


@np.errstate(over="ignore")
def _bits_of(low: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a bucket's filter that stand for a hash."""
    return (low & np.uint64(size - 1)).astype(np.int64), ((low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


class _Filter:
    """Which pairs may occur LEAST times: never wrong about one that does."""

    def __init__(self, bits: int, size: int, filled: bytes):
        self.bits, self.size, self.filled = bits, size, filled

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        of_bucket = (keys >> np.uint64(32)).astype(np.int64) * self.size
        filled, out = np.frombuffer(self.filled, np.uint8), np.ones(len(keys), bool)
        for at in _bits_of(keys & np.uint64(0xFFFFFFFF), self.size):
            at = at + of_bucket
            out &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def _pair_filter(docs: DataFrame, salt: str, words: int, least: int) -> _Filter:
    """Counts hashes of pairs in buckets, each in one task, and marks those that reach ``least`` in a filter of bounded size."""
    bits = min(16, max(6, (max(1, words) // BUCKET).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on(lang: str, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            real, keys = _pairs(lang, c, bits)
            keys, n = np.unique(keys[real], return_counts=True)
            ends = np.searchsorted(keys, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
            low, n = keys.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            starts = np.concatenate([[0], ends[:-1]])
            own = np.flatnonzero(ends > starts)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([low[starts[k] : ends[k]].tobytes() for k in own], pa.binary()), pa.array([n[starts[k] : ends[k]].tobytes() for k in own], pa.binary())], names=["bucket", "low", "n"])

        yield from _gathered(batches, _Codes(salt.encode()), hand_on)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> pa.RecordBatch:
            low, n = (np.concatenate([np.frombuffer(x, kind) for x in y]) for y, kind in ((lows, np.uint32), (ns, np.uint8)))
            keys, which = np.unique(low, return_inverse=True)
            keys = keys[np.bincount(which, weights=n) >= min(least, 255)]
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())], names=["bucket", "low", "n"])

        at, lows, ns = None, [], []
        for batch in batches:
            for bucket, low, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if bucket != at and lows:
                    yield settled()
                    lows, ns = [], []
                at = bucket
                lows.append(low)
                ns.append(n)
        if lows:
            yield settled()

    counted = docs.mapInArrow(count, "bucket int, low binary, n binary").repartition("bucket").sortWithinPartitions("bucket")
    frequent = saved(counted.mapInArrow(often, "bucket int, low binary, n long"))
    many = frequent.agg(F.sum("n")).first()[0] or 0
    size = 1 << max(6, min((FILTER_BITS >> bits).bit_length() - 1, (12 * many >> bits).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                filled = np.zeros(size, bool)
                for at in _bits_of(np.frombuffer(low, np.uint32).astype(np.uint64), size):
                    filled[at] = True
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())], names=["bucket", "filled"])

    filled = bytearray(size // 8 << bits)
    for r in frequent.select("bucket", "low").mapInArrow(mark, "bucket int, filled binary").toLocalIterator():  # FILTER_BITS in all
        filled[r.bucket * size // 8 : (r.bucket + 1) * size // 8] = r.filled
    return _Filter(bits, size, bytes(filled))


def _sums(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of ``words`` (sorted) as one, with the sum of their weights."""
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    return words[first], np.add.reduceat(weight, first)


def _projected(docs: DataFrame, salt: str, pairs: _Filter, most_words: int) -> DataFrame:
    """(lang, c1 ... cm, n): occurrences of every first word with the words behind it, as far as each pair may be frequent (0 beyond)."""
    names = [f"c{k + 1}" for k in range(most_words)]
    shared = docs.sparkSession.sparkContext.broadcast(pairs)  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value

        def hand_on(lang: str, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            real, keys = _pairs(lang, c, known.bits)
            real[real] = known.maybe(keys[real])
            at = np.flatnonzero(real)
            words, on = np.zeros((len(at), most_words), np.uint64), np.ones(len(at), bool)
            words[:, 0] = c[at]
            for k in range(1, most_words):
                on &= real[np.minimum(at + k - 1, len(real) - 1)]
                words[on, k] = c[at[on] + k]
            words = words[np.lexsort(words.T[::-1])]
            if len(words):
                words, n = _sums(words, np.ones(len(words), np.int64))
                for a in range(0, len(n), 100_000):
                    part = words[a : a + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), *(pa.array(part[:, k]) for k in range(most_words)), pa.array(n[a : a + 100_000])], names=["lang", *names, "n"])

        yield from _gathered(batches, _Codes(salt.encode()), hand_on)

    return docs.mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in names)}, n long")


def _grown(pointers: DataFrame, most_words: int, least: int) -> DataFrame:
    """(lang, codes, a) of the phrases of 2 to ``most_words`` words that occur ``least`` times.

    Pointers are dealt by ranges of their words and sorted, so those of a prefix lie together, and within them those
    of each prefix that is a word longer: a task walks down the tree of its prefixes, and goes on to the next word
    only with the pointers of frequent ones. A prefix of very many pointers goes to several tasks; what lies at the
    edge of a block of rows is a part of a count, which Spark sums up with the others.
    """
    names = [f"c{k + 1}" for k in range(most_words)]

    def grow(lang: str, words: np.ndarray, weight: np.ndarray, first: bool, last: bool, depth: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """first, last: whether the rows begin, or end, at an edge of the block."""
        longer = words[:, depth - 1] != 0
        first, last = first and bool(longer[0]), last and bool(longer[-1])
        words, weight = words[longer], weight[longer]
        if not len(words):
            return
        starts = np.flatnonzero(np.concatenate([[True], (words[1:, :depth] != words[:-1, :depth]).any(axis=1)]))
        total = np.add.reduceat(weight, starts)
        take = total >= least
        take[0] |= first
        take[-1] |= last
        yield lang, words[starts[take], :depth], total[take]
        if depth < most_words:
            stay = np.repeat(take, np.diff(np.append(starts, len(words))))
            if stay.any():
                yield from grow(lang, words[stay], weight[stay], first and bool(stay[0]), last and bool(stay[-1]), depth + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            langs = t.column("lang").to_numpy(zero_copy_only=False)
            words = np.stack([t.column(c).to_numpy() for c in names], axis=1)
            weight = t.column("n").to_numpy()
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for a, b in zip(cuts, cuts[1:]):
                for lang, codes, total in grow(langs[a], words[a:b], weight[a:b], True, True, 2):
                    if len(total):
                        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)), pa.array(codes.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), flat, pa.array(total)], names=["lang", "codes", "a"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield from block(held)
                held = []
        if held:
            yield from block(held)

    key = ["lang", *names]
    parts = max(int(pointers.sparkSession.conf.get("spark.sql.shuffle.partitions")), pointers.count() // 2_000_000)
    ranged = pointers.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return ranged.mapInArrow(run, "lang string, codes array<long>, a long").groupBy("lang", "codes").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (lang, text) are lower-cased (A-Z), cut into pieces and words. Words get codes, which a table of all words
    proves to be different. A filter of bounded size says which pairs may be frequent; only for those, pointers to the
    words behind a first word are projected. Prefixes then grow to the right by a word, depth-first in sorted order
    (see ``_grown``), counts at edges are summed up. A phrase is scored by the worst of its cuts, in whole numbers of
    38 digits; phrases that a longer one mostly stands for are dropped; the rest is ranked.

    A null lang counts as "und"; null and empty texts hold no words; repeated rows count as often as they come; equal
    scores rank by count, then by phrase in the order of its bytes. An empty table gives no rows; further columns are
    ignored. A very long text is cut as a whole, in a batch of its own.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for salt in ("", "1", "2", "3"):
        vocabulary = saved(_vocabulary(docs, salt))
        if vocabulary.filter("code = 0").isEmpty() and vocabulary.groupBy("lang", "code").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("no salt keeps the codes of all words apart")
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    pairs = _pair_filter(docs, salt, sizes.agg(F.sum("n")).first()[0] or 0, least)
    found = saved(_grown(saved(_projected(docs, salt, pairs, most_words)), most_words, least))

    known = vocabulary.filter(F.col("n") >= least).select("lang", F.array("code").alias("part"), F.col("n").alias("f")).union(found.select("lang", "codes", "a"))
    cuts = found.select("lang", "codes", "a", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("codes", F.lit(1), F.col("k"))).withColumn("right", F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact('a')} * {exact('a')})) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "codes", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "codes", "a", "cut.l", "cut.r", "cut.score")

    inner = F.expr("flatten(transform(sequence(2, size(codes) - 1), m -> transform(sequence(1, size(codes) - m + 1), i -> slice(codes, i, m))))")
    covered = found.filter(F.size("codes") > 2).select("lang", "a", F.explode(inner).alias("codes")).groupBy("lang", "codes").agg(F.max("a").alias("longer"))
    kept = scored.join(covered, ["lang", "codes"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")

    # the best of each of a language's PARTS first, so that no task gets more than PARTS * top rows, but for ties
    best = kept.withColumn("part", F.pmod(F.xxhash64("codes"), F.lit(PARTS)))
    for key in (["lang", "part"], ["lang"]):
        by_score = Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("a"))
        best = best.withColumn("place", F.rank().over(by_score)).filter(F.col("place") <= top)
    best = saved(best.drop("place", "part"))
    spelt = best.select("lang", "codes", F.posexplode("codes").alias("at", "code")).join(vocabulary.select("lang", "code", "word"), ["lang", "code"])
    spelt = spelt.groupBy("lang", "codes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.join(spelt, ["lang", "codes"]).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
