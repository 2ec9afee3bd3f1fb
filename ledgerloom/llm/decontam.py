"""Benchmark decontamination by templates: passages whose numbers, names and units may have been exchanged."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import MEMO_WORDS, _odd, mix, slices, window_hashes, window_starts

#: Template tokens of a window; shorter items are one window. Windows of fewer than LEAST tokens, and those with more
#: slots than words, are compared word by word.
WINDOW, LEAST = 8, 4
#: Share of an item's tokens that consistent windows must cover.
COVERAGE = 0.6
#: Most benchmark windows that are sent to every task; beyond it windows are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

UNITS = frozenset(
    # fixed values: unit names and symbols that stand for a measure
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons lb lbs oz ounce ounces pound pounds "
    "ml cl l litre litres liter liters gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years usd eur gbp dollar dollars euro euros cent cents percent % ° °c °f k w kw mw wh kwh v a hz khz mhz ghz "
    "b kb mb gb tb pa kpa bar j kj cal kcal n mph kmh km/h m/s".split()
)
_EDGES = re.compile(r"^[^\w%°$€£-]+|[^\w%°]+$")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_NUMBER_UNIT = re.compile(r"([-+$€£]?\d[\d.,]*)([a-z%°/]+)")
#: Units that stand alone; single letters and "in" are mostly other words.
_BARE_UNITS = frozenset(u for u in UNITS if len(u) > 1 and u != "in") | {"%", "°"}
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3


def canonical(word: str) -> tuple[int, str, str]:
    """(kind, template token, value) of a word; token is empty if nothing but marks is left."""
    bare = _EDGES.sub("", word)
    low = bare.lower()
    if not low:
        return WORD, "", ""
    if _NUMBER.fullmatch(low):
        return NUMBER, "<number>", low
    if (m := _NUMBER_UNIT.fullmatch(low)) and m[2] in UNITS:
        return NUMBER, "<number+unit>", low
    if low in _BARE_UNITS:
        return UNIT, "<unit>", low
    if bare[0].isupper() and bare[1:].islower():
        return NAME, "<name>", low
    return WORD, low, low


def _code(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class _Canon(dict):
    """bytes of a word -> (template code, slot code or 0); (0, its own code) if it is nothing but marks."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        kind, token, value = canonical(word.decode("utf-8", "replace"))
        self[word] = found = (_code(token) if token else 0, _code(f"{kind} {value}") if kind else 0 if token else _code(f"marks {word.decode('utf-8', 'replace')}"))
        return found


def _tokens(texts: list[bytes | None], memo: _Canon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template codes and slot codes of all texts, where each text starts, and codes of the lone marks before each token."""
    parts, marks, at = [], {}, 0
    for t in texts:
        pairs = np.array([memo[w] for w in t.split()] if t else [], np.int64).reshape(-1, 2)
        full = pairs[:, 0] != 0
        if not full.all():
            lone = np.flatnonzero(~full)
            for k, code in zip((lone - np.arange(len(lone)) + at).tolist(), pairs[lone, 1].tolist()):
                marks[k] = (marks.get(k, 0) * 31 + code) & 0xFFFFFFFFFFFFFFFF
            pairs = pairs[full]
        parts.append(pairs)
        at += len(pairs)
    starts = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    both = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    glue = np.zeros(at + 1, np.uint64)
    glue[np.fromiter(marks, np.int64, len(marks))] = np.fromiter(marks.values(), np.uint64, len(marks))
    return both[:, 0].copy().view(np.uint64), both[:, 1], starts, glue


def _literal(size: int, n_slots: np.ndarray | int) -> np.ndarray | bool:
    """Whether windows are too short, or have too many slots, to be told by their template."""
    return (size < LEAST) | (2 * n_slots > size)


def _windows(texts: list[bytes | None], memo: _Canon, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each size: owner text, position, hash and slots (a row each) of the windows.

    The hash is of the template, or of words, slot values and the lone marks between them where that says too little.
    """
    codes, slots, starts, glue = _tokens(texts, memo)
    filled = np.r_[0, np.cumsum(slots != 0)]
    for size in sizes:
        at, owner = window_starts(starts, size)
        h = window_hashes(codes, size)[at]
        exact = np.flatnonzero(_literal(size, filled[at + size] - filled[at]))
        found = np.zeros(len(exact), np.uint64)
        for j, (m, g) in enumerate(zip(_odd(2000 + size, size), _odd(3000 + size, size))):
            k = at[exact] + j
            found += np.where(slots[k] != 0, slots[k].view(np.uint64), codes[k]) * m
            if j:
                found += glue[k] * g
        h[exact] = mix(found)
        yield owner, at - starts[owner], h.view(np.int64), np.lib.stride_tricks.sliding_window_view(slots, size)[at] if len(at) else np.empty((0, size), np.int64)


def _index(items: pd.DataFrame) -> pd.DataFrame:
    """Windows of benchmark items: (h, item_id, n, ipos, size, islots)."""
    memo = _Canon()
    texts = [None if t is None else bytes(t) for t in items["text"]]
    n = np.diff(_tokens(texts, memo)[2])
    out = []
    for size in range(1, WINDOW + 1):
        own = np.flatnonzero(n >= WINDOW) if size == WINDOW else np.flatnonzero(n == size)
        for owner, pos, h, slots in _windows([texts[i] for i in own], memo, (size,)):
            out.append(pd.DataFrame({"h": h, "item_id": items["item_id"].to_numpy()[own[owner]], "n": n[own[owner]], "ipos": pos, "size": size, "islots": [s.tobytes() for s in slots]}))
    return pd.concat(out, ignore_index=True)


_INDEX = "h long, item_id long, n long, ipos long, size long, islots binary"
_MATCH = "doc_id long, item_id long, n long, pos long, ipos long, size long, slots binary, islots binary"

_MATCH_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _MATCH.split(", ")])


def _judge(matches: list) -> tuple[float, int, int]:
    """Coverage, windows and exchanged slots of the matches of one document and item.

    Windows on one diagonal belong to one passage: there every slot value of the item must stand for one value
    of the document, and the other way round; a diagonal that breaks this is no copy of the question. Windows
    compared word by word are copies as they are.
    """
    passages: dict[int, list] = {}
    for m in {(m["pos"], m["ipos"], m["size"], bytes(m["slots"]), bytes(m["islots"])) for m in matches}:
        passages.setdefault(m[0] - m[1], []).append(m)
    covered: set[int] = set()
    windows, changed = 0, set()
    for whole in passages.values():
        passage = []
        for m in whole:
            if _literal(m[2], np.count_nonzero(np.frombuffer(m[4], np.int64))):
                windows += 1
                covered.update(range(m[1], m[1] + m[2]))
            else:
                passage.append(m)
        forth: dict[int, int] = {}
        back: dict[int, int] = {}
        for *_, slots, islots in passage:
            for a, b in zip(np.frombuffer(islots, np.int64).tolist(), np.frombuffer(slots, np.int64).tolist()):
                if a and (forth.setdefault(a, b) != b or back.setdefault(b, a) != a):
                    break
            else:
                continue
            break
        else:
            windows += len(passage)
            changed |= {a for a, b in forth.items() if a != b}
            for _, ipos, size, *_ in passage:
                covered.update(range(ipos, ipos + size))
    return len(covered) / matches[0]["n"], windows, len(changed)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold an item (item_id, text): doc_id, item_id, coverage, windows, changed.

    Words become template tokens: numbers, capitalised words (names) and units turn into typed placeholders,
    other words lose case and marks at their edges. Windows of 8 tokens are joined by hash; slot values must map
    one to one along a passage; a document counts if its consistent windows cover 60 % of the item. ``changed``
    counts slot values that were exchanged. Items of fewer than 8 tokens are one window. Windows with more slots
    than words, or of fewer than 4 tokens, must agree in every word and value (case and marks at the edges of words
    aside): verbatim copies are found whatever the item, so an item of one word is found wherever the word stands,
    but exchanged values only where words outweigh slots. An item without any word or number is left out.

    Null texts match nothing; null ids of documents or items are left out; repeated rows change nothing; empty
    tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    index = items.mapInPandas(lambda batches: (_index(b) for b in batches), _INDEX)
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    count = index.count()
    if count <= BROADCAST_WINDOWS:
        local = index.toPandas().sort_values(["h", "size"], ignore_index=True)
        sent = spark.sparkContext.broadcast(local)
        sizes = tuple(sorted(set(local["size"].tolist())))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            memo, local = _Canon(), sent.value
            keys = local["h"].to_numpy()
            known = np.zeros(1 << 22, bool)  # most windows are told apart by 22 bits
            known[keys & ((1 << 22) - 1)] = True
            rows = local[["item_id", "n", "ipos", "size", "islots"]]
            for batch in slices(batches, 1):
                ids = batch.column(0).to_numpy()
                for (owner, pos, h, slots), size in zip(_windows(batch.column(1).to_pylist(), memo, sizes), sizes):
                    maybe = np.flatnonzero(known[h & ((1 << 22) - 1)])
                    low, high = np.searchsorted(keys, h[maybe]), np.searchsorted(keys, h[maybe], "right")
                    at = np.repeat(maybe, high - low)
                    to = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a]) if len(at) else np.empty(0, np.int64)
                    fit = rows["size"].to_numpy()[to] == size
                    at, to = at[fit], to[fit]
                    found = rows.iloc[to].reset_index(drop=True)
                    found.insert(0, "doc_id", ids[owner[at]])
                    found.insert(3, "pos", pos[at])
                    found.insert(6, "slots", [s.tobytes() for s in slots[at]])
                    yield pa.RecordBatch.from_pandas(found, schema=_MATCH_ARROW, preserve_index=False)

        matches = docs.mapInArrow(look, _MATCH)
    else:
        sizes = tuple(sorted(r["size"] for r in index.select(F.col("size").cast("int")).distinct().collect()))

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = _Canon()
            for batch in slices(batches, 1):
                ids = batch.column(0).to_numpy()
                for (owner, pos, h, slots), size in zip(_windows(batch.column(1).to_pylist(), memo, sizes), sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(pos), pa.array(np.full(len(h), size)), pa.array(h), pa.array([s.tobytes() for s in slots], pa.binary())], ["doc_id", "pos", "size", "h", "slots"])

        rows = docs.mapInArrow(explode, "doc_id long, pos long, size long, h long, slots binary")
        matches = rows.join(index, ["h", "size"]).select(*(c.split()[0] for c in _MATCH.split(", ")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [(d, i, *_judge(m)) for d, i, m in zip(batch["doc_id"], batch["item_id"], batch["m"])]
            out = pd.DataFrame(got, columns=["doc_id", "item_id", "coverage", "windows", "changed"])
            yield out[out["coverage"] >= COVERAGE]

    grouped = matches.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("n", "pos", "ipos", "size", "slots", "islots")).alias("m"))
    return grouped.mapInPandas(judge, "doc_id long, item_id long, coverage double, windows long, changed long")
