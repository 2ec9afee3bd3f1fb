"""Encoders for the public tokenizers that remember the pieces they have met.

Both return, as little-endian unsigned 32-bit bytes, exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``. Texts of Latin-1 characters are cut by the tokenizer's own pre-tokenisation rule,
written out for that alphabet, and pieces go straight to the library's model. Other texts are cut at blanks
where that rule cuts whatever stands around, and pieces go through the whole library. Most pieces are common
words, which a memo answers; a Python worker keeps its memo from task to task. Texts that may hold one of the
vocabulary's added tokens go to the library as they are.

``ByteTable`` does the same for many byte-level texts at a time: pieces are found by comparing the classes of
neighbouring characters, and a table of numpy arrays, asked for all pieces at once, takes the memo's place.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Pieces a memo holds in each of its two generations, about 200 bytes each: what was asked for lately stays.
MEMO_PIECES = 150_000
#: A blank between two visible ASCII or Latin letters, digits or marks starts a piece of its own.
_BLANK = re.compile(r"(?<=[!-~¡-ÿĀ-ɏ])(?= [!-~¡-ÿĀ-ɏ])")
_SPACES = re.compile(r"[ \t-\r]+")
# the characters of Latin-1 by class: letters, digits, white space
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_PIECES = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_PIECES = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _byte_letters() -> dict[int, str]:
    """The rule by which byte-level vocabularies write a byte as a letter: visible ones as they are."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Memo(dict):
    """piece -> ids; ``whole``: pieces may hold several pre-tokens and characters of any kind."""

    def __init__(self, tokenizer: Tokenizer, whole: bool):
        self.tokenizer, self.model, self.whole = tokenizer, tokenizer.model, whole
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_PIECES:
            self.older = dict(self)
            self.clear()
        if (found := self.older.get(piece)) is not None:
            self[piece] = found
            return found
        if self.whole:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        else:
            plain = piece.isascii() and piece.isprintable()  # then only the blank is written otherwise
            ids = [t.id for t in self.model.tokenize(piece.replace(" ", _LETTERS[32]) if plain else piece.encode().decode("latin-1").translate(_LETTERS))]
        found = self[piece] = array("I", ids).tobytes()
        return found


_MEMOS: dict[str, tuple[_Memo, _Memo, list[str]]] = {}


def _encoder(path: str, latin: Callable[[str], list[str]], other: Callable[[str], list[str]]) -> Callable[[str], bytes]:
    if path not in _MEMOS:
        tokenizer = Tokenizer.from_file(path)
        # how texts with an added token (such as an end mark) may look: its first two characters
        heads = sorted({t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()} - {""})
        _MEMOS[path] = _Memo(tokenizer, False), _Memo(tokenizer, True), heads
    *memos, heads = _MEMOS[path]
    piece, whole = (memo.__getitem__ for memo in memos)

    def run(text: str) -> bytes:
        if any(head in text for head in heads):
            return array("I", memos[1].tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(whole, other(text)))
        return b"".join(map(piece, latin(text)))

    return run


def word_encoder(path: str) -> Callable[[str], bytes]:
    """For lower-case vocabularies of words whose pre-tokenisation drops white space."""
    return _encoder(path, lambda text: _WORD_PIECES.findall(text.lower()), lambda text: [w for w in _SPACES.split(text) if w])


def byte_encoder(path: str) -> Callable[[str], bytes]:
    """For byte-level vocabularies where a word takes the blank before it along."""
    return _encoder(path, _BYTE_PIECES.findall, _BLANK.split)


#: Pieces and ids a table holds before it starts anew, and the characters it looks at in one go.
TABLE_PIECES, TABLE_IDS, TABLE_CHARS = 1_200_000, 16_000_000, 1 << 20
_TABLE_BITS, _SHORT = 21, 15
_LETTER, _DIGIT, _OTHER, _WHITE, _EDGE = range(5)
_CLASSES = np.array([next(k for k, rule in enumerate((_L, _N, f"^{_S}{_L}{_N}", _S)) if re.match(f"[{rule}]", chr(b))) for b in range(256)], np.uint8)
#: Bytes as letters of the vocabulary; 255 stands in no text in UTF-8 and parts pieces.
_LETTER_CODES = np.array([ord(_LETTERS[b]) for b in range(255)] + [32], "<u2")
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _piece_starts(text: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of Latin-1 texts start that lie one after another, each with one byte behind it (``edges``),
    which is a piece of its own. This is the rule of ``_BYTE_PIECES``."""
    kind = _CLASSES[text]
    kind[edges] = _EDGE
    white, blank = kind == _WHITE, (text == 32)
    seen = kind < _WHITE
    start = np.ones(len(text), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[1:] &= white[1:] | ~blank[:-1]  # a blank goes with what is seen behind it
    start[:-1] |= white[:-1] & seen[1:]  # the last of several white characters before it stands alone
    start[edges] = True
    quotes = np.flatnonzero(start & (text == 39))
    if len(quotes):
        padded = np.append(text, np.zeros(2, np.uint8))
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for found, size in ((quotes[one], 2), (quotes[two], 3)):
            for k in range(1, size):
                start[found + k] = False
            start[found + size] = True
    return np.flatnonzero(start)


class ByteTable:
    """Texts -> ids, each text's followed by ``end_id``, for byte-level vocabularies.

    Pieces of up to 15 Latin-1 characters are two numbers, their bytes and their length, so they are compared whole;
    longer ones stand in a dict. What the table doesn't hold goes to the library's model in one call a stretch.
    """

    def __init__(self, path: str, end_id: int):
        self.one, self.end_id = byte_encoder(path), end_id
        self.heads = _MEMOS[path][2]
        self.model = Tokenizer(_MEMOS[path][0].model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._clear()

    def _clear(self) -> None:
        slots = (1 << _TABLE_BITS) + 2  # the last two: an end, and the edge of a stretch that ends no text
        self.first, self.second = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.place, self.size = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool[0], self.filled, self.held, self.long = self.end_id, 1, 0, {}
        self.size[-2] = 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (unsigned 32-bit), and how many of them are each text's."""
        lengths, out = np.zeros(len(texts), np.int64), []
        stretch: list[tuple[int, bytes, bool]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if stretch:
                ids, n = self._stretch([s for _, s, _ in stretch], np.array([last for *_, last in stretch]))
                np.add.at(lengths, [k for k, *_ in stretch], n)
                out.append(ids)
                stretch.clear()
                held = 0

        for k, text in enumerate(texts):
            plain = None
            if not any(head in text for head in self.heads):
                try:
                    plain = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            cuts = [0]
            while plain is not None and len(plain) - cuts[-1] > 2 * TABLE_CHARS:
                if not (blank := _BLANK.search(text, cuts[-1] + TABLE_CHARS)):
                    break
                cuts.append(blank.start())
            ends = [*cuts[1:], len(text)]
            if plain is None or max(b - a for a, b in zip(cuts, ends)) > 2 * TABLE_CHARS:  # characters of any kind, or no place to cut
                flush()
                ids = np.frombuffer(self.one(text), np.uint32)
                out += [ids, np.array([self.end_id], np.uint32)]
                lengths[k] = len(ids) + 1
                continue
            for a, b in zip(cuts, ends):
                if held + b - a > 2 * TABLE_CHARS:
                    flush()
                stretch.append((k, plain[a:b], b == len(plain)))
                held += b - a
                if held >= TABLE_CHARS:
                    flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), lengths

    def _stretch(self, parts: list[bytes], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.held > TABLE_PIECES or self.filled > TABLE_IDS:
            self._clear()
        raw = b"\0".join([*parts, bytes(16)])  # the last bytes are there to be read beyond the end
        edges = np.cumsum([len(p) + 1 for p in parts]) - 1
        text = np.frombuffer(raw, np.uint8, edges[-1] + 1)
        start = _piece_starts(text, edges)
        size = np.diff(start, append=len(text))
        words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
        first = words[start] & _MASKS.take(size, mode="clip")
        second = words[start + 8] & _MASKS.take(np.clip(size - 8, 0, 7)) | size.astype(np.uint64) << np.uint64(56)
        slot = self._find(first, second)
        long = np.flatnonzero(size > _SHORT)
        at_edge = np.searchsorted(start, edges)
        slot[long] = slot[at_edge] = len(self.size) - 1
        slot[at_edge[last]] -= 1
        new = np.flatnonzero(slot < 0)
        cut = lambda k: raw[start[k] : start[k] + size[k]]
        unknown = {raw[a:b]: k for k, a, b in zip(new.tolist(), start[new].tolist(), (start[new] + size[new]).tolist())}
        far = [cut(k) for k in long.tolist()]
        place, n = self._ask([*unknown, *(more := [p for p in dict.fromkeys(far) if p not in self.long])])
        self.long |= zip(more, zip(place[len(unknown) :].tolist(), n[len(unknown) :].tolist()))
        own = np.fromiter(unknown.values(), np.int64, len(unknown))
        self._put(first[own], second[own], place[: len(unknown)], n[: len(unknown)])
        self.held += len(unknown) + sum(len(p) // _SHORT for p in more)
        slot[new] = self._find(first[new], second[new])
        place, n = self.place[slot], self.size[slot]
        if far:
            place[long], n[long] = np.array([self.long[p] for p in far], np.int32).T
        ends = np.cumsum(n)
        ids = self.pool.take(np.repeat((place - (ends - n)).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32))
        return ids, np.diff(ends[at_edge], prepend=0)

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 where the table doesn't hold it."""
        slot = self._slot(first, second)
        there = self.second[slot]
        open_ = np.flatnonzero((there != second) | (self.first[slot] != first))
        while len(open_):
            empty = self.second[slot[open_]] == 0
            slot[open_[empty]] = -1
            open_ = open_[~empty]
            slot[open_] = slot[open_] + 1 & (1 << _TABLE_BITS) - 1
            at = slot[open_]
            open_ = open_[(self.second[at] != second[open_]) | (self.first[at] != first[open_])]
        return slot

    def _put(self, first: np.ndarray, second: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Add pieces, all different and none of them there."""
        slot, left = self._slot(first, second), np.arange(len(first))
        while len(left):
            free = left[self.second[slot[left]] == 0]
            at = slot[free]
            self.place[at] = free  # of several for one slot, one stays
            won = free[self.place[at] == free]
            at = slot[won]
            self.first[at], self.second[at], self.place[at], self.size[at] = first[won], second[won], place[won], size[won]
            waits = np.ones(len(first), bool)
            waits[won] = False
            left = left[waits[left]]
            taken = left[self.second[slot[left]] != 0]
            slot[taken] = slot[taken] + 1 & (1 << _TABLE_BITS) - 1

    def _ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of pieces into the pool: their first place and number."""
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        joined = np.frombuffer(b"\xff".join([p if p.isascii() else p.decode("latin-1").encode() for p in pieces]), np.uint8)
        found = self.model.encode(_LETTER_CODES[joined].tobytes().decode("utf-16-le"), add_special_tokens=False)
        ids, size = np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(pieces)).astype(np.int32)
        if self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + len(ids), np.uint32)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        place = self.filled + np.cumsum(size, dtype=np.int32) - size
        self.filled += len(ids)
        return place, size
