import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import _tokens
from ledgerloom.llm._codec import decode_frame, encode_frame
from ledgerloom.llm.token_files import read_tokens, with_checksums, write_tokens


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (5000, 3), (9000, 50257), (4097, 200_000), (3000, 2**32)])
def test_frames_come_back(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) if n % 2 else np.minimum(rng.zipf(1.3, n), top - 1)).astype("<u4")
    for block in (7, 256, 2048):
        frame = encode_frame(ids, block)
        assert (decode_frame(frame) == ids).all()


def test_repeats_shrink_and_damage_shows():
    ids = np.tile(np.random.default_rng(1).integers(0, 50000, 97), 100).astype("<u4")
    frame = encode_frame(ids)
    assert len(frame) < len(ids) * 2 / 8
    for at in (0, 20, len(frame) // 2):
        bad = bytearray(frame)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            decode_frame(bytes(bad))
    with pytest.raises(ValueError):
        decode_frame(frame[:-3])


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Δx", "\n\n", "3,14"]) for _ in range(rng.randrange(80)))) for i in rng.sample(range(1000), 90)]
    rows += [(2000, None), (2001, ""), (2002, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk").repartition(5)
    write_tokens(df, str(tmp_path / "t"), path, frame_ids=900)
    got = sorted(with_checksums(read_tokens(spark, str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(path), 0
    for (d, x), r in zip(sorted(rows), got, strict=True):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    write_tokens(spark.createDataFrame([(None, "b"), (None, "a"), (1, "c"), (1, "c")], "doc_id long, text string"), str(tmp_path / "n"), path)
    assert sorted(((r.doc_id, r.start) for r in read_tokens(spark, str(tmp_path / "n")).collect()), key=lambda x: x[1]) == [(None, 0), (None, 2), (1, 4), (1, 6)]
    write_tokens(df.limit(0), str(tmp_path / "e"), path)
    assert read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_a_table_gives_the_ids_of_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, latin = Tokenizer.from_file(path), "".join(map(chr, range(256)))
    texts = ["".join(random.Random(k).choices(latin + " '.  \n" * 20 + "sdtremvlabcXYZ019" * 6, k=k)) for k in range(0, 1500, 7)]
    texts += [latin, "", " ", "  ", " \n", "\0", "a\0", "a", "'", "'r", "'s't're've'm'll'd 's ''s's a'sb'x", "\n'd 'd 1'dd'", "a" * 3000, "word " * 900, "日本 語 x", "A<|endoftext|> b", "é <|"]
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    for chars, pieces in ((1 << 20, 1_000_000), (100, 50), (1, 0)):  # long texts are cut, a full table starts anew
        monkeypatch.setattr(_tokens, "TABLE_CHARS", chars)
        monkeypatch.setattr(_tokens, "TABLE_PIECES", pieces)
        table = _tokens.ByteTable(path, 2)
        for _ in range(2):
            ids, n = table.encode(texts)
            got = np.split(ids, np.cumsum(n)[:-1])
            assert [x.tolist() for x in got] == want
    ids, n = table.encode([])
    assert len(ids) == len(n) == 0


def test_a_table_asks_once_for_each_piece(monkeypatch):
    table, asked = _tokens.ByteTable(public_tokenizers.path("byte_bpe_50k.json"), 2), []
    ask = table._ask
    monkeypatch.setattr(table, "_ask", lambda pieces: asked.extend(pieces) or ask(pieces))
    for _ in range(3):
        table.encode(["one two three, three", " a piece-longer_than_fifteen0000 abcdefghijklmnopqrstuvwxyz abcdefghijklmnopqrstuvwxyz two"])
    assert len(asked) == len(set(asked)) and b" two" in asked and b" abcdefghijklmnopqrstuvwxyz" in asked
