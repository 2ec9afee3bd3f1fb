import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm._tokens import byte_encoder, word_encoder
from ledgerloom.llm.packing import pack

ODD = ["", " ", "a\n\n b", "x  y", "é́ a", " ́x", "don't 's 'S it 's", "a b c", "\x1c a \x85 b", "tab\tx y\n", "A<|endoftext|> b", "<|startoftext|><|endoftext|>", "x <|ENDOFTEXT|> <|", "<|endoftext|", "é <|endoftext|>日", "日本 語 x", "­ ­", "a ͅ", "İ I ẞ", "x ¡y ª º", "a ǅ b", "Σ Σ ΑΣ Β", "a" * 3000, "12 3.4 '5"]


@pytest.mark.parametrize("name,encoder", [("word_bpe_49k.json", word_encoder), ("byte_bpe_50k.json", byte_encoder)])
def test_encoders_agree_with_the_library(name, encoder):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    encode = encoder(path)
    latin = "".join(map(chr, range(256)))
    more = ["".join(random.Random(k).choices(latin + " '.  \n" * 20 + "sdtremvlabcXYZ019" * 6, k=300)) for k in range(60)]
    for s in [latin, *more, *ODD, " ".join(ODD), "\n".join(ODD)]:
        assert np.frombuffer(encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_pieces_tile_the_sequences(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, (f"word {i} " * (i * 13 % 400))) for i in range(40)] + [(100, None), (101, ""), (3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(pack(df, path, 256).collect(), key=lambda r: (r.sequence_id, r.offset))
    t = Tokenizer.from_file(path)
    ids = {}
    for d, x in rows:
        ids.setdefault(d, []).append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4"))
    at = 0
    for r in got:
        assert divmod(at, 256) == (r.sequence_id, r.offset)
        at += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert at == sum(len(x) for v in ids.values() for x in v)
    assert pack(df.limit(0), path).count() == 0
