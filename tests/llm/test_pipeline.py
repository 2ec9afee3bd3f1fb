"""The stages of the pipeline against brute force, and the whole of it on a small table."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_near_duplicates_by_row(spark):
    a, b, c = words(1, 100), words(2, 100), words(3, 100)
    near = [*a[:50], "other", *a[51:]]
    rows = [(5, a), (3, near), (7, b), (7, c), (None, b), (None, words(4, 30)), (9, c), (9, c)]
    rows = [(i, " ".join(t)) for i, t in rows] + [(11, None), (11, None), (12, ""), (None, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).repartition(3), SF).collect()
    want = [(3, " ".join(near)), (7, " ".join(b)), (7, " ".join(c)), (None, " ".join(words(4, 30))), (11, None), (11, None), (12, ""), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))
    assert corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows).limit(0), SF).count() == 0


def test_contaminated_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    dirty, clean = f"{' '.join(words(1, 20))} {item} end", " ".join(words(2, 40))
    rows = [(1, dirty), (1, clean), (None, dirty), (None, clean), (2, None), (3, "")]
    got = corpus_pipeline.drop_contaminated(spark, frame(spark, rows), SF).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, [(1, clean), (None, clean), (2, None), (3, "")]))


def test_toxic_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    known = [d for (d,) in docs.select("doc_id").collect() if d in labels]
    assert np.mean([(d not in kept) == labels[d] for d in known]) > 0.97
    odd = frame(spark, [(None, None), (1, ""), (1, "")])
    assert corpus_pipeline.drop_toxic(spark, odd, SF).count() == 3


def test_redact(spark):
    got = corpus_pipeline.redact(spark, frame(spark, [(1, "write to a@b.org now"), (1, None), (None, "")]), SF).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in got] == [(1, "write to <email> now", 20), (1, None, None), (None, "", 0)]


def test_run_gives_every_kept_document_whole(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        (df.filter("doc_id < 300") if t != "benchmark" else df).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    kept = docs.collect()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in kept}
    assert {r.doc_id for r in got} == set(want) and len(kept) == len(want)
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    assert all(zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
