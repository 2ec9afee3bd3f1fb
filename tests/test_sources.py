"""Files that settle, versions of rows, and readers of files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from ledgerloom.sources import settled, tables, versions

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run_sightings(spark, tmp_path, scans, **how):
    """Each scan (list of path, length, modified, seen) is a micro-batch."""
    schema = "path string, length long, modified timestamp, seen_at timestamp"
    for k, scan in enumerate(scans):
        spark.createDataFrame([(p, n, at(m), at(s)) for p, n, m, s in scan], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{k:03}"))
    seen = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = settled.settled(seen, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(300)
    assert out.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r.path, r.length, (r.settled_at - T0).total_seconds()) for r in rows)


def test_a_growing_file_settles_once(spark, tmp_path):
    scans = [
        [("grows", 2000, 0, 1), ("small", 10, 0, 1), ("still", 5000, 0, 1)],
        [("grows", 3000, 2, 3), ("small", 10, 0, 3), ("still", 5000, 0, 3)],
        [("grows", 3000, 2, 4), ("still", 5000, 0, 4)],
        [("grows", 3000, 2, 9), ("still", 5000, 0, 9), ("new", 4000, 8, 9)],
        [("grows", 3000, 30, 31), ("still", 5000, 0, 31), ("small", 2048, 30, 31)],
        [("grows", 3000, 30, 40), ("small", 2048, 30, 40), ("new", 4000, 8, 40)],
    ]
    got = run_sightings(spark, tmp_path, scans)
    assert got == [("grows", 3000, 9.0), ("grows", 3000, 40.0), ("new", 4000, 40.0), ("small", 2048, 40.0), ("still", 5000, 3.0)]


def test_forgotten_files_start_afresh(spark, tmp_path):
    scans = [[("a", 2000, 0, 1)], [("a", 2000, 0, 4)], [("other", 2000, 0, 500)], [("other", 2000, 0, 600)], [("a", 2000, 0, 700)], [("a", 2000, 0, 705)]]
    got = run_sightings(spark, tmp_path, scans, forget=100)
    assert [x for x in got if x[0] == "a"] == [("a", 2000, 4.0), ("a", 2000, 705.0)]


def test_sightings_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.pdf", 10), ("sub/b.png", 2000)):
        (tmp_path / name).write_bytes(b"x" * n)
    got = settled.sightings(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in got) == [("a.pdf", 10), ("b.png", 2000)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc", "field", "value").collect())


def test_versions_repeat_and_fail(spark, tmp_path):
    path, schema = str(tmp_path / "drafts"), "doc string, field string, value string"
    assert versions.get(spark, path, ["doc"]) is None and versions.compact(spark, path, ["doc"]) is None
    first = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")], schema)
    assert versions.put(first, path, 1) and not versions.put(first, path, 1)
    second = spark.createDataFrame([("a", "z", "9")], schema)
    bad = F.udf(lambda v: 1 // 0, "string")
    with pytest.raises(PythonException):
        versions.put(second.union(first).repartition(2).withColumn("value", bad("value")), path, 2)
    want = [("a", "x", "1"), ("a", "y", "2"), ("b", "x", "3")]
    assert versions.whole_versions(spark, path) == [1] and rows_of(versions.get(spark, path, ["doc"])) == want
    assert versions.put(second, path, 2)
    after = [("a", "z", "9"), ("b", "x", "3")]
    assert rows_of(versions.get(spark, path, ["doc"])) == after and rows_of(versions.get(spark, path, ["doc"], upto=1)) == want
    open_reader = versions.get(spark, path, ["doc"])
    assert versions.compact(spark, path, ["doc"]) == 2 and versions.compact(spark, path, ["doc"]) is None
    assert rows_of(open_reader) == rows_of(versions.get(spark, path, ["doc"])) == after
    assert versions.clean(spark, path) == [1, 2] and rows_of(versions.get(spark, path, ["doc"])) == after
    assert not versions.put(first, path, 2) and versions.put(spark.createDataFrame([("c", "x", None), ("b", "x", "5")], schema), path, 3)
    assert rows_of(versions.get(spark, path, ["doc"])) == [("a", "z", "9"), ("b", "x", "5"), ("c", "x", None)]


def test_checkpoints_go_on_where_they_stopped(spark, tmp_path):
    df, bad = spark.createDataFrame([("a", 1)], "doc string, n int"), F.udf(lambda v: 1 // 0, "int")
    with pytest.raises(PythonException):
        versions.write_checkpoints({"read": df, "normalised": df.withColumn("n", bad("n"))}, str(tmp_path), "doc", 1)
    assert versions.write_checkpoints({"read": df, "normalised": df, "final": df}, str(tmp_path), "doc", 1) == ["normalised", "final"]
    with pytest.raises(ValueError):
        versions.write_checkpoints({"read": df.drop("doc")}, str(tmp_path), "doc", 2)


def test_readers_of_a_run(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"results": [{"doc_stem": "a", "status": "failed"}, {"doc_stem": "b", "status": "ok", "pages": 2}, {"doc_stem": "a", "status": "ok", "pages": 3}]}))
    got = {r.doc_stem: (r.status, r.pages) for r in tables.run_summary(spark, str(tmp_path / "run.json")).collect()}
    assert got == {"a": ("ok", 3), "b": ("ok", 2)}
    names = spark.createDataFrame([("d", "x.json"), ("d", "d.json"), ("e", "b.json"), ("e", "a.json")], "document_id string, name string")
    assert {r.document_id: r["name"] for r in tables.chosen_final(names).collect()} == {"d": "d.json", "e": "a.json"}
    page = {"page_id": "p__p0001", "text": "t", "ocr_items": [{"text": "x", "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "zips").mkdir()
    with zipfile.ZipFile(tmp_path / "zips" / "all.zip", "w") as z:
        z.writestr("all.json", json.dumps([page, page | {"page_id": "q"}]))
        z.writestr("p__ocr_raw.json", json.dumps(page))
    with zipfile.ZipFile(tmp_path / "zips" / "each.zip", "w") as z:
        z.writestr("p__ocr_raw.json", "﻿" + json.dumps(page))
        z.writestr("bad__ocr_raw.json", "{")
    (tmp_path / "zips" / "broken.zip").write_bytes(b"PK nothing")
    got = sorted((r.archive.rsplit("/", 1)[1], r.page_id, r.ocr_items[0].bbox) for r in tables.archived_pages(spark, str(tmp_path / "zips")).collect())
    assert got == [("all.zip", "p__p0001", [1, 2, 3, 4]), ("all.zip", "q", [1, 2, 3, 4]), ("each.zip", "p__p0001", [1, 2, 3, 4])]
