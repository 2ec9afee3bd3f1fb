"""Readers and writers of the library's tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def final_json(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Final documents below <root>/<document>/data/final_json, with the document's name from its path."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    return df.withColumn("document_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)\.json$", 1))


def recognised_pages(spark: SparkSession, root: str) -> DataFrame:
    """Archived recognition results: page_id, text, ocr_items."""
    schema = "page_id string, text string, ocr_items array<struct<text string, bbox array<int>>>"
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(root)


def incoming(spark: SparkSession, root: str, least_bytes: int = 1024) -> DataFrame:
    """A stream of new input files large enough to be whole; content stays unread until it is used."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).load(root)
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(F.col("length") >= least_bytes).filter(known.isin("pdf", "png", "jpg", "jpeg")).select("path", "modificationTime", "length", known.alias("file_type"))


def write_final(df: DataFrame, path: str) -> None:
    """Final documents as JSON, one folder a document type."""
    df.write.mode("overwrite").partitionBy("doc_type").json(path)


#: Kinds of incoming files by suffix.
KINDS = {"image": ("png", "jpg", "jpeg", "tif", "tiff", "bmp"), "pdf": ("pdf",), "document": ("doc", "docx", "xls", "xlsx"), "text": ("txt", "csv", "json", "xml")}
#: Suffixes whose content may be shown as text, the largest such file, and the characters shown.
SHOWN, SHOWN_BYTES, SHOWN_CHARS = ("json", "txt", "log", "csv", "md", "html", "xml"), 2_000_000, 100_000
_PAGE = "page_id string, text string, ocr_items array<struct<text string, bbox array<int>>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_kind(path: Column) -> Column:
    out = F.lit("unknown")
    for kind, known in KINDS.items():
        out = F.when(suffix(path).isin(*known), kind).otherwise(out)
    return out


def artefacts(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), stage (its first part), kind, length and time of all files; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return files.select(below.alias("path"), F.element_at(F.split(below, "/"), 1).alias("stage"), file_kind(below).alias("kind"), "length", F.col("modificationTime").alias("modified"))


def artefact_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text, truncated of text files that aren't too large: the start of each, as the feature shows it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    shown = files.filter(F.col("length") <= SHOWN_BYTES).filter(suffix(F.col("path")).isin(*SHOWN))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return shown.select("path", F.substring(text, 1, SHOWN_CHARS).alias("text"), (F.length(text) > SHOWN_CHARS).alias("truncated"))


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results inside ZIP archives: an archive's whole list if it holds one, else its page files.

    Archives and files inside them that can't be read give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = sorted(n for n in archive.namelist() if n.endswith(".json"))
                pages = [n for n in names if n.endswith("__ocr_raw.json")]
                for n in [n for n in names if n not in pages][:1] or pages:
                    try:
                        rows = json.loads(archive.read(n).decode("utf-8-sig"))
                    except (zipfile.BadZipFile, ValueError, RecursionError, zlib.error):
                        continue
                    yield pd.DataFrame({"archive": name, "page": [json.dumps(r, ensure_ascii=False) for r in (rows if isinstance(rows, list) else [rows])]})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, page string").select("archive", F.from_json("page", _PAGE).alias("p")).select("archive", "p.*")


def chosen_final(files: DataFrame) -> DataFrame:
    """One final file a document (document_id, name): the one named like it, else the first by name."""
    own = (F.col("name") == F.concat(F.col("document_id"), F.lit(".json"))).cast("int")
    return files.groupBy("document_id").agg(F.min_by("name", F.struct(-own, F.col("name"))).alias("name"))


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_stem, status, error, pages of a run's summary; a later entry of the same document wins."""
    schema = "results array<struct<doc_stem string, status string, error string, pages int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("results").alias("pos", "r"))
    return rows.groupBy("r.doc_stem").agg(F.max_by("r", "pos").alias("r")).select("r.*")
