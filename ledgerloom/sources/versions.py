"""A table of versions of rows: a batch replaces the rows of its keys as a whole, can be repeated, and shows at once or not at all.

Each batch is a folder ``version=<n>`` of the table. A folder counts once Spark's committer has marked it as whole, so a
batch that failed in the middle is never seen, and one that is repeated is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = "_SUCCESS"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _whole(spark: SparkSession, path: str, kind: str) -> list[int]:
    fs, to = _files(spark, path)
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in fs.globStatus(to(f"{path}/{kind}=*/{_MARK}")) or ())


def whole_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole, in order."""
    return _whole(spark, path, "version")


def put(batch: DataFrame, path: str, version: int) -> bool:
    """Writes a batch of rows as a version; False, and nothing happens, if that version is whole already or
    part of a base.

    What an earlier try left of it goes first. Rows stay where Spark has them; nothing is gathered.
    """
    bases = _whole(batch.sparkSession, path, "base")
    if version in whole_versions(batch.sparkSession, path) or bases and version <= bases[-1]:
        return False
    batch.drop("version").write.mode("overwrite").parquet(f"{path}/version={version}")
    return True


def get(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """The newest rows of each key over all whole versions (up to ``upto``), with their ``version``: those of the last version
    that has the key, all of them, for a batch replaces whatever rows its keys had. None if no version is whole."""
    fits = lambda v: upto is None or v <= upto
    base = max(filter(fits, _whole(spark, path, "base")), default=None)
    versions = [v for v in whole_versions(spark, path) if fits(v) and (base is None or v > base)]
    parts = [spark.read.option("basePath", path).option("mergeSchema", True).parquet(*(f"{path}/version={v}" for v in versions))] if versions else []
    parts += [spark.read.parquet(f"{path}/base={base}").withColumn("version", F.lit(base))] if base is not None else []
    if not parts:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    newest = rows.groupBy(*keys).agg(F.max("version").alias("version"))
    return rows.join(newest, [*keys, "version"], "left_semi")


def compact(spark: SparkSession, path: str, keys: list[str]) -> int | None:
    """Writes what all whole versions come to as a base, and gives its number; None if there is nothing new to put together.

    A base counts once it is whole, and then stands for all versions up to its number, so readers see the same rows before,
    meanwhile and after. Nothing is removed here.
    """
    versions, bases = whole_versions(spark, path), _whole(spark, path, "base")
    if not versions or bases and bases[-1] >= versions[-1]:
        return None
    get(spark, path, keys).drop("version").write.mode("overwrite").parquet(f"{path}/base={versions[-1]}")
    return versions[-1]


def clean(spark: SparkSession, path: str) -> list[int]:
    """Removes what the newest base stands for: older bases, and versions up to its number (which it gives). For a time when
    no reader is at work that began before the base was there."""
    bases = _whole(spark, path, "base")
    gone = [v for v in whole_versions(spark, path) if bases and v <= bases[-1]]
    fs, to = _files(spark, path)
    for folder in [*(f"version={v}" for v in gone), *(f"base={v}" for v in bases[:-1])]:
        fs.delete(to(f"{path}/{folder}"), True)
    return gone


def write_checkpoints(stages: dict[str, DataFrame], path: str, key: str, version: int) -> list[str]:
    """The states of documents after each named stage of a run (as read, normalised, recovered, final) as versions of a table
    each, below ``path``; names of the stages that this call wrote. A repeated call goes on where an earlier one stopped."""
    for name, df in stages.items():
        if key not in df.columns:
            raise ValueError(f"stage {name} has no column {key}")
    return [name for name, df in stages.items() if put(df, f"{path}/{name}", version)]
