"""Files that have stopped changing: a stream of sightings, with the state of each file, gives a file once it is settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Smallest file that counts, seconds and sightings without a change after which it is settled, seconds a file is remembered unseen.
LEAST_BYTES, SETTLE_SECONDS, LEAST_SIGHTINGS, FORGET_SECONDS = 1024, 2.0, 2, 86_400
_OUT = "path string, length long, modified timestamp, settled_at timestamp"
_STATE = "length long, modified timestamp, first_seen timestamp, sightings int, given boolean"


def sightings(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified, seen_at of all files below ``root`` as they are now; folders and hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.filter(~F.col("path").rlike(r"/\.[^/]*$")).withColumn("seen_at", F.current_timestamp())


def settled(seen: DataFrame, settle: float = SETTLE_SECONDS, least_sightings: int = LEAST_SIGHTINGS, least_bytes: int = LEAST_BYTES, forget: int = FORGET_SECONDS) -> DataFrame:
    """path, length, modified, settled_at of files, each once it was seen ``least_sightings`` times or more over ``settle``
    seconds or more with the same length and time, and again whenever it has changed and settled anew.

    ``seen`` is a stream (path, length, modified, seen_at). Sightings of a file meet by its path; its state is one row,
    and goes when the file has not been seen for ``forget`` seconds of the stream's own time, so state is bounded by the
    files that are there. Files smaller than ``least_bytes`` don't count until they have grown.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.getOption
        out = []
        rows = pd.concat(list(batches)).sort_values("seen_at")
        for length, modified, seen_at in zip(rows["length"], rows["modified"], rows["seen_at"]):
            if held is None or (int(held[0]), pd.Timestamp(held[1])) != (int(length), modified):
                held = (int(length), modified, seen_at, 1, False)
            else:
                held = (*held[:3], held[3] + 1, held[4])
            if not held[4] and length >= least_bytes and held[3] >= least_sightings and (seen_at - pd.Timestamp(held[2])).total_seconds() >= settle:
                out.append((key[0], int(length), modified, seen_at))
                held = (*held[:4], True)
        state.update(held)
        state.setTimeoutTimestamp(max(int(rows["seen_at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + forget * 1000 + 1)
        yield pd.DataFrame(out, columns=["path", "length", "modified", "settled_at"])

    timed = seen.withWatermark("seen_at", "0 seconds")
    return timed.groupBy("path").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
