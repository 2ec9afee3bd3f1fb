"""Meeting the members of hash buckets in blocks of bounded size, without a row for every pair.

Tables here grow with the input and are written compressed, so their files say little of their size in memory: joins are
merge joins, which pass nothing through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import components, saved

#: Members of a bucket that meet in one call at most: two blocks.
BLOCK = 128
#: Weight (n-grams, or numbers) of a block at most, but for a single member that weighs more.
BLOCK_WEIGHT = 2_000_000


def bucket_blocks(keys: DataFrame, block: int = BLOCK, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From (id long, tree int, key, probe int, weight long): rows (grp, id, tree, probe, own, other), and the buckets taken.

    All rows of one ``grp`` meet in one call: two blocks of a bucket, or one block with itself (own = other).
    Buckets of one member vanish; of buckets with the same members the one of the lowest tree (in it, the one with
    the fewest probing members) stays, and none if ``before`` holds the bucket taken for these members earlier. A
    large bucket is cut into blocks of some ``block`` members, or fewer where they weigh more than BLOCK_WEIGHT, so
    that no call ever holds more than two blocks, however many members it has.
    """
    rows = keys.select("id", "tree", "probe", "weight", F.xxhash64("tree", "key").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"), F.min("tree").alias("t"), F.sum("probe").alias("probes"), F.sum("weight").alias("weight")).filter("n > 1")
    full = full.groupBy("n", "who").agg(F.min(F.struct("t", "probes", "bucket", "weight")).alias("b"))
    if before is not None:
        full = full.join(before, ["n", "who"], "left_anti")
    taken = saved(full.select("n", "who", F.col("b.bucket").alias("bucket"), F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("b.weight") / BLOCK_WEIGHT)).alias("blocks")))
    rows = rows.drop("weight").join(taken.select("bucket", "blocks").hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    calls = rows.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "id", "tree", "probe", F.col("own").cast("int"), F.col("other").cast("int"))
    return calls, taken.select("n", "who")


def pair_mask(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which pairs (i < j) of a call are its own: members of one block with each other, or of two blocks across."""
    n = len(own)
    mask = np.triu(np.ones((n, n), bool), 1)
    if (own != other).any():
        mask &= own[:, None] != own[None, :]
    return mask


def stars(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n members the smallest id of those that the links (i, j) join to it."""
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def settle(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_links, group_id) of every class (id, class_id, copies), from the links (id, links, root) found.

    n_links counts all other rows linked with a row of the class, its copies included; group_id is the smallest
    class_id that links lead to.
    """
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    groups = roots.join(classes.select("id", "class_id").hint("merge"), "id").groupBy("root").agg(F.min("class_id").alias("group_id"))
    groups = roots.join(groups.hint("merge"), "root").select("id", "group_id")
    out = classes.select("id", "class_id", "copies").join(links.hint("merge"), "id", "left").join(groups.hint("merge"), "id", "left")
    return saved(out.selectExpr("id", "copies - 1 + coalesce(links, 0) as n_links", "coalesce(group_id, class_id) as group_id"))
