"""Applying a feed of inserts, updates and deletes to a table (problem 1).

The state is a signed multiset of images (key, value, seq). Every change, deliveries of it counted once,
adds its after-image (+1) and takes away its before-image (-1), the image of the version before it; the
rows of the base table are images of +1. The sum of all of them has one positive image per key: the
newest. A delete's image has a null value, so that it takes the place of older ones and is itself
dropped at the end, or kept as a tombstone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.skew import hot_split
from tidelog.schema import changes


def consolidate(images: DataFrame, by: list[str]) -> DataFrame:
    """Sums the signed images of (k, v, seq) within each group of `by`; keeps the positive ones.

    The before-image of an image is the one before it in the group. `by` is the partitioning of the
    input, so that neither the window nor the sum shuffles.
    """
    before = F.lag(F.struct("v", "seq")).over(Window.partitionBy(*by).orderBy("seq", "v"))
    signed = images.withColumn("_before", before).select(
        *by,
        F.inline(
            F.array_compact(
                F.array(
                    F.struct(F.col("v"), F.col("seq"), F.lit(1).alias("m")),
                    F.when(F.col("_before").isNotNull(), F.struct(F.col("_before.v").alias("v"), F.col("_before.seq").alias("seq"), F.lit(-1).alias("m"))),
                )
            )
        ),
    )
    total = signed.groupBy(*by, "v", "seq").agg(F.sum("m").alias("m"))
    return total.where("m > 0").drop("m")


def apply_changes(kv_state: DataFrame, kv_log: DataFrame, tombstones: bool = False, total: int | None = None) -> DataFrame:
    """(k, v, seq): `kv_state` after all valid changes of `kv_log`, each key at its highest seq.

    Order and number of deliveries do not matter. A base row newer than a change of its key stands; a
    base row and a change of the same seq are the same version. Keys are compared byte by byte. Base
    rows with a null or empty key, or a null seq where the key has changes, give way to changes (a null
    seq sorts first). Extra columns of either table are ignored. Two empty tables give an empty one.

    One shuffle takes all changes to ranges of seq of their key (several for a hot key); the sums of the
    ranges, one image each, are then summed by key.
    """
    log = changes(kv_log).select("k", "v", "seq")
    base = kv_state.where(F.length("k") > 0).select("k", "v", "seq")
    images = base.unionByName(log)
    split, hot = hot_split(images, "k", "seq", total)
    split = split.repartition(F.col("k"), F.col("_part"))
    # one image per version; a base row of the same version as a change differs from it in nothing
    once = split.groupBy("k", "_part", "seq", "v").agg(F.lit(1).alias("_one")).drop("_one")
    state = consolidate(once, ["k", "_part"])
    if hot:
        state = consolidate(state.drop("_part").repartition(F.col("k")), ["k"])
    state = state.select("k", "v", "seq")
    return state if tombstones else state.where(F.col("v").isNotNull())
