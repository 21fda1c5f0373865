"""Sampling: by hash order, and by reservoir over the rows in the order of a unique key."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.config import DEFAULTS, Settings
from ragloom.sources.staging import staged


def _free(frame: DataFrame, out: str) -> None:
    if out in frame.columns:
        raise ValueError(f"column {out!r} exists; name another by out")


def hash_sample(frame: DataFrame, key: str, n: int, seed: int = 42, out: str = "h") -> DataFrame:
    """The n rows whose md5(seed:key) is smallest, with it: a top-n, independent of partitioning. frame has no column `out`."""
    _free(frame, out)
    return frame.withColumn(out, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy(out, key).limit(n)


def ordinals(frame: DataFrame, order: str, passes: Column | None = None) -> DataFrame:
    """(order, scanned, seen): each row's number among all rows and among those that pass, from 1; null if it does not.

    Only keys are sorted and written; rows are numbered within partitions and shifted by the partitions' counts.
    """
    mark = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
    keys = frame.select(order, mark.alias("__p")).repartitionByRange(F.col(order)).sortWithinPartitions(order)
    dealt = staged(keys.withColumn("__at", F.monotonically_increasing_id()), "ordinals").withColumn("__part", F.shiftright("__at", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"), F.count_if("__p").alias("m"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in "nm"])
    within = Window.partitionBy("__part").orderBy("__at")
    own = dealt.withColumn("__m1", F.count_if("__p").over(within)).withColumn("__n1", F.row_number().over(within))
    return own.join(F.broadcast(starts), "__part").select(order, (F.col("__n") + F.col("__n1")).alias("scanned"), F.when(F.col("__p"), F.col("__m") + F.col("__m1")).alias("seen"))


def scanned(frame: DataFrame, order: str, passes: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """(order, seen) of the rows that a sequential scan takes: it stops after max_scan rows, or once 100 samples' worth have passed."""
    return ordinals(frame, order, passes).where((F.col("scanned") <= settings.max_scan) & (F.col("seen") <= settings.sample_size * 100)).select(order, "seen")


def reservoir_draws(total: int, n: int, seed: int = 42) -> dict[int, int]:
    """number -> slot of the survivors of a sequentially seeded draw over `total` rows: one draw a row, on the driver."""
    rng, slots = random.Random(seed), list(range(1, min(n, total) + 1))
    for seen in range(n + 1, total + 1):
        j = rng.randint(1, seen)
        if j <= n:
            slots[j - 1] = seen
    return {number: slot for slot, number in enumerate(slots)}


def hash_slot(seen: Column, n: int, seed: int = 42) -> Column:
    """The slot a row takes, or null: a number from 1 to seen drawn by md5, as the reservoir draws it."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), seen.cast("string"))), 1, 15), 16, 10).cast("long") % seen
    return F.when(seen <= n, seen - 1).when(draw < n, draw).cast("int")


def reservoir_sample(frame: DataFrame, order: str, n: int, seed: int = 42, numbers: DataFrame | None = None, sequential: bool = False, out: str = "slot") -> DataFrame:
    """The reservoir's rows and their slots; ValueError if there are fewer than n.

    A slot keeps the last row that drew it. Draws are hashes of the rows' numbers, so all is distributed. With sequential
    draws, which reproduce a seeded generator, the driver draws one number a row and only the n survivors leave it: a
    loop over all rows, for small inputs. numbers: (order, seen), if not all rows take part. frame has no column `out`.
    """
    _free(frame, out)
    own = numbers if numbers is not None else ordinals(frame, order).select(order, "seen")
    total = own.count()
    if total < n:
        raise ValueError(f"{total} rows, {n} wanted")
    if sequential:
        chosen = frame.sparkSession.createDataFrame(list(reservoir_draws(total, n, seed).items()), "seen long, slot int")
        kept = own.join(F.broadcast(chosen), "seen").select(order, "slot")
    else:
        drawn = own.withColumn("slot", hash_slot(F.col("seen"), n, seed)).where("slot is not null")
        kept = drawn.groupBy("slot").agg(F.max_by(order, "seen").alias(order))
    return frame.join(F.broadcast(kept.withColumnRenamed("slot", out)), order)  # n rows
