"""Sharding by a Feistel permutation over global row numbers (native: DataFrame functions only).

Rows get gapless numbers 0..n-1 in the order of (key, CRC-32, size): a range partitioning of the digests
(never of the texts) gives each partition its rows, the partition sizes (one row per partition) give the offsets.
A four-round Feistel network on Z_m x Z_m, m = ceil(sqrt(n)), permutes the numbers; values beyond n-1 walk on along
their cycle. Shard and slot are then arithmetic: p mod shards, p div shards. The same input and seed give the same
shuffle, and (n, seed, row number) suffice to compute any row's place.

Null texts count as empty, null keys come first, repeated rows each get a slot of their own, an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm import work

ROUNDS = 4
WALK = 64  # the domain exceeds n by 2*sqrt(n)+1 at most: for n < 900 no cycle leaves n for longer, above 64 misses in a row have odds below 1e-50


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with gapless row numbers `row_number` from 0 in the order of the given columns, and the row count.

    The final key is the row's place in the scan, which spreads equal rows over partitions.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in order] + [F.col("__scan")]
    dealt = df.withColumn("__scan", F.monotonically_increasing_id()).repartitionByRange(work.partitions(spark), *keys)
    placed = work.table(dealt.sortWithinPartitions(*keys).drop("__scan").withColumn("__at", F.monotonically_increasing_id()), "rows")
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumn("__part", F.shiftright("__at", 33)).join(F.broadcast(starts), "__part")
    numbers = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("row_number", numbers).drop("__at", "__part", "__start"), placed.count()


def feistel(x: Column, m: int, seed: int) -> Column:
    """One application of the keyed network to x in [0, m*m)."""
    left, right = F.floor(x / F.lit(m)).cast("long"), F.pmod(x, F.lit(m))
    left = F.expr("0") + left
    for i in range(ROUNDS):
        left, right = right, F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), right.cast("long")), F.lit(m)), F.lit(m))
    return left.cast("long") * F.lit(m) + right.cast("long")


def permuted(x: Column, n: int, seed: int) -> Column:
    """x in [0, n) sent to its place in [0, n)."""
    m = max(1, math.isqrt(max(n - 1, 0)) + 1)
    first = feistel(x, m, seed)
    steps = F.sequence(F.lit(1), F.lit(WALK))
    walk = lambda y: F.aggregate(steps, y, lambda acc, _: F.when(acc < F.lit(n), acc).otherwise(feistel(acc, m, seed)))
    return F.transform(F.array(first), lambda y: F.when(y < F.lit(n), y).otherwise(walk(y)))[0]


def shard_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 20240607) -> DataFrame:
    """Place every row in a shard and slot; shard row counts differ by one at most (law `rows`)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    digests = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + F.lit(8)).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows, n = numbered(digests, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("__p", permuted(F.col("row_number"), n, seed))
    placed = placed.withColumn("__p", F.when(F.col("__p") < F.lit(n), F.col("__p")).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("__p"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("__p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
