"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    edges: two long columns, in any direction, repeated or not. Every round rewires each node's neighbours to their
    smallest; the table shrinks to stars in a number of rounds that grows with the logarithm of the longest chain.
    Minima are pre-aggregated before the shuffle and hubs meet their one minimum in a join that may be split. Each
    round is a written table, so a lost executor costs one round at most. An unfinished search raises.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    low, high = F.least(a, b), F.greatest(a, b)
    links = work.table(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        sign = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign[0] == 0 or sign == mark:
            break
        mark = sign
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        small = large.join(least, "u").select(pairs.alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        before, links = links, work.table(small, "links")
        work.remove(spark, before)
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select("v", F.col("v").alias("root")).distinct().withColumnRenamed("v", "node"))
