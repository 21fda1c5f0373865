"""A vector index of inverted lists: centres from a sample, every vector in the list of its nearest centre.

A search visits the lists whose centres are nearest to a question. How many that must be is measured when the centres
are made: the least number of lists that holds the wanted share of the sample's true neighbours. Lists are searched
exactly, by the matrix products of retrieval.dense; lists of more than ROWS vectors are searched in parts, so a list
that many equal vectors share is no task of its own. retrieval.dense is the exact way over all rows.

Centres are fitted on at most SAMPLE vectors, the documented bound; every vector is indexed, and batches that come later
go to the lists of the same centres. Null vectors are not indexed; a zero vector is nearest to the first centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import providers as P
from ragloom.operators import retrieval
from ragloom.sources.staging import pieces, staged

SAMPLE, PER_LIST, MOST_LISTS, ASKED = 16_384, 1024, 4096, 256
SHARE = 0.97  # of the sample's true neighbours that the visited lists hold
CENTRES = "list int, centre array<double>, visits int"


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def clustered(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors: Lloyd's rounds by cosine from random members; an empty one takes the worst served vector."""
    own = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        scores = sample @ own.T
        near = scores.argmax(1)
        total = np.zeros_like(own)
        np.add.at(total, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(own)) == 0)
        own = unit(total)
        own[empty] = sample[np.argsort(scores.max(1))[: len(empty)]]
    return own


def visits(sample: np.ndarray, centres: np.ndarray, k: int, share: float = SHARE) -> int:
    """How many nearest lists hold that share of the k nearest others of the sample's first vectors."""
    asked = sample[:ASKED]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, (sample @ centres.T).argmax(1)[best], axis=1)
    return int(np.quantile(needed, share, method="higher")) + 1 if needed.size else 1


def centres_of(vectors: DataFrame, vector: str = "vector", k: int = 10, sample: int = SAMPLE) -> DataFrame:
    """(list, centre, visits) fitted on the `sample` vectors of least hash; no row where there is none."""
    own = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = own.orderBy(F.xxhash64("v")).limit(sample).collect()
    spark = vectors.sparkSession
    if not rows:
        return spark.createDataFrame([], CENTRES)
    taken = unit(np.array([r["v"] for r in rows], float))
    lists = max(1, min(MOST_LISTS, -(-own.count() // PER_LIST), len(taken) // 8))
    made = clustered(taken, lists)
    visited = visits(taken, made, k)
    return spark.createDataFrame([(j, c.tolist(), visited) for j, c in enumerate(made)], CENTRES)


def known(centres: DataFrame) -> tuple[np.ndarray, int]:
    """The centres (MOST_LISTS at most) and the number of lists to visit."""
    rows = centres.orderBy("list").collect()
    return np.array([r["centre"] for r in rows], float), rows[0]["visits"] if rows else 0


def dealt(frame: DataFrame, vector: str, centres: np.ndarray, many: int, out: str) -> DataFrame:
    """frame with the numbers of the `many` nearest lists of every vector."""
    held = frame.sparkSession.sparkContext.broadcast(centres)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):  # a row of scores and one of places for each centre
            rows = part.column(part.schema.get_field_index(vector))
            near = np.argsort(-(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) @ held.value.T), axis=1, kind="stable")[:, :many]
            made = P.nested(np.full(len(rows), near.shape[1]), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{kept}, `{out}` array<int>")


def assigned(vectors: DataFrame, key: str, centres: DataFrame, vector: str = "vector") -> DataFrame:
    """(list, key, vector) of every vector that is not null."""
    own = vectors.select(key, F.col(vector).cast("array<double>").alias("vector")).where("vector is not null")
    middle, _ = known(centres)
    if not len(middle):
        return own.withColumn("list", F.lit(0)).select("list", key, "vector")
    return dealt(own, "vector", middle, 1, "near").select(F.col("near")[0].alias("list"), key, "vector")


def search(questions: DataFrame, lists: DataFrame, centres: DataFrame, qkey: str, qvec: str, key: str, k: int = 10, visited: int | None = None) -> DataFrame:
    """(qkey, key, score, rank): cosine top-k of the visited lists. lists: assigned() rows, of any number of batches."""
    middle, many = known(centres)
    asked = questions.select(F.col(qkey).alias("__q"), F.col(qvec).cast("array<double>").alias("__v")).where("__v is not null")
    if not len(middle):
        return retrieval.dense(questions, lists, qkey, qvec, key, "vector", k)
    asking = dealt(asked, "__v", middle, min(visited or many, len(middle)), "near").select("__q", "__v", F.explode("near").alias("list"))
    asking = staged(asking, "asking")
    sizes = staged(lists.join(asking.select("list").distinct(), "list", "left_semi").groupBy("list").agg(F.ceil(F.count("*") / retrieval.ROWS).cast("int").alias("parts")), "sizes")
    many_questions = asking.groupBy("list").agg(F.ceil(F.count("*") / retrieval.QUESTIONS).cast("int").alias("turns"))
    shape = F.broadcast(sizes.join(many_questions, "list"))  # a row per list, MOST_LISTS at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(shape, "list").withColumn("turn", F.pmod(F.xxhash64("__q"), F.col("turns")).cast("int")).select("list", "turn", every("parts").alias("part"), "__q", "__v")
    right = lists.join(shape, "list").select("list", F.pmod(F.xxhash64(key), F.col("parts")).cast("int").alias("part"), every("turns").alias("turn"), F.col(key).alias("__k"), F.col("vector").alias("__v"))
    kinds = f"`{qkey}` {questions.schema[qkey].dataType.simpleString()}, `{key}` {lists.schema[key].dataType.simpleString()}, score double"
    on = ["list", "part", "turn"]
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(retrieval.nearest_of(qkey, key, k), kinds)
    return retrieval.ranked(met.withColumn("score", F.round("score", 6)), qkey, key, k)


def recall(found: DataFrame, exact: DataFrame, qkey: str, key: str) -> DataFrame:
    """One row: the share of exact hits that were found."""
    both = exact.select(qkey, key).join(found.select(qkey, key).withColumn("__hit", F.lit(1)), [qkey, key], "left")
    return both.agg(F.round(F.coalesce(F.sum("__hit"), F.lit(0)) / F.count("*"), 6).alias("recall"))
