"""Ranked lexical search by Fagin's threshold algorithm over blocks of documents.

A first pass writes the forward index: of every document its number of terms and, for the terms that any item asks for,
their frequencies. Its counts give N, L and the terms' document frequencies. Then every task reads a block of the
forward index, sorts its lists by impact (the share of the score that a term gives a document), and answers each item by
the threshold algorithm: lists are read in turns from their tops, a document seen for the first time is scored whole
from the forward index, and the reading ends when the sum of the impacts that the lists have come to falls strictly
below the kth score. No unread document can reach that score then, so a block's best are exact, ties included. The best
of the blocks are ranked once more.

An item's floor is its kth score within a hashed share of the documents (1 of PILOT). The kth score of all is no less, so
documents below the floor are neither read for nor sent; the shuffle holds few rows more than the result at any size.

Items are answered in blocks of ITEMS, whose terms every task holds. Rows of one item_id are one item: its terms are
those of all its rows. Null and empty texts have no terms: such items get no rows, such documents count nowhere. Each row
of documents is a document, also where ids repeat; a null id is ranked after others of equal score. An empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm import work

ITEMS, BLOCK, PILOT = 1024, 1 << 15, 64
#: Bytes that no term holds become spaces, A-Z become a-z.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LAST = (1 << 63) - 1


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split() if text else []


def asked(items: DataFrame, key: str, text: str, part: int, parts: int) -> dict[int | None, set[bytes]]:
    """The terms of the items of one block."""
    own = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("binary").alias("t")).where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
    found: dict = {}
    for r in own.collect():
        found.setdefault(r["item_id"], set()).update(terms(r["t"]))
    return found


def forward_index(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(doc_id, n, terms array<int>, tfs array<int>) of every document with a term; terms: those of `known`."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batch_iter):
        ids = held.value
        for batch in work.batches(batch_iter):
            keys, sizes, own, tfs = [], [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if every := terms(t):
                    counts = Counter(filter(ids.__contains__, every))
                    keys.append(k), sizes.append(len(every)), own.append([ids[w] for w in counts]), tfs.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((keys, pa.int64()), (sizes, pa.int64()), (own, pa.list_(pa.int32())), (tfs, pa.list_(pa.int32())))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


class Lists:
    """Impact-sorted lists and the forward index of a block of documents."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        ids = [b.column(0) for b in batches]
        self.ids = np.concatenate([c.fill_null(LAST).to_numpy(zero_copy_only=False) for c in ids])
        self.null = np.concatenate([c.is_null().to_numpy(zero_copy_only=False) for c in ids])
        n = np.concatenate([b.column(1).to_numpy() for b in batches])
        many = np.concatenate([b.column(2).value_lengths().to_numpy() for b in batches])
        self.terms = np.concatenate([b.column(2).flatten().to_numpy() for b in batches])
        tf = np.concatenate([b.column(3).flatten().to_numpy() for b in batches]).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(many)])
        m = 50 + 50 * n * documents // length
        whose = np.repeat(np.arange(len(many)), many)
        self.impact = weights[self.terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[whose]))
        order = np.lexsort((-self.impact, self.terms))
        self.docs, self.best = whose[order], self.impact[order]
        self.begins = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))
        self.seen = np.full(len(many), -1)

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The whole scores of documents, looked up in the forward index."""
        many = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(many)
        spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[rows] - (ends - many), many)
        shares = np.concatenate([[0], np.cumsum(np.where(wanted[self.terms[spots]], self.impact[spots], 0))])
        return shares[ends] - shares[ends - many]

    def top(self, mark: int, own: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best of an item with the terms `own`, in order; none below the floor."""
        wanted = np.zeros(len(self.begins) - 1, bool)
        wanted[own] = True
        low, high = self.begins[own], self.begins[own + 1]
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, step, line = 0, 16, max(floor, 1)
        while True:
            parts = [self.docs[a + depth : min(a + depth + step, b)] for a, b in zip(low.tolist(), high.tolist()) if a + depth < b]
            if not parts:
                break
            fresh = np.unique(np.concatenate(parts))
            fresh = fresh[self.seen[fresh] != mark]
            self.seen[fresh] = mark
            found = self.scores(fresh, wanted)
            rows, scores = np.concatenate([rows, fresh[found >= line]]), np.concatenate([scores, found[found >= line]])
            if len(scores) >= k:
                line = max(line, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                rows, scores = rows[scores >= line], scores[scores >= line]
            depth += step
            step = depth  # turns of doubling length
            if int(self.best[low[low + depth < high] + depth - 1].sum()) < line:
                break
        order = np.lexsort((self.null[rows], self.ids[rows], -scores))[:k]
        return rows[order], scores[order]


def blocks(batch_iter, size: int):
    """Lists of batches of about `size` rows together."""
    own, rows = [], 0
    for batch in batch_iter:
        own.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield own
            own, rows = [], 0
    if rows:
        yield own


def best_of_blocks(index: DataFrame, items: list, weights: np.ndarray, documents: int, length: int, k: int, floors: dict, block: int) -> DataFrame:
    """(item_id, doc_id, score): of every block and item the k best that reach the floor. items: (item_id, term numbers)."""
    held = index.sparkSession.sparkContext.broadcast((items, weights, floors))

    def run(batch_iter):
        own, w, least = held.value
        for part in blocks(batch_iter, block):
            lists = Lists(part, w, documents, length)
            found = [(item, *lists.top(j, numbers, k, least.get(item, 0))) for j, (item, numbers) in enumerate(own)]
            for item, rows, scores in found:
                if len(rows):
                    ids = pa.array(lists.ids[rows], mask=lists.null[rows])
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(rows), pa.int64()), ids, pa.array(scores)], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", item_block: int = ITEMS, block: int = BLOCK, pilot: int = PILOT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0."""
    spark, out = docs.sparkSession, None
    parts = max(1, -(-items.count() // item_block))
    for part in range(parts):
        own = asked(items, item, item_text, part, parts)
        known = {w: j for j, w in enumerate(sorted(set().union(*own.values())))}
        if not known:
            continue
        index = work.table(forward_index(docs, known, key, text), "forward")
        size = index.agg(F.count("*"), F.sum("n")).first()
        if not size[0]:
            continue
        df = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * size[0] + 2) / (2 * df.get(j, 0) + 1))) for j in range(len(known))], np.int64)
        numbers = [(i, np.array(sorted(known[w] for w in ws), np.int64)) for i, ws in own.items() if ws]
        tried = best_of_blocks(index.where(F.pmod(F.xxhash64("doc_id"), F.lit(pilot)) == 0), numbers, weights, *size, k, {}, block)
        order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        placed = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        floors = {r["item_id"]: r["score"] for r in placed(tried).where(F.col("rank") == k).select("item_id", "score").collect()}
        made = placed(best_of_blocks(index, numbers, weights, *size, k, floors, block)).select("item_id", "rank", "doc_id", "score")
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
