"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it. Equal fingerprints are
one node. Nodes within `radius` = 2 bits are found by two 32-bit segments: of two such fingerprints either the high
halves differ by one bit at most, or the low halves are equal. So the table holds each node under both halves; the
probe of the high half enumerates its ball of radius 1 (only cleared bits: the partner with the bit set finds the
other), the probe of the low half is the half itself; matches are verified on all 64 bits.

A bucket of more than CROWD nodes would make pairs by the square of its size. Every node that meets such a bucket
instead enumerates the ball of radius 1 around its whole fingerprint: two fingerprints are within 2 bits exactly if
these balls meet, and all members of a meeting point (65 at most) are linked to its smallest. So no link is lost and
rows grow with the number of nodes. Links become components by star rounds; nothing is collected.

Several views (fingerprints under independent hashes) may be linked together, which raises the recall for pairs of
lower similarity; the contract's query uses one.

Null text and text without words: fingerprint zero, linked like any other. Null keys get fingerprints but are never a
component's id unless it has no other. Repeated rows each get their row. An empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work
from ragloom.llm.components import components

CROWD = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words, repeats included; of the whole sequence if there are fewer."""
    from xxhash import xxh64_intdigest

    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[:n].tolist(), last.tolist())], np.uint64)


def mixed(h: np.ndarray, view: int) -> np.ndarray:
    """The hash values under another view: a bijective mix of the same values."""
    if view:
        h = h + np.uint64(0x9E3779B97F4A7C15 * view % (1 << 64))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprint(hashes: np.ndarray, view: int = 0) -> int:
    """The majority bits of the hashes, as a signed 64-bit integer."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = mixed(hashes[at : at + (1 << 15)], view)
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, views: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, fps array<long>): the text's xxhash64 and one fingerprint per view."""

    def run(batch_iter):
        for batch in work.batches(batch_iter):
            rows = []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t or "", words)
                rows.append([fingerprint(h, v) for v in range(views)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "mark", "fps"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fps array<long>")


def links(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) that connect all nodes with fingerprints within 2 bits in some view. nodes: (node, view, fp)."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    tag = F.shiftleft(F.col("view").cast("long"), 34)
    at_low, at_high = tag.bitwiseOR(low), tag.bitwiseOR(F.lit(1 << 33)).bitwiseOR(high)
    bits = F.array(*[F.lit(1 << b) for b in range(32)])
    cleared = F.transform(F.filter(bits, lambda b: b.bitwiseAND(high) != 0), lambda b: at_high.bitwiseXOR(b))
    table = nodes.select(F.explode(F.array(at_low, at_high)).alias("key"), "node", "fp")
    probes = nodes.select(F.explode(F.concat(F.array(at_low, at_high), cleared)).alias("key"), F.col("node").alias("probe"), F.col("fp").alias("probe_fp"), "view")
    full = work.table(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    crowded = not full.isEmpty()
    cold = table.join(full, "key", "left_anti") if crowded else table
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("probe_fp"))) <= 2
    found = probes.join(cold, "key").where(near & (F.col("node") != F.col("probe"))).select(F.col("node").alias("a"), F.col("probe").alias("b"))
    if not crowded:
        return found
    touched = probes.join(full, "key", "left_semi").select("view", F.col("probe").alias("node"), F.col("probe_fp").alias("fp")).distinct()
    signed = [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]
    ball = F.explode(F.concat(F.array(F.col("fp")), F.transform(F.array(*[F.lit(b) for b in signed]), lambda b: F.col("fp").bitwiseXOR(b))))
    meets = touched.select("view", ball.alias("at"), "node").groupBy("view", "at").agg(F.collect_set("node").alias("who")).where(F.size("who") > 1)  # 65 at most
    return found.unionByName(meets.select(F.explode("who").alias("a"), F.array_min("who").alias("b")).where("a <> b").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, views: int = 1, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id, fps, mark, root) of every row: the smallest key reachable by links, the text's xxhash64, the class."""
    with work.scratch(docs.sparkSession):
        own = fingerprints(docs, words, views, key, text)
        node = F.col("fps")[0] if views == 1 else F.xxhash64("fps")
        own = work.table(own.withColumn("node", node), "fingerprints", stays=True)
        nodes = work.table(own.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("fps").alias("fps")), "nodes")
        seen = nodes.select("node", F.posexplode("fps").alias("view", "fp")).where(F.lit(True))
        roots = components(links(seen, crowd))
        placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = work.table(placed.join(firsts, "root").select("node", "root", "component_id"), "classes", stays=True)
    out = own.join(classes, "node")
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id", "fps", "mark", "root")


def first_of_groups(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each class: that of the smallest key; rows with a null key stay. classes: (doc_id, mark, root).

    Rows that share a key are told apart by their texts' hashes (mark). Of rows equal in both, the one whose other
    columns are least as JSON stays.
    """
    known = classes.where(F.col("doc_id").isNotNull())
    best = known.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("best")).select("best.*").distinct()
    kept = best.select(F.col("doc_id").alias("__kept"), F.col("mark").alias("__mark"))
    own = (F.col(key) == F.col("__kept")) & (F.xxhash64(docs[text]) == F.col("__mark"))
    out = docs.join(kept, own, "left_semi")
    again = known.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__kept"), F.col("mark").alias("__mark"))
    if not again.isEmpty():
        once = out.join(again, own, "left_anti")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = out.join(again, own, "left_semi").groupBy(key, F.xxhash64(docs[text])).agg(F.min_by(row, F.to_json(row)).alias("__row"))
        out = once.unionByName(one.select("__row.*"))
    return out.unionByName(docs.where(F.col(key).isNull()))


def keep_one(docs: DataFrame, words: int = 5, views: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document of each group left: that of the smallest key. Rows with a null key stay."""
    return first_of_groups(docs, near_duplicates(docs, words, views, key, text), key, text)
