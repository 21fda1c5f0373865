"""Near-duplicates of five-word shingles at a Jaccard similarity of 0.8, by multi-index hashing of SimHash fingerprints.

A text's fingerprint has 64 * VIEWS majority bits over its distinct shingles' hashes. TABLES segments of WIDTH bits each
are the keys of one table of the index; a text enters each table under its segment's small Hamming ball: the segment
itself and the segment with one of its FLIPS least certain bits flipped. Two texts of similarity 0.8 differ in 15 % of
their bits, so their balls meet in a segment with probability 0.76; short segments alone would make chance matches that
grow with the square of the corpus, and segments long enough for it would need hundreds of tables. So each table is
partitioned by MINIMA minima of the shingle hashes, which agree with probability 0.8 each: a key is (table, minima,
segment), chance matches do not grow, and a pair at 0.8 is missed by all tables with probability 0.69^18 = 0.001 (by
simulation; texts of four or five shingles 0.009; less at higher similarity).

Texts that meet are verified, where they meet, by the distance of their complete fingerprints: 0.8 gives 154 of 1,024
bits with a standard deviation of 11.5, MOST is five of them more and leaves few pairs of 0.6. Then they are verified by
their exact shingle sets (of 64-bit hashes), which are made again for those texts alone: their rows are found by the
text's hash before any shingle is.

Groups of copies would make pairs by the square of their size. So, first, the members of a segment's own bucket meet
that bucket's member of least hash, and those linked take its label. Then only buckets with several labels are worked
on, and only pairs of different labels are made. For buckets of more than CROWD members, the shingles that at most RARE
of all such members have are counted. Members that share a rare shingle meet by it. Two that share none have no more in
common than their other shingles, a bound on their similarity; members whose bound is too low leave the crowd, and
pairs whose bound is too low are not made. The members left first meet about ANCHORS members, and components are formed.
Then, in rounds of growing size, further members meet those of other components: members of the bucket's largest
component meet those outside it, all others every member. Components only grow, so after a round its members are
settled for good with every member of their bucket, whichever component is the largest later; the rounds end when all
members are settled or the bucket is one component. No match is dropped, and groups of copies cost rows in proportion
to their size.

Texts without words (null, empty) form one class of their own. Null keys get a class but never name it unless it has
no other key. Repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ragloom.llm import simhash, work
from ragloom.llm.components import components
from ragloom.llm.jaccard import SKETCH, parities

TABLES, WIDTH, FLIPS, MINIMA = 18, 8, 2, 4
VIEWS, MOST = 16, 212  # words of a fingerprint, and the bits in which two of 0.8 may differ
SHORT, SHORT_MOST = 8, 260  # sets of fewer shingles differ in more bits
CROWD, ANCHORS, SHARE, RARE = 16, 2, 4096, 8
NEEDED = 1_000_000  # rows of eight bytes that may be broadcast; more are shuffled


def odd(what: str, n: int) -> np.ndarray:
    """n odd multipliers."""
    return np.array([xxh64_intdigest(f"{what} {k}".encode(), 42) | 1 for k in range(n)], np.uint64)


FACTOR, MIX, VIEW = odd("factor", TABLES * MINIMA), odd("mix", TABLES * MINIMA), odd("view", VIEWS)
PLACE = np.int64(1) << np.arange(WIDTH, dtype=np.int64)


def margins(hashes: np.ndarray) -> np.ndarray:
    """Twice the number of set bits less the number of hashes, for each of the fingerprint's bits."""
    total = np.zeros(64 * VIEWS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of bytes, which hold 255 at most
        h = hashes[at : at + 255, None] * VIEW
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        total += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return 2 * total - len(hashes)


def folded(margin: np.ndarray) -> np.ndarray:
    """The fingerprint as VIEWS signed integers."""
    return np.packbits(margin > 0).view(np.int64)


def segment_keys(hashes: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """For each table the key of the segment, then those of its ball; for one hash at least."""
    least = np.full(TABLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (FACTOR[:, None] * hashes[at : at + 512]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(29))) * MIX
    salt = (least ^ (least >> np.uint64(32))).reshape(TABLES, MINIMA).sum(axis=1, dtype=np.uint64)
    own = margin[: TABLES * WIDTH].reshape(TABLES, WIDTH)
    code = (own > 0) @ PLACE
    doubt = np.argsort(np.abs(own), axis=1, kind="stable")[:, :FLIPS]
    codes = np.concatenate([code[:, None], code[:, None] ^ PLACE[doubt]], axis=1).astype(np.uint64)
    key = (salt[:, None] + codes) * MIX[:TABLES, None]
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, int]:
    """(distinct shingle hashes, their digest: the node)."""
    h = np.unique(simhash.shingle_hashes(text or "", words))
    return h, int(np.uint64(xxh64_intdigest(h.tobytes(), 7)).view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def keyed(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """(doc_id, mark, node, size, fp, own, ball) of every row: the text's hash, its shingle set's hash and size, fingerprint and keys."""

    def run(batch_iter):
        work.forget()
        for batch in work.batches(batch_iter):
            nodes, sizes, fps, own, ball = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                h, node = shingle_set(t, words)
                margin = margins(h)
                keys = segment_keys(h, margin) if len(h) else np.empty((0, 2), np.int64)
                nodes.append(node), sizes.append(len(h)), fps.append(np.concatenate([folded(margin), parities(h)])), own.append(keys[:, 0]), ball.append(keys[:, 1:].ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists(fps), lists(own), lists(ball)], names=["doc_id", "mark", "node", "size", "fp", "own", "ball"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, node long, size long, fp array<long>, own array<long>, ball array<long>")


def shingle_sets(docs: DataFrame, words: int, text: str, needed: DataFrame) -> DataFrame:
    """(node, hashes) of the needed texts. needed: (mark, one row per node); few are broadcast, more shuffle the texts."""

    def run(batch_iter):
        work.forget()
        for batch in work.batches(batch_iter):
            made = [shingle_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in made], pa.int64()), lists([h.view(np.int64) for h, _ in made])], names=["node", "hashes"])

    wanted = needed.select(F.col("mark").alias("__mark"))
    wanted = F.broadcast(wanted) if wanted.count() <= NEEDED else wanted
    chosen = docs.select(F.col(text).alias("text")).join(wanted, F.xxhash64("text") == F.col("__mark"), "left_semi")
    return chosen.mapInArrow(run, "node long, hashes array<long>").groupBy("node").agg(F.any_value("hashes").alias("hashes"))


def pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def close(similarity: float, a: str = "a", b: str = "b"):
    """Whether sizes and parities allow that similarity and complete fingerprints are near, for columns size_ and fp_ of both."""
    far = sum((F.bit_count(F.col(f"fp_{a}")[k].bitwiseXOR(F.col(f"fp_{b}")[k])) for k in range(1, VIEWS)), F.bit_count(F.col(f"fp_{a}")[0].bitwiseXOR(F.col(f"fp_{b}")[0])))
    small, large = F.least(f"size_{a}", f"size_{b}"), F.greatest(f"size_{a}", f"size_{b}")
    odd_ones = sum((F.bit_count(F.col(f"fp_{a}")[k].bitwiseXOR(F.col(f"fp_{b}")[k])) for k in range(VIEWS + 1, VIEWS + SKETCH // 64)), F.bit_count(F.col(f"fp_{a}")[VIEWS].bitwiseXOR(F.col(f"fp_{b}")[VIEWS])))
    room = odd_ones <= (small + large) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (small >= similarity * large - 1e-6) & room & (far <= F.when(small < SHORT, SHORT_MOST).otherwise(MOST))


def near(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that are close()."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("fp").alias(f"fp_{s}"), F.col("size").alias(f"size_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(close(similarity)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"hashes_{s}"))
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), (F.size("hashes_a") + F.size("hashes_b")).alias("total"))
    return both.where(F.col("common") / (F.col("total") - F.col("common")) >= similarity).select("a", "b")


def place() -> F.Column:
    """A node's place among others, by its hash: 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), "node"), 11) / F.lit(float(1 << 53))


def labelled(frame: DataFrame, roots: DataFrame | None) -> DataFrame:
    """frame with each node's root: the node itself where it has none."""
    if roots is None:
        return frame.withColumn("root", F.col("node"))
    kin = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return frame.join(kin, frame["node"] == kin["__node"], "left").withColumn("root", F.coalesce("__root", "node")).drop("__node", "__root")


def first_links(nodes: DataFrame, docs: DataFrame, words: int, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((a, b) of verified links to the first member of an own segment's bucket, (node, root) labels after them)."""
    own = nodes.select(F.explode("own").alias("key"), "node")
    first = own.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(place().alias("place"), "node")).alias("first")).where("n > 1").select("key", F.col("first.node").alias("first"))
    met = own.join(first, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    met = work.table(near(met, nodes, similarity), "met")
    needed = met.select("a").unionByName(met.select(F.col("b").alias("a"))).distinct()
    sets = work.table(shingle_sets(docs, words, text, nodes.join(needed, nodes["node"] == needed["a"], "left_semi")), "sets")
    links = work.table(verified(met, sets, similarity), "verified")
    up = links.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64(F.lit(7), "b").alias("h"), "b")).alias("up")).select("node", F.col("up.b").alias("root"))
    for _ in range(2):  # to the first member's own first member
        above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
        up = work.table(up.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
    return links, up


def reachable(similarity: float):
    """Whether x and y can be that similar without a rare shingle in common: rest_ counts their other shingles."""
    most = F.least("rest_x", "rest_y")
    return most >= similarity * (F.col("size_x") + F.col("size_y") - most) - 1e-6


def meet(anchors: DataFrame, others: DataFrame, similarity: float) -> DataFrame:
    """Pairs of anchors with others (key, node, root, n, size, rest, perhaps fp) of their key and another root, if they are
    close and reachable; a crowd of n is dealt to n / SHARE tasks."""
    parts, known = F.ceil(F.col("n") / SHARE).cast("int"), [c for c in ("root", "size", "rest", "fp") if c in anchors.columns]
    side = lambda s: [F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in known]]
    left = anchors.select("key", *side("x"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = others.select("key", *side("y"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    wanted = (F.col("root_x") != F.col("root_y")) & reachable(similarity)
    wanted = wanted & close(similarity, "x", "y") if "fp" in known else wanted
    return left.join(right, ["key", "part"]).where(wanted).select(*pair("x", "y")).distinct()


def by_rare(full: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of different roots that share a rare shingle, (node, size, rest) of all members of crowded buckets)."""
    held = work.table(full.select("node", "root").distinct().join(sets.select("node", "hashes"), "node"), "crowds")
    shingles = held.select("node", "root", F.explode("hashes").alias("shingle"))
    counts = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("n") <= RARE)
    rare = work.table(shingles.join(counts, "shingle").select("shingle", "node", "root", (F.col("low") < F.col("high")).alias("parted")), "rare")
    left, right = (rare.where("parted").select("shingle", F.col("node").alias(s), F.col("root").alias(f"root_{s}")) for s in "xy")
    met = left.join(right, "shingle").where("x < y and root_x <> root_y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    own = held.select("node", F.size("hashes").alias("size")).join(rare.groupBy("node").agg(F.count("*").alias("r")), "node", "left")
    return met, own.select("node", "size", (F.col("size") - F.coalesce("r", F.lit(0))).alias("rest"))


def merged(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, root) after further links (a, b); only the roots that these join are worked on again."""
    if roots is None:
        return work.table(components(found), "roots")
    kin = lambda s: roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
    joins = found.join(kin("a"), "a", "left").join(kin("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = work.table(components(joins), "moved")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return work.table(old.unionByName(moved.join(roots, "node", "left_anti").select("node", "root")), "roots")


def linked_roots(table: DataFrame, counts: DataFrame | None, sets: DataFrame, similarity: float, crowd: int = CROWD, known: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node with a verified link.

    table: (key, node) of the buckets, with counts: (key, n), n > 1; or (key, node, root, n), where nodes of one root
    are connected by known: (a, b) links verified before. sets: (node, hashes). nodes: (node, size, fp).
    """
    members, fp = table, [] if nodes is None else ["fp"]
    if counts is not None:
        members = work.table(labelled(table.select("key", "node").join(counts.select("key", "n"), "key"), None).select("key", "node", "root", "n"), "members")
    if fp:
        members = work.table(members.join(nodes.select("node", "size", "fp"), "node"), "printed")
    few, full = members.where(F.col("n") <= crowd), members.where(F.col("n") > crowd)
    told = ["root", *(["size", "fp"] if fp else [])]
    left, right = (few.select("key", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in told]) for s in "xy")
    wanted = F.expr("x < y and root_x <> root_y")
    wanted = wanted & close(similarity, "x", "y") if fp else wanted
    met = left.join(right, "key").where(wanted).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    crowded = not full.isEmpty()
    if crowded:
        paired, rests = by_rare(full, sets)
        full = work.table(full.drop("size").join(rests.where(F.col("rest") >= similarity * F.col("size") - 1e-6), "node"), "crowded")
        met = met.unionByName(near(paired, nodes, similarity) if fp else paired).unionByName(meet(full.where(place() < ANCHORS / F.col("n")), full, similarity))
    found = verified(met.distinct(), sets, similarity)
    roots = merged(None, work.table(found if known is None else found.unionByName(known), "verified"))
    share = ANCHORS
    while crowded:  # members below the share are settled: linked to, or compared with, every member of another component
        placed = labelled(full.where(F.col("n") > share).select("key", "node", "n", "size", "rest", *fp), roots)
        main = placed.groupBy("key", "root").agg(F.count("*").alias("here")).groupBy("key").agg(F.max_by("root", F.struct("here", "root")).alias("main"), F.count("*").alias("kinds"))
        parted = work.table(placed.join(main.where("kinds > 1"), "key").select("key", "node", "root", "n", "size", "rest", *fp, (F.col("root") != F.col("main")).alias("apart")), "parted")
        full, rest = parted, parted.where(place() >= share / F.col("n"))  # a bucket of one component stays one
        if rest.isEmpty():
            break
        share *= 64
        now = rest.where(place() < share / F.col("n"))
        more = meet(now.where("apart"), parted, similarity).unionByName(meet(now.where("not apart"), parted.where("apart"), similarity)).distinct()
        roots = merged(roots, work.table(verified(more, sets, similarity), "verified"))
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id, mark, root) of every row: the smallest key reachable by links, the text's xxhash64, the class."""
    with work.scratch(docs.sparkSession):
        rows = work.table(keyed(docs, words, key, text), "keyed")
        some = [F.any_value(c).alias(c) for c in ("mark", "size", "fp", "own", "ball")]
        nodes = work.table(rows.groupBy("node").agg(F.min("doc_id").alias("first"), *some), "nodes")
        known, labels = first_links(nodes, docs, words, text, similarity)
        table = labelled(nodes, labels).select(F.explode(F.concat("own", "ball")).alias("key"), "node", "root")
        counts = table.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
        table = work.table(table.join(counts, "key").select("key", "node", "root", "n"), "shared")
        sets = work.table(shingle_sets(docs, words, text, nodes.join(table.select("node").distinct(), "node", "left_semi")), "sets")
        roots = linked_roots(table, None, sets, similarity, crowd, known, nodes)
        placed = labelled(nodes.select("node", "first"), roots)
        firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = placed.join(firsts, "root").select("node", "root", "component_id")
        return work.table(rows.select("doc_id", "mark", "node").join(classes, "node").select("doc_id", "component_id", "mark", "root"), "classes", stays=True)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one document of each group left: that of the smallest key. Rows with a null key stay."""
    return simhash.first_of_groups(docs, near_duplicates(docs, words, similarity, key, text), key, text)
