"""Jaccard join of documents' shingle sets: a size-aware heavy-light join.

Rows with equal sets are one node. Two nodes of sizes a <= b link when percent * union <= 100 * intersection, that is when
they share at least need(a, b) shingles.

Light nodes, of up to `boundary` shingles, are joined by subsets: for every size c that some light partner needs, a node
enters each of its subsets of c shingles. Nodes that share a subset and need no more than c link. Need grows with both
sizes, so all links within a subset's list are implied by links to its smallest member: the list is a star, whatever its
length.

Heavy nodes scan the inverted lists of their shingles, and of light ones only those large enough to be a partner. One
order of all shingles makes the scan short: two linked nodes have a shingle in common among the first b - need + 1 of
each, rarest first. The order is by shingle hash, but shingles that more than `common` nodes have among their RESERVE
first hashes come last, by their counts, so that passages which many documents share are nobody's first. A node whose
reserve does not hold enough other shingles has its whole set ordered anew from its text. Lists are longer than `common`
only where nodes consist of common shingles for the most part: groups of near copies.

The boundary is chosen by cost. A subset costs a row; a place in a list costs a row and, for every other node there (the
mean over all lists is measured), the sets that a comparison moves. Light sizes are those for which subsets cost less.

Lists are worked on in two passes, so that groups of copies make no pairs by the square of their size. First, all members
of a list meet the most central one, that with the fewest rarer shingles, and linked nodes become components. Then, where
a list still has members of several components, members of different components meet, in long lists each pair only in the
first list that both have in common; members of a long list's largest component meet only those outside it. A pair is
made only if sizes, places and parities leave room for a link: what follows a shared place in both must suffice, and the
SKETCH parities of a set's hashes that differ number no more than the shingles that only one of two linked sets may have.
The pairs that are left are verified on the complete sets. These bounds leave out what cannot link; no link is lost.

Null texts and texts without words have no shingles: component_id is their own id. With fewer words than a shingle has,
the whole sequence is one shingle. Null keys get rows but name a component only where it has no other key. Repeated rows
each get their row; an empty table gives no rows; other columns are ignored. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ragloom.llm import work
from ragloom.llm.components import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RESERVE, WHOLE = 0.22, 32  # share of a set's hashes that a node keeps; small sets are kept whole
COMMON = 32
SKETCH = 512  # parities of a set, by the lowest bits of its hashes
NEEDED = 1_000_000  # rows of sixteen bytes that may be broadcast; more are shuffled
FACTOR = np.array([xxh64_intdigest(f"place {k}".encode(), 42) | 1 for k in range(16)], np.uint64)


def need(a: int, b: int, percent: int) -> int:
    """The shingles that sets of a and b must share."""
    return -(-percent * (a + b) // (100 + percent))


def first_places(n: int, percent: int) -> tuple[int, int]:
    """How many of the first shingles serve for partners of n and more, and for those of fewer too."""
    return n - need(n, n, percent) + 1, n - -(-percent * n // 100) + 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 42)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """The distinct shingles' hashes in rising order."""
    parts = text.translate(LOWER).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(own))
    n = len(own) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += own[k : k + n] * FACTOR[k]
    return np.unique(mixed(total))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *[p.view(np.int64) for p in parts]])))


def parities(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes has each of SKETCH remainders, as longs."""
    return np.packbits(np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) % 2 == 1).view(np.int64)


def kept(n: int, percent: int, reserve: float) -> int:
    return n if n <= WHOLE else min(n, max(int(reserve * n) + 1, first_places(n, percent)[1]))


def keyed(docs: DataFrame, words: int, percent: int, reserve: float, key: str, text: str) -> DataFrame:
    """(doc_id, mark, node, size, sketch, reserve) of every row: the text's hash, its set's hash, size, parities and least hashes."""

    def run(batch_iter):
        known = WordHashes()
        for batch in work.batches(batch_iter):
            sets = [shingle_set(t, words, known) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxh64_intdigest(h.tobytes(), 7) for h in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array([len(h) for h in sets], pa.int32()), lists([parities(h) for h in sets]), lists([h[: kept(len(h), percent, reserve)] for h in sets])], names=["doc_id", "mark", "node", "size", "sketch", "reserve"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, node long, size int, sketch array<long>, reserve array<long>")


def whole_sets(docs: DataFrame, words: int, key: str, text: str, needed: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in needed (first, mark), from the text of each one's first row; few are broadcast, more shuffle the texts.

    A row that is repeated gives its node again.
    """

    def run(batch_iter):
        known = WordHashes()
        for batch in work.batches(batch_iter):
            sets = [shingle_set(t, words, known) for t in batch.column(0).to_pylist()]
            nodes = np.array([xxh64_intdigest(h.tobytes(), 7) for h in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), lists(sets)], names=["node", "hashes"])

    wanted = needed.select(F.col("first").alias("__first"), F.col("mark").alias("__mark"))
    wanted = F.broadcast(wanted) if wanted.count() <= NEEDED else wanted
    own = docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("text"))
    chosen = own.join(wanted, (F.xxhash64("text") == F.col("__mark")) & F.col("__id").eqNullSafe(F.col("__first")), "left_semi").select(F.col("text").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "node long, hashes array<long>")


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """The sizes of subsets under which a light node of n shingles meets its light partners."""
    partners = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    own = {(need(n, b, percent), min(n, b)) for b in partners if not (b == n and need(n, n, percent) == n)}
    return sorted({c for c, most in own if c <= most})


def chosen_boundary(counts: dict[int, int], others: float, percent: int) -> int:
    """The largest size up to which subsets cost no more than places in lists. counts: nodes by size; others: mean others in a list."""
    best, least, cost = 0, 0.0, 0.0
    for n in range(1, WHOLE + 1):
        subsets = sum(comb(n, c) for c in subset_sizes(n, WHOLE, percent))
        places = first_places(n, percent)[1] * (1 + others * 2 * n / 3)
        cost += counts.get(n, 0) * (subsets - places)
        if cost <= least:
            best, least = n, cost
    return best


def subset_keys(h: np.ndarray, c: int) -> np.ndarray:
    """A hash of every subset of c of the hashes: of the sum of what stays."""
    own = mixed(h)
    gone = np.array(list(combinations(range(len(h)), len(h) - c)), np.int64).reshape(comb(len(h), c), len(h) - c)
    return mixed(own.sum(dtype=np.uint64) - own[gone].sum(axis=1, dtype=np.uint64) + FACTOR[15:] * np.uint64(c))


def light_links(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links (a, b) of light nodes to the smallest member of every subset's list."""

    def run(batch_iter):
        for batch in work.batches(batch_iter):
            rows: list = [[], [], [], []]
            for node, n, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for c in subset_sizes(n, boundary, percent):
                    keys = subset_keys(np.array(h, np.int64).view(np.uint64), c).view(np.int64)
                    for column, values in zip(rows, (keys, np.full(len(keys), c), np.full(len(keys), node), np.full(len(keys), n))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *c]), pa.int64()) for c in rows], names=["key", "c", "node", "size"])

    light = nodes.where(F.col("size").between(1, boundary)).select("node", "size", "reserve")
    rows = light.mapInArrow(run, "key long, c long, node long, size long")
    first = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.min(F.struct("size", "node")).alias("first")).where("n > 1").select("key", "c", "first")
    needed = F.ceil(F.lit(percent) * (F.col("size") + F.col("first.size")) / F.lit(100 + percent))
    return rows.join(first, ["key", "c"]).where((F.col("node") != F.col("first.node")) & (needed <= F.col("c"))).select(F.col("node").alias("a"), F.col("first.node").alias("b"))


def ordered_places(own: np.ndarray, hot: np.ndarray, counts: np.ndarray, size: int, percent: int) -> np.ndarray | None:
    """A node's first shingles in the order of all; None if it needs more hashes than `own`, its least ones.

    hot, counts: the common shingles, at least those among own, in rising order, and how many nodes have each.
    """
    many = first_places(size, percent)[1]
    if not len(hot):
        return own[:many]
    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
    common = hot[at] == own
    cold = own[~common]
    if len(cold) >= many:
        return cold[:many]
    if len(own) < size:
        return None
    last = own[common][np.lexsort((own[common], counts[at[common]]))]
    return np.concatenate([cold, last])[:many]


def list_rows(frame: DataFrame, hot: DataFrame, percent: int, hashes: str, needed: int = NEEDED) -> DataFrame:
    """(node, size, mark, places) of every node in frame; places is null where its hashes do not suffice.

    hot: (key, n) of the common shingles. Every task holds them if they are few; else each node gets its own by a join.
    """
    if hot.count() <= needed:
        table = hot.toArrow().sort_by("key")
        every = frame.sparkSession.sparkContext.broadcast((table["key"].to_numpy(), table["n"].to_numpy()))
        rows = frame.select("node", "size", "mark", hashes, F.lit(None).cast("array<struct<key:bigint,n:bigint>>").alias("common"))
    else:
        every = None
        found = frame.select("node", F.explode(hashes).alias("key")).join(hot, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("common"))
        rows = frame.select("node", "size", "mark", hashes).join(found, "node", "left")

    def run(batch_iter):
        keys, counts = every.value if every else (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in work.batches(batch_iter):
            made = []
            for size, own, common in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4)):
                if common.is_valid:
                    keys, counts = common.values.field("key").to_numpy(), common.values.field("n").to_numpy()
                elif not every:
                    keys = keys[:0]
                made.append(ordered_places(own.values.to_numpy(), keys, counts, size, percent))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(3)], pa.array(made, pa.list_(pa.int64()))], names=["node", "size", "mark", "places"])

    return rows.mapInArrow(run, "node long, size int, mark long, places array<long>")


def can_link(percent: int, a: str = "x", b: str = "y"):
    """Whether sizes and what follows a shared place leave room for a link; columns size_ and pos_ of both."""
    small, large = F.least(f"size_{a}", f"size_{b}"), F.greatest(f"size_{a}", f"size_{b}")
    most = F.least(F.col(f"size_{a}") - F.col(f"pos_{a}"), F.col(f"size_{b}") - F.col(f"pos_{b}"))
    return (F.lit(100) * small >= F.lit(percent) * large) & (F.lit(100 + percent) * most >= F.lit(percent) * (small + large))


def near(percent: int, a: str = "x", b: str = "y"):
    """Whether the parities of two sets allow a link; columns size_ and sketch_ of both."""
    total = F.col(f"size_{a}") + F.col(f"size_{b}")
    differ = sum((F.bit_count(F.col(f"sketch_{a}")[k].bitwiseXOR(F.col(f"sketch_{b}")[k])) for k in range(1, SKETCH // 64)), F.bit_count(F.col(f"sketch_{a}")[0].bitwiseXOR(F.col(f"sketch_{b}")[0])))
    return differ * F.lit(100 + percent) <= F.lit(100 - percent) * total


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their complete sets."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("hashes").alias(f"hashes_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("hashes_a", "hashes_b")).alias("common"), (F.size("hashes_a") + F.size("hashes_b")).alias("total"))
    return both.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b")


def compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, key: str, text: str, percent: int) -> DataFrame:
    """The links among pairs, as a table; the sets are made again from the texts of those nodes alone."""
    pairs = work.table(pairs, "pairs")
    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    sets = work.table(whole_sets(docs, words, key, text, nodes.join(ends, nodes["node"] == ends["a"], "left_semi")), "sets")
    return work.table(verified(pairs, sets, percent), "links")


def allowed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are near()."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near(percent, "a", "b")).select("a", "b")


def labelled(frame: DataFrame, roots: DataFrame) -> DataFrame:
    kin = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return frame.join(kin, frame["node"] == kin["__node"], "left").withColumn("root", F.coalesce("__root", "node")).drop("__node", "__root")


def pair(a: str = "x", b: str = "y") -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def apart_pairs(rows: DataFrame, nodes: DataFrame, places: DataFrame, roots: DataFrame, percent: int, common: int, share: int = 4096) -> DataFrame:
    """Pairs of different components that may link. rows: (key, node, size, pos, serves)."""
    rows = labelled(rows, roots)
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    rows = work.table(rows.join(counts, "key").join(nodes.select("node", "sketch"), "node"), "parted")
    short, long = rows.where(F.col("n") <= common), rows.where(F.col("n") > common)
    told = ["size", "pos", "serves", "root", "sketch"]
    side = lambda s, *more: [*[F.col(c).alias(f"{c}_{s}") for c in [*told, *more]], F.col("node").alias(s)]
    serves = F.expr("case when size_x < size_y then serves_x when size_x > size_y then serves_y else serves_x and serves_y end")
    wanted = (F.col("root_x") != F.col("root_y")) & serves & can_link(percent) & near(percent)
    out = short.select("key", *side("x")).join(short.select("key", *side("y")), "key").where("x < y").where(wanted).select(*pair()).distinct()
    if long.isEmpty():
        return out
    main = long.groupBy("key", "root").agg(F.count("*").alias("here")).groupBy("key").agg(F.max_by("root", F.struct("here", "root")).alias("main"))
    held = long.join(main, "key").join(places.select("node", "places"), "node").withColumn("before", F.expr("slice(places, 1, pos)")).withColumn("apart", F.col("root") != F.col("main"))
    held = work.table(held.drop("places", "main"), "crowded")
    parts = F.ceil(F.col("n") / share).cast("int")
    left = held.where("apart").select("key", *side("x", "before"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = held.select("key", *side("y", "apart", "before"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    once = ~F.col("apart_y") | (F.col("x") < F.col("y"))
    met = left.join(right, ["key", "part"]).where(once & wanted & ~F.coalesce(F.arrays_overlap("before_x", "before_y"), F.lit(False)))
    return out.unionByName(met.select(*pair())).distinct()


def linked(docs: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", common: int = COMMON, reserve: float = RESERVE, boundary: int | None = None, needed: int = NEEDED) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest key reachable by links."""
    spark = docs.sparkSession
    with work.scratch(spark):
        rows = work.table(keyed(docs, words, percent, reserve, key, text), "keyed")
        members = work.table(rows.select("doc_id", "node", "size"), "members", stays=True)
        nodes = work.table(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min_by("mark", F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("mark"), *[F.any_value(c).alias(c) for c in ("size", "sketch", "reserve")]), "nodes")
        work.remove(spark, rows)
        counts = nodes.select(F.explode("reserve").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counts = work.table(counts, "counts")
        hot = counts.where(F.col("n") > common)
        if boundary is None:
            sizes = {r["size"]: r["many"] for r in nodes.where(F.col("size") <= WHOLE).groupBy("size").agg(F.count("*").alias("many")).collect()}
            places, pairs = nodes.agg(F.sum(F.size("reserve"))).first()[0] or 1, counts.where(F.col("n") <= common).agg(F.sum(F.expr("n * (n - 1)"))).first()[0] or 0
            boundary = chosen_boundary(sizes, pairs / places, percent)
        heavy = nodes.where(F.lit(100) * F.col("size") >= percent * (boundary + 1))
        placed = work.table(list_rows(heavy, hot, percent, "reserve", needed), "placed")
        short = placed.where("places is null")
        placed = placed.where("places is not null")
        if not short.isEmpty():
            asked = short.join(nodes.select("node", "first"), "node")
            sets = whole_sets(docs, words, key, text, asked).dropDuplicates(["node"]).join(short.select("node", "size", "mark"), "node")
            placed = placed.unionByName(work.table(list_rows(sets, hot, percent, "hashes", needed), "placed"))
        alone = F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / F.lit(100 + percent)) + 1  # places that serve for partners of this size and more
        spot = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))  # two numbers in one column of what is shuffled
        every = placed.select("node", "size", F.posexplode("places").alias("pos", "key")).select("key", "node", spot.alias("spot"))
        shared = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        every = work.table(every.join(shared, "key"), "lists")
        every = every.select("key", "node", F.shiftright("spot", 32).alias("size"), F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"))
        central = F.shiftleft("pos", 40).bitwiseOR(F.xxhash64(F.lit(7), "node").bitwiseAND(F.lit((1 << 40) - 1)))
        every = every.withColumn("serves", F.col("pos") < alone).withColumn("h", central)
        least = every.groupBy("key").agg(F.min("h").alias("least"))
        ahead = every.join(least, "key")
        least = ahead.where("h = least").select("key", F.col("node").alias("y"), F.col("size").alias("size_y"), F.col("pos").alias("pos_y"))
        star = ahead.where("h > least").join(least, "key").select("node", "y", "size_y", "pos_y", F.col("size").alias("size_x"), F.col("pos").alias("pos_x")).where(can_link(percent))
        star = star.select(*pair("node", "y")).unionByName(light_links(nodes, boundary, percent).select(*pair("a", "b"))).distinct()
        first = compared(allowed(star, nodes, percent), docs, nodes, words, key, text, percent)
        roots = work.table(components(first), "roots")
        pairs = apart_pairs(every.select("key", "node", "size", "pos", "serves"), nodes, placed, roots, percent, common)
        found = compared(pairs, docs, nodes, words, key, text, percent)
        roots = work.table(components(first.unionByName(found)), "roots")
        classes = labelled(nodes.select("node", "first"), roots)
        firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
        classes = work.table(classes.join(firsts, "root").select("node", "component_id"), "classes", stays=True)
    out = members.join(classes, "node", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))
