"""Inverted index, BM25, vector top-k and rank fusion, all questions at once.

The sparse index is dealt to blocks of chunks. A term's postings of one block are one row with the block's greatest
frequency and least length, which bound what the term can add to any score in the block. A search adds the bounds up,
answers every question from its most promising blocks first, and leaves out the blocks whose bound is below the kth
score found there. Blocks return their own best, so a question costs at most 2 k rows a block. Scores are rounded before
ranking and ties go to the smaller key. An index may be built for a call, or written and extended batch by batch and
read back (sources.index): bounds hold for any mean length, and counts of batches add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.config import DEFAULTS, Settings
from ragloom.functions import providers as P
from ragloom.functions import text as T
from ragloom.sources.staging import pieces, spread, staged

SIZE = 1024  # chunks of a block of the sparse index
FIRST = 2  # blocks of a question that are searched before the others
MET = 1 << 19  # pairs of a question and a posting of its terms that are met at once
FEW = 32  # blocks that are all searched at once: bounds would cost more than they save
ROWS, QUESTIONS = 8192, 1024  # of a block of a search
TERMS, LISTED = 100_000, 16_384  # that a task holds to post no others; of a list of the others
PROBE = 64  # blocks, or up to twice as many, that tell whether bounds leave blocks out


class Index(NamedTuple):
    """The tables of a sparse index."""

    blocks: DataFrame  # term, block, pos, tfs, most, least: a term's postings in one block, and what bounds their scores
    terms: DataFrame  # term, df; a term of several batches has several rows
    chunks: DataFrame  # block, keys, dls: the chunks of every block in the order of their keys


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return chunks.select(key, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(terms: DataFrame, n: Column, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
    """(term, df, idf) of (term, df): negative values become epsilon times the vocabulary's mean."""
    own = terms.groupBy("term").agg(F.sum("df").cast("long").alias("df"))
    raw = own.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(epsilon) * mean).otherwise(F.col("raw")).alias("idf"))


def vocabulary(chunks: DataFrame, text: str, epsilon: float = DEFAULTS.bm25_epsilon) -> DataFrame:
    """(term, df, idf) of the chunks' terms. One plan, no action."""
    own = chunks.select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return inverse_frequencies(own, chunks.agg(F.count("*").cast("double")).scalar(), epsilon)


def in_order(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t, at): lower-cased texts as bytes, in the order of their keys within a partition; at numbers them there."""
    at = F.monotonically_increasing_id()
    return spread(chunks.select(key, text), key, ranges=True).select(key, F.lower(text).cast("binary").alias("t")).sortWithinPartitions(key).withColumn("at", at)


def counted(chunks: DataFrame, key: str, text: str, batch: int = 0) -> DataFrame:
    """(key, block, pos, dl, terms, tfs) of every chunk, tokenised once; blocks are runs of SIZE keys of a partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            counts = [Counter(t.split()) if t else Counter() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([c.total() for c in counts], pa.int32()), pa.array([[w.decode() for w in c] for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                names=[key, "at", "dl", "terms", "tfs"],
            )

    made = in_order(chunks, key, text).mapInArrow(run, f"`{key}` {chunks.schema[key].dataType.simpleString()}, at long, dl int, terms array<string>, tfs array<int>")
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    block = F.lit(batch << 44) + F.shiftleft(F.shiftright("at", 33), 20) + (row / SIZE).cast("long")
    return made.select(key, block.alias("block"), (row % SIZE).cast("int").alias("pos"), "dl", "terms", "tfs")


def wanted(terms: DataFrame) -> set[str] | None:
    """The terms (term) where there are TERMS at most, which a task can hold; else None."""
    rows = terms.select("term").distinct().limit(TERMS + 1).collect()
    return {r["term"] for r in rows} if len(rows) <= TERMS else None


def packed(chunks: DataFrame, key: str, text: str, batch: int = 0, dim: int = 0, only: set[str] | None = None) -> DataFrame:
    """Every block's rows: one per term (block, term, df, pos, tfs, most, least), and one without a term (block, keys, dls, vectors).

    Blocks are those of counted(). Their chunks are neighbours in one partition, so postings are counted and sorted there, a
    block at a time, and never shuffled one by one. dim: of the chunks' hashed vectors (providers.hashed_vector), none if 0.
    only: terms that have rows, if not all; of the others there are lists (block, rest, dfs), as every term is counted.
    """
    kind, ints, doubles = chunks.schema[key].dataType.simpleString(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.float64()))
    texts = pa.list_(pa.string())
    told = None if only is None else chunks.sparkSession.sparkContext.broadcast(sorted(only))

    def batch_of(n: int, key_type: pa.DataType, **columns) -> pa.RecordBatch:
        """n rows of the given columns, all others null."""
        kinds = {"block": pa.int64(), "term": pa.string(), "df": pa.int32(), "pos": ints, "tfs": ints, "most": pa.int32(), "least": pa.int32(), "keys": pa.list_(key_type), "dls": ints, "vectors": doubles, "rest": texts, "dfs": ints}
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def post(block: int, own: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of one block, whose chunks are own (key, t, at)."""
        keys, n = own.column(0).combine_chunks(), len(own)
        words = pc.ascii_split_whitespace(pc.fill_null(own.column(1).combine_chunks().cast(pa.large_string()), ""))
        flat = words.flatten().dictionary_encode()
        codes, row = flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), P.sizes(words))
        terms = flat.dictionary.cast(pa.string())
        blank = pc.index(terms, pa.scalar("")).as_py()  # at the ends of a text
        pairs, tfs = np.unique((codes * n + row)[codes != blank], return_counts=True)  # by term, then position
        code, pos = np.divmod(pairs, n)
        dls = np.bincount(pos, tfs, n).astype(np.int32)
        vectors = {}
        if dim:
            near = P.buckets(terms, dim)[code]
            units = P.unit(np.bincount(pos * dim + near, tfs, n * dim).reshape(n, dim))
            vectors = {"vectors": P.nested([n], P.nested(np.full(n, dim), pa.array(units.ravel())))}
        yield batch_of(1, keys.type, block=pa.array([block]), keys=P.nested([n], keys), dls=P.nested([n], pa.array(dls)), **vectors)
        if told is not None:
            mine = pc.is_in(terms, value_set=pa.array(told.value, pa.string())).to_numpy(zero_copy_only=False)
            dfs = np.bincount(code, minlength=len(terms))
            others = np.flatnonzero(~mine & (dfs > 0))
            for at in range(0, len(others), LISTED):
                some = others[at : at + LISTED]
                yield batch_of(1, keys.type, block=pa.array([block]), rest=P.nested([len(some)], terms.take(pa.array(some))), dfs=P.nested([len(some)], pa.array(dfs[some], pa.int32())))
            held = mine[code]
            code, pos, tfs = code[held], pos[held], tfs[held]
        if not len(code):
            return
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        lengths, many = np.diff(starts, append=len(code)), len(starts)
        whole = batch_of(
            many, keys.type, block=pa.array(np.full(many, block)), term=terms.take(pa.array(code[starts])), df=pa.array(lengths, pa.int32()), pos=P.nested(lengths, pa.array(pos, pa.int32())), tfs=P.nested(lengths, pa.array(tfs, pa.int32())),
            most=pa.array(np.maximum.reduceat(tfs, starts), pa.int32()), least=pa.array(np.minimum.reduceat(dls[pos], starts)),
        )
        yield from (whole.slice(at, 4096) for at in range(0, many, 4096))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = None
        for part in parts:
            at = part.column(2).to_numpy()
            blocks = (batch << 44) + ((at >> 33) << 20) + (at & ((1 << 33) - 1)) // SIZE
            starts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for start, end in zip(starts, [*starts[1:], part.num_rows]):
                if held and blocks[start] != number:
                    yield from post(number, pa.Table.from_batches(held))
                    held = []
                number = int(blocks[start])
                held.append(part.slice(start, end - start))
        if held:
            yield from post(number, pa.Table.from_batches(held))

    return in_order(chunks, key, text).mapInArrow(run, f"block long, term string, df int, pos array<int>, tfs array<int>, most int, least int, keys array<{kind}>, dls array<int>, vectors array<array<double>>, rest array<string>, dfs array<int>")


def indexed(rows: DataFrame) -> Index:
    """The index of a table of packed() blocks."""
    posted = rows.where("term is not null")
    blocks = posted.select("term", "block", "pos", "tfs", "most", "least")
    rest = rows.where("rest is not null").select(F.explode(F.arrays_zip("rest", "dfs")).alias("p")).select(F.col("p.rest").alias("term"), F.col("p.dfs").alias("df"))
    terms = posted.select("term", "df").unionByName(rest).groupBy("term").agg(F.sum("df").cast("long").alias("df"))
    return Index(blocks, terms, rows.where("keys is not null").select("block", "keys", "dls"))


def packed_vectors(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector) of a table of packed() blocks."""
    own = rows.where("keys is not null").select(F.explode(F.arrays_zip("keys", "vectors")).alias("p"))
    return own.select(F.col("p.keys").alias(key), F.col("p.vectors").alias("vector"))


def build(chunks: DataFrame, key: str, text: str, only: DataFrame | None = None) -> Index:
    """The index of chunks for one call, in staged tables; only: (term) that are asked for, if not all."""
    made = indexed(staged(packed(chunks, key, text, only=None if only is None else wanted(only)), "packed"))
    return Index(*[staged(table, name) for name, table in made._asdict().items()])


def index_stats(chunks: DataFrame, strategy: str = "strategy", source: str = "source_id", text: str = "text") -> DataFrame:
    size, words = F.length(text), F.regexp_count(text, F.lit(r"\S+"))
    return chunks.groupBy(strategy).agg(
        F.countDistinct(source).alias("num_documents"), F.count("*").alias("num_chunks"),
        F.min(size).cast("long").alias("chars_min"), F.avg(size).alias("chars_mean"), F.max(size).cast("long").alias("chars_max"),
        F.min(words).cast("long").alias("tokens_min"), F.avg(words).alias("tokens_mean"), F.max(words).cast("long").alias("tokens_max"),
    )


def stats_of(chunks: DataFrame, strategies: list[str], model: str, **columns: str) -> DataFrame:
    """index_stats with a row of zeros for every strategy without chunks, the embedding's name and the time."""
    every = chunks.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    own = index_stats(chunks, **columns)
    return every.join(own, "strategy", "left").fillna(0).withColumn("embedding_model", F.lit(model)).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def sparse(questions: DataFrame, chunks: DataFrame, qkey: str, qtext: str, key: str, text: str, k: int = DEFAULTS.top_k, settings: Settings = DEFAULTS) -> DataFrame:
    """(qkey, key, score, rank): BM25 top-k over chunks, whose index is built for this call, of the questions' terms."""
    asked = questions.select(F.explode(T.tokens(F.col(qtext))).alias("term")).distinct()
    return sparse_search(questions, build(chunks, key, text, asked), qkey, qtext, key, k, settings)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of these starts and lengths, one run after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def sparse_search(questions: DataFrame, index: Index, qkey: str, qtext: str, key: str, k: int = DEFAULTS.top_k, settings: Settings = DEFAULTS) -> DataFrame:
    """(qkey, key, score, rank): BM25 top-k; questions with fewer matches are filled with zero scores in key order.

    Questions are answered in blocks of QUESTIONS, whose terms and weights every task holds.
    """
    total = index.chunks.agg(F.count("*").alias("blocks"), F.sum(F.size("keys")).cast("double").alias("n"), F.sum(F.aggregate("dls", F.lit(0).cast("long"), lambda s, d: s + d)).alias("l")).first()
    n, mean = total["n"] or 0.0, (total["l"] or 0) / total["n"] if total["l"] else 1.0
    asked = questions.select(F.col(qkey).alias("q"), F.explode(T.tokens(F.col(qtext))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qf"))
    idf = inverse_frequencies(index.terms, F.lit(n), settings.bm25_epsilon)
    weights = staged(asked.join(idf, "term").select("q", "term", (F.col("qf") * F.col("idf")).alias("w")), "weights")
    parts = max(1, -(-questions.count() // QUESTIONS))
    found = None
    for part in range(parts):
        own = weights if parts == 1 else weights.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part)
        made = searched(own, index, qkey, key, questions.schema[qkey].dataType.simpleString(), k, mean, settings, total["blocks"])
        found = made if found is None else found.unionByName(made)
    found = staged(found, "sparse")
    best = found.where("score > 0").groupBy(qkey).agg(F.count("*").alias("n"))
    if questions.select(qkey).distinct().join(best, qkey, "left").where(F.coalesce("n", F.lit(0)) < k).isEmpty():
        return ranked(found, qkey, key, k)
    spare = index.chunks.select(F.explode("keys").alias(key)).orderBy(key).limit(2 * k).agg(F.collect_list(key).alias("__spare"))  # 2 k keys: k at least are not among a question's k best
    blank = questions.select(qkey, F.explode(spare.scalar()).alias(key)).withColumn("score", F.lit(0.0))
    filled = found.unionByName(blank).groupBy(qkey, key).agg(F.max(F.when(F.col("score") != 0, F.col("score"))).alias("s"))
    return ranked(filled.select(qkey, key, F.coalesce("s", F.lit(0.0)).alias("score")), qkey, key, k)


def searched(weights: DataFrame, index: Index, qkey: str, key: str, kind: str, k: int, mean: float, settings: Settings, blocks: int) -> DataFrame:
    """(qkey, key, score): what blocks that may hold one of a question's k best return, or all of few blocks.

    weights: (q, term, w) of one block of questions. Where bounds leave out less than half of what some PROBE blocks are
    asked, all blocks are searched at once too: bounds and a second reading would cost more than they save.
    """
    k1, b, spark = settings.bm25_k1, settings.bm25_b, weights.sparkSession
    held: dict[str, list] = {}
    numbers: dict = {}
    for r in weights.collect():  # the terms of QUESTIONS questions
        held.setdefault(r["term"], []).append((numbers.setdefault(r["q"], len(numbers)), r["w"]))
    flat = [pair for pairs in held.values() for pair in pairs]
    ends = np.cumsum([0, *map(len, held.values())])
    told = spark.sparkContext.broadcast(({t: at for at, t in enumerate(held)}, ends, np.array([j for j, _ in flat], np.int64), np.array([w for _, w in flat]), list(numbers)))
    terms = weights.select("term").distinct()
    key_kind = index.chunks.schema["keys"].dataType.elementType.simpleString()

    def meet(posted: pa.Table, asking: pa.Table) -> pa.Table:
        """The 2 k best of every question that asks this block, by rounded score and key; none whose score rounds to 0."""
        empty = pa.table([pa.array([], asking.schema.field("qs").type.value_type), pa.array([], asking.schema.field("keys").type.value_type), pa.array([], pa.float64())], names=[qkey, key, "score"])
        if not posted.num_rows or not asking.num_rows:
            return empty
        place, ends, by, weight, names = told.value
        row = asking.slice(0, 1)
        dls, keys = row.column("dls").combine_chunks()[0].values.to_numpy(), row.column("keys").combine_chunks()[0].values
        every = row.column("qs").combine_chunks()[0].as_py()
        mine = {q: j for j, q in enumerate(every)}
        slots = np.array([mine.get(q, -1) for q in names], np.int64)
        posted = posted.sort_by("term")
        at, tf = [posted.column(c).combine_chunks() for c in ("pos", "tfs")]
        many, at, tf = P.sizes(at).astype(np.int64), at.flatten().to_numpy(), tf.flatten().to_numpy()
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dls / mean)[at])
        terms = np.array([place[t] for t in posted.column("term").to_pylist()], np.int64)
        of, pair = np.repeat(np.arange(len(terms)), np.diff(ends)[terms]), runs(ends[terms], np.diff(ends)[terms])  # every question of every term
        asks = slots[by[pair]] >= 0
        of, pair = of[asks], pair[asks]
        firsts, scores = np.cumsum(many) - many, np.zeros(len(every) * len(dls))
        turns = np.cumsum(many[of]) // MET
        for some in np.split(np.arange(len(of)), np.flatnonzero(np.diff(turns)) + 1):
            spots, long = runs(firsts[of[some]], many[of[some]]), many[of[some]]
            scores += np.bincount(np.repeat(slots[by[pair[some]]] * len(dls), long) + at[spots], np.repeat(weight[pair[some]], long) * part[spots], len(scores))
        scores = scores.reshape(len(every), len(dls))
        grid = np.floor(scores * 1e6 + 0.5)
        line = np.partition(grid, -2 * k, axis=1)[:, -2 * k] if 2 * k < len(dls) else np.zeros(len(every))
        qs, at = [], []
        for j in range(len(every)):
            some = np.flatnonzero(grid[j] >= line[j]) if line[j] > 0 else np.flatnonzero(grid[j])
            best = some[np.argsort(-grid[j, some], kind="stable")[: 2 * k]]  # positions follow the keys
            qs.append(np.full(len(best), j)), at.append(best)
        qs, at = np.concatenate(qs), np.concatenate(at)
        return pa.table([pc.take(row.column("qs").combine_chunks()[0].values, pa.array(qs, pa.int64())), pc.take(keys, pa.array(at, pa.int64())), pa.array(scores[qs, at])], names=[qkey, key, "score"])

    def answered(pairs: DataFrame | None) -> DataFrame:
        """What the blocks return to the questions that ask them: pairs (q, block), or all of both."""
        posted = index.blocks.select("term", "block", "pos", "tfs").join(terms, "term", "left_semi")
        if pairs is None:
            asking = index.chunks.withColumn("qs", weights.agg(F.collect_set("q")).scalar())  # QUESTIONS at most
        else:
            asking = pairs.groupBy("block").agg(F.collect_list("q").alias("qs")).join(index.chunks, "block")
            posted = posted.join(pairs.select("block").distinct(), "block", "left_semi")
        met = posted.groupBy("block").cogroup(asking.groupBy("block")).applyInArrow(meet, f"`{qkey}` {kind}, `{key}` {key_kind}, score double")
        return met.withColumn("score", F.round("score", 6))

    if blocks <= FEW:
        return answered(None)
    share = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))

    def bounded(some: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """(what the first blocks return, the other pairs, those of them that are not left out) of these rows of index.blocks."""
        bounds = some.select("term", "block", "most", "least").join(weights, "term")
        bounds = staged(bounds.groupBy("q", "block").agg((F.sum(F.greatest("w", F.lit(0.0)) * share(F.col("most"), F.col("least"))) + 2e-6).alias("bound")), "bounds")
        placed = bounds.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("bound"), "block")))
        first = placed.where(F.col("place") <= FIRST).select("q", "block")
        rest = placed.where(F.col("place") > FIRST)
        if rest.isEmpty():
            return answered(first), None, None
        met = staged(answered(first), "first")
        floors = ranked(met, qkey, key, k).where(F.col("rank") == k).select(F.col(qkey).alias("q"), F.col("score").alias("floor"))
        return met, rest, rest.join(floors, "q", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("q", "block")

    if (parts := blocks // PROBE) > 1:
        _, every, left = bounded(index.blocks.where(F.pmod(F.xxhash64("block"), F.lit(parts)) == 0))
        if every is not None and 2 * left.count() > every.count():
            return answered(None)
    met, _, left = bounded(index.blocks)
    return met if left is None else met.unionByName(answered(left))


def ranked(hits: DataFrame, qkey: str, key: str, k: int, order: list[Column] | None = None) -> DataFrame:
    """(qkey, key, score, rank) of the k best of each question."""
    best = Window.partitionBy(qkey).orderBy(*(order or [F.desc("score"), F.col(key)]))
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select(qkey, key, "score", "rank")


def nearest_of(qkey: str, key: str, k: int):
    """Makes the function that meets a block of questions (__q, __v) with one of rows (__k, __v): 2 k best of each question."""

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("__q"), b.sort_by("__k")
        out: list = [[], [], []]
        if a.num_rows and b.num_rows:
            left, right, many = unit(a["__v"]), unit(b["__v"]), min(2 * k, b.num_rows)
            for at in range(0, len(left), 128):
                scores = left[at : at + 128] @ right.T
                grid = np.floor(scores * 1e6 + 0.5)
                line = -np.partition(-grid, many - 1, axis=1)[:, many - 1]
                for j in range(len(scores)):
                    above, even = np.flatnonzero(grid[j] > line[j]), np.flatnonzero(grid[j] == line[j])
                    near = np.concatenate([above, even[: many - len(above)]])
                    out[0].append(np.full(len(near), at + j)), out[1].append(near), out[2].append(scores[j, near])
        rows = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
        return pa.table([pc.take(a["__q"], pa.array(rows[0], pa.int64())), pc.take(b["__k"], pa.array(rows[1], pa.int64())), pa.array(rows[2], pa.float64())], names=[qkey, key, "score"])

    return meet


def dense(questions: DataFrame, chunks: DataFrame, qkey: str, qvec: str, key: str, vec: str, k: int = DEFAULTS.top_k) -> DataFrame:
    """(qkey, key, score, rank): exact cosine top-k of array vectors.

    Both sides are dealt to blocks of about ROWS and QUESTIONS rows; each pair of blocks meets once, in a matrix product
    that keeps 2 k per question, so no pair of rows is ever written. Null vectors take no part; a zero one scores 0.
    """
    asked = questions.select(F.col(qkey).alias("__q"), F.col(qvec).cast("array<double>").alias("__v")).where("__v is not null")
    own = chunks.select(F.col(key).alias("__k"), F.col(vec).cast("array<double>").alias("__v")).where("__v is not null")
    blocks = lambda frame, n: max(1, -(-frame.count() // n))
    na, nb = blocks(asked, QUESTIONS), blocks(own, ROWS)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("__a", deal("__q", na)).withColumn("__b", every(nb))
    own = own.withColumn("__b", deal("__k", nb)).withColumn("__a", every(na))
    kinds = [f"`{qkey}` {questions.schema[qkey].dataType.simpleString()}", f"`{key}` {chunks.schema[key].dataType.simpleString()}", "score double"]

    met = asked.groupBy("__a", "__b").cogroup(own.groupBy("__a", "__b")).applyInArrow(nearest_of(qkey, key, k), ", ".join(kinds))
    return ranked(met.withColumn("score", F.round("score", 6)), qkey, key, k)


def hybrid(sparse_hits: DataFrame, dense_hits: DataFrame, qkey: str, key: str, k: int = DEFAULTS.top_k, rrf_k: int = DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of two top-k lists; ties: sparse hits by rank, then dense-only hits."""
    mark = lambda hits, s, d: hits.select(qkey, key, F.col("rank").alias(s), F.lit(None).cast("long").alias(d))
    both = mark(sparse_hits, "s", "d").unionByName(mark(dense_hits, "d", "s")).groupBy(qkey, key).agg(F.max("s").alias("s"), F.max("d").alias("d"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = both.withColumn("score", F.round(part("s") + part("d"), 9))
    return ranked(fused, qkey, key, k, [F.desc("score"), F.coalesce("s", F.lit(1_000_000) + F.col("d"))])


def retrieve(method: str, hits: dict[str, DataFrame]) -> DataFrame:
    """The hits of a method; ValueError for an unknown one."""
    if method not in hits:
        raise ValueError(f"unknown retrieval method {method!r}")
    return hits[method]


def context_string(hits: DataFrame, qkey: str, text: str) -> DataFrame:
    """(qkey, context): the hits' texts as numbered documents in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    one = lambda s: F.concat(F.lit('<document index="'), s["rank"].cast("string"), F.lit('">\n'), s["t"], F.lit("\n</document>"))
    return hits.groupBy(qkey).agg(F.array_join(F.transform(ordered, one), "\n\n").alias("context"))
