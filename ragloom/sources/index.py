"""Chunk indexes on disk: chunks, sparse blocks, terms, vectors in lists and statistics, by strategy and batch.

write() replaces a strategy, add() appends a batch to it: a batch has its own blocks, counts of terms and lengths, and
its vectors go to the lists of the centres that the strategy already has. A search reads all batches and adds the counts
up, so it answers as an index made anew would; a batch written twice replaces itself. Blocks are sorted by term within
files dealt by term, and vectors by list, so the row groups that a question needs are found by their bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.config import DEFAULTS, Settings
from ragloom.functions import providers as P
from ragloom.operators import retrieval
from ragloom.operators import vectors as V
from ragloom.sources.staging import at_once, delete, exists, length, scope, spread, staged

KEY = "chunk_id"
TABLES = ("chunks", "packed", "blocks", "terms", "members", "vectors", "centres")


def folder(path: str, table: str, strategy: str) -> str:
    return f"{path}/{table}/strategy={strategy}"


def write(chunks: DataFrame, path: str, strategy: str, settings: Settings = DEFAULTS, embedder=None, model: str = "hashing", only: set[str] | None = None, kept: bool = True) -> None:
    """Index one strategy's chunks (chunk_id, source_id, chunk_index, text, ...). embedder: makes another embedding.

    only: terms that questions will ask for; by default all can be asked for. kept: False for an index of one call, whose
    questions read all blocks and vectors: blocks lie as they were made, vectors are in no lists, and there are no statistics.
    """
    for table in TABLES:
        delete(chunks.sparkSession, folder(path, table, strategy))
    add(chunks, path, strategy, 0, settings, embedder, only, kept)
    if not kept:
        return
    write_stats(read_chunks(chunks.sparkSession, path, strategy).withColumn("strategy", F.lit(strategy)), path, strategy, model)


def add(chunks: DataFrame, path: str, strategy: str, batch: int, settings: Settings = DEFAULTS, embedder=None, only: set[str] | None = None, kept: bool = True) -> None:
    """Index further chunks as batch number `batch`; ids must be new to the index."""
    spark = chunks.sparkSession
    at = lambda table: f"{folder(path, table, strategy)}/batch={batch}"

    def put(frame: DataFrame, table: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(at(table))
        return spark.read.schema(frame.schema).parquet(at(table))

    own = put(chunks.drop("strategy"), "chunks")
    rows = put(retrieval.packed(own, KEY, "text", batch, settings.embedding_dim if embedder is None else 0, only), "packed")
    index = retrieval.indexed(rows)
    embedded = lambda: retrieval.packed_vectors(rows, KEY) if embedder is None else vectors(own, KEY, "text", settings.embedding_dim, embedder)
    if not kept:
        at_once(spark, [lambda: put(index.blocks, "blocks"), lambda: put(index.terms, "terms"), lambda: put(index.chunks, "members"), lambda: put(embedded(), "vectors")])
        delete(spark, at("packed"))
        return
    put(index.blocks.repartition("term").sortWithinPartitions("term", "block"), "blocks")
    put(index.terms, "terms")
    put(index.chunks, "members")
    made = put(embedded(), "embedded")
    delete(spark, at("packed"))
    centres = folder(path, "centres", strategy)
    if not exists(spark, centres) or spark.read.schema(V.CENTRES).parquet(centres).isEmpty():
        V.centres_of(made, k=settings.top_k).coalesce(1).write.mode("overwrite").parquet(centres)
    lists = V.assigned(made, KEY, spark.read.schema(V.CENTRES).parquet(centres))
    put(lists.repartitionByRange("list", KEY).sortWithinPartitions("list", KEY), "vectors")
    delete(spark, at("embedded"))


def vectors(frame: DataFrame, key: str, text: str, dim: int, embedder=None) -> DataFrame:
    """(key, vector) of every text; a failed embedding is null."""
    own = spread(frame.select(key, text), key).select(key, F.array(text).alias("__t"))
    made = P.hashed_vectors(own, "__t", dim) if embedder is None else P.embed(own, "__t", embedder)
    return made.select(key, F.get("vectors", F.lit(0)).alias("vector"))


def table(spark: SparkSession, path: str, name: str, strategy: str) -> DataFrame:
    return spark.read.parquet(folder(path, name, strategy)).drop("batch")


def read_chunks(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    return table(spark, path, "chunks", strategy)


def read(spark: SparkSession, path: str, strategy: str) -> tuple[retrieval.Index, DataFrame]:
    """(sparse index, (list, chunk_id, vector)) of a strategy. Nothing is loaded before a question asks for it."""
    one = lambda name: table(spark, path, name, strategy)
    return retrieval.Index(one("blocks"), one("terms"), one("members")), one("vectors")


def centres(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """The centres of the vectors' lists, for vectors.search; retrieval.dense needs none."""
    return spark.read.schema(V.CENTRES).parquet(folder(path, "centres", strategy))


def preload(spark: SparkSession, path: str, strategies: list[str], most: int = 1 << 30) -> dict[str, tuple[retrieval.Index, DataFrame]]:
    """The strategies' indexes with terms and members in memory where their files hold at most `most` bytes together.

    A strategy that cannot be read is left out, so that the others still serve; read() it for the error.
    """
    out = {}
    for strategy in strategies:
        try:
            index, lists = read(spark, path, strategy)
            size = sum(length(spark, folder(path, name, strategy)) for name in ("terms", "members"))
            if size <= most:
                most -= size
                index = index._replace(terms=index.terms.cache(), chunks=index.chunks.cache())
            out[strategy] = (index, lists)
        except Exception:  # noqa: BLE001  told by its absence
            continue
    return out


def write_stats(chunks: DataFrame, path: str, strategy: str, model: str = "hashing") -> None:
    """One JSON row; zeros for a strategy without chunks."""
    own = retrieval.stats_of(chunks, [strategy], model)
    own.coalesce(1).write.mode("overwrite").json(f"{path}/stats/{strategy}")


def compact(spark: SparkSession, path: str, strategy: str, settings: Settings = DEFAULTS, embedder=None, model: str = "hashing") -> None:
    """All batches as one, with centres fitted anew: fewer, longer rows of postings to read."""
    with scope(spark):
        write(staged(read_chunks(spark, path, strategy), "compact"), path, strategy, settings, embedder, model)
