"""Sparse blocks, the vector index, batches, and staged tables that go."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.config import Settings
from ragloom.operators import chunking, retrieval
from ragloom.operators import vectors as V
from ragloom.sources import index
from ragloom.sources.staging import scope, shared_dir, staged

SF = "/root/testdata/sf0.001"


def hits(frame, q="item_id", key="chunk_id"):
    return sorted((r[q], r["rank"], r[key], r.score) for r in frame.collect())


def brute(docs, asked, k=10, k1=1.5, b=0.75, epsilon=0.25):
    own = {d: (t or "").lower().split() for d, t in docs}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    df = {}
    for words in own.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {w: floor if x < 0 else x for w, x in idf.items()}
    out = []
    for q, text in asked:
        scores = {d: sum(idf.get(t, 0) * words.count(t) * (k1 + 1) / (words.count(t) + k1 * (1 - b + b * len(words) / mean)) for t in (text or "").lower().split()) for d, words in own.items()}
        out += [(q, r, d) for r, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [3, 16, 1024])
def test_sparse_blocks_equal_brute_force(spark, monkeypatch, size):
    """Small blocks, so that most of them are left out by their bounds; ties and empty texts among the chunks."""
    monkeypatch.setattr(retrieval, "SIZE", size)
    monkeypatch.setattr(retrieval, "FEW", 0)
    rng = np.random.default_rng(4)
    words = np.array([f"t{k}" for k in range(60)])
    docs = [(k, " ".join(words[(rng.zipf(1.4, int(rng.integers(1, 30))) - 1) % 60])) for k in range(150)] + [(200, ""), (201, None), (202, "t1 t2"), (203, "t1 t2")]
    asked = [(q, " ".join(words[rng.integers(0, 60, 4)])) for q in range(12)] + [(50, "unknown"), (51, "t1 t1 t2")]
    got = retrieval.sparse(spark.createDataFrame(asked, "q int, s string"), spark.createDataFrame(docs, "id int, t string").repartition(3), "q", "s", "id", "t")
    assert [(q, r, d) for q, r, d, _ in hits(got, "q", "id")] == brute(docs, asked)


def test_questions_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUESTIONS", 5)
    docs = [(k, f"a{k % 7} b{k % 5} c{k}") for k in range(40)]
    asked = [(q, f"a{q % 7} b{q % 3}") for q in range(17)]
    got = retrieval.sparse(spark.createDataFrame(asked, "q int, s string"), spark.createDataFrame(docs, "id int, t string"), "q", "s", "id", "t")
    assert [(q, r, d) for q, r, d, _ in hits(got, "q", "id")] == brute(docs, asked)


def test_bounds_leave_blocks_out(spark, monkeypatch):
    """Blocks return at most 2 k rows a question, and those whose bound is too low are not read."""
    monkeypatch.setattr(retrieval, "SIZE", 10)
    monkeypatch.setattr(retrieval, "FEW", 0)
    docs = [(k, "rare " * 5 + "x" if k < 20 else f"rare {' '.join(f'w{j}' for j in range(k % 9 + 20))}") for k in range(400)] + [(1000 + k, f"filler{k}") for k in range(500)]
    seen = []
    made = retrieval.searched

    def watched(*args, **knobs):
        seen.append(made(*args, **knobs))
        return seen[-1]

    monkeypatch.setattr(retrieval, "searched", watched)
    got = retrieval.sparse(spark.createDataFrame([(1, "rare")], "q int, s string"), spark.createDataFrame(docs, "id int, t string").coalesce(1), "q", "s", "id", "t", 5)
    assert [d for *_, d, _ in hits(got, "q", "id")] == [0, 1, 2, 3, 4]
    assert seen[0].count() <= 2 * 5 * 3  # of 40 blocks that hold the term


def test_three_batches_search_like_a_fresh_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    chunks = staged(chunking.chunk("heuristic", docs, "doc_id", "text"), "chunks")
    index.write(chunks, str(tmp_path / "whole"), "heuristic")
    for k in range(3):
        index.add(chunks.where(F.pmod(F.col("source_id").cast("long"), F.lit(3)) == k), str(tmp_path / "parts"), "heuristic", k)
    index.add(chunks.where(F.pmod(F.col("source_id").cast("long"), F.lit(3)) == 2), str(tmp_path / "parts"), "heuristic", 2)  # again: replaces itself
    found = {}
    for name in ("whole", "parts"):
        own, lists = index.read(spark, str(tmp_path / name), "heuristic")
        vec = index.vectors(asked, "item_id", "text", 16)
        found[name] = hits(retrieval.sparse_search(asked, own, "item_id", "text", "chunk_id")), hits(retrieval.dense(vec, lists, "item_id", "vector", "chunk_id", "vector"))
    assert found["whole"] == found["parts"]
    index.compact(spark, str(tmp_path / "parts"), "heuristic")
    own, lists = index.read(spark, str(tmp_path / "parts"), "heuristic")
    assert hits(retrieval.sparse_search(asked, own, "item_id", "text", "chunk_id")) == found["whole"][0] and lists.count() == chunks.count()
    loaded = index.preload(spark, str(tmp_path / "parts"), ["heuristic", "absent"])
    assert list(loaded) == ["heuristic"] and loaded["heuristic"][0].terms.count() == own.terms.count()


def test_stream_extends_an_index(spark, tmp_path):
    from ragloom.streaming.ingest import ingest

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").limit(8)
    for k in range(3):
        docs.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest(spark, str(tmp_path / "in"), docs.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    fresh = retrieval.sparse(asked, chunking.chunk("heuristic", docs, "doc_id", "text"), "item_id", "text", "chunk_id", "text")
    own, _ = index.read(spark, str(tmp_path / "out"), "heuristic")
    assert hits(retrieval.sparse_search(asked, own, "item_id", "text", "chunk_id")) == hits(fresh)


def test_vector_index_recall(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 24))
    rows = [(k, (middles[k % 40] + 0.35 * rng.normal(size=24)).tolist()) for k in range(6000)] + [(9000 + k, middles[0].tolist()) for k in range(300)] + [(9999, None)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    asked = vectors.where("id % 60 = 0 and vector is not null").select(F.col("id").alias("q"), F.col("vector").alias("w"))
    centres = staged(V.centres_of(vectors, sample=2000), "centres")
    lists = staged(V.assigned(vectors, "id", centres), "lists")
    assert lists.count() == 6300 and centres.count() == 7
    found, exact = V.search(asked, lists, centres, "q", "w", "id"), retrieval.dense(asked, vectors, "q", "w", "id", "vector")
    assert V.recall(found, exact, "q", "id").first().recall >= 0.9
    every = V.search(asked, lists, centres, "q", "w", "id", visited=7)
    assert hits(every, "q", "id") == hits(exact, "q", "id")
    assert found.schema == exact.schema


def test_vector_index_without_rows(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    centres = V.centres_of(none)
    assert centres.count() == 0 and V.assigned(none, "id", centres).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "q int, w array<double>")
    assert V.search(asked, V.assigned(none, "id", centres), centres, "q", "w", "id").count() == 0


def test_scope_removes_what_was_staged(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/ragloom"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    docs = spark.createDataFrame([(k, f"a{k} b") for k in range(20)], "id int, t string")
    with scope(spark):
        assert retrieval.sparse(docs.select(F.col("id").alias("q"), F.col("t").alias("s")).limit(3), docs, "q", "s", "id", "t").count() == 30
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before


def test_heuristic_of_another_splitter(spark):
    frame = spark.createDataFrame([(1, "One two. Three")], "w int, text string")
    got = chunking.heuristic_chunks(frame, "w", "text", Settings(chunk_tokens=2, overlap_tokens=0), parts=F.array(F.lit("One two. Three")))
    assert [(r.w, r.text) for r in got.collect()] == [(1, "One two."), (1, "Three")]
