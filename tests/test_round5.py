"""Finding F3 of round 3, asked again: what an index of one call leaves out, and how little each document costs."""

import os
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.functions import providers as P
from ragloom.functions import text as T
from ragloom.operators import chunking, experiment, retrieval
from ragloom.sources import index
from ragloom.sources.staging import at_once, new_path, scope, staged


def test_run_makes_no_lists_and_no_statistics(spark, monkeypatch):
    """No question of the call reads them; an index with a path of its own has them."""
    made = []
    monkeypatch.setattr(experiment, "new_path", lambda spark, tag, own=experiment.new_path: made.append(own(spark, tag)) or made[-1])
    docs = spark.createDataFrame([(1, "Red fox. Blue sky and a long day."), (2, "Green tree.")], "doc_id long, text string")
    asked = spark.createDataFrame([("1", "", "red sky", "red sky")], "question_id string, document_id string, question string, short_answer string")
    assert experiment.run(docs, asked).count() == 9
    top = made[0].removeprefix("file://")
    assert set(os.listdir(top)) - {"packed"} == {"blocks", "chunks", "members", "terms", "vectors"}
    assert set(index.table(spark, made[0], "vectors", "semantic").columns) == {"chunk_id", "vector"}


def test_strategies_are_at_work_together(spark):
    """Each job waits for the others; what they stage goes with the caller's scope."""
    gate = threading.Barrier(3, timeout=60)
    with scope(spark):
        paths = at_once(spark, [lambda k=k: (gate.wait(), staged(spark.range(k + 1), "part").count(), new_path(spark, "own"))[1:] for k in range(3)])
        assert [n for n, _ in paths] == [1, 2, 3]
        folder = os.path.dirname(paths[0][1].removeprefix("file://"))
        assert any(name.startswith("part-") for name in os.listdir(folder))
        inside = set(os.listdir(folder))
    assert not {name for name in set(os.listdir(folder)) & inside if name.startswith("part-")}


def test_buckets_of_slices(spark):
    terms = pa.array(["x", "", "é", "a" * 99, "b"])
    want = [r.b for r in spark.createDataFrame([(t,) for t in terms.to_pylist()], "t string").select(F.expr("cast(conv(substring(md5(t), 1, 8), 16, 10) as long) % 16 as b")).collect()]
    assert P.buckets(terms.slice(2), 16).tolist() == want[2:] and P.buckets(terms, 16).tolist() == [want[0], -1, *want[2:]] and not len(P.buckets(terms[:0], 16))


def test_likeness_of_runs_of_sentences(spark):
    rows = [(1, ["A b.", "c", "a B.", "É", "x"]), (2, None), (3, []), (4, ["q"]), (5, ["a", "", " ", "a b"])]
    own = spark.createDataFrame(rows, "k long, m array<string>")
    got = {r.k: r.near for r in P.hashed_likeness(own, "m", 8, size=2).collect()}
    want = {r.k: r.near for r in P.hashed_likeness(own.withColumn("w", F.when(F.col("m").isNotNull(), chunking.windowed(F.col("m"), 2))), "w", 8).collect()}
    assert {k: v and np.round(v, 12).tolist() for k, v in got.items()} == {k: v and np.round(v, 12).tolist() for k, v in want.items()} and len(got[1]) == 2


def test_strip_and_heuristic_rows(spark):
    texts = [" \t\n\x0b\f\r a \n b.\r\n", "", " \n", None, " x ", "A.\u0001 b. \u0001"]
    own = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    assert [r.s for r in own.orderBy("k").select(T.strip(F.col("t")).alias("s")).collect()] == ["a \n b.", "", "", None, " x ", "A.\u0001 b. \u0001"]
    assert [r.s for r in own.where("k = 5").select(T.sentences(F.col("t")).alias("s")).collect()] == [["A.", "b."]]
    plan = chunking.heuristic_chunks(own, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "w#" not in generate and ".w" not in generate  # no chunk's row carries all the words of its document


def test_small_turns_of_a_block(spark, monkeypatch):
    """Scores are the same whether a block's pairs are met in one turn or in many."""
    chunks = spark.createDataFrame([(k, " ".join(f"t{(k * j) % 7}" for j in range(1 + k % 5))) for k in range(30)], "c long, text string")
    asked = spark.createDataFrame([(q, f"t{q % 7} t{q % 3} none") for q in range(9)] + [(9, "")], "q long, text string")
    hits = lambda: [tuple(r) for r in retrieval.sparse(asked, chunks, "q", "text", "c", "text").orderBy("q", "rank").collect()]
    whole = hits()
    monkeypatch.setattr(retrieval, "MET", 2)
    assert hits() == whole and len(whole) == 100
