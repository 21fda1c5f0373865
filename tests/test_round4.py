"""Findings F2 and F3 of round 3: the experiment's work per document."""

import os

import numpy as np
from pyspark.sql import functions as F

from ragloom.functions import providers as P
from ragloom.operators import experiment, retrieval
from ragloom.sources import index
from ragloom.sources.staging import staged


def test_experiment_posts_the_questions_terms_and_counts_all(spark, monkeypatch):
    """An index of one call holds no other postings; its terms and answers are those of the whole index, whose postings are never shuffled one by one."""
    monkeypatch.setattr(retrieval, "SIZE", 4)
    monkeypatch.setattr(retrieval, "LISTED", 3)
    words = "Ab cdé ef. gh ij kl mn! op".split()
    docs = spark.createDataFrame([(k, " ".join(words[(k * j * j + j) % len(words)] for j in range(1 + k % 9)) + f"\tonly{k} ") for k in range(40)] + [(40, ""), (41, None)], "chunk_id long, text string")
    asked = spark.createDataFrame([("a", "ab gh gh none"), ("b", "cdé"), ("c", "")], "question_id string, question string")
    whole = retrieval.packed(docs, "chunk_id", "text", dim=4)
    assert "Aggregate" not in whole._jdf.queryExecution().executedPlan().toString()
    some = staged(retrieval.packed(docs, "chunk_id", "text", dim=4, only={"ab", "gh", "none", "cdé"}), "some")
    whole = staged(whole, "whole")
    assert {r.term for r in retrieval.indexed(some).blocks.select("term").collect()} == {"ab", "gh", "cdé"}
    terms = [{(r.term, r.df) for r in retrieval.indexed(x).terms.collect()} for x in (some, whole)]
    assert terms[0] == terms[1] and ("only7", 1) in terms[0]
    apart = lambda x: retrieval.Index(*[staged(t, "part") for t in retrieval.indexed(x)])
    hits = [[tuple(r) for r in retrieval.sparse_search(asked, apart(x), "question_id", "question", "chunk_id").orderBy("question_id", "rank").collect()] for x in (some, whole)]
    assert hits[0] == hits[1] and len(hits[0]) == 30
    want = {r.chunk_id: r.v for r in docs.select("chunk_id", P.hashed_vector(F.col("text"), 4).alias("v")).collect()}
    got = {r.chunk_id: r.vector for r in retrieval.packed_vectors(some, "chunk_id").collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_run_writes_no_other_postings(spark, monkeypatch):
    """experiment.run without a path posts what the questions ask for only."""
    made = []
    monkeypatch.setattr(experiment, "new_path", lambda spark, tag, own=experiment.new_path: made.append(own(spark, tag)) or made[-1])
    docs = spark.createDataFrame([(1, "Red fox. Blue sky and a long day."), (2, "Green tree.")], "doc_id long, text string")
    asked = spark.createDataFrame([("1", "", "red sky", "red sky")], "question_id string, document_id string, question string, short_answer string")
    assert experiment.run(docs, asked).count() == 9
    blocks = index.table(spark, made[0], "blocks", "heuristic")
    assert {r.term for r in blocks.collect()} == {"red", "sky"}
    assert not os.path.exists(f"{made[0].removeprefix('file://')}/packed/strategy=heuristic/batch=0")
