"""Findings of round 3 on core queries."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ragloom.functions import providers as P
from ragloom.functions.markdown import markdown
from ragloom.llm import ann
from ragloom.operators import retrieval, sentences, vectors
from ragloom.plans import queries as core


def test_html_to_markdown_references_without_semicolon(spark, tmp_path):
    """As the query's SQL has it they stay; the operator decodes them as browsers do unless told otherwise."""
    html = '<html><body><h1>A&amp; b&amp</h1><p>1 &middot; 2 &#38; 3 &#38 &copy 4 &notit;</p><ul><li><a href="/a?b=1&copy=2">c</a></li></ul></body></html>'
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = core.q_html_to_markdown(spark, str(tmp_path)).first().document_text
    assert got == "# A& b&amp\n\n1 · 2 & 3 &#38 &copy 4 &notit;\n\n* [c](/a?b=1&copy=2)"
    assert markdown("<p>a&amp b</p>") == "a& b"


def test_op2_recall_on_uneven_rows(spark):
    """Rows of very different lengths, and dimensions of very different scales: 0.95 of the 20 nearest are found."""
    rng = np.random.default_rng(5)
    for e in (rng.normal(size=(12000, 64)) * np.exp(1.2 * rng.normal(size=(12000, 1))), rng.normal(size=(12000, 64)) * np.exp(-0.1 * np.arange(64))):
        frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "vec_id long, embedding array<double>")
        got: dict = {}
        for r in ann.search(frame, every=40).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q, mine in got.items():
            s = e @ e[q]
            s[q] = -np.inf
            hits += len(mine & set(np.argsort(-s)[:20].tolist()))
        assert len(got) == 300 and hits >= 0.95 * 20 * 300, hits / 6000


def test_python_steps_hold_few_rows_of_a_large_batch(spark, monkeypatch):
    """10,000 rows in one Arrow batch are worked on, and given on, in slices of 256; none is lost."""
    frame = spark.createDataFrame([(1, "a b", [1.0, 0.0])], "id long, t string, v array<double>")
    ran = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda own, run, kind: ran.append(run) or frame.withColumns({"at": F.lit(0).cast("long"), "dl": F.lit(1), "terms": F.array("t"), "tfs": F.array("id"), "near": F.array("id")}))
    retrieval.counted(frame, "id", "t")
    P.hashed_vectors(frame.select("id", F.array("t").alias("t")), "t", 4)
    vectors.dealt(frame.select("id", "v"), "v", np.eye(2), 1, "near")
    ids, n = pa.array(range(10_000)), 10_000
    given = [[ids, pa.array([b"a b"] * n), ids], [ids, pa.array([["a b"]] * n), pa.array([[["a", "b"]]] * n)], [ids, pa.array([[0.0, 1.0]] * n)]]
    for run, columns in zip(ran, given, strict=True):
        out = list(run(iter([pa.RecordBatch.from_arrays(columns, names=["id", "v", "at"][: len(columns)])])))
        assert max(b.num_rows for b in out) <= 256 and [k for b in out for k in b.column(0).to_pylist()] == list(range(n))


def test_sentence_abbreviations_reads_texts_once(spark, tmp_path):
    """Tokens are counted once, as a table that the scores and both totals read; the counts are those of token_pairs."""
    texts = ["Dr. No saw 3.5 of it, etc. (Mr. X.) No, 7. He", "He said etc. again. dr. who", "... --", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = core.q_sentence_abbreviations(spark, str(tmp_path))
    assert not [f for f in made.inputFiles() if "documents.parquet" in f]
    want = sentences.abbreviation_scores(sentences.token_pairs(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text"))
    got = {(r.type, r.dots, r.others) for r in made.collect()}
    assert got == {(r.type, r.dots, r.others) for r in want.collect()} and {("dr", 2, 0), ("etc", 2, 0)} <= got
