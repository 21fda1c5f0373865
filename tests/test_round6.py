"""Findings of round 4."""

import duckdb
from pyspark.sql import functions as F

from ragloom.operators import experiment, sentences
from ragloom.plans import queries as core
from tests.test_providers import corpus


def test_factorial_results_cross_strategies_with_methods(spark, tmp_path):
    """Every question has a row of every strategy and method, with chunks, answer and tokens, as SQL has it."""
    texts = ["Red fox. Blue sky and a long day.\n\n# Head\nA green tree stands. It is old.", "Green tree. " * 300, "", None, "  \n", "sky"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red sky"), (2, "green"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = core.q_factorial_results(spark, str(tmp_path))
    got = sorted(tuple(r) for r in made.collect())
    assert len({r[:3] for r in got}) == len(got) == 36 and {r[0] for r in got} == {"heuristic", "semantic", "agentic"}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(core.ORACLES["q_factorial_results"])
    assert [d[0] for d in found.description] == made.columns and sorted(found.fetchall()) == got
    assert all(r[3].startswith(r[0] + ":") and r[4] and r[5] > 20 for r in got if r[2] == 2)


def test_results_keep_failed_rows(spark):
    """A generation that fails leaves the failure text, no chunks and zero tokens in its row."""

    def broken():
        def call(prompts):
            raise RuntimeError("down")

        return call

    docs = spark.createDataFrame([(1, "Red fox. Blue sky.")], "doc_id long, text string")
    asked = spark.createDataFrame([("1", "", "red sky", "red sky")], "question_id string, document_id string, question string, short_answer string")
    rows = experiment.results(docs, asked, generate=broken).select("generated_answer", F.size("retrieved_chunks").alias("n"), "tokens.total_tokens").collect()
    assert [tuple(r) for r in rows] == [(experiment.FAILED, 0, 0)] * 9


def test_a_model_of_any_size_is_whole(spark):
    """With more entries of a kind than a task may hold, none is left out: sentences are those of the model held in memory."""
    texts = [t + f" Kon {k % 7} zeta-Inc. Bar no. {k} Foo \"a.\" Baz." for k, t in enumerate(corpus())]
    texts += ["Bar got Acme Inc. " + "B" * 300 + ". Mar far", "Dr. Miller... J. Smith.  ", "", " . ", None, "Stone inc. x Bar? Yes! no. 1 e.g. Lat"]
    frame = spark.createDataFrame([(k, t, k % 3) for k, t in enumerate(texts)], "id int, text string, __x int").repartition(3)
    small, large = sentences.train(frame, "text"), sentences.train(frame, "text", most=2)
    assert isinstance(small, sentences.Model) and isinstance(large, sentences.Tables)
    assert {r.type for r in large.abbreviations.collect()} == small.abbreviations and {tuple(r) for r in large.collocations.collect()} == small.collocations
    assert {r.type for r in large.starters.collect()} == small.starters and {r.type: r.places for r in large.places.collect()} == small.places
    want = sentences.with_sentences(frame, "text", small)
    got = sentences.with_sentences(frame, "text", large)
    assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect()) and len(small.abbreviations) > 2
    assert all(r.sentences == sentences.plain_sentences(r.text, small) for r in got.collect())


def test_a_long_token_after_a_period_is_judged_whole():
    model = sentences.Model(frozenset({"inc"}), frozenset(), frozenset({"b" * 300}), {})
    assert sentences.plain_sentences("Acme Inc. " + "B" * 300 + " far", model) == ["Acme Inc.", "B" * 300 + " far"]


def test_training_counts_few_pairs(spark, monkeypatch):
    """Neighbours that no period parts are counted by the second alone, in parts of any size; sums are those of all pairs."""
    monkeypatch.setattr(sentences, "COUNTED", 5)
    frame = spark.createDataFrame([(t,) for t in [*corpus(30), None, "", "a - B ... c! D? ..#.. e 3.5. F \"x.\" Y"]], "text string")
    tokens, pairs = sentences.counted(frame, "text")
    every = sentences.token_pairs(frame, "text").where("next is not null")
    got = {tuple(r) for r in pairs.where("mark = '.'").collect()}
    assert got == {tuple(r) for r in every.where("mark = '.'").collect()} and got
    ways = lambda rows: {tuple(r) for r in rows.where("mark <> '.'").groupBy("mark", "next", "up").agg(F.sum("n")).collect()}
    assert ways(pairs) == ways(every) and pairs.where("mark <> '.'").select("type").distinct().count() == 1
    assert {tuple(r) for r in tokens.collect()} == {tuple(r) for r in sentences.token_counts(frame, "text").collect()}
