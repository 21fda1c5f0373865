"""Core operators: every query against its SQL, and hand-computed edges."""

import gzip
import json
import random

import duckdb
import numpy as np
import pytest

from ragloom.functions import providers as P
from ragloom.functions import text as T
from ragloom.operators import chunking, cleaning, evaluation, experiment, retrieval, sampling
from ragloom.config import Settings
from ragloom.plans import queries as core
from ragloom.sources import index, io

SF = "/root/testdata/sf0.001"
TABLES = "benchmark conversations documents embeddings events labels lineitem pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, got, order):
    at = [names.index(c) for c in order]
    return sorted(repr([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in at]) for r in got)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, con, name):
    frame = core.QUERIES[name](spark, SF)
    order = sorted(frame.columns)
    found = con.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    assert rows(frame.columns, [tuple(r) for r in frame.collect()], order) == rows(names, found.fetchall(), order)


def test_clean_text_edges(spark):
    source = "For other uses , see x\nA ( edit ) b\n## Notes\ngone"
    frame = spark.createDataFrame([(source,), ("",), (None,)], "t string")
    assert [r[0] for r in frame.select(cleaning.clean_text(frame.t)).collect()] == ["A b", "", None]


def test_answers_of_inadmissible_length_go(spark):
    note = [([(0, 1)],)]
    data = [(k, text, note) for k, text in enumerate(["a" * 9, "a" * 10, "a" * 100, "a" * 101])]
    frame = spark.createDataFrame(data, "id int, document_text string, annotations array<struct<short_answers: array<struct<start_token: int, end_token: int>>>>")
    assert sorted(r.id for r in cleaning.quality_filter(frame).collect()) == [1, 2]


def test_reservoir_equals_sequential_draw(spark):
    rng, slots = random.Random(42), []
    for seen in range(1, 501):
        if len(slots) < 20:
            slots.append(seen - 1)
        elif (j := rng.randint(1, seen)) <= 20:
            slots[j - 1] = seen - 1
    got = sampling.reservoir_sample(spark.range(500).repartition(7), "id", 20, sequential=True).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.slot)] == slots
    with pytest.raises(ValueError):
        sampling.reservoir_sample(spark.range(3), "id", 20)


def test_heuristic_units_overlap_and_tail():
    units = [(f"s{k} " + "w " * 8 + "e", 10) for k in range(12)]
    chunks = chunking.heuristic_units(units, 30, 12)
    assert [n for _, n in chunks][0] == 30
    assert chunks[1][0].split(" ")[-1] == "e" and chunking.heuristic_units([], 30, 5) == []
    assert all(any(u in c for c, _ in chunks) for u, _ in units)


def test_semantic_keeps_every_sentence(spark):
    text = "# H\nThe first sentence has quite a few words in it to be long. " + "Another sentence about something else that is long enough too. " * 3
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = chunking.semantic_chunks(frame, "id", "text").collect()
    assert {r.id for r in got} == {1}
    assert "first sentence" in " ".join(r.text for r in sorted(got, key=lambda r: r.chunk_index))


def test_sparse_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(k, "alpha" if k == 7 else "beta") for k in range(15)], "id int, t string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "unknown"), (3, None)], "q int, s string")
    got = retrieval.sparse(asked, docs, "q", "s", "id", "t").collect()
    assert [r.id for r in sorted((r for r in got if r.q == 1), key=lambda r: r["rank"])] == [7, 0, 1, 2, 3, 4, 5, 6, 8, 9]
    assert [r.id for r in sorted((r for r in got if r.q == 2), key=lambda r: r["rank"])] == list(range(10))


def test_hybrid_is_a_subset_with_ranks(spark):
    s = spark.createDataFrame([(1, k, 1.0, k + 1) for k in range(10)], "q int, id int, score double, rank long")
    d = spark.createDataFrame([(1, k + 5, 1.0, k + 1) for k in range(10)], "q int, id int, score double, rank long")
    got = retrieval.hybrid(s, d, "q", "id").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 11)) and {r.id for r in got} <= set(range(15))
    with pytest.raises(ValueError):
        retrieval.retrieve("other", {})


def test_csv_round_trip(spark, tmp_path):
    data = [("1", 'a "q", b\nc', ["x", None]), ("2", "NA", [])]
    io.write_csv(spark.createDataFrame(data, "id string, t string, l array<string>"), str(tmp_path / "c"))
    got = io.read_csv(spark, str(tmp_path / "c"), "id string, t string, l string").orderBy("id").collect()
    assert [r.t for r in got] == [data[0][1], "NA"] and json.loads(got[0].l) == ["x", None]


def test_jsonl_drops_malformed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"example_id": 1}\n\nnot json\n{"example_id": 2}\n')
    assert sorted(r.example_id for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == [1, 2]


def test_providers(spark):
    calls = []

    def flaky(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return prompts

    assert P.retrying(flaky, wait=0.0)(["a"]) == ["a"] and len(calls) == 3
    assert P.safe_json('```json\n{"a": 1}\n```') == {"a": 1} and P.safe_json("x", 5) == 5
    frame = spark.createDataFrame([(" yes ",), ("YES.",), (None,)], "a string")
    assert [r[0] for r in frame.select(P.parse_judgement(frame.a)).collect()] == [True, False, False]
    got = P.ask(frame, T.normalize_ws(frame.a), lambda: lambda prompts: [str(p).upper() for p in prompts]).where("a = ' yes '").collect()
    assert got[0].answer == "YES" and got[0].status == "ok"


def test_streaming_ingest(spark, tmp_path):
    from ragloom.streaming.ingest import ingest

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), docs.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert index.read_chunks(spark, str(tmp_path / "out"), "heuristic").select("source_id").distinct().count() == docs.where("text <> ''").count()


def test_html_text_decodes_quotes(spark):
    frame = spark.createDataFrame([("<p>a &quot;b&quot; &amp;lt; c</p><script>x</script>",)], "h string")
    assert frame.select(cleaning.html_to_text(frame.h)).first()[0] == 'a "b" &lt; c'


def loop_chunks(sentences, size, overlap):
    """Sentences gathered one by one, in words; the reference result for both forms."""
    units = [(w,) for s in sentences for w in ([s] if len(s.split()) <= size else s.split())]
    units = [u[0].split() for u in units]
    out, current = [], []
    for k, u in enumerate(units):
        current = current + u
        if len(current) >= size and k + 1 < len(units):
            out.append(" ".join(current))
            current = current[-overlap:] if overlap else []
    return out + ([" ".join(current)] if current else [])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_heuristic_forms_agree(spark, seed):
    """Expressions, the general form and the plain loop, with sentences longer than a chunk among them."""
    rng, texts = random.Random(seed), []
    for _ in range(12):
        texts.append(" ".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([1, 3, 8, 20, 31, 90]))) + "." for _ in range(rng.randint(0, 14))))
    frame = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id int, t string")
    settings = Settings(chunk_tokens=30, overlap_tokens=7)
    native = chunking.heuristic_chunks(frame, "id", "t", settings).orderBy("id", "chunk_index").collect()
    general = chunking.heuristic_chunks(frame, "id", "t", settings, make_count=lambda: lambda s: len(s.split())).orderBy("id", "chunk_index").collect()
    assert [tuple(r) for r in native] == [tuple(r) for r in general]
    for k, t in enumerate(texts):
        want = loop_chunks([s + "." for s in t.split(". ")] if t else [], 30, 7)
        assert [" ".join(r.text.split()).replace("..", ".") for r in native if r.id == k] == [w.replace("..", ".") for w in want]


def test_heuristic_counts_the_carried_words():
    """A counter that gives two tokens a word: carried words are counted, not numbered."""
    count = lambda s: 2 * len(s.split())
    units = [("a b c d", 8), ("e f g h", 8), ("i j", 4)]
    chunks = chunking.heuristic_units(units, 16, 5, count)
    assert chunks[0] == ("a b c d e f g h", 16)
    assert chunks[1] == ("e f g h i j", 12)


def test_semantic_with_an_embedder(spark):
    text = "# H\n" + " ".join(f"Sentence {k} about {'cats' if k < 4 else 'dogs'} which is long enough to be one of its own." for k in range(8))
    frame = spark.createDataFrame([(1, text)], "id int, text string")
    topic = lambda: lambda texts: [[1.0, 0.0] if "cats" in t else [0.0, 1.0] for t in texts]
    got = chunking.semantic_chunks(frame, "id", "text", embedder=topic).orderBy("chunk_index").collect()
    assert [("cats" in r.text, "dogs" in r.text) for r in got] == [(True, False), (False, True)] and {r.header for r in got} == {"# H"}

    def broken():
        def call(texts):
            raise ValueError("no service")

        return call

    whole = chunking.semantic_chunks(frame, "id", "text", embedder=broken).collect()
    assert len(whole) == 1 and whole[0].text == text.split("\n")[1]


def test_agentic_with_providers(spark):
    def propose():
        return lambda prompts: ["```json\n" + json.dumps({"propositions": [{"statement": s.strip()} for s in p.split("\n\n", 1)[1].split(".") if s.strip()]}) + "\n```" if "bad" not in p else "no json" for p in prompts]

    def arrange():
        return lambda prompts: [json.dumps({"groups": [{"group_indices": [2, 0, 9, -1], "title": "First"}, {"group_indices": [0], "title": "Second"}]}) for _ in prompts]

    frame = spark.createDataFrame([(1, "a is a. b is b. c is c. d is d."), (2, "one only."), (3, "bad text. here."), (4, "")], "id int, text string")
    got = {}
    for r in chunking.agentic_chunks(frame, "id", "text", propose=propose, arrange=arrange).collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.text, r.fallback))
    assert sorted(got[1]) == [(0, "First\na is a c is c", False), (1, "Miscellaneous\nb is b d is d", False)]
    assert got[2] == [(0, "Single Topic\none only", False)]
    assert got[3] == [(0, "bad text. here.", True)] and 4 not in got


def test_dense_equals_numpy(spark):
    rng = np.random.default_rng(0)
    own, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    own[10] = own[11] = own[12]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)] + [(900, None), (901, [0.0] * 8)], "id int, v array<double>")
    got = retrieval.dense(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], "q int, w array<double>"), rows, "q", "w", "id", "v").collect()
    for q in range(7):
        s = np.append(np.round(own @ asked[q] / np.linalg.norm(own, axis=1) / np.linalg.norm(asked[q]), 6), 0.0)
        want = np.lexsort((np.append(np.arange(300), 901), -s))[:10]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == [int(i) if i < 300 else 901 for i in want]


def test_plans_have_no_cross_product(spark):
    frame = core.QUERIES["q_retrieve_sparse"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_index_round_trip_equals_fresh_search(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    chunks = chunking.chunk("heuristic", docs, "doc_id", "text")
    index.write(chunks, str(tmp_path), "heuristic")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet")
    sparse, vectors = index.read(spark, str(tmp_path), "heuristic")
    key = lambda rows: sorted((r.item_id, r["rank"], r.chunk_id, r.score) for r in rows)
    assert key(retrieval.sparse_search(asked, sparse, "item_id", "text", "chunk_id").collect()) == key(retrieval.sparse(asked, chunks, "item_id", "text", "chunk_id", "text").collect())
    assert vectors.count() == chunks.count()
    stats = json.loads(next((tmp_path / "stats" / "heuristic").glob("part*")).read_text())
    assert stats["num_chunks"] == chunks.count() and stats["created_at"] and stats["embedding_model"] == "hashing"
    none = retrieval.stats_of(chunks.withColumn("strategy", F_lit("x")), ["heuristic"], "m").first()
    assert (none.num_chunks, none.tokens_mean) == (0, 0.0)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_experiment_failure_rows_and_providers(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    asked = spark.createDataFrame([("1", "d", "the and", "the"), ("2", "d", "fails", "x")], "question_id string, document_id string, question string, short_answer string")

    def generate():
        def call(prompts):
            if any("Question: fails" in p for p in prompts):
                raise RuntimeError("down")
            return ["the answer"] * len(prompts)

        return call

    experiment.index_documents(docs, str(tmp_path), "doc_id", "text")
    hits = experiment.all_hits(asked, str(tmp_path))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = experiment.answered(asked, hits, str(tmp_path), generate=generate).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 18
    for r in rows:
        failed = r.question_id == "2"
        assert (r.generated_answer == experiment.FAILED) == failed and len(r.retrieved_chunks) == (0 if failed else 10) and (r.tokens.total_tokens == 0) == failed
    made = spark.createDataFrame(rows)
    assert experiment.validate(made, 2).first().asDict() == {"n_rows": 18, "rows_ok": True, "chunks_ok": False}
    judged = experiment.evaluated(made, judge=lambda: lambda prompts: [" yes" if k % 2 else "no" for k in range(len(prompts))], metric=lambda: lambda prompts: ["0.5" if k % 2 else "none" for k in range(len(prompts))])
    wide = judged.collect()
    assert len(wide) == 18 and {r.faithfulness for r in wide} <= {0.0, 0.5} and all(0 <= r[m] <= 1 for r in wide for m in evaluation.METRICS)
    nested = experiment.summary_json(judged)
    assert (len(nested["by_strategy"]), len(nested["by_method"]), len(nested["by_combination"])) == (3, 3, 9)


def test_step_runner(spark, tmp_path):
    from ragloom import __main__ as runner

    note = [{"short_answers": [{"start_token": 2, "end_token": 6}]}]
    with gzip.open(tmp_path / "raw.jsonl.gz", "wt") as f:
        for k in range(12):
            text = f"<p>Document number {k} tells of rivers and bridges in some detail.</p> <p>It goes on about topic {k}.</p>"
            f.write(json.dumps({"example_id": k, "question_text": f"what of topic {k}", "document_text": text, "document_url": f"u{k}" if k % 2 else "", "document_title": "", "annotations": note if k < 10 else []}) + "\n")
        f.write("broken\n")
    out = str(tmp_path / "out")
    settings = Settings(sample_size=6)
    assert runner.main(["--raw", str(tmp_path / "raw.jsonl.gz"), "--out", out], spark, settings) == [1, 2, 3, 4]
    assert runner.read_cleaned(spark, out).count() == 6
    assert io.read_results(spark, f"{out}/results").count() == 54
    summary = json.loads("".join(p.read_text() for p in (tmp_path / "out" / "summary").glob("part*")))
    assert len(summary["by_combination"]) == 9 and 0 <= summary["by_method"]["hybrid"]["mean_mrr_at_k"] <= 1
    with pytest.raises(SystemExit):
        runner.main(["--out", out], spark, settings)


def test_validation_names_missing_columns(spark):
    with pytest.raises(ValueError, match="Question"):
        cleaning.validate_clean(spark.range(1).withColumn("short_answer", F_lit("x" * 20)), 1, required=tuple(cleaning.CLEANED))


def test_chunks_by_a_tokenizers_count(spark):
    public = pytest.importorskip("public_tokenizers")
    make = P.token_counter(public.path("word_bpe_49k.json"))
    frame = spark.createDataFrame([(1, "One unbelievably long-winded sentence stands here. " * 12)], "id int, t string")
    got = chunking.heuristic_chunks(frame, "id", "t", Settings(chunk_tokens=40, overlap_tokens=6), make_count=make).collect()
    assert len(got) > 2 and sum(r.token_count for r in got) >= make()(frame.first().t)
    assert all(r.token_count < 60 for r in got)


def test_markdown_by_hand(spark):
    page = '<h2>Head &amp; more</h2><p>A <b>bold</b> and <i>soft</i> <a href="u">link</a><a>none</a></p><ul><li>one<li>two</ul><table><tr><Th_colspan="2">H</th></tr><tr><td>x</td></tr></table><script>no()</script>'
    frame = spark.createDataFrame([(1, page), (2, None), (3, "plain")], "id int, h string")
    got = {r.id: r.markdown for r in cleaning.html_to_markdown(frame, "id", "h").collect()}
    lines = [line.rstrip() for line in got[1].split("\n") if line.strip()]
    assert lines == ["## Head & more", "A **bold** and *soft* [link](u)none", "* one", "* two", "| H |  |", "| --- | --- |", "| x |  |"]
    assert (got[2], got[3]) == ("", "plain")
    whole = {r.id: r.document_text for r in cleaning.process_documents(spark.createDataFrame([(1, "<p>Jump to : top</p><p>Body ( edit ) text.</p><h2>References</h2><p>gone</p>")], "id int, h string"), "id", "h").collect()}
    assert whole == {1: "Body text."}
