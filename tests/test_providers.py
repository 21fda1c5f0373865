"""Calls of models: failures, rounds, bounds, claims; table functions; sentences; scans; Markdown."""

import gzip
import json
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from ragloom.config import Settings
from ragloom.functions import providers as P
from ragloom.functions import tables
from ragloom.functions.markdown import markdown
from ragloom.operators import chunking, evaluation, sentences
from ragloom.sources import io

SF = "/root/testdata/sf0.001"


def test_one_poisoned_prompt_costs_one_row(spark):
    frame = spark.range(10_000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("p")).repartition(3)

    def make():
        def call(prompts):
            if "p4321" in prompts:
                raise RuntimeError("poison")
            return [p.upper() for p in prompts]

        return call

    got = P.ask(frame, F.col("p"), make, budget=P.Budget(batch=64, in_flight=2))
    bad = got.where("status <> 'ok'").collect()
    assert [(r.id, r.answer, r.status) for r in bad] == [(4321, None, "failed: RuntimeError")]
    assert got.count() == 10_000 and got.where("answer = upper(p)").count() == 9_999


def test_rows_are_asked_again_in_rounds(spark, tmp_path):
    """An answer of the wrong form the first time, right the second; what was answered is not asked again."""

    def make():
        def call(prompts):
            out = []
            for p in prompts:
                mark = tmp_path / p.replace(" ", "_")
                first = not mark.exists()
                mark.open("a").write("x")
                out.append("?" if p.startswith("odd") and first else "never" if p.startswith("bad") else f"yes {p}")
            return out

        return call

    frame = spark.createDataFrame([("odd 1",), ("even 2",), ("bad 3",)], "p string").coalesce(1)
    got = {r.p: (r.said, r.how) for r in P.ask(frame, F.col("p"), make, "said", "how", P.Budget(rounds=3), lambda a: F.startswith(a, F.lit("yes"))).collect()}
    assert got == {"odd 1": ("yes odd 1", "ok"), "even 2": ("yes even 2", "ok"), "bad 3": ("never", "failed: form")}
    assert [len((tmp_path / n).read_text()) for n in ("odd_1", "even_2", "bad_3")] == [2, 1, 3]
    with pytest.raises(ValueError, match="status"):
        P.ask(frame.withColumn("status", F.lit(1)), F.col("p"), make)


def test_calls_overlap_within_the_bound(spark):
    def make():
        lock, state = threading.Lock(), {"now": 0, "most": 0}

        def call(prompts):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
            return [f"{p}:{state['most']}" for p in prompts]

        return call

    frame = spark.range(40).select(F.col("id").cast("string").alias("p")).coalesce(1)
    began = time.time()
    got = P.ask(frame, F.col("p"), make, budget=P.Budget(batch=1, in_flight=4)).collect()
    took = time.time() - began
    assert [r.p for r in got] == [r.answer.split(":")[0] for r in got]
    assert max(int(r.answer.split(":")[1]) for r in got) == 4 and took < 40 * 0.05 + 3


def test_pace_is_shared_among_tasks(spark):
    pace, began = P.Pace(0.02), time.monotonic()
    many = [threading.Thread(target=pace.wait) for _ in range(11)]
    [t.start() for t in many], [t.join() for t in many]
    assert time.monotonic() - began >= 0.19


def test_messages_and_forms(spark):
    class Chat:
        messages = True

        def __call__(self, prompts):
            return [f"{len(p.system) > 0}|{p.user}" for p in prompts]

    frame = spark.createDataFrame([("t {text}",)], "t string")
    assert P.ask(frame, P.prompt("propositions", text=F.col("t")), Chat).first().answer == "True|t {text}"
    for name, keys in (("propositions", ("propositions", "statement")), ("grouping", ("groups", "group_indices", "title", "15")), ("statements", ("statements",))):
        assert all(k in P.PROMPTS[name][0] for k in keys)


def test_one_bad_text_costs_its_own_vectors(spark):
    def make():
        def call(texts):
            if "bad" in texts:
                raise ValueError
            return [[float(len(t))] for t in texts]

        return call

    frame = spark.createDataFrame([(1, ["a", "bb"]), (2, ["bad", "c"]), (3, None), (4, []), (5, ["ddd"])], "id int, t array<string>").coalesce(1)
    assert {r.id: r.vectors for r in P.embed(frame, "t", make).collect()} == {1: [[1.0], [2.0]], 2: None, 3: None, 4: [], 5: [[3.0]]}


def test_claims_by_hand(spark):
    """Claims are what stands between semicolons; one follows from a premise that holds it."""

    def make():
        def call(prompts):
            out = []
            for p in prompts:
                if "Break the answer" in p:
                    answer = p.rsplit("\nAnswer: ", 1)[1]
                    out.append("no json" if "garbled" in answer else "```json\n" + json.dumps({"statements": [c.strip() for c in answer.split(";")]}) + "\n```")
                else:
                    premise, claim = p.split("Premise:\n", 1)[1].split("\n\nStatement: ")
                    out.append("yes" if claim in premise else "NO")
            return out

        return call

    rows = [(1, "q", "a b; c d", "a b; e f; c d", "a b and more", "s"), (2, "q", "garbled", "a b", "a b", "s"), (3, "q", "", "a b", "a b", "s"), (4, "q", "x; y", "x; y", "x y", None)]
    frame = spark.createDataFrame(rows, "id int, q string, said string, truth string, ctx string, status string")
    got = {r.id: (r.faithfulness, r.factual_correctness, r.status) for r in evaluation.answer_metrics(frame, "said", "truth", "ctx", make, "q").collect()}
    assert got == {1: (0.5, 0.8, "s"), 2: (0.0, 0.0, "s"), 3: (0.0, 0.0, "s"), 4: (1.0, 1.0, None)}


def test_sections_that_fail_once_are_asked_again(spark, tmp_path):
    def propose():
        def call(prompts):
            out = []
            for p in prompts:
                first = not (tmp_path / "seen").exists()
                (tmp_path / "seen").touch()
                out.append("sorry" if first else json.dumps({"propositions": [{"statement": "made."}]}))
            return out

        return call

    got = chunking.agentic_chunks(spark.createDataFrame([(1, "Some text.")], "id int, text string"), "id", "text", propose=propose).collect()
    assert [(r.text, r.fallback) for r in got] == [("Single Topic\nmade.", False)]


def test_table_functions_equal_the_chunkers(spark):
    tables.register(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80).unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs.createOrReplaceTempView("some_docs")
    for name, own in (("chunk_heuristic", chunking.heuristic_chunks), ("chunk_token_window", chunking.token_windows)):
        got = spark.sql(f"select d.doc_id, c.* from some_docs d, lateral {name}(d.text, 512, 51) c")
        want = own(docs, "doc_id", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    got = spark.sql("select d.doc_id, s.pos, s.sentence from some_docs d, lateral split_sentences(d.text) s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.split_sentences(docs, ["doc_id"], "text").collect()))


def corpus(texts=400):
    """Sentences of words that stand anywhere, with titles, a firm's ending, initials and e.g. within them."""
    rnd, words = random.Random(6), [f"{a}{b}{c}" for a in "bdfglmn" for b in "aeo" for c in "rst"]
    names, out = ["Miller", "Stone", "Jones", "Smith", "Baker", "Young"], []
    for _ in range(texts):
        said = []
        for _ in range(rnd.randint(2, 6)):
            w = [rnd.choice(words) for _ in range(rnd.randint(5, 9))]
            extra = rnd.choice([["Dr.", rnd.choice(names)], ["Mr.", rnd.choice(names)], ["Acme", "Inc."], [rnd.choice("ABJK") + ".", rnd.choice(names)], ["e.g."], [], []])
            at = rnd.randint(1, len(w) - 2)
            w[at:at] = extra
            said.append(w[0].capitalize() + " " + " ".join(w[1:]) + rnd.choice("...!"))
        out.append(" ".join(said))
    return out


def test_trained_sentences(spark):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(corpus())], "id int, text string").repartition(3)
    model = sentences.train(frame, "text")
    assert {"dr", "mr", "inc", "e.g"} <= model.abbreviations and len(model.abbreviations) < 12
    cases = {
        "Dr. Miller got Mr. Stone. Bar got J. Smith far.": ["Dr. Miller got Mr. Stone.", "Bar got J. Smith far."],
        "Bar got Acme Inc. bat, e.g. for mas. Mor far!": ["Bar got Acme Inc. bat, e.g. for mas.", "Mor far!"],
        'Bar got "Lat mar." Dat far. ': ['Bar got "Lat mar."', "Dat far."],
        "": [], "  ": [], "no end": ["no end"],
    }
    for text, want in cases.items():
        assert sentences.plain_sentences(text, model) == want, text
    right = [s for t in corpus(60) for s in sentences.plain_sentences(t, model)]
    assert all(s[0].isupper() and s[-1] in ".!" for s in right) and len(right) == sum(len(re.findall(r"[a-z]{3}[.!](?= |$)", t)) for t in corpus(60))
    got = sentences.with_sentences(frame.limit(20).unionByName(spark.createDataFrame([(-1, None)], "id int, text string")), "text", model).collect()
    assert all(r.sentences == sentences.plain_sentences(r.text, model) for r in got)
    empty = sentences.train(frame.where("false"), "text")
    assert not empty.abbreviations and sentences.plain_sentences("A bo. C do.", empty) == ["A bo.", "C do."]


def test_bad_lines_are_kept_and_gzip_is_dealt_out(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write("".join(json.dumps({"example_id": k, "question_text": "q"}) + "\n" for k in range(100)) + '\nnot json\n{"example_id": "x"}\n[1]\n')
    path = str(tmp_path / "a.jsonl.gz")
    rows = io.read_jsonl(spark, path, tasks=7)
    assert sorted(r.example_id for r in rows.collect()) == list(range(100)) and rows.rdd.getNumPartitions() == 7
    assert {r.line for r in io.bad_lines(spark, path).collect()} == {"not json", '{"example_id": "x"}', "[1]"}
    assert [(r.n_rows, r.n_bad) for r in io.line_counts(spark, path).collect()] == [(100, 3)]


def test_markdown_trees():
    assert markdown("<ol start=3><li>a<ul><li>b<li>c</ul><li>d</ol>") == "3. a\n   * b\n   * c\n4. d"
    assert markdown("<blockquote><p>one<p>two</blockquote>") == "> one\n> \n> two"
    assert markdown("<pre>a  b\n c</pre><p>x <code>y  z</code></p>") == "```\na  b\n c\n```\n\nx `y  z`"
    assert markdown("<table><thead><tr><th>h<th>i</thead><tr><td>1|2<td>3</table>") == "| h | i |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert markdown("<p><b> bold </b>and<i></i> <a href='u' title='t'>l</a><a>n</a><br>next<hr>") == "**bold** and [l](u \"t\")n\nnext\n\n---"
    assert markdown("<div>" * 3000 + "deep") == "deep" and markdown("") == ""


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "One two three. Four five. " * 9)], "s int, text string")
    for key in ("s", "w", "n", "c", "i"):
        own = frame.withColumnRenamed("s", key)
        settings = Settings(chunk_tokens=10, overlap_tokens=2)
        assert chunking.heuristic_chunks(own, key, "text", settings).count() == chunking.heuristic_chunks(own, key, "text", settings, make_count=lambda: lambda s: len(s.split())).count() > 2
        assert chunking.token_windows(own, key, "text", 10, 2).count() > 2


def test_environment_is_checked(spark, tmp_path):
    from ragloom import __main__ as runner

    out = str(tmp_path / "out")
    with pytest.raises(SystemExit, match="cleaned"):
        runner.main(["--out", out, "--step", "2"], spark)
    with pytest.raises(SystemExit, match="unknown"):
        runner.check_providers({"other": list})

    def broken():
        raise RuntimeError("no key")

    with pytest.raises(SystemExit, match="no key"):
        runner.check_providers({"judge": broken})
    runner.check_providers({"judge": lambda: lambda prompts: ["YES"] * len(prompts), "embedder": lambda: lambda texts: [[1.0]] * len(texts)})


def test_sampling_names_that_clash(spark):
    from ragloom.operators import sampling

    frame = spark.range(30).withColumn("h", F.lit(1)).withColumn("slot", F.lit(2))
    with pytest.raises(ValueError, match="'h'"):
        sampling.hash_sample(frame, "id", 3)
    with pytest.raises(ValueError, match="'slot'"):
        sampling.reservoir_sample(frame, "id", 3)
    got = sampling.reservoir_sample(frame, "id", 3, out="place").collect()
    assert sorted(r.place for r in got) == [0, 1, 2] and {r.slot for r in got} == {2}
    assert sampling.hash_sample(frame, "id", 3, out="mark").count() == 3
