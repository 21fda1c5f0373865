"""Providers of what needs a service elsewhere, each with a deterministic offline default.

A provider is any object with the method of its protocol, made once per partition. Answers are asked for in rounds that
are written as tables, so an answer that was paid for is not asked for again when a later stage fails or reads it twice.
"""

from __future__ import annotations

import hashlib
import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import pairwise
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.sources.staging import pieces, staged

log = logging.getLogger("ragloom")
#: (system, user) of every prompt; places in braces are filled by columns.
PROMPTS = {
    "propositions": (
        "Split the text into self-contained statements: whole sentences of one fact each, with every pronoun resolved, each to be understood alone.\n"
        'Answer with one JSON object and nothing else: {"propositions": [{"statement": "..."}, {"statement": "..."}]}',
        "{text}",
    ),
    "grouping": (
        "Group the numbered statements by topic, neighbours or not. Every number from 0 to the last belongs to exactly one group; a group has at most 15 numbers, larger topics become parts; each has a short title.\n"
        'Answer with one JSON object and nothing else: {"groups": [{"group_indices": [0, 2], "title": "..."}, {"group_indices": [1], "title": "..."}]}',
        "{propositions}",
    ),
    "generation": (
        "Answer the question from the context alone, in a few words and no sentence. If the context does not hold the answer, say so.",
        "Context:\n{context_string}\n\nQuestion: {question}",
    ),
    "judge": (
        "Judge whether a passage holds what is needed to answer the question. The meaning of the true answer must be there, in whatever words; the topic alone does not do. Reply YES or NO only.",
        "Question: {question}\nTrue answer: {short_answer}\n\nPassage:\n{chunk_text}\n\nDoes it hold the answer?",
    ),
    "statements": (
        "Break the answer to the question down into statements that can be understood alone, without pronouns.\n"
        'Answer with one JSON object and nothing else: {"statements": ["...", "..."]}',
        "Question: {question}\nAnswer: {answer}",
    ),
    "verdict": (
        "Decide whether the statement follows from the premise alone. Reply YES or NO only.",
        "Premise:\n{premise}\n\nStatement: {statement}",
    ),
}
PROPOSITIONS = "propositions array<struct<statement: string>>"
GROUPS = "groups array<struct<group_indices: array<int>, title: string>>"


class Message(NamedTuple):
    """A prompt's two parts; str() joins them."""

    system: str
    user: str

    def __str__(self) -> str:
        return f"{self.system}\n\n{self.user}" if self.system else self.user


class Batch(Protocol):
    """Prompts in, one answer per prompt out. With the attribute `messages` true it gets Message, else text."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class Budget:
    """How a provider is called.

    batch: prompts of a call; in_flight: calls of a task at once; per_second: calls of all tasks together (each task
    gets its share of the slots), None for no limit; rounds: how often a row is asked at most.
    """

    batch: int = 16
    in_flight: int = 8
    per_second: float | None = None
    rounds: int = 3


ONCE = (TimeoutError, ConnectionError)  # what waiting may mend


def retrying(call: Callable, attempts: int = 5, wait: float = 4.0, most: float = 60.0, on: tuple = ONCE) -> Callable:
    """call with exponential waits between attempts after the given errors."""

    def again(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except on:
                if k + 1 == attempts:
                    raise
                time.sleep(min(most, wait * 2**k))

    return again


class Pace:
    """Starts of calls at least `gap` seconds apart, whichever thread makes them."""

    def __init__(self, gap: float):
        self.gap, self.lock, self.next = gap, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.gap:
            with self.lock:
                now = time.monotonic()
                start = max(now, self.next)
                self.next = start + self.gap
            time.sleep(max(0.0, start - now))


def each_answer(call: Callable, prompts: list) -> list[tuple[str | None, str]]:
    """(answer, status) of every prompt: a call that fails is split until the prompt at fault is alone.

    An error that waiting may mend, and has not, fails the whole call at once: splitting would not help.
    """
    try:
        said = list(call(prompts))
        if len(said) != len(prompts):
            raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
        return [(None if a is None else str(a), "ok" if a is not None else "failed: none") for a in said]
    except Exception as error:  # noqa: BLE001  the row's status tells
        if len(prompts) > 1 and not isinstance(error, ONCE):
            half = len(prompts) // 2
            return each_answer(call, prompts[:half]) + each_answer(call, prompts[half:])
        return [(None, f"failed: {type(error).__name__}")] * len(prompts)


def asked_once(frame: DataFrame, make: Callable[[], Batch], out: str, status: str, budget: Budget) -> DataFrame:
    """frame, whose last columns are __system and __user, with an answer and a status instead of these. Lazy."""
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    gap = tasks / budget.per_second if budget.per_second else 0.0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider, pace = make(), Pace(gap)
        whole = getattr(provider, "messages", False)

        def paced(prompts: list):
            pace.wait()
            return provider(prompts)

        call = retrying(paced)
        with ThreadPoolExecutor(budget.in_flight) as pool:
            for part in parts:
                prompts = [Message(s or "", u or "") for s, u in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                prompts = prompts if whole else [str(p) for p in prompts]
                calls = [prompts[at : at + budget.batch] for at in range(0, len(prompts), budget.batch)]
                said = [pair for answers in pool.map(lambda c: each_answer(call, c), calls) for pair in answers]
                made = [pa.array([a for a, _ in said], pa.string()), pa.array([s for _, s in said], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *made], names=[*part.schema.names[:-2], out, status])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-2]]
    return frame.mapInArrow(run, ", ".join([*kept, f"`{out}` string", f"`{status}` string"]))


def ask(frame: DataFrame, prompt: Column, make: Callable[[], Batch], out: str = "answer", status: str = "status", budget: Budget = Budget(), valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """frame with a provider's answers and a status column, as tables; frame has neither column yet.

    prompt: text, or a struct (system, user). valid: whether an answer is of the asked form; others fail too. Rows that
    failed are asked again, in calls of an eighth as many prompts each round; after the last round a row whose answer
    failed has status `failed: ...`, and its answer is null unless only the form was wrong.
    """
    if clash := {out, status} & set(frame.columns):
        raise ValueError(f"columns {sorted(clash)} exist; name others by out and status")
    kind = frame.select(prompt.alias("p")).schema["p"].dataType.typeName()
    system, user = (prompt["system"], prompt["user"]) if kind == "struct" else (F.lit(None).cast("string"), prompt)
    asking, done, size = frame.withColumns({"__system": system, "__user": user}), None, budget.batch
    for turn in range(max(1, budget.rounds)):
        made = asked_once(asking, make, out, status, Budget(size, budget.in_flight, budget.per_second))
        if valid is not None:
            fine = (F.col(status) != "ok") | F.coalesce(valid(F.col(out)), F.lit(False))
            made = made.withColumn(status, F.when(fine, F.col(status)).otherwise("failed: form"))
        made = staged(made, "asked")
        counts = made.agg(F.count("*"), F.count_if(F.col(status) != "ok")).first()
        log.info("%s, round %d: %d rows asked, %d failed", out, turn + 1, *counts)
        last = turn + 1 >= budget.rounds or not counts[1]
        own = made if last else made.where(F.col(status) == "ok")
        done = own if done is None else done.unionByName(own)
        if last:
            break
        asking, size = made.where(F.col(status) != "ok").drop(out, status).withColumns({"__system": system, "__user": user}), max(1, size // 8)
    return done


def prompt(name: str, **parts: Column) -> Column:
    """(system, user) of the named prompt with its places filled by columns."""
    system, out = PROMPTS[name][0], F.lit(PROMPTS[name][1])
    for place, part in parts.items():
        out = F.replace(out, F.lit("{" + place + "}"), F.coalesce(part.cast("string"), F.lit("")))
    return F.struct(F.lit(system).alias("system"), out.alias("user"))


def propositions(text: Column) -> Column:
    """Default: the sentences."""
    return T.sentences(text)


def judge(chunk: Column, answer: Column) -> Column:
    """Default: the normalised answer occurs in the normalised passage."""
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return F.coalesce((F.trim(answer) != "") & F.contains(squeeze(chunk), squeeze(answer)), F.lit(False))


def parse_judgement(answer: Column) -> Column:
    """Exactly YES, in any case and with white space around it."""
    return F.coalesce(F.upper(F.regexp_replace(answer, r"^\s+|\s+$", "")) == "YES", F.lit(False))


def safe_json(text: str | None, fallback=None):
    """The JSON value of a provider's answer without its fence, or the fallback."""
    try:
        body = text.strip()
        if body.startswith("```"):
            body = body.split("\n", 1)[1] if "\n" in body else body.strip("`")
            body = body.rstrip().removesuffix("```")
        return json.loads(body)
    except (AttributeError, ValueError):
        return fallback


def parsed_propositions(answer: Column) -> Column:
    """The non-empty statements of a provider's JSON answer; null where it is not of that form."""
    found = F.from_json(T.json_repair(answer), PROPOSITIONS)["propositions"]
    return F.filter(F.transform(found, lambda p: p["statement"]), lambda t: F.coalesce(t, F.lit("")) != "")


def parsed_groups(answer: Column) -> Column:
    """The groups (group_indices, title) of a provider's JSON answer; null where it is not of that form."""
    found = F.from_json(T.json_repair(answer), GROUPS)["groups"]
    title = lambda g: F.coalesce(g["title"], F.lit("Untitled"))
    return F.transform(found, lambda g: F.struct(F.coalesce(g["group_indices"], F.array().cast("array<int>")).alias("group_indices"), title(g).alias("title")))


def parsed_statements(answer: Column) -> Column:
    """The non-empty statements of a provider's JSON answer; null where it is not of that form."""
    found = F.from_json(T.json_repair(answer), "statements array<string>")["statements"]
    return F.filter(found, lambda t: F.coalesce(t, F.lit("")) != "")


class Embedder(Protocol):
    """Texts in, one vector per text out."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def hashed_vector(text: Column, dim: int) -> Column:
    """Default embedding: term counts by md5 bucket, of unit length (all zero for a text without terms)."""
    bucket = lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int")
    zero = F.array_repeat(F.lit(0.0), dim)
    add = lambda v, b: F.transform(v, lambda x, i: F.when(i == b, x + 1.0).otherwise(x))
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-300)))
    return F.aggregate(F.transform(T.tokens(F.coalesce(text, F.lit(""))), bucket), zero, add, unit)


def buckets(terms: pa.Array, dim: int) -> np.ndarray:
    """The bucket of every term by its md5, -1 for an empty one.

    Most terms of a block are rare, so none are remembered: digests are taken of slices of the terms' bytes and become numbers together.
    """
    if not len(terms):
        return np.empty(0, np.int64)
    own = terms.cast(pa.large_binary())
    ends = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
    data = own.buffers()[2].to_pybytes() if ends[-1] > ends[0] else b""
    firsts = np.frombuffer(b"".join([hashlib.md5(data[a:b]).digest() for a, b in pairwise(ends.tolist())]), ">u4")[::4]
    return np.where(np.diff(ends) > 0, firsts.astype(np.int64) % dim, -1)


def sizes(lists: pa.ListArray) -> np.ndarray:
    """The lengths of lists, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def nested(lengths: np.ndarray, values: pa.Array, mask: pa.Array | None = None) -> pa.ListArray:
    """Lists of these lengths of the values, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), values, mask=mask)


def bucket_counts(terms: pa.ListArray, dim: int) -> np.ndarray:
    """How many terms of every list fall into each bucket."""
    flat = terms.flatten().dictionary_encode()
    own = buckets(flat.dictionary, dim)[flat.indices.to_numpy()] if len(flat) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(terms)), sizes(terms))
    return np.bincount((row * dim + own)[own >= 0], minlength=len(terms) * dim).reshape(len(terms), dim).astype(float)


def unit(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(np.sqrt((counts * counts).sum(1, keepdims=True)), 1e-300)


def hashed_vectors(frame: DataFrame, texts: str, dim: int, out: str = "vectors") -> DataFrame:
    """frame with hashed_vector() of every element of an array of texts; buckets are counted in Arrow batches."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            rows = part.column(part.num_columns - 1)
            vectors = unit(bucket_counts(rows.flatten(), dim))
            made = nested(sizes(rows), nested(np.full(len(vectors), dim), pa.array(vectors.ravel())), rows.is_null())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], out])

    terms = F.transform(texts, lambda t: T.tokens(F.coalesce(t, F.lit(""))))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.withColumn("__terms", terms).mapInArrow(run, f"{kept}, `{out}` array<array<double>>")


def hashed_likeness(frame: DataFrame, texts: str, dim: int, out: str = "near", size: int = 1) -> DataFrame:
    """frame with the cosines of hashed_vector() of each two neighbouring runs of `size` texts of an array; 0 where one has no terms."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            rows = part.column(part.num_columns - 1)
            counts, many = bucket_counts(pc.ascii_split_whitespace(rows.flatten()), dim), sizes(rows)
            if size > 1 and len(counts):
                at = np.arange(len(counts)) - np.repeat(np.cumsum(many) - many, many)  # within the row
                counts, many = np.add.reduceat(counts, np.flatnonzero(at % size == 0)), -(-many // size)
            long = np.sqrt((counts * counts).sum(1))
            near = (counts[:-1] * counts[1:]).sum(1) / np.maximum(long[:-1] * long[1:], 1e-300)
            row = np.repeat(np.arange(len(rows)), many)
            made = nested(np.maximum(many - 1, 0), pa.array(near[row[:-1] == row[1:]]), rows.is_null())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], out])

    lowered = F.transform(texts, lambda t: F.lower(F.coalesce(t, F.lit(""))))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.withColumn("__lowered", lowered).mapInArrow(run, f"{kept}, `{out}` array<double>")


def embed(frame: DataFrame, texts: str, make: Callable[[], Embedder], out: str = "vectors", batch: int = 128, in_flight: int = 4) -> DataFrame:
    """frame with the vectors of an array of texts; null for a row one of whose texts failed.

    Texts are sent `batch` at a time, with `in_flight` calls at once; a call that fails is split, so one text that
    cannot be embedded costs its own row.
    """

    def each(call: Callable, some: list[str]) -> list:
        try:
            made = [[float(x) for x in v] for v in call(some)]
            if len(made) != len(some):
                raise ValueError(f"{len(made)} vectors for {len(some)} texts")
            return made
        except Exception as error:  # noqa: BLE001  a null vector tells
            if len(some) > 1 and not isinstance(error, ONCE):
                return each(call, some[: len(some) // 2]) + each(call, some[len(some) // 2 :])
            return [None] * len(some)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retrying(make())
        with ThreadPoolExecutor(in_flight) as pool:
            for part in parts:
                rows = part.column(part.schema.get_field_index(texts)).to_pylist()
                flat = [t or "" for row in rows for t in row or ()]
                made = iter([v for some in pool.map(lambda c: each(call, c), [flat[at : at + batch] for at in range(0, len(flat), batch)]) for v in some])
                vectors = [None if row is None else [next(made) for _ in row] for row in rows]
                vectors = [None if v is None or any(x is None for x in v) else v for v in vectors]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.list_(pa.float64())))], names=[*part.schema.names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{kept}, `{out}` array<array<double>>")


def answer(context: Column) -> Column:
    """Default answer: the first sentence of the context's first document."""
    first = F.regexp_extract(context, r'^<document index="1">\n([\s\S]*?)\n</document>', 1)
    return F.coalesce(F.get(T.sentences(first), F.lit(0)), F.lit(""))


def faithfulness(said: Column, context: Column) -> Column:
    """Default: the share of an answer's sentences that its context holds."""
    parts = T.sentences(said)
    held = F.size(F.filter(parts, lambda s: F.contains(F.lower(context), F.lower(s))))
    return F.coalesce(F.when(F.size(parts) > 0, held.cast("double") / F.size(parts)), F.lit(0.0))


def factual_correctness(said: Column, truth: Column) -> Column:
    """Default: F1 of the claims of both sides; a claim, here a sentence, holds where the other side contains it."""
    a, b = T.sentences(said), T.sentences(truth)
    held = lambda parts, whole: F.size(F.filter(parts, lambda s: F.contains(F.lower(whole), F.lower(s)))).cast("double")
    precision, recall = held(a, truth) / F.size(a), held(b, said) / F.size(b)
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0) & (precision + recall > 0), 2 * precision * recall / (precision + recall)), F.lit(0.0))


def token_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """Makes counters of the tokens of a text under a tokenizer file (JSON), for chunk sizes; one per partition."""

    def make():
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda text: len(own.encode(text, add_special_tokens=False).ids)

    return make
