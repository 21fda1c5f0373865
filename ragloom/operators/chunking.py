"""Chunking strategies: token windows, heuristic with overlap, semantic breaks, and proposition groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.config import DEFAULTS, Settings
from ragloom.functions import providers as P
from ragloom.functions import text as T
from ragloom.sources.staging import pieces, spread

HEAD, BODY = "\u0001", "\u0002"
MAX_GROUP = 15


def split_headers(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, header, body): the text before the first header has header ''."""
    marked = F.regexp_replace(F.col(text), r"(?dm)^(#+\s+.*)$", f"{HEAD}$1{BODY}")
    parts = frame.select(key, F.posexplode(F.split(marked, HEAD)).alias("section", "part")).where("part <> ''")
    has = F.instr("part", BODY) > 0
    header = F.when(has, F.substring_index("part", BODY, 1)).otherwise("")
    body = F.when(has, F.substring_index("part", BODY, -1)).otherwise(F.col("part"))
    return parts.select(key, F.col("section").cast("long").alias("section"), T.strip(header).alias("header"), T.strip(body).alias("body"))


def macro_split(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, text): header and body joined by a line break; header-only sections at the end go."""
    own = split_headers(frame, key, text)
    blank = F.col("body") == ""
    last = F.max(F.when(~blank, F.col("section"))).over(Window.partitionBy(key))
    whole = F.when(F.col("header") == "", F.col("body")).otherwise(F.concat_ws("\n", F.nullif("header", F.lit("")), F.nullif("body", F.lit(""))))
    return own.withColumn("__last", last).where(F.col("section") <= F.col("__last")).where(whole != "").select(key, "section", whole.alias("text"))


def split_sentences(frame: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, sentence)."""
    return numbered(frame, keys, T.sentences(F.col(text)), "pos", "sentence")


def numbered(frame: DataFrame, keys: list[str], parts: Column, pos: str, out: str) -> DataFrame:
    """(keys, pos, out): the elements of an array, one row each."""
    return frame.select(*keys, F.posexplode(parts).alias(pos, out)).withColumn(pos, F.col(pos).cast("long"))


def merged_short(sentences: Column, least: int = DEFAULTS.min_sentence_chars) -> Column:
    """A sentence under `least` characters joins the one before it; a first one stays. One pass: join, then cut at marks."""
    marked = lambda ss: F.transform(ss, lambda s, i: F.concat(F.when(i == 0, F.lit("")).when(F.length(s) >= least, F.lit(HEAD)).otherwise(F.lit(" ")), s))
    return bound(sentences, lambda ss: F.when(F.size(ss) > 0, F.split(F.array_join(marked(ss), ""), HEAD)).otherwise(F.array().cast("array<string>")))


def windowed(sentences: Column, size: int = DEFAULTS.window_sentences) -> Column:
    """Tumbling windows of `size` sentences joined by a space, the last may be short."""
    starts = F.sequence(F.lit(0), F.floor((F.size(sentences) - 1) / size).cast("int"))
    joined = F.transform(starts, lambda w: F.array_join(F.slice(sentences, w * size + 1, F.lit(size)), " "))
    return F.when(F.size(sentences) > 0, joined).otherwise(F.array().cast("array<string>"))


def merge_short(frame: DataFrame, keys: list[str], text: str, least: int = DEFAULTS.min_sentence_chars) -> DataFrame:
    """(keys, pos, sentence) after merging, without a shuffle."""
    return numbered(frame, keys, merged_short(T.sentences(F.col(text)), least), "pos", "sentence")


def sentence_windows(frame: DataFrame, keys: list[str], text: str, size: int = DEFAULTS.window_sentences) -> DataFrame:
    """(keys, win, window) over merged sentences, without a shuffle."""
    merged = frame.select(*keys, merged_short(T.sentences(F.col(text))).alias("__m"))
    return numbered(merged, keys, windowed(F.col("__m"), size), "win", "window")


def token_windows(frame: DataFrame, key: str, text: str, size: int = DEFAULTS.chunk_tokens, overlap: int = DEFAULTS.overlap_tokens) -> DataFrame:
    """(key, chunk_index, text, token_count): windows of `size` tokens with stride size - overlap."""
    words, step = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""), size - overlap
    own = frame.select(F.col(key).alias("__key"), words.alias("w")).where(F.size("w") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - F.lit(overlap)) / F.lit(float(step)))).cast("int")
    cut = own.select("__key", "w", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    part = F.slice("w", F.col("chunk_index") * step + 1, F.lit(size))
    return cut.select(F.col("__key").alias(key), F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(part, " ").alias("text"), F.size(part).cast("long").alias("token_count"))


def heuristic_units(units: list[tuple[str, int]], size: int, overlap: int, count: Callable[[str], int] = lambda s: len(s.split())) -> list[tuple[str, int]]:
    """Chunks of (text, tokens) from units of (text, tokens), by any token counter.

    A chunk ends with the unit that fills `size`. The next one starts with the longest tail of whole units within
    `overlap` tokens and, if room is left, that many of the last words of the unit before, counted anew.
    """
    chunks, lead, start = [], [], 0  # lead: the carried text and its tokens; start: the first fresh unit
    ends = list(accumulate((n for _, n in units), initial=0))
    while start < len(units):
        need = size - sum(n for _, n in lead)
        stop = min(max(bisect_left(ends, ends[start] + need), start + 1), len(units))
        body = [*lead, *units[start:stop]]
        chunks.append((" ".join(t for t, _ in body), sum(n for _, n in body)))
        tail = list(accumulate((n for _, n in reversed(body)), initial=0))
        whole = bisect_right(tail, overlap) - 1
        lead, room = body[len(body) - whole :], overlap - tail[whole]
        if whole < len(body) and room > 0:
            rest = " ".join(body[-whole - 1][0].split(" ")[-room:])
            lead = [(rest, count(rest)), *lead]
        start = stop
    return chunks


def cuts(lengths: Column, size: int, overlap: int) -> Column:
    """(a, b) word ranges of chunks, from the numbers of words of a text's sentences; the text has one word at least."""
    stride = size - overlap
    empty = lambda total: F.struct(F.lit(0).alias("start"), F.lit(0).alias("at"), total.alias("total"), F.array().cast("array<struct<a:int,b:int>>").alias("cuts"))

    def step(s, n):
        """A short sentence that fills the chunk ends it; a sentence longer than a chunk ends chunks wherever they are full."""
        end = s["at"] + n
        single = (n <= size) & (end - s["start"] >= size) & (end < s["total"])
        full = s["start"] + size
        last = F.least(end, s["total"] - 1)  # where a chunk that is not the last may end
        long = (n > size) & (full <= last)
        spots = F.transform(F.sequence(full, F.greatest(full, last), F.lit(stride)), lambda b: F.struct((b - size).alias("a"), b.alias("b")))
        start = F.when(single, end - overlap).when(long, full + F.floor((last - full) / stride).cast("int") * stride - overlap).otherwise(s["start"])
        made = F.when(single, F.concat(s["cuts"], F.array(F.struct(s["start"].alias("a"), end.alias("b"))))).when(long, F.concat(s["cuts"], spots)).otherwise(s["cuts"])
        return F.struct(start.alias("start"), end.alias("at"), s["total"].alias("total"), made.alias("cuts"))

    ended = lambda s: F.concat(s["cuts"], F.array(F.struct(s["start"].alias("a"), s["total"].alias("b"))))
    return F.aggregate(lengths, empty(F.aggregate(lengths, F.lit(0), lambda t, n: t + n)), step, ended)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def heuristic_chunks(frame: DataFrame, key: str, text: str, settings: Settings = DEFAULTS, make_count: Callable[[], Callable[[str], int]] | None = None, parts: Column | None = None) -> DataFrame:
    """(key, chunk_index, text, token_count): sentences gathered to a token size, with overlap.

    Tokens are white-space words by default. Then a chunk is a run of words that ends with a sentence and starts
    `overlap` words before the last one's end, so cuts are a fold over the sentences' lengths and all stays in
    expressions. make_count: makes another token counter per partition, which cuts documents in Arrow batches.
    parts: an array column of sentences, for example of a trained splitter; by default they end at . ! or ?.
    """
    size, overlap = settings.chunk_tokens, settings.overlap_tokens
    frame = spread(frame.select(key, text) if parts is None else frame, key)
    sentences = F.transform(T.sentences(F.col(text)) if parts is None else parts, lambda s: F.trim(F.replace(s, F.lit("\n"), F.lit(" "))))
    if make_count is None:
        words = F.transform(sentences, lambda s: F.filter(F.split(s, " "), lambda w: w != ""))
        spots = lambda ws: F.when(F.exists(ws, lambda w: F.size(w) > 0), bound(F.transform(ws, lambda w: F.size(w)), lambda n: cuts(n, size, overlap)))
        cut = lambda w, c: F.struct(F.array_join(F.slice(w, c["a"] + 1, c["b"] - c["a"]), " ").alias("text"), (c["b"] - c["a"]).cast("long").alias("n"))
        told = bound(words, lambda ws: bound(F.flatten(ws), lambda w: F.transform(spots(ws), lambda c: cut(w, c))))  # a chunk's row has its own words only
        one = frame.select(F.col(key).alias("__key"), F.posexplode(told).alias("i", "c"))
        return one.select(F.col("__key").alias(key), F.col("i").cast("long").alias("chunk_index"), F.col("c.text").alias("text"), F.col("c.n").alias("token_count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make_count()
        for b in pieces(batches):
            rows = []
            for k, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                units = []
                for s in parts or ():
                    n = count(s)
                    units += [(s, n)] if n <= size else [(w, count(w)) for w in s.split(" ") if w]
                rows += [(k, i, t, n) for i, (t, n) in enumerate(heuristic_units([u for u in units if u[0]], size, overlap, count))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.schema.types[0], pa.int64(), pa.string(), pa.int64()))], names=[key, "chunk_index", "text", "token_count"])

    own = frame.select(key, sentences.alias("parts"))
    return own.mapInArrow(run, f"`{key}` {frame.schema[key].dataType.simpleString()}, chunk_index long, text string, token_count long")


def semantic_chunks(frame: DataFrame, key: str, text: str, settings: Settings = DEFAULTS, dim: int = 64, embedder: Callable[[], P.Embedder] | None = None) -> DataFrame:
    """(key, chunk_index, header, text): sections break where neighbouring sentence windows differ.

    Sections of one window, or whose embedding failed, are one chunk with the raw body. A section stays in its row:
    sentences, windows, vectors and cuts are arrays; only the numbering of a document's chunks needs a shuffle.
    embedder: makes another embedding.
    """
    size = settings.window_sentences
    sections = split_headers(spread(frame.select(key, text), key), key, text).where("body <> ''")
    own = sections.withColumn("m", merged_short(T.sentences(F.col("body")), settings.min_sentence_chars))
    n = F.ceil(F.size("m") / size).cast("int")
    if embedder is None:  # a section is either cut or kept raw: one of its forms goes through Python
        own = P.hashed_likeness(own.select(key, "section", "header", F.when(n <= 1, F.col("body")).alias("body"), F.when(n > 1, F.col("m")).alias("m")), "m", dim, size=size)
    else:
        own = own.withColumn("windows", windowed(F.col("m"), size))
        near = F.zip_with(F.slice("vectors", 1, n - 1), F.slice("vectors", 2, n - 1), T.cosine)
        own = P.embed(own, "windows", embedder).withColumn("near", F.when(F.col("vectors").isNotNull(), near))
    own = own.withColumn("sims", F.when(n > 1, F.transform("near", lambda s: F.round(s, 6))))
    mark = lambda i: F.when(i == 0, F.lit("")).when((i % size == 0) & (F.get(F.col("sims"), (i / size).cast("int") - 1) < settings.similarity_threshold), F.lit(HEAD)).otherwise(F.lit(" "))
    cut = F.split(F.array_join(F.transform("m", lambda s, i: F.concat(mark(i), s)), ""), HEAD)
    parts = own.select(key, "section", "header", F.posexplode(F.when(F.col("sims").isNull(), F.array("body")).otherwise(cut)).alias("g", "text"))
    order = Window.partitionBy(key).orderBy("section", "g")
    return parts.select(key, (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), "header", "text")


def repaired_groups(groups: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, group_pos, title, idx): the first group to name a valid index keeps it; the rest is "Miscellaneous".

    groups: (key, group_pos, title, group_indices); sizes: (key, n). Without any usable group all is "Single Topic".
    """
    named = groups.select(key, "group_pos", "title", F.explode(F.array_distinct("group_indices")).alias("idx")).join(sizes, key).where("idx >= 0 and idx < n")
    first = Window.partitionBy(key, "idx").orderBy("group_pos")
    kept = named.withColumn("r", F.row_number().over(first)).where("r = 1").select(key, "group_pos", "title", "idx")
    every = sizes.where("n > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("idx"))
    left = every.join(kept, [key, "idx"], "left_anti")
    any_kept = kept.select(F.col(key).alias("__k")).distinct()
    rest = left.join(any_kept, left[key] == any_kept["__k"], "left").select(key, F.lit(1 << 20).cast("long").alias("group_pos"), F.when(F.col("__k").isNull(), F.lit("Single Topic")).otherwise(F.lit("Miscellaneous")).alias("title"), "idx")
    return kept.withColumn("group_pos", F.col("group_pos").cast("long")).unionByName(rest)


def agentic_chunks(frame: DataFrame, key: str, text: str, status: Column | None = None, group: int = MAX_GROUP, propose: Callable[[], P.Batch] | None = None, arrange: Callable[[], P.Batch] | None = None, budget: P.Budget = P.Budget()) -> DataFrame:
    """(key, chunk_index, group_title, text, fallback): propositions grouped per section.

    propose and arrange make providers that answer the prompts for propositions and for groups with JSON; a section whose
    answer failed or was not of the asked form is asked again as the budget allows; answers are repaired (repaired_groups). By default propositions are sentences and groups runs of `group` of them; a section of
    one is "Single Topic". Documents whose status is not `ok`, or one of whose answers failed or was not of the asked
    form, become one chunk with the whole text.
    """
    own = spread(frame, key).select(key, F.col(text).alias("__t"), (F.lit("ok") if status is None else status).alias("__s"))
    sections = macro_split(own.where("__s = 'ok'"), key, "__t")
    if propose is None:
        listed = sections.select(key, "section", P.propositions(F.col("text")).alias("props"))
    else:
        asked = P.ask(sections, P.prompt("propositions", text=F.col("text")), propose, budget=budget, valid=lambda a: P.parsed_propositions(a).isNotNull())
        listed = asked.select(key, "section", F.when(F.col("status") == "ok", P.parsed_propositions(F.col("answer"))).alias("props"))
    if arrange is None:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("props") - 1) / group).cast("int")), lambda g: F.struct(F.concat(F.lit("Part "), (g + 1).cast("string")).alias("title"), F.slice("props", g * group + 1, F.lit(group)).alias("said")))
        single = F.array(F.struct(F.lit("Single Topic").alias("title"), F.col("props").alias("said")))
        grouped = listed.select(key, "section", F.when(F.size("props") > 1, runs).when(F.size("props") == 1, single).when(F.col("props").isNotNull(), F.slice(single, 1, 0)).alias("groups"))
    else:
        numbers = F.array_join(F.transform("props", lambda p, i: F.concat(i.cast("string"), F.lit(": "), p)), "\n")
        asked = P.ask(listed.where(F.size("props") > 1), P.prompt("grouping", propositions=numbers), arrange, budget=budget, valid=lambda a: P.parsed_groups(a).isNotNull())
        named = asked.select(key, "section", "props", F.when(F.col("status") == "ok", P.parsed_groups(F.col("answer"))).alias("made"))
        alone = listed.where(F.coalesce(F.size("props"), F.lit(-1)) <= 1).withColumn("made", F.when(F.col("props").isNotNull(), F.array().cast("array<struct<group_indices:array<int>,title:string>>")))
        both = named.unionByName(alone).withColumn("__id", F.struct(key, "section"))
        usable = both.where(F.col("made").isNotNull())
        groups = usable.select("__id", F.posexplode("made").alias("group_pos", "g")).select("__id", "group_pos", "g.title", "g.group_indices")
        placed = repaired_groups(groups, usable.select("__id", F.size("props").alias("n")), "__id")
        said = placed.join(usable.select("__id", "props"), "__id").select("__id", "group_pos", "title", F.struct("idx", F.get("props", F.col("idx")).alias("p")).alias("s"))
        body = said.groupBy("__id", "group_pos", "title").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["p"]).alias("said"))
        lists = body.groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(F.struct("group_pos", "title", "said"))), lambda g: F.struct(g["title"].alias("title"), g["said"].alias("said"))).alias("groups"))
        none = F.array().cast(lists.schema["groups"].dataType)
        grouped = both.join(lists, "__id", "left").select(key, "section", F.when(F.col("made").isNotNull(), F.coalesce("groups", none)).alias("groups"))
    merged = grouped.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("section", "groups"))).alias("s"))
    broken = F.exists("s", lambda s: s["groups"].isNull())
    every = F.flatten(F.transform("s", lambda s: s["groups"]))
    made = merged.where(~broken).select(key, F.posexplode(every).alias("chunk_index", "g"))
    made = made.select(key, F.col("chunk_index").cast("long").alias("chunk_index"), F.col("g.title").alias("group_title"), F.concat_ws("\n", "g.title", F.array_join("g.said", " ")).alias("text"), F.lit(False).alias("fallback"))
    failed = own.where("__s <> 'ok'")
    if propose is not None or arrange is not None:
        failed = failed.unionByName(own.join(merged.where(broken).select(key), key, "left_semi"))
    failed = failed.select(key, F.lit(0).cast("long").alias("chunk_index"), F.lit(None).cast("string").alias("group_title"), F.col("__t").alias("text"), F.lit(True).alias("fallback"))
    return made.unionByName(failed)


STRATEGIES = {"heuristic": heuristic_chunks, "semantic": semantic_chunks, "agentic": agentic_chunks}


def chunk(strategy: str, frame: DataFrame, key: str, text: str, **knobs) -> DataFrame:
    """(chunk_id, strategy, source_id, chunk_index, text, metadata) by any strategy; ValueError for an unknown one.

    metadata maps the names of what else the strategy tells of a chunk (token_count, header, group_title, fallback).
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    own = STRATEGIES[strategy](frame, key, text, **knobs)
    told = {c: F.col(c) for c in own.columns if c not in (key, "chunk_index", "text")}
    chunk_id = T.chunk_id(F.lit(strategy), F.col(key), F.col("chunk_index"))
    return own.select(chunk_id.alias("chunk_id"), F.lit(strategy).alias("strategy"), F.col(key).cast("string").alias("source_id"), "chunk_index", "text", T.metadata(**told).alias("metadata"))
