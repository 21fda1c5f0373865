"""Trained sentence boundaries: abbreviations, collocations and sentence starters learned from the corpus without labels.

The statistics are those of unsupervised multilingual boundary detection (Kiss and Strunk, 2006): a type that is nearly
always followed by a period, and is short, is an abbreviation; a period after one ends a sentence only if what follows
looks like a beginning. Training counts tokens and their neighbours of all texts once, in one aggregation, and everything
else is derived from those counts. Nothing that was learned is left out: every task holds a model of at most MOST entries of a kind;
a larger one stays in tables, with which the places where texts may be cut are joined.

A text is cut after . ! or ?, and closing quotes or brackets, before white space. Null and blank texts have no sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.sources.staging import pieces, spread, staged

MOST = 100_000
COUNTED = 200_000  # counts that a task holds before it gives them on
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0  # least scores
NUMBER = "##number##"
#: Places a type was seen in: capital first at a sentence's beginning and within, small first at the beginning and within.
UP_BEGIN, UP_WITHIN, LOW_BEGIN, LOW_WITHIN = 1, 2, 4, 8
EDGES, DIGITS, ENDING = r"^[^\p{L}\p{N}.]+|[^\p{L}\p{N}.]+$", r"^[-+.]*\p{N}[\p{N},.\-]*$", "[.!?][\"')\\]}”’»]*"


class Model(NamedTuple):
    """What training found; a set or dict of each kind."""

    abbreviations: frozenset[str]
    collocations: frozenset[tuple[str, str]]
    starters: frozenset[str]
    places: dict[str, int]  # of types that follow a period which may not end a sentence


class Tables(NamedTuple):
    """A model that tasks need not hold: a staged table of each kind."""

    abbreviations: DataFrame  # (type)
    collocations: DataFrame  # (type, next)
    starters: DataFrame  # (type)
    places: DataFrame  # (type, places)


def bare(token: Column) -> Column:
    return F.regexp_replace(token, EDGES, "")


def type_of(token: Column) -> Column:
    """Lower-cased, without edges and the final period; numbers are one type."""
    own = F.regexp_replace(F.lower(bare(token)), r"\.$", "")
    return F.when(F.rlike(own, F.lit(DIGITS)), F.lit(NUMBER)).otherwise(own)


def token_pairs(texts: DataFrame, text: str) -> DataFrame:
    """(type, dot, mark, next, up, n): counts of neighbouring tokens. mark: what may end a sentence; up: case of the next, null if none.

    Neighbours are counted as they are written, so that each different pair is taken apart once.
    """
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    both = F.transform(F.array(words), lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.get(ws, i + 1).alias("n"))))[0]
    rows = spread(texts.select(text)).select(F.explode(both).alias("p")).groupBy(F.col("p.w").alias("w"), F.col("p.n").alias("n")).agg(F.count("*").alias("c"))
    return typed(rows, F.rlike("type", F.lit(r"[\p{L}\p{N}#]")))


def typed(rows: DataFrame, kept: Column) -> DataFrame:
    """token_pairs of (w, n, c), counts of neighbours as written: the rows of the condition `kept` on w and type."""
    mark = F.regexp_extract("w", rf"({ENDING})$", 1)
    first = F.substring(bare(F.col("n")), 1, 1)
    up = F.when(F.rlike(first, F.lit(r"\p{Lu}")), True).when(F.rlike(first, F.lit(r"\p{Ll}")), False)
    own = rows.select("w", type_of(F.col("w")).alias("type"), F.endswith(bare(F.col("w")), F.lit(".")).alias("dot"), F.substring(mark, 1, 1).alias("mark"), type_of(F.col("n")).alias("next"), up.alias("up"), "c")
    return own.where(kept).groupBy("type", "dot", "mark", "next", "up").agg(F.sum("c").alias("n"))


def token_counts(texts: DataFrame, text: str) -> DataFrame:
    """(type, dot, n): counts of tokens without their neighbours, all that abbreviation_scores asks for; a staged table."""
    words = spread(texts.select(text)).select(F.explode(F.split(F.col(text), r"\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("c"))
    return typed_alone(words)


def typed_alone(words: DataFrame) -> DataFrame:
    """token_counts of (w, c), counts of tokens as written."""
    own = words.select(type_of(F.col("w")).alias("type"), F.endswith(bare(F.col("w")), F.lit(".")).alias("dot"), "c")
    return staged(own.where(F.rlike("type", F.lit(r"[\p{L}\p{N}#]"))).groupBy("type", "dot").agg(F.sum("c").alias("n")), "tokens")


class Kinds(dict):
    """What training asks of a token before its neighbour: all where a period may end a sentence there, else the mark or nothing; null without a letter or digit."""

    def __missing__(self, w: str) -> str | None:
        mark = _MARK.search(w)
        if mark and mark.group()[0] == ".":
            own = w
        else:
            own = (mark.group()[0] if mark else "") if _REAL.search(plain_type(w)) else None
        return self.setdefault(w, own)


def counted(texts: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, pairs): token_counts, and token_pairs with a neighbour, where all types that no period follows are one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pairs, kinds = Counter(), Counter(), Kinds()

        def given() -> pa.RecordBatch:
            rows = [(w, None, c) for w, c in own.items()] + [(w, n, c) for (w, n), c in pairs.items() if w is not None]
            for held in (own, pairs, kinds):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["w", "n", "c"])

        for part in pieces(parts):
            for t in part.column(0).to_pylist():
                words = _TOKEN.findall(t or "")
                own.update(words)
                pairs.update(zip([kinds[w] for w in words[:-1]], words[1:]))
                if len(own) + len(pairs) > COUNTED:
                    yield given()
        yield given()

    rows = spread(texts.select(text)).mapInArrow(run, "w string, n string, c long").groupBy("w", "n").agg(F.sum("c").alias("c"))
    rows = staged(rows, "counted")
    kept = F.col("w").isin("", "!", "?") | F.rlike("type", F.lit(r"[\p{L}\p{N}#]"))
    return typed_alone(rows.where("n is null").select("w", "c")), staged(typed(rows.where("n is not null"), kept), "pairs")


def likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's ratio: how far ab joint cases among a exceed what b among n foretells."""
    p, p1, p2 = b / n, ab / a, (b - ab) / F.greatest(n - a, F.lit(1))
    term = lambda k, m, q: k * F.log(F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))) + (m - k) * F.log(F.least(F.greatest(1 - q, F.lit(1e-12)), F.lit(1.0)))
    return -2 * (term(ab, a, p) + term(b - ab, n - a, p) - term(ab, a, p1) - term(b - ab, n - a, p2))


def abbreviation_scores(pairs: DataFrame) -> DataFrame:
    """(type, dots, others, score) of every type that was seen with a period: high where the period belongs to the type."""
    known = pairs.where(F.col("type") != NUMBER)
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("d"))
    n, d = total.select("n").scalar(), total.select("d").scalar()
    own = known.groupBy("type").agg(F.sum(F.when(F.col("dot"), F.col("n")).otherwise(0)).alias("dots"), F.sum(F.when(F.col("dot"), 0).otherwise(F.col("n"))).alias("others")).where("dots > 0")
    p, k, m = F.least(d / n, F.lit(1 - 1e-9)), F.col("dots"), F.col("others")
    ratio = -2 * (k * F.log(p) + m * F.log(1 - p) - k * F.log(F.lit(0.99)) - m * F.log(F.lit(0.01)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    size = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(F.greatest(size, F.lit(1.0)), -m)
    return own.select("type", "dots", "others", score.alias("score"))


def train(texts: DataFrame, text: str, most: int = MOST) -> Model | Tables:
    """The whole model of all texts; as tables if it has more than `most` entries of a kind."""
    tokens, pairs = counted(texts, text)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    scores = abbreviation_scores(tokens).where(F.col("score") >= ABBREVIATION)
    short = staged(scores.select("type"), "abbreviations")
    known = short.withColumn("abbreviation", F.lit(True))
    known = F.broadcast(known) if short.count() <= most else known
    initial = F.rlike("type", F.lit(r"^\p{L}$"))
    told = pairs.join(known, "type", "left").withColumn("open", F.coalesce("abbreviation", F.lit(False)) | initial | (F.col("type") == NUMBER))
    ends = (F.col("mark") != "") & ~(F.col("open") & (F.col("mark") == "."))
    by_type = tokens.groupBy("type").agg(F.sum("n").alias("c"))
    after = told.where(ends & F.col("next").isNotNull()).groupBy(F.col("next").alias("type")).agg(F.sum("n").alias("ab"))
    breaks = told.where(ends & F.col("next").isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    starters = after.join(by_type, "type").where(F.rlike("type", F.lit(r"^\p{L}"))).where((likelihood(breaks, F.col("c"), F.col("ab"), total) >= STARTER) & (total * F.col("ab") > breaks * F.col("c")))
    joined = told.where(F.col("open") & F.col("dot") & (F.col("mark") == ".") & F.col("next").isNotNull()).groupBy("type", "next").agg(F.sum("n").alias("ab"))
    joined = joined.join(by_type.withColumnRenamed("c", "a"), "type").join(by_type.select(F.col("type").alias("next"), F.col("c").alias("b")), "next")
    collocations = joined.where(F.rlike("next", F.lit(r"^\p{L}"))).where((likelihood(F.col("a"), F.col("b"), F.col("ab"), total) >= COLLOCATION) & (total * F.col("ab") > F.col("a") * F.col("b")) & (F.col("ab") > 1))
    where = F.when(ends, F.when(F.col("up"), UP_BEGIN).otherwise(LOW_BEGIN)).when(F.col("mark") == "", F.when(F.col("up"), UP_WITHIN).otherwise(LOW_WITHIN))
    seen = told.where(F.col("up").isNotNull()).select(F.col("next").alias("type"), where.alias("place"), "n").where("place is not null").groupBy("type").agg(F.bit_or("place").alias("places"))
    wanted = told.where(F.col("open") & (F.col("mark") == ".")).select(F.col("next").alias("type")).distinct()
    places = seen.join(wanted, "type", "left_semi")
    made = Tables(short, staged(collocations.select("type", "next"), "collocations"), staged(starters.select("type"), "starters"), staged(places, "places"))
    if max(table.count() for table in made) > most:
        return made
    rows = [[tuple(r) for r in table.collect()] for table in made]  # `most` of a kind at most
    return Model(frozenset(t for (t,) in rows[0]), frozenset(rows[1]), frozenset(t for (t,) in rows[2]), dict(rows[3]))


_EDGES, _DIGITS, _CANDIDATE = regex.compile(EDGES), regex.compile(DIGITS), regex.compile(rf"{ENDING}[ \t\n\x0b\f\r]+")
_TOKEN, _MARK, _REAL = regex.compile(r"[^ \t\n\x0b\f\r]+"), regex.compile(rf"{ENDING}\Z"), regex.compile(r"[\p{L}\p{N}#]")


def plain_type(token: str) -> str:
    own = _EDGES.sub("", token).lower()
    own = own[:-1] if own.endswith(".") else own
    return NUMBER if _DIGITS.match(own) else own


def told_apart(before: str, after: str) -> tuple[str, str, str]:
    """(own, following, first): all that a decision asks of two neighbours, their types and the first character of the second."""
    return plain_type(before), plain_type(after), _EDGES.sub("", after)[:1]


def ends_here(before: str, after: str, model: Model) -> bool:
    """Whether the period of the token `before` ends a sentence that `after` follows."""
    own, following, first = told_apart(before, after)
    short = own in model.abbreviations or own.rsplit("-", 1)[-1] in model.abbreviations
    return decided(own, first, short, (own, following) in model.collocations, following in model.starters, model.places.get(following, 0))


def decided(own: str, first: str, short: bool, joined: bool, starter: bool, places: int) -> bool:
    """The same from what the model knows of both: own is an abbreviation, both are a collocation, the second starts sentences."""
    initial, number, dots = len(own) == 1 and own.isalpha(), own == NUMBER, not regex.search(r"[\p{L}\p{N}]", own) and own != NUMBER
    if joined:
        return False
    begins = None  # whether `after` looks like a beginning
    if not first or not (first.isalpha() or first.isdigit()):
        begins = False
    elif first.isupper() and places & (LOW_BEGIN | LOW_WITHIN) and not places & UP_WITHIN:
        begins = True
    elif first.islower() and (places & (UP_BEGIN | UP_WITHIN) or not places & LOW_BEGIN):
        begins = False
    if (short or dots) and not initial:
        return begins is True or (first.isupper() and starter)
    if initial or number:
        if begins is False:
            return False
        if begins is None and initial and first.isupper() and not places & (LOW_BEGIN | LOW_WITHIN):
            return False
    return True


def stops(text: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(end, before, after) of each place where text may be cut; no neighbours where a mark other than a period cuts it anyway."""
    low = 0
    for m in _CANDIDATE.finditer(text):
        if m.end() == len(text):
            break
        if m.group()[0] == ".":
            left = max(text.rfind(c, low, m.start()) for c in " \t\n\x0b\f\r") + 1
            yield m.end(), text[max(left, low) : m.start() + 1], _TOKEN.match(text, m.end()).group()
        else:
            yield m.end(), None, None
        low = m.end()


def cut(text: str, ends: list[int]) -> list[str]:
    return [s for a, b in zip([0, *ends], [*ends, len(text)]) if (s := text[a:b].strip())]


def plain_sentences(text: str | None, model: Model) -> list[str]:
    """The sentences of one text."""
    text = text or ""
    return cut(text, [end for end, before, after in stops(text) if before is None or ends_here(before, after, model)])


def held_stops(texts: DataFrame, row: str, text: str, model: Tables) -> DataFrame:
    """(row, __held): the ends of stops that do not end a sentence. Each different pair of neighbours is decided once, by joins with the model."""
    neighbours = ["own", "following", "first"]

    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            ids = part.column(part.schema.get_field_index(row)).to_pylist()
            made = [(k, end, *told_apart(before, after)) for k, t in zip(ids, part.column(part.schema.get_field_index(text)).to_pylist()) for end, before, after in stops(t or "") if before is not None]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in made], kind) for j, kind in enumerate(kinds)], names=[row, "end", *neighbours])

    def held(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            asked = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("own", "first", "short", "joined", "starter", "places")]
            mine = pa.array([not decided(*values) for values in zip(*asked)], pa.bool_())
            yield part.select(neighbours).filter(mine)

    every = staged(texts.select(row, text).mapInArrow(found, f"`{row}` long, end long, own string, following string, first string"), "stops")
    marked = lambda table, name, **keys: table.withColumnsRenamed(keys).withColumn(name, F.lit(True))
    asked = every.select(*neighbours).distinct().withColumn("tail", F.substring_index("own", "-", -1))
    asked = asked.join(marked(model.abbreviations, "whole", type="own"), "own", "left").join(marked(model.abbreviations, "last", type="tail"), "tail", "left")
    asked = asked.join(marked(model.collocations, "both", type="own", next="following"), ["own", "following"], "left").join(marked(model.starters, "starts", type="following"), "following", "left")
    asked = asked.join(model.places.withColumnRenamed("type", "following"), "following", "left")
    known = lambda *names: F.coalesce(*names, F.lit(False))
    asked = asked.select(*neighbours, known("whole", "last").alias("short"), known("both").alias("joined"), known("starts").alias("starter"), F.coalesce("places", F.lit(0)).cast("int").alias("places"))
    return every.join(asked.mapInArrow(held, "own string, following string, first string"), neighbours, "left_semi").groupBy(row).agg(F.collect_list("end").alias("__held"))


def with_sentences(frame: DataFrame, text: str, model: Model | Tables, out: str = "sentences") -> DataFrame:
    """frame with the array of every text's sentences."""
    own, whole = frame.schema, isinstance(model, Model)
    held = frame.sparkSession.sparkContext.broadcast(model) if whole else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(parts):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            if whole:
                made = [plain_sentences(t, held.value) for t in texts]
            else:
                left = [set(ends or []) for ends in part.column(part.schema.get_field_index("__held")).to_pylist()]
                made = [cut(t or "", [end for end, _, _ in stops(t or "") if end not in ends]) for t, ends in zip(texts, left)]
            part = part.select(names)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.list_(pa.string()))], names=[*names, out])

    names = own.names
    if whole:
        rows = spread(frame)
    else:
        texts = staged(spread(frame).withColumn("__row", F.monotonically_increasing_id()), "texts")
        rows = texts.join(held_stops(texts, "__row", text, model), "__row", "left")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return rows.mapInArrow(run, f"{kept}, `{out}` array<string>")
