"""Language identification by cross-parsing against suffix automata.

For each language, of the LANGUAGES with the most labelled documents, a suffix automaton is built over a bounded sample of
labelled text (TRAIN_CHARS characters, excerpts of at most SAMPLE_CHARS characters, each from its document's first letter
on, in the order of a hash of their ids). A text is parsed greedily into
the longest phrases that occur in the sample; few phrases mean that the sample predicts the text well. Phrase counts
are normalised to bits per character, phrases x log2(sample length) / text length; the lowest wins, ties go to the
smaller language name.

All letters of the samples, of whatever script, are symbols of their own; letters that no sample has are one more, which
no phrase holds, and all other characters are symbol 0. The
automata's transitions lie in one sparse table by row displacement: a state is its offset, and the slot at offset +
symbol names the state it belongs to. A missing transition ends the phrase and leads to where the next one begins. So
that all parts of a batch of texts advance in step for all languages, texts are first parsed in segments of SEGMENT
characters, each as if a phrase began there. Then the phrase that really runs into a segment is carried on from the
state in which the one before ended, until it ends where the segment's own parse has an end too; from there on both
agree. The counts are those of one greedy parse of the whole text, whatever SEGMENT is.

Null text, or text without a letter: language `und`, score 0. Without any learned language every text is `und`; the
pipeline's stage keeps the lettered ones all the same. The pipeline's stage also rejects texts of JUDGED letters or more
that no learned language predicts: the best language needs more than LOOSE times the bits per character that pieces of
labelled text need which are held out from a first automaton (the worst of its pieces counts).
Empty tables give no rows; repeated rows are judged each; other columns are ignored. Rows with null key are held in.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm import work

TRAIN_CHARS = 40_000
SAMPLE_CHARS = 8_192
SAMPLE_DOCS = 200
LANGUAGES = 128  # that are learned: those with the most labelled documents
SPARE = 4  # times TRAIN_CHARS that may reach the driver for a language, since repeated excerpts are left out there
SEGMENT = 512
JUDGED, LOOSE = 200, 2.0
PIECE = 400  # characters of a held-out piece
GROUP = 1 << 22  # characters parsed at once; one longer text is parsed alone
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, str]:
    """Labelled text by language, at most TRAIN_CHARS characters each of LANGUAGES: the bounded sample that the models learn from."""
    told = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(key)))
    many = F.broadcast(told.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__lang").limit(LANGUAGES))
    own = told.join(many, told[lang] == many["__lang"], "left_semi").select(F.col(key).alias("k"), F.xxhash64(key, text).alias("h"), F.regexp_extract(text, rf"(?s)\p{{L}}.{{0,{SAMPLE_CHARS - 1}}}", 0).alias("t"), F.col(lang).alias("lang"))
    usable = own.where("t <> ''")
    first = Window.partitionBy("lang").orderBy("h", "k")
    chosen = usable.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS)
    so_far = F.sum(F.length("t")).over(first.rowsBetween(Window.unboundedPreceding, -1))
    chosen = chosen.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < SPARE * TRAIN_CHARS)
    out: dict[str, str] = {}
    for row in sorted(chosen.collect(), key=lambda r: (r["lang"], r["n"])):
        have = out.get(row["lang"], "")
        if len(have) < TRAIN_CHARS and row["t"] not in have:
            out[row["lang"]] = (have + " " + row["t"])[:TRAIN_CHARS]
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(automata: list[list[dict[int, int]]], width: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """(offset of each state, owner of each slot, next state's offset in each slot); no two states share an offset."""
    taken, used, spots = bytearray(b"\1" * width + b"\0" * width), set(), []
    order = sorted(((-len(edges), k, s) for k, own in enumerate(automata) for s, edges in enumerate(own)))
    at = [[0] * len(own) for own in automata]
    low, degree = width, 0
    for d, k, s in order:
        symbols = sorted(automata[k][s])
        if not symbols:  # owns no slot
            at[k][s] = 0
            continue
        if d != degree:
            low, degree = width, d
        slot, tries = low, 0
        while True:
            slot = taken.find(0, slot)
            if slot < 0 or slot + width >= len(taken):
                slot = len(taken) - width if slot < 0 else slot
                taken.extend(bytes(len(taken)))
                continue
            offset = slot - symbols[0]
            if offset not in used and not any(taken[offset + c] for c in symbols):
                break
            slot, tries = slot + 1, tries + 1
        if tries > 64 or len(symbols) == 1 and not tries:
            low = slot
        at[k][s] = offset
        used.add(offset)
        for c in symbols:
            taken[offset + c] = 1
    owner, to = np.full(len(taken), -1, np.int32), np.zeros(len(taken), np.int32)
    for own, places in zip(automata, at):
        for s, edges in enumerate(own):
            for c, t in edges.items():
                owner[places[s] + c] = places[s]
                to[places[s] + c] = places[t]
    return at, owner, to


@functools.cache
def alphabetic() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class CrossParser:
    """The automata of all languages in one sparse table; `begin` holds each language's state after a phrase's first symbol."""

    def __init__(self, sample: dict[str, str]):
        self.names = sorted(sample)
        texts = {k: v.lower() for k, v in sample.items()}
        letters = sorted({c for t in texts.values() for c in t if c.isalpha() or c == " " or unicodedata.category(c)[0] == "M"})
        width = len(letters) + 2  # symbol 0: no letter; the last one: a letter that no sample has
        self.symbols = np.where(alphabetic(), np.int32(width - 1), np.int32(0))
        self.symbols[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.symbols[10] = self.symbols[32]
        coded = [self.codes(texts[name]).tolist() for name in self.names]
        self.bits = [math.log2(len(codes) + 2) for codes in coded]
        automata = [suffix_automaton(codes) for codes in coded]
        at, self.owner, self.to = displaced(automata, width)
        self.starts = [places[0] for places in at]
        dead = len(self.owner)  # the state after a character that a sample lacks: nothing goes on from there
        self.owner, self.to = np.append(self.owner, np.full(width, -1, np.int32)), np.append(self.to, np.zeros(width, np.int32))
        self.begin = np.full((len(automata), width), dead, np.int32)
        for k, own in enumerate(automata):
            for c, t in own[0].items():
                self.begin[k, c] = at[k][t]

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        return self.symbols[points]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages phrase counts, text lengths)."""
        coded = [self.codes(t.lower()) for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if self.names:
            group = np.cumsum(lengths) // GROUP
            for g in np.unique(group[lengths > 0]).tolist():
                mine = np.flatnonzero((group == g) & (lengths > 0))
                out[mine] = self.parsed([coded[i] for i in mine.tolist()], lengths[mine])
        return out, lengths

    def parsed(self, coded: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        """Phrase counts of non-empty texts in every language."""
        per_text = -(-lengths // SEGMENT)
        owner, flat = np.repeat(np.arange(len(coded)), per_text), np.concatenate(coded)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)  # of the segment in its text
        begin = np.repeat(np.cumsum(lengths) - lengths, per_text) + number * SEGMENT
        sizes = np.minimum(SEGMENT, np.repeat(lengths, per_text) - number * SEGMENT)
        many, langs = len(owner), len(self.names)
        order = np.argsort(-sizes, kind="stable")  # segments that are still running come first
        at = begin[order]
        running = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
        state = np.repeat(np.array(self.starts, np.int32)[:, None], many, 1)
        count = np.zeros(state.shape, np.int64)
        ends = np.zeros((langs, len(flat)), bool)  # where a phrase of the segments' own parse begins
        for j, n in enumerate(running.tolist()):
            symbol = flat.take(at[:n] + j)
            slot = state[:, :n] + symbol
            missing = self.owner.take(slot) != state[:, :n] if j else np.ones((langs, n), bool)
            count[:, :n] += missing
            ends[:, at[:n] + j] = missing
            state[:, :n] = np.where(missing, self.begin[:, symbol], self.to.take(slot))
        back = np.argsort(order)
        count, own, last = count[:, back], state[:, back], state[:, back].copy()
        whose, seg = np.nonzero(np.broadcast_to(number > 0, (langs, many)))
        change = np.zeros((langs, many), np.int64)
        while len(seg):  # pairs of language and segment whose entering state is new
            lane, here, fixed, step = last[whose, seg - 1], np.arange(len(seg)), np.zeros(len(seg), np.int64), 0
            leaves = own[whose, seg]
            while len(here):
                k, spot = whose[here], begin[seg[here]] + step
                symbol = flat[spot]
                slot = lane + symbol
                missing, theirs = self.owner[slot] != lane, ends[k, spot]
                fixed[here] += missing.astype(np.int64) - theirs
                lane = np.where(missing, self.begin[k, symbol], self.to[slot])
                over = step + 1 == sizes[seg[here]]
                leaves[here[over & ~(missing & theirs)]] = lane[over & ~(missing & theirs)]
                stay = ~(missing & theirs) & ~over
                here, lane, step = here[stay], lane[stay], step + 1
            change[whose, seg] = fixed
            new = leaves != last[whose, seg]
            last[whose, seg] = leaves
            follow = new & (seg + 1 < many)
            follow[follow] &= number[seg[follow] + 1] > 0
            whose, seg = whose[follow], seg[follow] + 1
        total = count + change
        return np.stack([np.bincount(owner, total[k], len(coded)) for k in range(langs)], 1).astype(np.int64)

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, bits per character) of the texts."""
        counts, lengths = self.phrases([t or "" for t in texts])
        bits = counts * np.array(self.bits or [0.0] * counts.shape[1]) / np.maximum(lengths, 1)[:, None]
        has = np.array([lettered(t) for t in texts], bool)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.names) > 1 else low + 1
        score = np.where(has, np.clip(1 - low / np.maximum(second, 1e-9), 0, 1), 0.0)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has.tolist())], score, low


def parser(sample: dict[str, str]) -> CrossParser:
    """The parser of a sample, built once in each worker."""
    return work.held(("parser", hash(tuple(sorted(sample.items())))), lambda: CrossParser(sample))


def predict(docs: DataFrame, sample: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits) of every text; the sample travels with the tasks (at most TRAIN_CHARS a language)."""

    def run(batch_iter):
        own = parser(sample)
        for batch in work.batches(batch_iter, 2048):
            names, score, bits = own.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "lang_pred", "score", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the labelled rows that are not held out, then predict every row."""
    out = predict(docs, training_sample(docs, key, text, lang), key, text)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def loosest(sample: dict[str, str]) -> float:
    """The bits per character that the hardest held-out piece of any language needs, parsed by the rest of its sample."""
    worst = 0.0
    for name, text in sample.items():
        cut = max(len(text) * 4 // 5, len(text) - 25 * PIECE)
        pieces = [text[at : at + PIECE] for at in range(cut, len(text) - PIECE + 1, PIECE)]
        if pieces and cut > PIECE:
            worst = max(worst, float(CrossParser({name: text[:cut]}).judge(pieces)[2].max()))
    return worst


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is in a learned language, all columns as they are.

    Text without a letter goes (`und`), and text of JUDGED letters or more that no learned language predicts; shorter
    text is too short to reject. Where nothing was learnt all lettered rows stay. Works row by row beside the other
    columns, so repeated and null keys need no join.
    """
    sample, names = training_sample(docs, key, text, lang), docs.columns
    at, limit = names.index(text), LOOSE * loosest(sample)

    def run(batch_iter):
        own = parser(sample)
        for batch in work.batches(batch_iter, 2048):
            texts = batch.column(at).to_pylist()
            if not own.names:
                keep = [lettered(t) for t in texts]
            else:
                found, _, bits = own.judge(texts)
                keep = [f != UNKNOWN and (not limit or b <= limit or sum(map(str.isalpha, t)) < JUDGED) for f, b, t in zip(found, bits.tolist(), texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
