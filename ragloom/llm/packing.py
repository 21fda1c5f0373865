"""Packing by shortest-pack-first over the length histogram.

Every document is tokenised whole and cut into pieces of at most `capacity` ids. The histogram of piece lengths
(at most `capacity` rows) goes to the driver, which places lengths longest first, always into the shortest open
packs, moving whole counts of packs from one pattern to the next. Pieces are then joined to the patterns by their
rank within their length: ranks come from a range partitioning by length and the counts per partition and length
(at most partitions + capacity rows).

A null text counts as empty (it still has its end id); repeated rows are packed each; an empty table gives no rows.
Only the key and the text of the input are read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work
from ragloom.llm.pairs import PairMerger

CACHE = 1_500_000  # words whose ids a worker remembers
LONG = 1 << 22  # characters from which a text is encoded in parts
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words that need no Unicode normalisation: printable ASCII and the Latin-1 letters, which have one simple lower case.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: The tokenizer's own pre-token pattern, for lower-cased plain words.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a tokenizer whose tokens never span a space or a newline, remembered by word.

    New plain words are merged many at once from the tokenizer's own vocabulary and merges; all other words are
    encoded by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {"": b""}
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, letters, end = model["vocab"], byte_letters(), model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.merger = PairMerger(pairs) if list(pairs.values()) == sorted(pairs.values()) else None  # ids must rise with rank
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)

    def learn_plain(self, words: list[str]) -> None:
        cut = [PRE_TOKEN.findall(w) for w in "\n".join(words).lower().split("\n")]
        names = {p: p.encode() for c in cut for p in c}
        data = self.merger.merge_pieces(list(set(names.values())), self.inner, self.final)
        ids = {p: struct.pack(f"<{len(v)}I", *v) for p, b in names.items() if (v := data.get(b))}
        for word, parts in zip(words, cut):
            try:
                self.known[word] = b"".join([ids[p] for p in parts])
            except KeyError:  # longer than the merger takes
                self.known[word] = self.single(word)

    def learn(self, words: list[str]) -> None:
        """Encode the words as one text and cut its ids back into words by their offsets."""
        if self.merger:
            plain = [w for w in words if PLAIN.fullmatch(w)]
            self.learn_plain(plain)
            words = list(set(words).difference(plain))
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            places = np.array([o[0] for o in got.offsets], np.int64)
            cuts = np.searchsorted(places, begins).tolist() + [len(ids)]
            for k, word in enumerate(part):
                self.known[word] = ids[cuts[k] : cuts[k + 1]].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts together are small, or one long text is cut at spaces first."""
        words = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.known) > CACHE:
            self.known = {"": b""}
        if new := set().union(*words) - self.known.keys():
            self.learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u4") for w in words]

    def encode_long(self, text: str, step: int = 1 << 22) -> np.ndarray:
        """Ids of a text of any length, cut at its spaces every `step` characters or more."""
        at, parts = 0, []
        while at < len(text):
            to = text.find(" ", at + step)
            to = len(text) if to < 0 else to
            parts += self.encode([text[at:to]])
            at = to
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def single(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    return work.held(("words", path), lambda: WordEncoder(path))


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32) of each piece of a document's ids."""
    return [(at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for at in range(0, len(ids), capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of every document."""

    def encode(batch_iter):
        own, end = encoder(path), np.array([end_id], "<u4")
        for batch in work.batches(batch_iter):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            whole = iter(own.encode([t for t in texts if len(t) <= LONG]))
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                ids = next(whole) if len(text) <= LONG else own.encode_long(text)
                ids = np.concatenate([ids, end])
                rows += [(doc, a, n, c, len(ids)) for a, n, c in cut(ids, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work.without_collector(encode), PIECES)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Shortest-pack-first: [((length, how many), ...), packs] for lengths placed longest first.

    Each step takes the shortest open packs and gives as many of them as there are pieces one piece each; where even
    the shortest has no room, new packs open, each filled with the pieces of this length that it holds.
    """
    openings: list[tuple[int, int]] = []  # (used, pattern number) of packs that may still have room
    pool: dict[int, list] = {}
    made = 0

    def put(pattern, used, count):
        nonlocal made
        pool[made] = [pattern, count]
        heapq.heappush(openings, (used, made))
        made += 1

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if openings and openings[0][0] + length <= capacity:
                used, number = heapq.heappop(openings)
                pattern, count = pool.pop(number)
                k = min(left, count)
                if count > k:
                    put(pattern, used, count - k)
                grown = (*pattern[:-1], (length, pattern[-1][1] + 1)) if pattern[-1][0] == length else (*pattern, (length, 1))
                put(grown, used + length, k)
                left -= k
            else:
                full, rest = divmod(left, fit := max(1, capacity // length))
                if full:
                    put(((length, fit),), fit * length, full)
                if rest:
                    put(((length, rest),), rest * length, 1)
                left = 0
    return [(tuple(p), c) for p, c in pool.values()]


def intervals(packs: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, pieces per sequence, first offset), by rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    base = 0
    for pattern, count in packs:
        offset = 0
        for length, m in pattern:
            at = ranks.get(length, 0)
            rows.setdefault(length, []).append((at, base, m, offset))
            ranks[length] = at + m * count
            offset += m * length
        base += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every piece of every document: sequence_id and offset beside the columns of pieces()."""
    spark = docs.sparkSession
    order = ["length", "doc_id", "start", "ids_crc32"]
    cut_up = pieces(docs, path, capacity, end_id, key, text).withColumn("__scan", F.monotonically_increasing_id())
    dealt = work.table(cut_up, "pieces").repartitionByRange(work.partitions(spark), *order, "__scan")
    placed = work.table(dealt.sortWithinPartitions(*order, "__scan").drop("__scan").withColumn("at", F.monotonically_increasing_id()), "ranked")
    parts = placed.groupBy(F.shiftright("at", 33).alias("part"), "length").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    counts = sorted(tuple(r) for r in parts.collect())  # at most partitions + capacity rows
    histogram: dict[int, int] = {}
    shift: dict[tuple[int, int], int] = {}
    for part, length, n, first in counts:
        shift[part, length] = histogram.get(length, 0) - first
        histogram[length] = histogram.get(length, 0) + n
    places = intervals(patterns(histogram, capacity))

    def place(batch_iter):
        for batch in batch_iter:
            if not batch.num_rows:
                continue
            length, at = (batch.column(k).to_numpy() for k in (2, 5))
            sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            part = at >> 33
            for p, n in {*zip(part.tolist(), length.tolist())}:
                mine = np.flatnonzero((part == p) & (length == n))
                rank, rows = at[mine] + shift[p, n], places[n]
                row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                nth = rank - row[:, 0]
                sequence[mine], offset[mine] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(place, PIECES + ", sequence_id long, offset long")
