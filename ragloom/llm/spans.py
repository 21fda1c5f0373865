"""Suffix-array removal of passages that occur in an earlier document.

Every byte covered by a string of DEPTH = 50 bytes that also starts in a document with a smaller id goes. The work is
exact, and no step holds more than one unit of documents or one bucket of suffixes in memory:

1. Documents are packed into units of a few MB, written once as a table bucketed by unit; later rounds read it in
   place, so texts are never shuffled. In each round a unit sends bytes to buckets and gets an answer per bucket back.
2. Equal texts: only the one of the smallest id is searched; the others go whole.
3. Each 50-byte string is dealt to a suffix bucket by its anchor, the 24-byte substring of least hash (leftmost of
   equals), which equal strings share. Anchors that only one document has are dropped (5 bytes each are sent).
4. The remaining strings, as runs around their anchors, meet in their bucket. There the suffixes are sorted one suffix
   bucket at a time (one per distance from the anchor). A difference cover modulo 13 gives sample positions, whose
   26-byte substrings are ranked once; a suffix is ordered by its first 8 bytes, long ties by the ranks of the
   first and the last sample inside it, and by its last 8 bytes. Runs lie in the bucket's text with their anchors at
   multiples of 13, so suffixes of one bucket have the same residue and the same samples. Neighbours that are equal
   in all keys are equal in 50 bytes; each group's smallest document id says which of its strings go.

Equal runs of one unit are sent once, so a passage that many documents share costs one row per unit inside it. The runs
at its edges differ from document to document and share an anchor: strings of an anchor that HOT units have are dealt
by the bytes beside the anchor too, which every such string holds on one side or the other, so they spread.

The number of buckets follows the bytes of the texts (one bucket per BUCKET bytes), so a bucket's size does not grow
with the corpus, but for a string that very many units hold alike (one entry per unit).

Null text counts as empty. A null id counts as larger than any other. Rows of one id never remove each other's bytes;
repeated rows are each treated alike. Empty tables give no rows. Other columns travel with their rows.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ragloom.llm import work

DEPTH = 50
ANCHOR = 24
SPREAD = DEPTH - ANCHOR + 1  # windows that one anchor position can serve
UNIT = 4 << 20  # bytes of text in a unit
BUCKET = 32 << 20  # bytes of text per bucket
HOT = 16  # units
BLOCK = 1 << 22  # strings whose anchors are sought at once
PERIOD, COVER, SAMPLE = 13, (0, 1, 3, 9), 26
STRIDE = 104  # bytes of the bucket's text per run, a multiple of PERIOD
NO_ID = (1 << 63) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 50-byte strings with one anchor: (first start, last start, anchor position, anchor hash).

    The anchor is the window of least hash (its upper 40 bits), leftmost of equals: hash and position are one number.
    """
    parts = [_anchors(data[at : at + BLOCK + DEPTH - 1], at) for at in range(0, max(1, len(data) - DEPTH + 1), BLOCK)]
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts))


def _anchors(data: bytes, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(data) < DEPTH:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    h1 = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * np.uint64(0x9E3779B97F4A7C15) + h1[1:]
    h4 = h2[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h2[2:]
    h4 ^= h4 >> np.uint64(29)
    h8 = h4[:-4] * np.uint64(0x165667B19E3779F9) + h4[4:]
    h16 = h8[:-8] * np.uint64(0x27D4EB2F165667C5) + h8[8:]
    h16 ^= h16 >> np.uint64(31)
    h = mix(h16[:-8] * np.uint64(0x85EBCA77C2B2AE63) + h8[16:])
    low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    for step in (1, 2, 4, 8, SPREAD - 16):
        low = np.minimum(low[step:], low[:-step])
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    where = at[first]
    return first + begin, last + begin, where + begin, h[where]


def grouped(runs: np.ndarray, begins: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each run the bits of its strings (bit = distance from start to anchor) that a smaller id has too.

    runs: matrix of STRIDE columns, anchors at column 26; begins, ends: the distances that each run holds.
    """
    masks = np.zeros(len(runs), np.uint32)
    words = lambda c: np.ascontiguousarray(runs[:, c : c + 8]).view(">u8").ravel().astype(np.uint64)
    cover = [c for c in range(STRIDE - SAMPLE) if c % PERIOD in COVER and c <= 2 * PERIOD + DEPTH - SAMPLE]
    ranks = {}
    for c in cover:  # ranks of the sample: 26 bytes from each cover position
        keys = [words(c + 18), words(c + 16), words(c + 8), words(c)]
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(new)
        ranks[c] = rank
    for away in range(SPREAD):  # one suffix bucket at a time
        mine = np.flatnonzero((begins >= away) & (ends <= away))
        if len(mine) < 2:
            continue
        start = 2 * PERIOD - away
        near = min(c for c in cover if c >= start)
        far = max(c for c in cover if c <= start + DEPTH - SAMPLE)
        head, tie, tail = words(start)[mine], ((ranks[near] << np.uint64(32)) | ranks[far])[mine], words(start + DEPTH - 8)[mine]
        order = np.lexsort((tail, tie, head))
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in (head, tie, tail):
            new[1:] |= k[order][1:] != k[order][:-1]
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[mine][order], np.flatnonzero(new))
        hit = least[group] < ids[mine][order]
        masks[mine[order[hit]]] |= np.uint32(1 << away)
    return masks


def halves(text: bytes, a: int, b: int, p: int, mark: int):
    """The runs of strings a to b with the anchor at p, dealt by the 13 bytes that they all hold left or right of it."""
    middle = p - PERIOD  # strings up to here hold the 13 bytes left of the anchor, later ones those right of it
    if a <= middle:
        yield a, min(b, middle), mark ^ xxh64_intdigest(text[middle:p], 1)
    if b > middle:
        yield max(a, middle + 1), b, mark ^ xxh64_intdigest(text[p + ANCHOR : p + ANCHOR + PERIOD], 2)


class Unit:
    """The documents of one unit and what the rounds have told about them."""

    def __init__(self, data: bytes, key: str, text: str, buckets: int):
        with pa.ipc.open_stream(io.BytesIO(data)) as stream:
            self.batch = stream.read_next_batch()
        names = self.batch.schema.names
        self.ids = [NO_ID if i is None else i for i in self.batch.column(names.index(key)).to_pylist()]
        self.texts = [(t or "").encode() for t in self.batch.column(names.index(text)).to_pylist()]
        self.buckets = buckets

    def spread(self, where: np.ndarray) -> np.ndarray:
        return ((where >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)

    # equal texts
    def copies(self) -> list[tuple[bytes, int]]:
        """Distinct texts of the unit by digest, with their smallest id."""
        self.digests = [hashlib.blake2b(t, digest_size=16).digest() for t in self.texts]
        least: dict[bytes, int] = {}
        for d, i in zip(self.digests, self.ids):
            least[d] = min(i, least.get(d, NO_ID))
        return sorted(least.items())

    def send_copies(self):
        own = self.copies()
        where = [int.from_bytes(d[:4], "little") % self.buckets for d, _ in own]
        parts: dict[int, list] = {}
        for (d, i), b in zip(own, where):
            parts.setdefault(b, []).append((d, i))
        for b, rows in parts.items():
            yield b, b"".join(d for d, _ in rows) + np.array([i for _, i in rows], "<i8").tobytes()

    def hear_copies(self, answers: dict[int, bytes]) -> None:
        own = self.copies()
        at: dict[int, int] = {}
        least = {}
        for d, _ in own:
            b = int.from_bytes(d[:4], "little") % self.buckets
            k = at.get(b, 0)
            at[b] = k + 1
            least[d] = int.from_bytes(answers[b][8 * k : 8 * k + 8], "little", signed=True)
        self.first = [least[d] == i for d, i in zip(self.digests, self.ids)]

    # anchors
    def find(self) -> None:
        self.runs = [anchors(t) if first else None for t, first in zip(self.texts, self.first)]
        found = [(k, mix(r[3])) for k, r in enumerate(self.runs) if r is not None and len(r[3])]
        self.marks = {k: m for k, m in found}
        if found:
            every, whose = np.concatenate([m for _, m in found]), np.concatenate([np.full(len(m), k) for k, m in found])
            order = np.argsort(every, kind="stable")
            every, whose = every[order], whose[order]
            begin = np.concatenate([[True], every[1:] != every[:-1]])
            at = np.flatnonzero(begin)
            self.known = every[at]
            self.shared_here = np.array(np.minimum.reduceat(whose, at) != np.maximum.reduceat(whose, at))
        else:
            self.known, self.shared_here = np.empty(0, np.uint64), np.empty(0, bool)
        self.home = self.spread(self.known)
        self.by_home = np.argsort(self.home, kind="stable")
        self.cuts = np.searchsorted(self.home[self.by_home], np.arange(self.buckets + 1))

    def send_anchors(self):
        self.find()
        for b in range(self.buckets):
            mine = self.by_home[self.cuts[b] : self.cuts[b + 1]]
            if len(mine):
                short = self.known[mine].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                yield b, short + np.packbits(self.shared_here[mine]).tobytes()

    def hear_anchors(self, answers: dict[int, bytes]) -> None:
        """Entries: a bucket's name, distance and bytes of a run; places: where this unit has them."""
        self.find()
        shared, hot = np.zeros(len(self.known), bool), np.zeros(len(self.known), bool)
        for b, data in answers.items():
            mine = self.by_home[self.cuts[b] : self.cuts[b + 1]]
            flags = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * len(mine)).astype(bool)
            shared[mine], hot[mine] = flags[: len(mine)], flags[len(mine) :]
        keep, heat = self.known[shared], hot[shared]
        entries: dict[tuple, int] = {}
        least: list[int] = []
        places: list[tuple[int, int, int, int, int]] = []  # document, first start, last start, anchor position, entry
        for k, marks in self.marks.items():
            if not len(keep):
                break
            at = np.minimum(np.searchsorted(keep, marks), len(keep) - 1)
            first, last, pos, _ = self.runs[k]
            text, own = self.texts[k], self.ids[k]
            mine = np.flatnonzero(keep[at] == marks)
            for a, b, p, mark, many in zip(first[mine].tolist(), last[mine].tolist(), pos[mine].tolist(), marks[mine].tolist(), heat[at[mine]].tolist()):
                for a, b, mark in halves(text, a, b, p, mark) if many else ((a, b, mark),):
                    name = (mark, p - a, text[a : b + DEPTH])
                    e = entries.setdefault(name, len(least))
                    if e == len(least):
                        least.append(own)
                    elif own < least[e]:
                        least[e] = own
                    places.append((k, a, b, p, e))
        self.names, self.least = list(entries), np.array(least, np.int64)
        self.places = np.array(places, np.int64).reshape(-1, 5)

    # runs
    def sorted_entries(self) -> dict[int, np.ndarray]:
        homes = self.spread(np.fromiter((n[0] for n in self.names), np.uint64, len(self.names)))
        order = np.array(sorted(range(len(self.names)), key=self.names.__getitem__), np.int64)
        order = order[np.argsort(homes[order], kind="stable")]
        found, at = np.unique(homes[order], return_index=True)
        return dict(zip(found.tolist(), np.split(order, at[1:])))

    def placed(self) -> tuple[bytes, list[tuple[int, bytes]]]:
        """(what a later round needs to know, what is sent to the buckets)."""
        names, parts, sends = self.names, self.sorted_entries() if self.names else {}, []
        for b, mine in parts.items():
            own = [names[e] for e in mine.tolist()]
            size, lead = np.array([len(n[2]) for n in own], np.uint8), np.array([n[1] for n in own], np.uint8)
            sends.append((b, len(own).to_bytes(4, "little") + size.tobytes() + lead.tobytes() + self.least[mine].astype("<i8").tobytes() + b"".join(n[2] for n in own)))
        sizes = np.array([[b, len(mine)] for b, mine in parts.items()], np.int64).reshape(-1, 2)
        order = np.concatenate([*parts.values(), np.empty(0, np.int64)])
        counts = np.array([len(self.first), len(self.least), len(self.places), len(sizes)], np.int64)
        return b"".join(x.astype(np.int64).tobytes() for x in (counts, np.array(self.first, np.int64), self.least, self.places, sizes, order)), sends

    def recall(self, state: bytes, answers: dict[int, bytes]) -> None:
        """What placed() told, and the buckets' answers."""
        whole = np.frombuffer(state, np.int64)
        n, m, k, j = whole[:4].tolist()
        self.first, self.least, self.places, sizes, order = np.split(whole[4:], np.cumsum([n, m, 5 * k, 2 * j]))
        self.places, self.masks, at = self.places.reshape(-1, 5), np.zeros(m, np.uint32), 0
        for b, size in sizes.reshape(-1, 2).tolist():
            self.masks[order[at : at + size]] = np.frombuffer(answers[b], "<u4")
            at += size

    def kept(self) -> list[tuple[bytes, int, int]]:
        """(what is left, bytes removed, spans removed) of every document."""
        gone: dict[int, list[tuple[int, int]]] = {}
        whose, entry = self.places[:, 0], self.places[:, 4]
        whole = np.array(self.ids, np.int64)[whose] > self.least[entry]
        some = np.flatnonzero(whole | (self.masks[entry] != 0))
        for (k, a, b, p, _), every, mask in zip(self.places[some].tolist(), whole[some].tolist(), self.masks[entry[some]].tolist()):
            ranges = gone.setdefault(k, [])
            if every:
                ranges.append((a, b + DEPTH))
            else:
                ranges += [(q, q + DEPTH) for q in range(a, b + 1) if mask >> (p - q) & 1]
        out = []
        for k, text in enumerate(self.texts):
            if not self.first[k] and len(text) >= DEPTH:
                out.append((b"", len(text), 1))
                continue
            spans: list[list[int]] = []
            for a, b in sorted(gone.get(k, ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            left, at = [], 0
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            out.append((b"".join(left), sum(b - a for a, b in spans), len(spans)))
        return out


def answer_copies(payloads: list[bytes]) -> list[bytes]:
    least: dict[bytes, int] = {}
    split = []
    for data in payloads:
        n = len(data) // 24
        names, ids = [data[16 * k : 16 * k + 16] for k in range(n)], np.frombuffer(data[16 * n :], "<i8").tolist()
        split.append(names)
        for d, i in zip(names, ids):
            if i < least.get(d, NO_ID):
                least[d] = i
    return [np.array([least.get(d, NO_ID) for d in names], "<i8").tobytes() for names in split]


def answer_anchors(payloads: list[bytes]) -> list[bytes]:
    keys, flags = [], []
    for data in payloads:
        n = next(m for m in range(len(data) * 8 // 41, len(data) + 1) if 5 * m + -(-m // 8) == len(data))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = np.frombuffer(data[: 5 * n], np.uint8).reshape(n, 5)
        keys.append(wide.view("<u8").ravel())
        flags.append(np.unpackbits(np.frombuffer(data[5 * n :], np.uint8), count=n).astype(bool))
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    units = np.diff(np.append(np.flatnonzero(new), len(ranked)))
    here = np.add.reduceat(np.concatenate(flags)[order].astype(np.int64), np.flatnonzero(new)) if len(ranked) else units
    group = np.cumsum(new) - 1
    # shared: several units have the anchor, or one has it in several documents
    shared, hot = np.empty(len(ranked), bool), np.empty(len(ranked), bool)
    shared[order], hot[order] = ((units > 1) | (here > 0))[group], (units >= HOT)[group]
    out, at = [], 0
    for k in keys:
        out.append(np.packbits(np.concatenate([shared[at : at + len(k)], hot[at : at + len(k)]])).tobytes())
        at += len(k)
    return out


def answer_runs(payloads: list[bytes]) -> list[bytes]:
    sizes, leads, ids, bodies = [], [], [], []
    for data in payloads:
        n = int.from_bytes(data[:4], "little")
        sizes.append(np.frombuffer(data, np.uint8, n, 4))
        leads.append(np.frombuffer(data, np.uint8, n, 4 + n))
        ids.append(np.frombuffer(data, "<i8", n, 4 + 2 * n))
        bodies.append(np.frombuffer(data, np.uint8, -1, 4 + 10 * n))
    size, lead, own, body = np.concatenate(sizes).astype(np.int64), np.concatenate(leads).astype(np.int64), np.concatenate(ids), np.concatenate(bodies)
    runs = np.zeros((len(size), STRIDE), np.uint8)
    begin = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    runs[row, np.arange(len(body)) - np.repeat(begin, size) + np.repeat(2 * PERIOD - lead, size)] = body
    masks = grouped(runs, lead, lead - (size - DEPTH), own)
    out, at = [], 0
    for s in sizes:
        out.append(masks[at : at + len(s)].astype("<u4").tobytes())
        at += len(s)
    return out


SENT = "bucket int, unit long, payload binary"


def _reply(sent: DataFrame, answer, tag: str) -> DataFrame:
    """The buckets' answers to (bucket, unit, payload): (unit, array<struct<bucket, payload>>), written."""

    def reply(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit")
        return pa.table([table.column("bucket"), table.column("unit"), pa.array(answer(table.column("payload").to_pylist()), pa.binary())], names=["bucket", "unit", "payload"])

    answers = sent.groupBy("bucket").applyInArrow(reply, SENT)
    return work.table(answers.groupBy("unit").agg(F.collect_list(F.struct("bucket", "payload")).alias(tag)), tag)


def _ask(frame: DataFrame, rounds: list[str], send: str, answer, key: str, text: str, buckets: int) -> DataFrame:
    """Units send to buckets and get their answers back."""

    def tell(batch_iter):
        work.forget()
        for batch in batch_iter:
            for row in batch.to_pylist():
                unit = opened(row, rounds, key, text, buckets)
                rows = [(b, row["unit"], data) for b, data in getattr(unit, send)()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "unit", "payload"])

    return _reply(frame.mapInArrow(tell, SENT), answer, send)


def answers_of(row: dict, name: str) -> dict[int, bytes]:
    return {a["bucket"]: a["payload"] for a in row[name] or ()}


def opened(row: dict, rounds: list[str], key: str, text: str, buckets: int) -> Unit:
    """A unit that has heard the answers of the given rounds."""
    unit = Unit(row["data"], key, text, buckets)
    for r in rounds:
        getattr(unit, r.replace("send", "hear"))(answers_of(row, r))
    return unit


def finished(row: dict, key: str, text: str, buckets: int) -> Unit:
    """A unit that knows what goes."""
    unit = Unit(row["data"], key, text, buckets)
    unit.recall(row["state"], answers_of(row, "runs"))
    return unit


def _units(docs: DataFrame, text: str) -> DataFrame:
    """(unit, data): documents packed into units, as a table bucketed by unit. Its name goes, its files stay."""
    at = docs.columns.index(text)

    def pack(batch_iter):
        work.forget()
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            nonlocal n, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, whole.schema) as stream:
                stream.write_batch(whole)
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + n], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["unit", "data"])

        for batch in work.batches(batch_iter, 64):
            for k in range(batch.num_rows):  # a unit ends once it holds UNIT bytes; one longer text is a unit of its own
                held.append(batch.slice(k, 1))
                size += len((batch.column(at)[k].as_py() or "").encode())
                if size >= UNIT:
                    yield closed()
        if held:
            yield closed()

    spark, name, path = docs.sparkSession, "ragloom_units_" + work.new_path(docs.sparkSession, "u")[-32:], work.new_path(docs.sparkSession, "units")
    work.left_for_reader(path)
    packed = docs.mapInArrow(pack, "unit long, data binary")
    packed.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(work.partitions(spark), "unit").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    return out


def _rounds(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(units with all they need to know, number of buckets)."""
    units = _units(docs, text)
    buckets = max(work.partitions(docs.sparkSession), -(-units.count() * UNIT // BUCKET))
    frame, rounds = units, []
    with work.scratch(docs.sparkSession):
        for send, answer in (("send_copies", answer_copies), ("send_anchors", answer_anchors)):
            told = _ask(frame, list(rounds), send, answer, key, text, buckets)
            frame = frame.join(told.hint("shuffle_hash"), "unit", "left")
            rounds.append(send)

        def place(batch_iter):
            work.forget()
            kind = pa.list_(pa.struct([("bucket", pa.int32()), ("payload", pa.binary())]))
            for batch in batch_iter:
                for row in batch.to_pylist():
                    state, sends = opened(row, rounds, key, text, buckets).placed()
                    yield pa.RecordBatch.from_arrays([pa.array([row["unit"]], pa.int64()), pa.array([state], pa.binary()), pa.array([[{"bucket": b, "payload": p} for b, p in sends]], kind)], names=["unit", "state", "sends"])

        placed = work.table(frame.mapInArrow(place, "unit long, state binary, sends array<struct<bucket:int,payload:binary>>"), "placed")
        sent = placed.select("unit", F.explode("sends").alias("s")).select("s.bucket", "unit", "s.payload")
        runs = _reply(sent, answer_runs, "runs")
        known = work.table(placed.select("unit", "state").join(runs, "unit", "left"), "known", stays=True)
    return units.join(known.hint("shuffle_hash"), "unit", "left"), buckets


def span_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    frame, buckets = _rounds(own, "doc_id", "text")

    def report(batch_iter):
        for batch in batch_iter:
            for row in batch.to_pylist():
                unit = finished(row, "doc_id", "text", buckets)
                left = unit.kept()
                yield pa.RecordBatch.from_arrays(
                    [unit.batch.column(0), pa.array([len(t) for t in unit.texts], pa.int64()), pa.array([x[1] for x in left], pa.int64()), pa.array([x[2] for x in left], pa.int64()), pa.array([hashlib.sha256(x[0]).hexdigest() for x in left], pa.string())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return frame.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with the repeated passages cut from their texts, all rows and columns kept.

    Bytes of a character that is cut in two go with the passage; `chars`, if there is such a column, is the new length.
    """
    frame, buckets = _rounds(docs, key, text)
    names = docs.columns

    def cut(batch_iter):
        for batch in batch_iter:
            for row in batch.to_pylist():
                unit = finished(row, key, text, buckets)
                left = [x[0].decode(errors="ignore") for x in unit.kept()]
                columns = list(unit.batch.columns)
                old = columns[names.index(text)]
                columns[names.index(text)] = pa.array([None if was is None else t for t, was in zip(left, old.to_pylist())], old.type)
                if chars in names:
                    columns[names.index(chars)] = pa.array([len(t) for t in left], columns[names.index(chars)].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return frame.mapInArrow(cut, docs.schema)
