"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of passages: its lines, cut on at sentence ends and, where a passage has more than LONG words,
after words chosen by their hash (so that cuts follow content, not position). Each passage hashes to a wide vector of
4 lanes modulo 2**64 and 128 lanes of +1 or -1 modulo 2**16; a fingerprint is the lane-wise sum. Sums do not depend on
order, adding or removing a passage is one vector addition or subtraction, and the sum of two texts' fingerprints is
that of the texts together. The wide lanes decide equality. The narrow lanes are a sketch: the mean square of their
difference estimates the squared distance of two multisets, which gives a likeness between 0 and 1.

A null text counts as empty: the zero fingerprint; two empty texts have likeness 1. Repeated rows follow each other;
the neighbour of the last row is the first. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm import work

LONG = 24
WIDE, NARROW = 4, 128
PASSAGE = re.compile(r"[^\n.!?]*[.!?\n]*")


def passages(text: str) -> list[str]:
    """The passages of a text, blank ones left out."""
    out = []
    for piece in PASSAGE.findall(text):
        piece = piece.strip()
        if len(piece) <= 6 * LONG:
            if piece:
                out.append(piece)
            continue
        words, at = piece.split(), 0
        if len(words) <= LONG:
            out.append(piece)
            continue
        for k, word in enumerate(words):
            if k - at >= 4 and hashlib.blake2b(word.encode(), digest_size=1).digest()[0] < 32:
                out.append(" ".join(words[at : k + 1]))
                at = k + 1
        if at < len(words):
            out.append(" ".join(words[at:]))
    return out


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(wide lanes uint64, narrow lanes int16) of a text."""
    wide, narrow = np.zeros(WIDE, np.uint64), np.zeros(NARROW, np.int64)
    found = passages(text)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        raw = np.frombuffer(b"".join([hashlib.blake2b(p.encode(), digest_size=48).digest() for p in part]), np.uint8).reshape(-1, 48)
        wide += np.ascontiguousarray(raw[:, :32]).view("<u8").sum(axis=0, dtype=np.uint64)
        narrow += 2 * np.unpackbits(raw[:, 32:], axis=1).sum(axis=0, dtype=np.int64) - len(part)
    return wide, narrow.astype(np.uint16).view(np.int16)


def combined(a, b, sign: int = 1):
    """The fingerprint of the passages of both texts, or of those of a without b's (sign -1)."""
    one = np.uint64(sign % (1 << 64))
    return a[0] + one * b[0], (a[1].astype(np.int64) + sign * b[1].astype(np.int64)).astype(np.uint16).view(np.int16)


def text_of(f) -> str:
    return f[0].astype("<u8").tobytes().hex() + f[1].astype("<i2").tobytes().hex()


def parsed(data: str):
    raw = bytes.fromhex(data)
    return np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<i2")


def likeness(a, b) -> float:
    """1 for equal fingerprints; else the share of passages in common, as the narrow lanes estimate it."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    d = a[1].astype(np.int64) - b[1].astype(np.int64)
    d = ((d + (1 << 15)) % (1 << 16) - (1 << 15)).astype(np.float64)
    own = x @ x + y @ y
    return float(min(max(1 - (d @ d) / own, 0.0), 1.0)) if own else 0.0


def edited(text: str, other: str) -> str:
    """text with its last half of code points replaced by as many of other's first."""
    k = len(text) // 2
    return text[: len(text) - k] + other[:k]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc, text, f, other, g):
    changed = edited(text, other)
    e = fingerprint(changed) if changed != text else f
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(f), text_of(e), likeness(f, e), likeness(f, g)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text: (doc_id, n_chars, fingerprint); no shuffle."""

    def run(batch_iter):
        for batch in work.batches(batch_iter):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_of(fingerprint(t)) for t in texts])], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to the edited and to the next text.

    The texts are range-partitioned by key once; each partition walks its rows in order. The row at the end of a
    partition meets the first row of the next one that has rows in a second, small step: two texts per partition.
    """
    spark = docs.sparkSession
    dealt = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = dealt.repartitionByRange(work.partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def walk(batch_iter):
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, None
        schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in work.batches(batch_iter):
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = last[2] if last and last[1] == body else fingerprint(body)
                if last:
                    rows.append((part, 0, *_row(*last, body, f), None))
                else:
                    first = doc, body
                last = doc, body, f
            if rows:
                yield out(rows)
        if last:
            yield out([(part, 1, first[0], None, None, None, None, None, None, first[1]), (part, 2, last[0], None, None, None, None, None, None, last[1])])

    walked = work.table(dealt.mapInArrow(walk, "part int, kind int, " + OUT + ", text string"), "edits")
    heads = walked.where("kind = 1").select(F.col("part").alias("p"), F.col("text").alias("other"))
    order = walked.where("kind = 1").select("part")
    every = Window.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    whole = Window.partitionBy(F.lit(0))
    after = order.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(whole)).alias("p"))
    ends = walked.where("kind = 2").select("part", "doc_id", "text").join(after, "part").join(heads, "p").select("doc_id", "text", "other")

    def close(batch_iter):
        for batch in batch_iter:
            rows = [_row(d, t, fingerprint(t), o, fingerprint(o)) for d, t, o in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                names = [x.split()[0] for x in OUT.split(", ")]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

    closed = ends.mapInArrow(close, OUT)
    return walked.where("kind = 0").select(*closed.columns).unionByName(closed)
