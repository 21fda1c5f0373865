"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The code points of a batch of texts become an array of symbols (letter, number, space, other white space, other,
and the letters that take part in contractions); a finite automaton over these symbols decides where pre-tokens
begin. Transition functions compose associatively, so the array is cut into equal blocks: all blocks compose their
functions in step, the block results are composed in order, and a second pass in step yields the state before every
symbol. Boundaries follow from states and neighbouring symbols by array comparisons; no regular expression runs.
The byte slices feed a cache of merged pieces; the ids are decoded again by the vocabulary.

A null text counts as empty: no ids, and the digests of nothing. Lone surrogates cannot occur in Spark strings.
Repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import work
from ragloom.llm.pairs import PairMerger

CACHE = 500_000  # pieces whose ids a worker remembers
CHARS = 1 << 20  # code points per array
RESET, L, N, SP, WS, O, AP, S_, R_, V_, LL_, E_ = range(12)
SYMBOLS = 12
BOS, sL, sN, sSP, sWS, sO, sAP, sR, sV, sLL, sEND = range(11)
STATES = 11
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: \x1c to \x1f are white space to str.isspace() but not to the Unicode property that the pattern's \s stands for.
WHITE = "".join(c for c in WHITE if not "\x1c" <= c <= "\x1f")


@functools.cache
def symbol_table() -> np.ndarray:
    """The symbol of every code point."""
    out = np.full(sys.maxunicode + 1, O, np.uint8)
    for code in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            out[code] = L
        elif kind == "N":
            out[code] = N
    for c in WHITE:
        out[ord(c)] = WS
    out[ord(" ")], out[ord("'")] = SP, AP
    for c, k in (("s", S_), ("t", S_), ("m", S_), ("d", S_), ("r", R_), ("v", V_), ("l", LL_), ("e", E_)):
        out[ord(c)] = k
    return out


def transitions() -> np.ndarray:
    """next[symbol, state]. sAP: after an apostrophe that begins a token; sEND: after a whole contraction."""
    out = np.zeros((SYMBOLS, STATES), np.uint8)
    plain = {RESET: BOS, L: sL, S_: sL, R_: sL, V_: sL, LL_: sL, E_: sL, N: sN, SP: sSP, WS: sWS, O: sO, AP: sO}
    for symbol, state in plain.items():
        out[symbol, :] = state
    for before in (BOS, sL, sN, sWS, sR, sV, sLL, sEND):
        out[AP, before] = sAP
    out[S_, sAP], out[R_, sAP], out[V_, sAP], out[LL_, sAP] = sEND, sR, sV, sLL
    out[E_, sR], out[E_, sV], out[LL_, sLL] = sEND, sEND, sEND
    return out


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked scan of transition functions."""
    n, step = len(symbols), transitions()
    rows = -(-n // block)
    grid = np.full(rows * block, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # row j: the j-th symbol of every block
    flat = step.ravel()
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    offset = grid.astype(np.uint16) * STATES
    for j in range(block):  # all blocks compose their next function in step
        whole = flat.take(offset[j][:, None] + whole)
    enter, state = np.empty(rows, np.uint8), BOS
    for k, f in enumerate(whole.tolist()):
        enter[k], state = state, f[state]
    out = np.empty((block, rows), np.uint8)
    for j in range(block):
        out[j] = enter
        enter = flat.take(offset[j] + enter)
    return out.T.reshape(-1)[:n]


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; code 0xFFFFFFFF separates texts and begins nothing."""
    table = symbol_table()
    ends = codes == 0xFFFFFFFF
    symbols = np.where(ends, RESET, table[np.where(ends, 0, codes)]).astype(np.uint8)
    before = states_before(symbols)
    kind = np.array([RESET, L, N, SP, WS, O, O, L, L, L, L, L], np.uint8)[symbols]
    last = np.concatenate([[RESET], kind[:-1]]).astype(np.uint8)
    white, was_white = (kind == SP) | (kind == WS), (last == SP) | (last == WS)
    start = (kind != last) & ~was_white | (last == WS) & ~white  # a new kind, or after white space other than a space
    start |= before == sEND  # whatever follows a contraction
    start[white & was_white] = False
    start[white & ~was_white] = True
    done = (before == sAP) & (symbols == S_)
    start[done] = False  # the letter belongs to its apostrophe
    two = np.flatnonzero(((before == sR) | (before == sV)) & (symbols == E_) | (before == sLL) & (symbols == LL_))
    start[two], start[two - 1] = False, False
    split = np.flatnonzero(~white & (kind != RESET) & was_white)  # white space before a text's end stays whole
    double = split[split > 1]
    double = double[np.isin(kind[double - 2], (SP, WS))]
    start[double - 1] = True  # the last of a run of white space begins anew
    start[kind == RESET] = False
    return start


class Vocabulary:
    """Ranks of byte sequences, and the remembered ids of pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.bytes[rank] = piece
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = ((self.ranks.get(p[:k]), self.ranks.get(p[k:]), r) for p, r in self.ranks.items() for k in range(1, len(p)))
        self.merger = PairMerger({(a, b): r for a, b, r in splits if a is not None and b is not None})
        self.decimal = [str(k) for k in range(len(self.bytes))]
        self.known: dict[bytes, tuple] = {}

    def merge_long(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, with a heap and links, for pieces of unbounded length."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, to = heapq.heappop(heap)
            right = nxt[k] if end[k] else n
            if not end[k] or right >= n or end[right] != to:
                continue
            end[k], end[right] = to, 0
            nxt[k] = nxt[right]
            if nxt[k] < n:
                prv[nxt[k]] = k
                if (r := ranks.get(piece[k : end[nxt[k]]])) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
            if prv[k] >= 0 and (r := ranks.get(piece[prv[k] : to])) is not None:
                heapq.heappush(heap, (r, prv[k], to))
        return [ranks[piece[k : end[k]]] for k in range(n) if end[k]]

    def learn(self, pieces: set[bytes]) -> None:
        """Remember (ids, their decimals joined by commas) of new pieces, merged together by length."""
        if len(self.known) > CACHE:
            self.known.clear()
        whole = {p for p in pieces if p in self.ranks}
        merged = self.merger.merge_pieces(list(pieces - whole), self.single, self.single)
        decimal = self.decimal
        for p in pieces:
            ids = (self.ranks[p],) if p in whole else tuple(merged[p]) if p in merged else tuple(self.merge_long(p))
            self.known[p] = ids, ",".join([decimal[i] for i in ids])


def vocabulary(path: str) -> Vocabulary:
    return work.held(("vocabulary", path), lambda: Vocabulary(path))


def slices(texts: list[str]) -> list[tuple[bytes, list[int]]]:
    """(UTF-8 bytes, byte offsets of pre-tokens and the end) of each text, which are small together."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le") + bytes(4), "<u4").copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    codes[ends] = 0xFFFFFFFF
    starts = np.flatnonzero(boundaries(codes))
    width = (1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int8) + (codes > 0xFFFF)).astype(np.int64)
    width[ends] = 0
    at = np.concatenate([[0], np.cumsum(width)])
    cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
    out, begin = [], 0
    for k, text in enumerate(texts):
        low = at[begin]
        out.append((text.encode(), (at[starts[cuts[k] : cuts[k + 1]]] - low).tolist() + [int(at[ends[k]] - low)]))
        begin = int(ends[k]) + 1
    return out


def encode_texts(texts: list[str], vocab: Vocabulary):
    """For each text: (lists of ids by piece, lists of decimals by piece, byte offsets of the pieces)."""
    group, size = [], 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text) + 1
        if size >= CHARS or k + 1 == len(texts):
            sliced = slices(group)
            cut = [[data[a:b] for a, b in zip(offsets, offsets[1:])] for data, offsets in sliced]
            pieces = {p for c in cut for p in c}
            if new := pieces - vocab.known.keys():
                vocab.learn(new)
                if lost := pieces - vocab.known.keys():  # the memory was emptied meanwhile
                    vocab.learn(lost)
            known = vocab.known
            for c, (_, offsets) in zip(cut, sliced):
                yield [known[p] for p in c], offsets
            for p in [p for p in new if len(p) > 64]:  # long pieces are not kept
                del known[p]
            group, size = [], 0


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of every text with the byte offsets of its pre-tokens: (doc_id, ids, piece_offsets)."""

    def run(batch_iter):
        vocab = vocabulary(path)
        for batch in work.batches(batch_iter, 128):
            ids, at = [], []
            for got, offsets in encode_texts([t or "" for t in batch.column(1).to_pylist()], vocab):
                ids.append([i for g in got for i in g[0]])
                at.append(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int64()))], names=["doc_id", "ids", "piece_offsets"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work.without_collector(run), "doc_id long, ids array<int>, piece_offsets array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of encoded rows (doc_id, ids): (doc_id, data binary)."""

    def run(batch_iter):
        vocab = vocabulary(path)
        for batch in work.batches(batch_iter, 128):
            data = [b"".join([vocab.bytes[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(work.without_collector(run), "doc_id long, data binary")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass, keeping counts and digests only."""

    def run(batch_iter):
        vocab = vocabulary(path)
        for batch in work.batches(batch_iter):
            rows = []
            for got, _ in encode_texts([t or "" for t in batch.column(1).to_pylist()], vocab):
                ids = [i for g in got for i in g[0]]
                data = b"".join([vocab.bytes[i] for i in ids])
                rows.append((len(ids), hashlib.sha256(",".join([g[1] for g in got]).encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work.without_collector(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
