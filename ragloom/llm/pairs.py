"""Pair merging of byte-pair vocabularies for many pieces at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(1 << 30)


class PairMerger:
    """Merges the pair of lowest rank (leftmost first) in every piece until none is left.

    Pairs are (left id, right id) -> merged id, ids below 2**16; the merged id is also the rank.
    """

    def __init__(self, pairs: dict[tuple[int, int], int]):
        keys = np.fromiter(((a << 16) | b for a, b in pairs), np.uint32, len(pairs))
        order = np.argsort(keys)
        self.keys = np.concatenate([keys[order], np.array([0xFFFFFFFF], np.uint32)])
        self.made = np.concatenate([np.fromiter(pairs.values(), np.int32, len(pairs))[order], [NONE]]).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def merge(self, ids: np.ndarray):
        """(row numbers, merged ids of those rows) in groups of equal length; all rows are pieces of one length."""
        rows, ranks = np.arange(len(ids)), self.rank(ids[:, :-1], ids[:, 1:])
        while True:
            low = ranks.min(axis=1) if ranks.shape[1] else np.full(len(ids), NONE)
            live = low < NONE
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, ranks, low = rows[live], ids[live], ranks[live], low[live]
            if not len(rows):
                return
            n, width = ids.shape
            at, every = ranks.argmin(axis=1), np.arange(n)
            ids[every, at] = low
            keep = np.ones((n, width), bool)
            keep[every, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = keep[:, 1:]  # the merged pair's own rank goes
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                some = np.flatnonzero(at < width - 2)
                ranks[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                ranks[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])

    def merge_pieces(self, pieces: list[bytes], first: np.ndarray, last: np.ndarray, longest: int = 48, block: int = 20_000) -> dict[bytes, list[int]]:
        """piece -> ids for the pieces of up to `longest` bytes; first and last give the ids of inner and final bytes."""
        out, by_length = {}, {}
        for p in pieces:
            if 0 < len(p) <= longest:
                by_length.setdefault(len(p), []).append(p)
        for n, same in by_length.items():
            for at in range(0, len(same), block):
                part = same[at : at + block]
                raw = np.frombuffer(b"".join(part), np.uint8).reshape(-1, n)
                ids = first[raw]
                ids[:, -1] = last[raw[:, -1]]
                for rows, merged in self.merge(ids):
                    out.update(zip([part[k] for k in rows.tolist()], merged.tolist()))
        return out
