"""Chunkers and sentences as table functions of SQL: register(spark), then

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_heuristic(d.text, 512, 51) c
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ragloom.operators.chunking import heuristic_units

CHUNKS = "chunk_index bigint, text string, token_count bigint"
END, SPACE = re.compile(r"([.!?])\s+", re.ASCII), re.compile(r"\s+", re.ASCII)
WHITE = " \t\n\x0b\f\r"


def sentences_of(text: str | None) -> list[str]:
    """What functions.text.sentences gives, for one text."""
    parts = [s.strip(WHITE) for s in END.sub("\\1\x01", text or "").split("\x01")]
    return [s for s in parts if s]


@udtf(returnType=CHUNKS, useArrow=True)
class HeuristicChunks:
    """(text, size, overlap): sentences gathered to a number of words, with overlap."""

    def eval(self, text: str, size: int, overlap: int):
        units = []
        for s in sentences_of(text):
            words = [w for w in s.replace("\n", " ").split(" ") if w]
            units += [(" ".join(words), len(words))] if len(words) <= size else [(w, 1) for w in words]
        for k, (chunk, count) in enumerate(heuristic_units([u for u in units if u[1]], size, overlap)):
            yield k, chunk, count


@udtf(returnType=CHUNKS, useArrow=True)
class TokenWindows:
    """(text, size, overlap): windows of words."""

    def eval(self, text: str, size: int, overlap: int):
        words = [w for w in SPACE.split(text or "") if w]
        for k, at in enumerate(range(0, max(1, len(words) - overlap), size - overlap) if words else ()):
            own = words[at : at + size]
            yield k, " ".join(own), len(own)


@udtf(returnType="pos bigint, sentence string", useArrow=True)
class Sentences:
    """(text): its sentences."""

    def eval(self, text: str):
        yield from enumerate(sentences_of(text))


FUNCTIONS = {"chunk_heuristic": HeuristicChunks, "chunk_token_window": TokenWindows, "split_sentences": Sentences}


def register(spark: SparkSession) -> list[str]:
    """Register the table functions for this session; returns their names. Rows travel in Arrow batches."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
    return list(FUNCTIONS)
