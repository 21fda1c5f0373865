"""Cleaning of web documents and selection of question-answer examples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.config import DEFAULTS, Settings
from ragloom.functions import text as T
from ragloom.functions.markdown import markdown
from ragloom.sources.staging import pieces, spread

# The patterns that results must follow, in the order in which they apply.
NAVIGATION = r"(?dim)^(?:Jump to :|For other uses ,|Not to be confused with).*?$"
CONTENTS = r"(?is)## Contents.*?(?=\n## )"
EDIT_LITERAL = " ( edit )"
EDIT = r"(?i)\s*\(\s*edit\s*\)"
HATNOTE = r"(?dim)^\s*(?:Main article|Further information|See also)\s*:.*?$"
FOOTER = r"(?dim)^##\s*(?:References|External links|See also|Sources|Notes|Bibliography)\s*$[\s\S]*"
RETRIEVED = r"(?s)Retrieved from `` https://en\.wikipedia\.org.*"
CATEGORIES = r"(?s)Categories\s*:.*"
CELL_SPAN = r'(?i)<(Th|Td)_colspan="(\d+)">'


def clean_text(text: Column) -> Column:
    """Boilerplate lines and footers removed, in the fixed order; null stays null."""
    out = F.regexp_replace(F.regexp_replace(text, NAVIGATION, ""), CONTENTS, "")
    out = F.regexp_replace(F.replace(out, F.lit(EDIT_LITERAL), F.lit("")), EDIT, "")
    for pattern in (HATNOTE, FOOTER, RETRIEVED, CATEGORIES):
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_text(html: Column) -> Column:
    """The visible text by expressions alone: scripts, styles and tags go, common entities are decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"^\s+|\s+$", "")


def html_to_markdown(frame: DataFrame, key: str, html: str, bare: bool = True) -> DataFrame:
    """(key, markdown); html that cannot be parsed comes back unchanged. bare: as of markdown()."""

    def one(source):
        try:
            return markdown(source, bare)
        except Exception:  # noqa: BLE001
            return source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(h or "") for h in b.column(1).to_pylist()], pa.string())], names=[key, "markdown"])

    fixed = F.regexp_replace(F.col(html), CELL_SPAN, '<$1 colspan="$2">')
    own = spread(frame.select(key, html), key).select(key, fixed.alias("html"))
    return own.mapInArrow(run, f"{key} {frame.schema[key].dataType.simpleString()}, markdown string")


def process_documents(frame: DataFrame, key: str, html: str, bare: bool = True) -> DataFrame:
    """Markdown, then cleaning: (key, document_text)."""
    return html_to_markdown(frame, key, html, bare).select(key, T.normalize_ws(clean_text(F.col("markdown"))).alias("document_text"))


def count_answers(annotations: Column) -> Column:
    """Short answers over all annotations."""
    return F.aggregate(annotations, F.lit(0), lambda n, a: n + F.coalesce(F.size(a["short_answers"]), F.lit(0)))


def extract_answer(text: Column, annotations: Column) -> Column:
    """Tokens [start, end) of the first annotation whose first short answer has end > start."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    firsts = F.transform(F.filter(annotations, lambda a: F.coalesce(F.size(a["short_answers"]), F.lit(0)) > 0), lambda a: a["short_answers"][0])
    span = F.get(F.filter(firsts, lambda s: s["end_token"] > s["start_token"]), F.lit(0))
    return T.normalize_ws(F.array_join(F.slice(words, span["start_token"] + 1, span["end_token"] - span["start_token"]), " "))


def quality_filter(examples: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Examples with exactly one short answer of admissible length, with the column short_answer."""
    own = examples.withColumn("short_answer", extract_answer(F.col("document_text"), F.col("annotations")))
    return own.where((count_answers(F.col("annotations")) == 1) & F.length(F.trim("short_answer")).between(settings.answer_min_chars, settings.answer_max_chars))


def document_id(url: Column, title: Column, example: Column) -> Column:
    return F.coalesce(F.nullif(url, F.lit("")), F.nullif(title, F.lit("")), example.cast("string"), F.lit("unknown"))


def transform(examples: DataFrame) -> DataFrame:
    """(ID, Question, DocumentID, Document_text, Documentlength, short_answer) of filtered examples, texts cleaned."""
    row = F.struct(
        F.coalesce(F.col("example_id").cast("string"), F.lit("")).alias("ID"), F.coalesce("question_text", F.lit("")).alias("Question"),
        document_id(F.col("document_url"), F.col("document_title"), F.col("example_id")).alias("DocumentID"), F.coalesce("short_answer", F.lit("")).alias("short_answer"),
    )
    made = process_documents(examples.select(row.alias("row"), "document_text"), "row", "document_text")
    text = F.coalesce("document_text", F.lit(""))
    return made.select("row.ID", "row.Question", "row.DocumentID", text.alias("Document_text"), F.length(text).alias("Documentlength"), "row.short_answer")


CLEANED = ["ID", "Question", "DocumentID", "Document_text", "Documentlength", "short_answer"]


def validate_clean(cleaned: DataFrame, rows: int, settings: Settings = DEFAULTS, strict: bool = False, required: tuple = ("short_answer",)) -> DataFrame:
    """One row: n_rows, rows_ok, lengths_ok; strict raises where a check fails. ValueError where a required column is missing."""
    if missing := [c for c in required if c not in cleaned.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    length = F.length(F.trim("short_answer"))
    out = cleaned.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") == rows).alias("rows_ok"),
        F.coalesce(F.bool_and(length.between(settings.answer_min_chars, settings.answer_max_chars)), F.lit(False)).alias("lengths_ok"),
    )
    if strict and not all(out.first()[1:]):
        raise ValueError("the cleaned examples do not pass validation")
    return out
