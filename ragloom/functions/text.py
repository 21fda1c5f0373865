"""Column builders for text: all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def normalize_ws(text: Column) -> Column:
    """Runs of spaces to one, three or more line breaks to two, ends stripped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, " +", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip(text: Column) -> Column:
    """Without white space at the ends, in a few comparisons where a pattern would be tried at every character."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def tokens(text: Column) -> Column:
    """Lower-cased white-space tokens, repeats kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space; trimmed, blanks dropped."""
    parts = F.split(F.regexp_replace(text, r"([.!?])\s+", f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def chunk_id(strategy: Column, source: Column, index: Column) -> Column:
    return F.concat_ws(":", strategy, source.cast("string"), index.cast("string"))


def json_repair(text: Column) -> Column:
    """A JSON answer without its Markdown fence, closed or not."""
    own = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(own, r"^```[a-zA-Z]*[ \t]*\n?", ""), r"\s*```$", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector has no length."""
    double = lambda v: v.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def token_f1(answer: Column, truth: Column) -> Column:
    """F1 of the two sets of tokens; 0 where either is empty or nothing is shared."""
    a, b = F.array_distinct(tokens(answer)), F.array_distinct(tokens(truth))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.when(shared > 0, 2 * shared / (F.size(a) + F.size(b))), F.lit(0.0))


def metadata(**entries: Column) -> Column:
    """A map of the entries that have a value, as text."""
    pairs = [x for name, value in entries.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def entry(values: Column, name: str, default: str = "") -> Column:
    """A map's value, or the default."""
    return F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(default))
