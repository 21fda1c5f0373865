"""Sources and sinks. Parquet is the exchange format between steps; CSV and JSON serve the edges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RAW = "example_id long, question_text string, document_text string, document_url string, document_title string, annotations array<struct<short_answers: array<struct<start_token: int, end_token: int>>>>"


def parsed_lines(spark: SparkSession, path: str, schema: str = RAW, tasks: int | None = None) -> DataFrame:
    """(file, line, row) of every line that is not blank; row is null where the line is not of that form.

    A gzip file is read by one task; its lines are dealt out to `tasks` tasks (by default those of the session) before
    they are parsed.
    """
    lines = spark.read.text(path)
    if tasks or any(f.endswith((".gz", ".bz2", ".zst")) for f in lines.inputFiles()):
        lines = lines.select("value", F.col("_metadata.file_path").alias("file")).repartition(tasks or spark.sparkContext.defaultParallelism)
    else:
        lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    bad = "__bad"
    kind = StructType([*_parse(schema).fields, StructField(bad, StringType())])
    read = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    own = lines.where(F.trim("value") != "").select("file", F.col("value").alias("line"), read.alias("__r"))
    fine = F.col("__r").isNotNull() & F.col(f"__r.{bad}").isNull() & F.startswith(F.trim("line"), F.lit("{"))
    row = F.struct(*[F.col(f"__r.{f.name}").alias(f.name) for f in _parse(schema).fields])
    return own.select("file", "line", F.when(fine, row).alias("row"))


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW, tasks: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not, dealt out to tasks; blank and malformed lines are dropped (bad_lines has these)."""
    return parsed_lines(spark, path, schema, tasks).where("row is not null").select("row.*")


def bad_lines(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """(file, line) of the malformed lines that read_jsonl drops."""
    return parsed_lines(spark, path, schema).where("row is null").select("file", "line")


def line_counts(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """(file, n_rows, n_bad) of every file with lines."""
    return parsed_lines(spark, path, schema).groupBy("file").agg(F.count("row").alias("n_rows"), F.count_if(F.col("row").isNull()).alias("n_bad"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quoted line breaks; an explicit schema, so that words such as NA stay words."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """Nested columns as JSON text with null fields kept."""
    flat = [F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in frame.schema]
    frame.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


RESULTS = "chunking_strategy string, retrieval_method string, question_id string, document_id string, question string, short_answer string, generated_answer string, retrieved_chunks_json string, token_json string"
CHUNKS = "array<struct<rank: bigint, chunk_id: string, source_id: string, chunk_text: string, chunk_length: bigint, score: double>>"
TOKENS = "struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"


def write_results(results: DataFrame, path: str) -> None:
    """Results with their chunks and token counts as JSON columns."""
    flat = results.withColumnsRenamed({"retrieved_chunks": "retrieved_chunks_json", "tokens": "token_json"})
    write_csv(flat, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    own = read_csv(spark, path, RESULTS)
    parsed = own.withColumn("retrieved_chunks", F.from_json("retrieved_chunks_json", CHUNKS)).withColumn("tokens", F.from_json("token_json", TOKENS))
    return parsed.drop("retrieved_chunks_json", "token_json")


def lookup(ids: DataFrame, chunks: DataFrame, key: str = "chunk_id", text: str = "text", metadata: tuple = ()) -> DataFrame:
    """Texts and metadata columns of chunk ids; an unknown id has the empty text and null metadata."""
    return ids.join(chunks.select(key, text, *metadata), key, "left").withColumn(text, F.coalesce(text, F.lit("")))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One nested object as one JSON file."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)
