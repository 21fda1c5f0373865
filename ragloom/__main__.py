"""Step runner: python -m ragloom --raw FILES --out FOLDER [--step N | --from-step N --to-step M].

1 cleans and samples raw examples, 2 chunks and indexes, 3 retrieves and answers, 4 evaluates. Every step reads what
the one before wrote below the output folder. --providers module:name names a dict of provider factories (embedder,
propose, arrange, generate, judge, metric); without it the offline defaults serve.
"""

from __future__ import annotations

import argparse
import importlib
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ragloom.config import DEFAULTS, Settings
from ragloom.functions import providers as P
from ragloom.operators import cleaning, evaluation, experiment, sampling
from ragloom.sources import io
from ragloom.sources.staging import exists, scope, shared_dir

log = logging.getLogger("ragloom")
CLEANED = "ID string, Question string, DocumentID string, Document_text string, Documentlength int, short_answer string"


def step1(spark: SparkSession, raw: str, out: str, settings: Settings, providers: dict) -> None:
    raws = io.read_jsonl(spark, raw)
    kept = cleaning.quality_filter(raws).select("example_id").distinct()
    flagged = raws.join(kept.withColumn("__ok", F.lit(True)), "example_id", "left")
    numbers = sampling.scanned(flagged, "example_id", F.col("__ok"), settings)
    sample = sampling.reservoir_sample(cleaning.quality_filter(raws), "example_id", settings.sample_size, settings.seed, numbers)
    io.write_csv(cleaning.transform(sample), f"{out}/cleaned")
    cleaning.validate_clean(read_cleaned(spark, out), settings.sample_size, settings, strict=True, required=tuple(cleaning.CLEANED))


def read_cleaned(spark: SparkSession, out: str):
    return io.read_csv(spark, f"{out}/cleaned", CLEANED)


def questions(spark: SparkSession, out: str):
    return read_cleaned(spark, out).select(F.col("ID").alias("question_id"), F.col("DocumentID").alias("document_id"), F.col("Question").alias("question"), "short_answer")


def picked(providers: dict, *names: str) -> dict:
    return {n: providers[n] for n in names if n in providers}


def step2(spark: SparkSession, raw: str, out: str, settings: Settings, providers: dict) -> None:
    experiment.index_documents(read_cleaned(spark, out), f"{out}/index", "ID", "Document_text", settings, **picked(providers, "embedder", "propose", "arrange"))


def step3(spark: SparkSession, raw: str, out: str, settings: Settings, providers: dict) -> None:
    asked = questions(spark, out)
    hits = experiment.all_hits(asked, f"{out}/index", settings=settings, **picked(providers, "embedder"))
    io.write_results(experiment.answered(asked, hits, f"{out}/index", **picked(providers, "generate")), f"{out}/results")
    log.info("results: %s", experiment.validate(io.read_results(spark, f"{out}/results"), asked.count()).first().asDict())


def step4(spark: SparkSession, raw: str, out: str, settings: Settings, providers: dict) -> None:
    rows = experiment.evaluated(io.read_results(spark, f"{out}/results"), **picked(providers, "judge", "metric"))
    names = {"retrieved_chunks": "retrieved_chunks_json", "tokens": "token_json"}
    columns = [c.split()[0] for c in io.RESULTS.split(", ")] + evaluation.METRICS
    io.write_csv(rows.withColumnsRenamed(names).select(columns), f"{out}/evaluation")
    metrics = ", ".join(f"{m} double" for m in evaluation.METRICS)
    again = spark.read.schema(f"{io.RESULTS}, {metrics}").option("header", True).option("multiLine", True).option("escape", '"').csv(f"{out}/evaluation")
    io.write_json(spark, experiment.summary_json(again), f"{out}/summary")


STEPS = {1: step1, 2: step2, 3: step3, 4: step4}


#: What a provider is asked before a run, by its name.
PROBES = {"embedder": ["probe"], "propose": ["Answer with OK."], "arrange": ["Answer with OK."], "generate": ["Answer with OK."], "judge": ["Reply YES."], "metric": ["Reply YES."]}


def check_providers(providers: dict) -> None:
    """Exit where a provider has an unknown name, cannot be made or does not answer one probe."""
    if unknown := sorted(set(providers) - set(PROBES)):
        sys.exit(f"unknown providers {unknown}; known are {sorted(PROBES)}")
    for name, make in providers.items():
        try:
            call = make()
            probes = [P.Message("", p) for p in PROBES[name]] if getattr(call, "messages", False) else PROBES[name]
            if len(list(call(probes))) != len(probes):
                raise ValueError("no answer")
        except Exception as error:  # noqa: BLE001
            sys.exit(f"provider {name}: {type(error).__name__}: {error}")


def check_environment(spark: SparkSession, raw: str | None, first: int, out: str, providers: dict | None = None) -> None:
    """Exit where the shared folder is not set, a step's input is missing, or a provider does not answer."""
    try:
        shared_dir(spark)
    except ValueError as error:
        sys.exit(str(error))
    if first == 1 and not raw:
        sys.exit("step 1 reads raw examples: name them by --raw")
    for step, table in ((2, "cleaned"), (3, "index"), (4, "results")):
        if first == step and not exists(spark, f"{out}/{table}"):
            sys.exit(f"step {step} reads {out}/{table}, which is not there: run the steps before it")
    check_providers(providers or {})


def main(args: list[str] | None = None, spark: SparkSession | None = None, settings: Settings = DEFAULTS) -> list[int]:
    """Run the chosen steps in order; returns their numbers. A step that fails ends the run with its error."""
    own = argparse.ArgumentParser(prog="ragloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    own.add_argument("--raw")
    own.add_argument("--out", required=True)
    own.add_argument("--step", type=int, choices=STEPS)
    own.add_argument("--from-step", type=int, choices=STEPS, default=1)
    own.add_argument("--to-step", type=int, choices=STEPS, default=4)
    own.add_argument("--providers")
    own.add_argument("--verbose", "-v", action="store_true")
    known = own.parse_args(args)
    logging.basicConfig(level=logging.DEBUG if known.verbose else logging.INFO)
    log.setLevel(logging.DEBUG if known.verbose else logging.INFO)
    chosen = [known.step] if known.step else list(range(known.from_step, known.to_step + 1))
    providers: dict = {}
    if known.providers:
        module, _, name = known.providers.partition(":")
        providers = getattr(importlib.import_module(module), name)
    spark = spark or SparkSession.builder.appName("ragloom").getOrCreate()
    out = known.out.rstrip("/")
    check_environment(spark, known.raw, chosen[0] if chosen else 0, out, providers)
    for n in chosen:
        log.info("step %d", n)
        try:
            with scope(spark):
                STEPS[n](spark, known.raw, out, settings, providers)
        except Exception:
            log.exception("step %d failed", n)
            raise
    return chosen


if __name__ == "__main__":
    main()
