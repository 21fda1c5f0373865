"""Pooled retrieval metrics, answer metrics and their grouped means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import providers as P
from ragloom.functions import text as T
from ragloom.sources.staging import staged

METRICS = ["relative_recall_at_k", "mrr_at_k", "ndcg_at_k", "f1_score", "faithfulness", "factual_correctness"]


def pool(hits: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    """Distinct chunks of all methods: each is judged once."""
    return hits.select(*keys, chunk).distinct()


def ranked_metrics(hits: DataFrame, judged: DataFrame, keys: list[str], chunk: str, per: list[str]) -> DataFrame:
    """(keys, per, recall, mrr, ndcg) of every ranked list; judged: (keys, chunk, relevant)."""
    totals = judged.groupBy(*keys).agg(F.sum(F.col("relevant").cast("int")).alias("total"))
    rel = F.coalesce(F.col("relevant"), F.lit(False))
    lists = hits.join(judged, [*keys, chunk], "left").groupBy(*keys, *per).agg(
        F.sum(rel.cast("int")).alias("found"), F.min(F.when(rel, F.col("rank"))).alias("first"), F.count("*").alias("k"),
        F.sum(F.when(rel, 1.0 / F.log2(F.col("rank") + 1)).otherwise(F.lit(0.0))).alias("dcg"),
    )
    own = lists.join(totals, keys, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("k", "total").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    zero = F.col("total") == 0
    return own.select(
        *keys, *per,
        F.round(F.when(zero, 0.0).otherwise(F.col("found") / F.col("total")), 6).alias("relative_recall_at_k"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr_at_k"),
        F.round(F.when(zero, 0.0).otherwise(F.col("dcg") / ideal), 6).alias("ndcg_at_k"),
    )


def joined_with_zeros(results: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on the result key; metrics that are missing become 0."""
    return results.join(metrics, keys, "left").fillna(0.0, [c for c in metrics.columns if c not in keys])


def answer_metrics(results: DataFrame, answer: str, truth: str, context: str, judge=None, question: str | None = None, budget: P.Budget = P.Budget()) -> DataFrame:
    """results with f1_score, faithfulness and factual_correctness.

    By default claims are sentences. judge: makes a provider that takes an answer apart into claims and then tells of each
    claim whether it follows (claim_metrics).
    """
    own = results.withColumn("f1_score", F.round(T.token_f1(F.col(answer), F.col(truth)), 6))
    if judge is None:
        return own.withColumn("faithfulness", F.round(P.faithfulness(F.col(answer), F.col(context)), 6)).withColumn("factual_correctness", F.round(P.factual_correctness(F.col(answer), F.col(truth)), 6))
    return claim_metrics(own, answer, truth, context, judge, question, budget)


def claim_metrics(results: DataFrame, answer: str, truth: str, context: str, judge, question: str | None = None, budget: P.Budget = P.Budget()) -> DataFrame:
    """results with faithfulness and factual_correctness from a model's verdicts on single claims.

    First every different (question, text) is taken apart into claims, then every different (premise, claim) is judged:
    the answer's claims by the context and by the truth, the truth's claims by the answer. faithfulness is the share of
    the answer's claims that follow from the context; factual_correctness is F1 of the share of the answer's claims that
    follow from the truth and of the truth's that follow from the answer. Without claims, or where the model failed to
    name them, a share is 0; a verdict that failed counts as no.
    """
    asked = F.lit("") if question is None else F.coalesce(question, F.lit(""))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = staged(results.select("*", F.struct(asked.alias("q"), text(answer).alias("a"), text(truth).alias("t"), text(context).alias("c")).alias("__m")).withColumn("__id", F.monotonically_increasing_id()), "judged")
    side = lambda s: rows.select(F.col("__m.q").alias("q"), F.col(f"__m.{s}").alias("text"))
    texts = side("a").unionByName(side("t")).where(F.trim("text") != "").distinct()
    said = P.ask(texts, P.prompt("statements", question=F.col("q"), answer=F.col("text")), judge, "__said", "__status", budget, lambda a: P.parsed_statements(a).isNotNull())
    claims = staged(said.select("q", "text", F.explode(P.parsed_statements(F.col("__said"))).alias("claim")), "claims")
    ways = F.explode(F.array(*[F.struct(F.lit(w).alias("way"), F.col(f"__m.{s}").alias("text"), F.col(f"__m.{p}").alias("premise")) for w, s, p in (("faithful", "a", "c"), ("precise", "a", "t"), ("complete", "t", "a"))]))
    pairs = rows.select("__id", F.col("__m.q").alias("q"), ways.alias("w")).select("__id", "q", "w.*").join(claims, ["q", "text"]).select("__id", "way", "premise", "claim")
    judged = P.ask(pairs.select("premise", "claim").distinct(), P.prompt("verdict", premise=F.col("premise"), statement=F.col("claim")), judge, "__said", "__status", budget)
    holds = judged.select("premise", "claim", P.parse_judgement(F.col("__said")).alias("holds"))
    shares = pairs.join(holds, ["premise", "claim"]).groupBy("__id").pivot("way", ["faithful", "precise", "complete"]).agg(F.avg(F.col("holds").cast("double")))
    p, r = F.coalesce("precise", F.lit(0.0)), F.coalesce("complete", F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    out = rows.join(shares, "__id", "left").withColumn("faithfulness", F.round(F.coalesce("faithful", F.lit(0.0)), 6)).withColumn("factual_correctness", F.round(f1, 6))
    return out.drop("__id", "__m", "faithful", "precise", "complete")


def summary(results: DataFrame, strategy: str, method: str, metrics: list[str]) -> DataFrame:
    """Means by strategy, by method and by both, in one pass; NaN counts as missing."""
    means = [F.round(F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))), 6).alias(f"mean_{m}") for m in metrics]
    kind = F.when(F.grouping_id() == 0, "combination").when(F.grouping_id() == 1, "strategy").otherwise("method")
    sets = results.groupingSets([[F.col(strategy)], [F.col(method)], [F.col(strategy), F.col(method)]], F.col(strategy), F.col(method))
    return sets.agg(kind.alias("grouping_name"), *means).select("grouping_name", strategy, method, *[f"mean_{m}" for m in metrics])
