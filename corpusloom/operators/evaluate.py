"""Retrieval and answer quality against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_any, normal_url, strip

# Beginnings of sentences that state no fact.
BOILERPLATE = ["Источники:", "📚", "Если", "Пожалуйста", "К сожалению", "Однако", "Вопрос", "Ответ"]
LIST_BOILERPLATE = ["Источники:", "📚"]
NO_CONTEXT = "no context to check facts"
#: Gates of a run: the least value of each measure.
GATES = {"precision_strict": 0.85, "precision_loose": 0.75, "mrr": 0.9, "groundedness": 0.9}


def relevant(source: Column, expected: Column) -> Column:
    """Whether a retrieved source matches an expected one: after normalising, either has the other in it."""
    own = normal_url(source)
    return F.exists(expected, lambda e: own.contains(normal_url(e)) | normal_url(e).contains(own))


def precision_at_k(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, rr): relevant hits in the first k over what was retrieved of them, and the first relevant hit's reciprocal rank; 0 for a query without hits."""
    judged = hits.join(truth.select("query_id", "expected_sources"), "query_id").select("query_id", "rank", relevant(F.col("source"), F.col("expected_sources")).alias("ok"))
    per = judged.groupBy("query_id").agg(F.count_if((F.col("rank") <= k) & F.col("ok")).alias("good"), F.count_if(F.col("rank") <= k).alias("n"), F.min(F.when(F.col("ok"), F.col("rank"))).alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return truth.select("query_id").join(per, "query_id", "left").select("query_id", zero(F.col("good") / F.nullif(F.col("n"), F.lit(0))).alias("precision"), zero(1 / F.col("first")).alias("rr"))


def matched_sources(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, source, rank) of the relevant hits."""
    return hits.join(truth.select("query_id", "expected_sources"), "query_id").where(relevant(F.col("source"), F.col("expected_sources"))).select("query_id", "source", "rank")


def _starts(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.startswith(w)
    return out


def facts(text: Column, boilerplate: list[str] | None = None) -> Column:
    """At most ten distinct sentences that may state a fact; parts between commas as well where fewer than two do."""
    fit = F.filter(F.transform(F.split(text, r"[.!?]\s+"), strip), lambda s: (F.length(s) > 12) & ~_starts(s, boilerplate or BOILERPLATE))
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda s: (F.length(s) > 15) & ~_starts(s, LIST_BOILERPLATE))
    every = F.when((F.size(fit) < 2) & text.contains(","), F.concat(fit, parts)).otherwise(fit)
    none = F.expr("cast(array() as array<string>)")
    return F.when(text.isNull() | (F.length(strip(text)) < 10), none).otherwise(F.slice(F.array_distinct(every), 1, 10))


def grounded(fact: Column, context: Column, key_facts: Column) -> Column:
    """A key fact stands in the fact and in the context, or half of the fact's words of four letters or more stand in the context; context is lower case."""
    low = F.lower(fact)
    by_key = F.exists(F.coalesce(key_facts, F.expr("cast(array() as array<string>)")), lambda x: low.contains(F.lower(x)) & context.contains(F.lower(x)))
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))
    return by_key | (F.coalesce(F.size(F.filter(words, lambda w: context.contains(w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0)) >= 0.5)


def groundedness(answers: DataFrame) -> DataFrame:
    """answers(query_id, answer, context, key_facts) -> groundedness, hallucination rate and at most five unfounded facts of each."""
    context = F.lower("context")
    own = answers.withColumn("f", facts(F.col("answer")))
    bad = F.filter("f", lambda x: ~grounded(x, context, F.col("key_facts")))
    has_context = F.coalesce(F.length("context") > 0, F.lit(False))
    keyed = F.size(F.filter("key_facts", lambda x: F.lower("answer").contains(F.lower(x))))
    no_context = F.when(keyed > 0, F.least(F.lit(0.4), keyed / F.size("key_facts") * 0.6)).otherwise(0.0)
    score = F.when(~has_context, no_context).when(F.size("f") == 0, 1.0).otherwise(1 - F.size(bad) / F.size("f"))
    shown = F.when(has_context, F.slice(F.transform(bad, lambda x: F.substring(x, 1, 100)), 1, 5)).when((no_context == 0) & (F.length("answer") > 0), F.array(F.lit(NO_CONTEXT))).otherwise(F.expr("cast(array() as array<string>)"))
    return own.select("query_id", score.alias("groundedness"), (1 - score).alias("hallucination"), shown.alias("unfounded"))


def evaluate(truth: DataFrame, hits: DataFrame, answers: DataFrame, k: int) -> DataFrame:
    """Metrics of each question with its category; what failed has zeros."""
    p, g = precision_at_k(hits, truth, k), groundedness(answers)
    m = matched_sources(hits, truth).groupBy("query_id").agg(F.count("*").alias("matched"))
    zero = lambda c, v=0.0: F.coalesce(c, F.lit(v)).alias(c)
    return truth.select("query_id", "category").join(p, "query_id", "left").join(g, "query_id", "left").join(m, "query_id", "left").select("query_id", "category", zero("precision"), zero("rr"), zero("groundedness"), zero("matched", 0))


def summary(results: DataFrame, categories: list[str]) -> DataFrame:
    """One row: counts and means overall and by category; an empty category has 0."""
    metrics = ("precision", "rr", "groundedness")
    mean = lambda c, keep=None: F.coalesce(F.round(F.avg(F.when(keep, F.col(c)) if keep is not None else F.col(c)), 6), F.lit(0.0))
    return results.agg(F.count("*").alias("questions"), *(mean(m).alias(m) for m in metrics), *(mean(m, F.col("category") == c).alias(f"{m}_{c}") for m in metrics for c in categories))


def gates(summarised: DataFrame, strict: str, loose: str, least: dict[str, float] | None = None) -> DataFrame:
    """Whether a summary meets the gates; precision of the strict and the loose category have their own."""
    columns = {"precision_strict": f"precision_{strict}", "precision_loose": f"precision_{loose}", "mrr": "rr", "groundedness": "groundedness"}
    return summarised.select(*((F.col(columns[name]) >= v).alias(f"{name}_ok") for name, v in {**GATES, **(least or {})}.items()))


__all__ = ["evaluate", "facts", "gates", "grounded", "groundedness", "has_any", "matched_sources", "precision_at_k", "relevant", "summary"]
