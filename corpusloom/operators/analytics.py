"""Usage, cost, coverage and listing reports as aggregations over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import keywords, status

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def _sums() -> list:
    return [*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS), F.count("*").alias("requests")]


def usage_totals(usage: DataFrame, model: str | None = None, project: str | None = None, since=None, until=None) -> DataFrame:
    """One row of token totals of the usage that the filters leave; a total of nothing is 0."""
    for given, keep in ((model, F.col("model_id") == model), (project, F.col("project_id") == project), (since, F.col("created_at") >= F.lit(since).cast("timestamp")), (until, F.col("created_at") < F.lit(until).cast("timestamp"))):
        usage = usage.where(keep) if given is not None else usage
    return usage.agg(*_sums())


def usage_by_model(usage: DataFrame) -> DataFrame:
    return usage.groupBy("model_id").agg(*_sums()).orderBy(F.desc("total_tokens"), "model_id")


def usage_report(usage: DataFrame, as_of, days: int) -> DataFrame:
    """Totals by model of the last days before as_of, and a grand total where model_id is null."""
    recent = usage.where((F.col("created_at") < F.lit(as_of).cast("timestamp")) & (F.col("created_at") >= F.expr(f"timestamp'{as_of}' - interval {days} days")))
    return recent.rollup("model_id").agg(*_sums())


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost: tokens at a price per million, in decimals; null where a price is missing or zero. prices has one row per model."""
    million = F.lit(1_000_000).cast("decimal(10,0)")
    part = lambda tokens, price: F.col(tokens).cast("decimal(20,0)") * F.nullif(F.col(price), F.lit(0)) / million
    cost = (part("input_tokens", "input_price") + part("output_tokens", "output_price")).cast("decimal(38,10)")
    return usage.join(prices, "model_id", "left").withColumn("cost", cost).drop("input_price", "output_price")


def tenant_counts(projects: DataFrame, users: DataFrame, documents: DataFrame) -> DataFrame:
    """Users and documents of each project, zero where it has none."""
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    out = projects.join(count(users, "users"), "project_id", "left").join(count(documents, "documents"), "project_id", "left")
    return out.select("project_id", F.coalesce("users", F.lit(0)).alias("users"), F.coalesce("documents", F.lit(0)).alias("documents"))


def index_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks, and those that have a vector, by project."""
    have = vectors.select("chunk_id", F.lit(1).alias("has")).dropDuplicates(["chunk_id"])
    return chunks.join(have, "chunk_id", "left").groupBy("project_id").agg(F.count("*").alias("chunks"), F.count("has").alias("indexed"))


def status_counts(documents: DataFrame, **kw) -> DataFrame:
    """Documents of each project by status; the three are disjoint."""
    s = status(F.col("content"), **kw)
    return documents.groupBy("project_id").agg(*(F.count_if(s == x).alias(x) for x in ("ready", "processing", "error")))


def best_strategy(scores: DataFrame) -> DataFrame:
    """The strategy with the highest score above 0 of each query; the first by name of equals."""
    top = F.min(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("s"), "strategy")))
    return scores.groupBy("query_id").agg(top.alias("m"), F.count("*").alias("compared")).select("query_id", "compared", F.col("m.strategy").alias("winner"), (-F.col("m.s")).alias("score"))


def trace_summary(steps: DataFrame) -> DataFrame:
    """Steps, distinct kinds, duration in seconds and text length of each trace (trace_id, ts, kind, text)."""
    seconds = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    return steps.groupBy("trace_id").agg(F.count("*").alias("steps"), F.count_distinct("kind").alias("kinds"), F.round(seconds, 3).alias("seconds"), F.sum(F.length("text")).cast("long").alias("chars"))


def hit_statistics(lookups: DataFrame) -> DataFrame:
    """Hits, misses and their ratio of cache lookups (hit boolean)."""
    hits = F.count_if("hit")
    return lookups.agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.nullif(F.count("*"), F.lit(0)), 6).alias("ratio"))


def newest(df: DataFrame, by: str, key: str, n: int, text: str, chars: int) -> DataFrame:
    """The n newest rows with a text cut to a length."""
    return df.orderBy(F.desc(by), key).limit(n).withColumn(text, F.substring(text, 1, chars))


def catalogue(listed: DataFrame, own: DataFrame, search: str | None = None) -> DataFrame:
    """Listed and own models in one table, those whose name or id has the search text, in any case."""
    both = listed.withColumn("is_custom", F.lit(False)).unionByName(own.withColumn("is_custom", F.lit(True)), allowMissingColumns=True)
    return both if search is None else both.where(F.lower("name").contains(search.lower()) | F.lower("model_id").contains(search.lower()))


def page(df: DataFrame, by: str, key: str, number: int, size: int) -> DataFrame:
    """A page of a listing, newest first; pages count from 0."""
    return df.orderBy(F.desc(by), key).offset(number * size).limit(size)


def index_statistics(chunks: DataFrame) -> DataFrame:
    """Chunks of each source, and of all where source is null."""
    return chunks.rollup("source").agg(F.count("*").alias("chunks"))


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with what changes supplies: a null leaves a column as it is."""
    own = [c for c in changes.columns if c != key and c in base.columns]
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in own))
    return base.join(new, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in own else F.col(c) for c in base.columns))


def resolve_model(projects: DataFrame, settings: DataFrame, default: str) -> DataFrame:
    """The model of each project: its own, else the primary of the one-row settings, else the default."""
    return projects.crossJoin(settings.select("primary_model").limit(1)).select("project_id", F.coalesce("llm_model", "primary_model", F.lit(default)).alias("model"))


def project_keywords(documents: DataFrame, text: str, most: int = 20) -> DataFrame:
    """The most frequent keywords of each project's names, by the number of documents, at most so many."""
    from pyspark.sql import Window

    counted = documents.select("project_id", F.explode(keywords(F.col(text))).alias("keyword")).groupBy("project_id", "keyword").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "keyword"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)
