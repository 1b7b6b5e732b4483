"""Context assembly: packing hits into a budget, formatting, prompts, history, catalogues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_keywords, strip

# Headers, lines and separators of contexts.
PART, PARTS = "[{source}, часть {n}]\n{text}\n", "\n---\n"
SOURCE, SOURCES = "[Источник: {source}]\n{text}", "\n\n---\n\n"
FRAGMENT = "Фрагмент {n} (источник: {source}, релевантность: {score}):\n{text}"
CITATION = '{n}. {source}, чанк {chunk}: "{quote}"'
CATALOGUE, FILE, FILE_WORDS, FILE_DATE = "Доступные документы в проекте:", "{n}. Файл: {name} (тип: {kind})", "\n   Ключевые слова: {words}", "\n   Загружен: {date}"
NO_NAME, NO_SOURCE, DOCUMENT, CHUNK = "Документ", "неизвестно", "Документ {id}", "Чанк {n}"


def filled(template: str, **fields: Column) -> Column:
    """A template with its {fields} replaced by columns."""
    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        parts += [F.lit(template[at : m.start()]), fields[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def joined(rows: DataFrame, by: str | list[str], order: list[str], text: Column, glue: str, name: str = "text") -> DataFrame:
    """Texts of each group joined in an order."""
    own = rows.select(*([by] if isinstance(by, str) else by), F.struct(*order, text.alias("__t")).alias("__s"))
    return own.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("__s")), lambda x: x["__t"]), glue).alias(name))


def pack_until_full(hits: DataFrame, budget: int, with_header: bool = True) -> DataFrame:
    """(query_id, chunks, context): hits by score, then chunk_index, up to the first that overflows the budget of characters. With headers they count, otherwise only texts do; blank texts are passed over."""
    own = hits.where(F.coalesce("text", F.lit("")) != "")
    header = filled(PART, source=F.coalesce("source", F.lit(NO_NAME)), n=F.col("chunk_index") + 1, text=F.col("text"))
    own = own.withColumn("block", header if with_header else filled(SOURCE, source=F.coalesce("source", F.lit(NO_SOURCE)), text=F.col("text"))).withColumn("n", F.length("block") if with_header else F.length("text"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index", "chunk_id")
    own = own.withColumn("total", F.sum("n").over(w)).withColumn("at", F.row_number().over(w)).where(F.col("total") <= budget)
    return joined(own, "query_id", ["at"], F.col("block"), PARTS if with_header else SOURCES, "context").join(own.groupBy("query_id").agg(F.count("*").alias("chunks")), "query_id")


def pack_skipping(hits: DataFrame, budget: int) -> DataFrame:
    """(query_id, chunks, context): hits by score; one that overflows the budget is left out and the next is tried."""
    order = hits.where(F.coalesce("text", F.lit("")) != "").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_index", "chunk_id", "text"))).alias("h"))
    start = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("out"))
    step = lambda a, x: F.when(a["n"] + F.length(x["text"]) <= budget, F.struct((a["n"] + F.length(x["text"])).alias("n"), F.concat(a["out"], F.array(x["text"])).alias("out"))).otherwise(a)
    return order.select("query_id", F.aggregate("h", start, step, lambda a: a["out"]).alias("o")).select("query_id", F.size("o").alias("chunks"), F.array_join("o", SOURCES).alias("context"))


def fragments(hits: DataFrame) -> DataFrame:
    """(query_id, context): hits numbered, with source and score to two places."""
    named = F.coalesce(F.when(F.col("source") != "", F.col("source")), filled(DOCUMENT, id=F.col("rank")))
    block = filled(FRAGMENT, n=F.col("rank"), source=named, score=F.format_string("%.2f", F.col("score").cast("double")), text=F.coalesce("text", F.lit("")))
    return joined(hits, "query_id", ["rank"], block, "\n\n", "context")


def citations(hits: DataFrame, most: int = 3, quote: int = 100) -> DataFrame:
    """(query_id, citations): of the first hits (document_id, chunk_index, text, rank), those unique by document and chunk, numbered by rank and quoted."""
    first = hits.where(F.col("rank") <= most)
    key = ["query_id", "document_id", "chunk_index"]
    own = first.groupBy(*key).agg(F.min_by("text", "rank").alias("text"), F.min("rank").alias("rank"))
    name = F.coalesce(F.when(F.col("document_id").cast("string") != "", filled(DOCUMENT, id=F.substring(F.col("document_id").cast("string"), 1, 8))), filled(CHUNK, n=F.col("rank")))
    said = F.concat(strip(F.substring("text", 1, quote)), F.when(F.length("text") > quote, "...").otherwise(""))
    return joined(own, "query_id", ["rank"], filled(CITATION, n=F.col("rank"), source=name, chunk=F.col("chunk_index").cast("int") + 1, quote=said), "\n", "citations")


def prompts(queries: DataFrame, contexts: DataFrame, history: DataFrame, template: str) -> DataFrame:
    """(query_id, messages): the template with the context, the history, the question."""
    own = queries.join(contexts.select("query_id", "context"), "query_id", "left").join(history.select("user_id", "history"), "user_id", "left")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    system = F.replace(F.replace(F.lit(template), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("question"))
    none = F.expr("cast(array() as array<struct<role:string, content:string>>)")
    return own.select("query_id", F.concat(F.array(message("system", system)), F.coalesce("history", none), F.array(message("user", F.col("question")))).alias("messages"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """(user_id, history): the last n messages of each user, oldest first, as structs of role and content."""
    w = Window.partitionBy("user_id").orderBy(F.desc("turn"))
    own = messages.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return own.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("history"))


def catalogue(documents: DataFrame, most: int = 20) -> DataFrame:
    """(project_id, catalogue): the newest documents (filename, file_type, created) of each project, numbered, with type, keywords and date."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created"), "filename")
    own = documents.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).withColumn("words", F.array_join(F.slice(file_keywords(F.col("filename")), 1, 5), ", "))
    line = F.concat(
        filled(FILE, n=F.col("r"), name=F.col("filename"), kind=F.upper("file_type")),
        F.when(F.col("words") != "", filled(FILE_WORDS, words=F.col("words"))).otherwise(""),
        F.coalesce(filled(FILE_DATE, date=F.date_format("created", "yyyy-MM-dd")), F.lit("")),
    )
    return joined(own, "project_id", ["r"], line, "\n", "catalogue").withColumn("catalogue", F.concat(F.lit(CATALOGUE + "\n"), "catalogue"))


def whole_text(chunks: DataFrame, by: str) -> DataFrame:
    """(id, text): chunks of a document joined in order."""
    return joined(chunks, by, ["chunk_index"], F.col("text"), "\n\n")


def sample(chunks: DataFrame, documents: int = 5, per: int = 3, chars: int = 500) -> DataFrame:
    """The first chunks of the first documents of each project, cut to a length."""
    firsts = chunks.select("project_id", "doc_id").distinct().withColumn("d", F.row_number().over(Window.partitionBy("project_id").orderBy("doc_id"))).where(F.col("d") <= documents)
    own = chunks.join(firsts.drop("d"), ["project_id", "doc_id"]).withColumn("c", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index"))).where(F.col("c") <= per)
    return own.select("project_id", "doc_id", "chunk_index", F.substring("text", 1, chars).alias("text"))


def summaries(documents: DataFrame, n: int, chars: int = 500) -> DataFrame:
    """At most n summaries of each project, stored ones first (1.0), else the beginning of the text (.8)."""
    w = Window.partitionBy("project_id").orderBy(F.col("summary").isNull(), "doc_id")
    own = documents.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return own.select("doc_id", "project_id", F.coalesce("summary", F.substring("content", 1, chars)).alias("summary"), F.when(F.col("summary").isNotNull(), 1.0).otherwise(0.8).alias("score"))


def question_answer_rows(messages: DataFrame) -> DataFrame:
    """(conv_id, id, question, answer, combined): each answer to the question right before it, with a stable id."""
    a = messages.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = messages.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    combined = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    return q.join(a, ["conv_id", "turn"]).select("conv_id", F.md5(F.concat_ws("|", "question", "answer")).alias("id"), "question", "answer", combined.alias("combined"))


