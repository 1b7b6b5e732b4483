"""Sources and sinks over parts, pages, documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunk as c
from ..sources import tables as s
from .registry import query
from .text_queries import strip


@query("s1_scan_folder", "select 'txt' as extension, role, sum(strlen(replace(text, chr(10), ' ')) + 1) as bytes from conversations group by role")
def _(tables):
    d = tables("conversations")
    folder = f"{s.scratch(d.sparkSession)}/scan-{uuid.uuid4().hex}"
    d.select("role", F.regexp_replace("text", "\n", " ").alias("value")).write.partitionBy("role").text(folder)
    return s.scan_folder(d.sparkSession, folder).groupBy("extension", F.regexp_extract("relative_path", "role=([^/]*)", 1).alias("role")).agg(F.sum("size").alias("bytes"))


@query("s2_decode", "select doc_id, md5(text) as valid, md5(text) as dropped, md5(text) as latin from documents")
def _(tables):
    raw = F.col("text").cast("binary")
    broken = F.concat(F.unhex(F.lit("FF")), raw, F.unhex(F.lit("C3")))
    return tables("documents").select("doc_id", F.md5(s.decode_any(raw)).alias("valid"), F.md5(s.decode(broken)).alias("dropped"), F.md5(s.decode_any(F.encode("text", "ISO-8859-1"), "latin-1")).alias("latin"))


@query("s3_sheet_rows", "select p_partkey + 1 as row, '[parts] ' || (p_partkey + 1) || ': ' || concat_ws(' | ', nullif(trim(p_name), ''), nullif(trim(case when p_partkey % 3 = 0 then ' ' else p_brand end), ''), p_size::varchar) as text from part")
def _(tables):
    p = tables("part").withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")))
    return s.sheet_rows(p, "parts", "p_partkey", ["p_name", "p_brand", "p_size"])


PRODUCT = "(select p_partkey, coalesce(case when p_partkey % 5 > 0 then p_name end, p_type) as name, p_type as category, case when p_partkey % 4 > 0 then p_partkey * 2 end::varchar as price, 'Продукт/услуга: ' || coalesce(case when p_partkey % 5 > 0 then p_name end, p_type) || chr(10) || 'Категория: ' || p_type || coalesce(chr(10) || 'Цена: ' || case when p_partkey % 4 > 0 then p_partkey * 2 end, '') || chr(10) || 'Size: ' || p_size as text from part)"


def products(tables):
    p = tables("part").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(" ").alias("Product Name"), F.col("p_type").alias("Category "), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") * 2).alias("PRICE, RUB"), F.col("p_size").alias("Size"))
    return s.price_products(p)


@query("s4_price_products", f"select name, category, price, text from {PRODUCT}")
def _(tables):
    return products(tables).select("name", "category", "price", "text")


@query("s5_price_chunks", f"select name, price, text, 0 as chunk_index from {PRODUCT}")
def _(tables):
    own = products(tables).withColumn("id", F.md5(F.concat_ws("|", "name", "text"))).dropDuplicates(["id"])
    parts = c.windows(own, "id", "text")
    return products(tables).withColumn("id", F.md5(F.concat_ws("|", "name", "text"))).select("id", "name", "price").join(parts, "id").select("name", "price", "text", "chunk_index")


@query("s6_validate", f"select doc_id, case when doc_id % 11 = 0 then 'extension' when length(text) > 8000 then 'size' when length({strip('text')}) < 50 then 'text' end as reject_reason from documents")
def _(tables):
    f = tables("documents").select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, "exe").otherwise("txt").alias("extension"), F.length("text").alias("size"))
    return s.validate(f, most=8000).select("doc_id", "reject_reason")


@query("s7_cap", "select doc_id, md5(case when length(text) > 2000 then left(text, 2000) || chr(10) || chr(10) || '[... документ обрезан, всего ' || length(text) || ' символов ...]' else text end) as digest from documents")
def _(tables):
    from ..functions.text import cap

    return tables("documents").select("doc_id", F.md5(cap(F.col("text"), 2000)).alias("digest"))


def _files(tables):
    return tables("documents").select("doc_id", F.col("source").alias("project_id"), F.concat("lang", F.lit("-"), F.col("doc_id") % 40).alias("filename"))


@query("s8_new_files", "with f as (select doc_id, source as project_id, lang || '-' || doc_id % 40 as filename from documents) select doc_id from f where (project_id, filename) not in (select project_id, filename from f where doc_id % 7 = 0)")
def _(tables):
    f = _files(tables)
    return s.new_files(f, f.where("doc_id % 7 = 0")).select("doc_id")


@query("s9_outcomes", "select source as project_id, count(*) filter (doc_id % 7 > 0 and length(text) >= 50) as processed, count(*) filter (doc_id % 7 = 0) as skipped, count(*) filter (doc_id % 7 > 0 and length(text) < 50) as error, count(*) as total from documents group by source")
def _(tables):
    o = F.when(F.col("doc_id") % 7 == 0, "skipped").when(F.length("text") < 50, "error").otherwise("processed")
    return s.outcomes(tables("documents").select(F.col("source").alias("project_id"), o.alias("outcome")))


def _chunks(tables):
    return s.chunk_ids(tables("conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("chunk_index"), "text", "role"))


CID = "md5(concat_ws('_', conv_id::varchar, turn::varchar, md5(text)))"


@query("s10_upsert", f"select {CID} as chunk_id, conv_id::varchar as source, turn as chunk_index, case when role = 'assistant' then 'v2' else 'v1' end as version from conversations where role <> 'system'")
def _(tables):
    own = _chunks(tables)
    return s.upsert(own.where("role = 'user' or role = 'assistant'").withColumn("version", F.lit("v1")), own.where("role = 'assistant'").withColumn("version", F.lit("v2"))).select("chunk_id", "source", "chunk_index", "version")


@query("s11_replace_source", "select conv_id::varchar as source, turn as chunk_index, 'old' as version from conversations where conv_id % 3 > 0 union all select conv_id::varchar, turn, 'new' from conversations where conv_id % 3 = 0 and turn < 2")
def _(tables):
    own = _chunks(tables)
    third = F.col("source").cast("long") % 3 == 0
    return s.replace_source(own.withColumn("version", F.lit("old")), own.where(third & (F.col("chunk_index") < 2)).withColumn("version", F.lit("new"))).select("source", "chunk_index", "version")


@query("s12_delete", "select 'documents' as name, count(*) as n from documents where source not in (select source from documents where doc_id % 250 = 0) union all select 'vectors', count(*) from embeddings where vec_id not in (select doc_id from documents where source in (select source from documents where doc_id % 250 = 0))")
def _(tables):
    d = tables("documents").select("doc_id", "source")
    gone = d.where("doc_id % 250 = 0").select("source")
    vectors = tables("embeddings").select(F.col("vec_id").alias("doc_id")).join(d, "doc_id", "left")
    left = s.delete({"documents": d, "vectors": vectors}, gone, "source")
    return left["documents"].agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n").union(left["vectors"].agg(F.count("*").alias("n")).select(F.lit("vectors"), "n"))


@query("s13_reindex", "select doc_id, 'index' as what from documents where doc_id not in (select vec_id from embeddings) union all select doc_id, 'chunk' from documents where doc_id % 5 > 0")
def _(tables):
    d = tables("documents").select("doc_id", F.col("text").alias("content"))
    have = tables("embeddings").select(F.col("vec_id").alias("chunk_id"))
    one = s.to_index(d.select(F.col("doc_id").alias("chunk_id")), have).select(F.col("chunk_id").alias("doc_id"), F.lit("index").alias("what"))
    return one.union(s.to_chunk(d, d.where("doc_id % 5 = 0")).select("doc_id", F.lit("chunk")))


@query("s14_json", "select conv_id, count(*) as n, cast(sum(length(text)) as bigint) as chars from conversations group by conv_id")
def _(tables):
    d = tables("conversations")
    folder = f"{s.scratch(d.sparkSession)}/json-{uuid.uuid4().hex}"
    s.write_json(d.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("messages")), folder)
    back = d.sparkSession.read.schema("conv_id long, messages array<struct<turn:long, role:string, text:string>>").json(folder)
    return back.select("conv_id", F.size("messages").cast("long").alias("n"), F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))


@query("s15_distinct_sources", "select distinct source from documents")
def _(tables):
    return s.distinct_sources(tables("documents"))


PREFIXES = ["https://www.ththth.example.net/en/", "therha.example.com", "HTTP://therin.example.net/en/7"]


@query("s16_allowed", r"with u as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(url)), '^https?://', ''), '^www\.', ''), '/+$', ''), '[?#].*$', '') as u from pages) select page_id from u where u = 'ththth.example.net/en' or starts_with(u, 'ththth.example.net/en/') or u = 'therha.example.com' or starts_with(u, 'therha.example.com/') or u = 'therin.example.net/en/7' or starts_with(u, 'therin.example.net/en/7/')")
def _(tables):
    p = tables("pages")
    return s.allowed(p, p.sparkSession.createDataFrame([(x,) for x in PREFIXES], "prefix string"), "url").select("page_id")
