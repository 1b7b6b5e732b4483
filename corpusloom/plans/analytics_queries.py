"""Reports over usage (lineitem joined to part), tenants (customer, orders), documents, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as a
from .registry import query
from .text_queries import tok

USAGE = "(select concat('m', l_partkey % 50) as model_id, concat('p', l_suppkey % 10) as project_id, cast(l_quantity as bigint) as input_tokens, cast(l_quantity as bigint) * 3 as output_tokens, cast(l_quantity as bigint) * 4 as total_tokens, l_shipdate as created_at, l_orderkey, l_linenumber from lineitem)"
SUMS = "cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens, count(*) as requests"


def usage(tables):
    q = F.col("l_quantity").cast("long")
    return tables("lineitem").select(F.concat(F.lit("m"), F.col("l_partkey") % 50).alias("model_id"), F.concat(F.lit("p"), F.col("l_suppkey") % 10).alias("project_id"), q.alias("input_tokens"), (q * 3).alias("output_tokens"), (q * 4).alias("total_tokens"), F.col("l_shipdate").alias("created_at"), "l_orderkey", "l_linenumber")


def documents(tables):
    return tables("documents").select("doc_id", F.col("source").alias("project_id"), F.col("text").alias("content"), "lang")


@query("a1_usage_totals", f"select {SUMS} from {USAGE} where model_id = 'm7' and created_at >= timestamp '1995-01-01' and created_at < timestamp '1997-01-01'")
def _(tables):
    return a.usage_totals(usage(tables), model="m7", since="1995-01-01", until="1997-01-01")


@query("a2_usage_by_model", f"select model_id, {SUMS} from {USAGE} group by model_id")
def _(tables):
    return a.usage_by_model(usage(tables))


@query("a3_usage_report", f"select model_id, {SUMS} from {USAGE} where created_at < timestamp '1998-01-01' and created_at >= timestamp '1998-01-01' - interval 90 days group by rollup(model_id)")
def _(tables):
    return a.usage_report(usage(tables), "1998-01-01", 90)


@query("a4_usage_cost", f"""
with p as (select concat('m', p_partkey) as model_id, cast(case when p_partkey % 7 = 0 then 0 else p_partkey + 1 end as decimal(20,10)) as i, cast(p_partkey * 2 + 1 as decimal(20,10)) as o from part where p_partkey < 40)
select project_id, cast(sum((input_tokens * nullif(i, 0) + output_tokens * nullif(o, 0)) / 1000000) as double) as cost, count(*) as n from {USAGE} left join p using (model_id) group by project_id""".replace("cast(sum((input_tokens * nullif(i, 0) + output_tokens * nullif(o, 0)) / 1000000) as double)", "round(cast(sum(cast(input_tokens as decimal(18,0)) * cast(nullif(i, 0) as decimal(18,0)) + cast(output_tokens as decimal(18,0)) * cast(nullif(o, 0) as decimal(18,0))) as double) / 1000000, 6)"))
def _(tables):
    key = F.col("p_partkey")
    prices = tables("part").where("p_partkey < 40").select(F.concat(F.lit("m"), key).alias("model_id"), F.when(key % 7 == 0, 0).otherwise(key + 1).cast("decimal(20,10)").alias("input_price"), (key * 2 + 1).cast("decimal(20,10)").alias("output_price"))
    return a.usage_cost(usage(tables), prices).groupBy("project_id").agg(F.round(F.sum("cost").cast("double"), 6).alias("cost"), F.count("*").alias("n"))


@query("a5_tenant_counts", "select n_nationkey as project_id, coalesce(u, 0) as users, coalesce(d, 0) as documents from nation left join (select c_nationkey, count(*) as u from customer group by all) on c_nationkey = n_nationkey left join (select c_nationkey as k, count(*) as d from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F' and c_nationkey < 20 group by all) on k = n_nationkey")
def _(tables):
    users = tables("customer").select(F.col("c_nationkey").alias("project_id"), "c_custkey")
    docs = tables("orders").where("o_orderstatus = 'F'").join(users, F.col("o_custkey") == F.col("c_custkey")).where("project_id < 20").select("project_id")
    return a.tenant_counts(tables("nation").select(F.col("n_nationkey").alias("project_id")), users, docs)


@query("a6_index_coverage", "select source as project_id, count(*) as chunks, count(vec_id) as indexed from documents left join embeddings on vec_id = doc_id group by source")
def _(tables):
    chunks = tables("documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("chunk_id"))
    return a.index_coverage(chunks, tables("embeddings").select(F.col("vec_id").alias("chunk_id")))


@query("a7_status_counts", "with s as (select source as project_id, case when starts_with(text, 'An') then 'error' when text is null or starts_with(text, 'The') or length(text) < 100 then 'processing' else 'ready' end as s from documents) select project_id, count(*) filter (s = 'ready') as ready, count(*) filter (s = 'processing') as processing, count(*) filter (s = 'error') as error from s group by project_id")
def _(tables):
    return a.status_counts(documents(tables), placeholder="The", error="An")


@query("a8_best_strategy", "select query_id, compared, strategy as winner, score from (select user_id as query_id, event_type as strategy, round(avg(value) - 50, 6) as score, count(*) over (partition by user_id) as compared, row_number() over (partition by user_id order by round(avg(value) - 50, 6) desc, event_type) as r from events group by user_id, event_type) where r = 1 and score > 0 union all select query_id, compared, null, null from (select user_id as query_id, count(*) as compared, max(score) as m from (select user_id, event_type, round(avg(value) - 50, 6) as score from events group by all) group by user_id) where not m > 0")
def _(tables):
    return a.best_strategy(tables("events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("strategy")).agg(F.round(F.avg("value") - 50, 6).alias("score")))


@query("a9_trace_summary", "select user_id as trace_id, count(*) as steps, count(distinct event_type) as kinds, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) as seconds, cast(sum(length(props)) as bigint) as chars from events group by user_id")
def _(tables):
    return a.trace_summary(tables("events").select(F.col("user_id").alias("trace_id"), "ts", F.col("event_type").alias("kind"), F.col("props").alias("text")))


@query("a10_hit_statistics", "select count(*) filter (event_type = 'view') as hits, count(*) filter (event_type <> 'view') as misses, round(count(*) filter (event_type = 'view') / count(*), 6) as ratio from events")
def _(tables):
    return a.hit_statistics(tables("events").select((F.col("event_type") == "view").alias("hit")))


@query("a11_newest", "select event_id, ts, left(props, 6) as props from events order by ts desc, event_id limit 25")
def _(tables):
    return a.newest(tables("events").select("event_id", "ts", "props"), "ts", "event_id", 25, "props", 6)


@query("a12_catalogue", "select concat('m', p_partkey) as model_id, p_name as name, false as is_custom, p_brand as vendor from part where contains(lower(p_name), 'small') or contains(lower(concat('m', p_partkey)), 'small') union all select concat('Small-', s_suppkey), s_name, true, null from supplier")
def _(tables):
    listed = tables("part").select(F.concat(F.lit("m"), "p_partkey").alias("model_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("vendor"))
    return a.catalogue(listed, tables("supplier").select(F.concat(F.lit("Small-"), "s_suppkey").alias("model_id"), F.col("s_name").alias("name")), "SMALL")


@query("a13_page", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def _(tables):
    return a.page(tables("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 2, 20)


@query("a14_index_statistics", "select source, count(*) as chunks from documents group by rollup(source)")
def _(tables):
    return a.index_statistics(tables("documents").select("source"))


@query("a15_patch", "select c_custkey, coalesce('Patched ' || o, c_name) as c_name, c_nationkey, case when o is not null then 'PATCH' else c_mktsegment end as c_mktsegment from customer left join (select o_custkey, max(o_orderkey) as o from orders where o_orderpriority = '1-URGENT' group by o_custkey) on o_custkey = c_custkey")
def _(tables):
    new = tables("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o"))
    changes = new.select("c_custkey", F.concat(F.lit("Patched "), "o").alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"), F.lit("PATCH").alias("c_mktsegment"))
    return a.patch(tables("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), changes, "c_custkey")


@query("a16_resolve_model", "select s_suppkey as project_id, coalesce(case when s_suppkey % 3 = 0 then s_name end, (select min(p_name) from part), 'default') as model from supplier")
def _(tables):
    projects = tables("supplier").select(F.col("s_suppkey").alias("project_id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("llm_model"))
    return a.resolve_model(projects, tables("part").agg(F.min("p_name").alias("primary_model")), "default")


@query("a17_project_keywords", f"select * from (select *, row_number() over (partition by project_id order by n desc, keyword) as rank from (select project_id, keyword, count(*) as n from (select source as project_id, unnest(list_distinct(list_filter({tok('text')}, lambda x: length(x) > 3))) as keyword from documents) group by all)) where rank <= 20")
def _(tables):
    return a.project_keywords(documents(tables), "content")
