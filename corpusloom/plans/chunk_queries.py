"""Chunking of documents and of pages joined from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunk as c
from .registry import query
from .text_queries import SENTENCES, strip

LINES = "unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i"


def digest(df, *keep):
    return df.select("doc_id", "chunk_index", F.md5("text").alias("digest"), *keep)


@query("c1_windows")
def _(tables):
    return digest(c.windows(tables("documents"), "doc_id", "text"), "start", "end")


@query("c2_recursive")
def _(tables):
    return digest(c.recursive(tables("documents"), "doc_id", "text"))


def lateral(tables, function: str, columns: str):
    """A table function over all documents, from SQL."""
    docs = tables("documents")
    c.register_table_functions(docs.sparkSession)
    return docs.sparkSession.sql(f"select d.doc_id, {columns} from {{docs}} d, lateral {function}(d.text, 1000, 200) w", docs=docs)


@query("c1_windows_sql")
def _(tables):
    """The rows of c1_windows."""
    return digest(lateral(tables, "chunk_windows", "w.chunk_index, w.start, w.end, w.text"), "start", "end")


@query("c1_windows_pieces")
def _(tables):
    """The rows of c1_windows, with long documents cut into pieces that are windowed apart."""
    return digest(c.windows_of_giants(tables("documents"), "doc_id", "text", piece=10_000), "start", "end")


@query("c2_recursive_sql")
def _(tables):
    """The rows of c2_recursive."""
    return digest(lateral(tables, "chunk_recursive", "w.chunk_index, w.text"))


@query("c3_pages", f"""
with m as (select conv_id as doc_id, turn, {strip(r"regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} as b from conversations),
f as (select *, case when length(b) >= 100 or row_number() over (partition by doc_id order by turn) = 1 then 1 else 0 end as start from m where b <> ''),
g as (select *, sum(start) over (partition by doc_id order by turn) as g from f)
select doc_id, cast(g - 1 as int) as chunk_index, md5(string_agg('[Page ' || (turn + 1) || ']' || chr(10) || b, chr(10) || chr(10) order by turn)) as digest from g group by doc_id, g""")
def _(tables):
    page = F.concat(F.lit("[Page "), F.col("turn") + 1, F.lit("]\n"), "text")
    texts = tables("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return digest(c.exploded(texts, "doc_id", c.pages(F.col("text"))))


@query("c4_elements", f"""
with l as (select doc_id, i, {strip('line')} as line from (select doc_id, {LINES} from documents)),
h as (select *, line <> '' and (regexp_matches(line, '^(?:In|The|[A-Z]+) ') or (length(line) < 80 and upper(line) = line and lower(line) <> line and len(regexp_split_to_array(line, '\\s+')) < 10)) as head from l),
g as (select *, sum(head::int) over (partition by doc_id order by i) as g from h),
p as (select doc_id, g, {strip("string_agg(line, chr(10) order by i)")} as part from g group by doc_id, g),
q as (select doc_id, g, part, sum(case when length(part) >= 100 then 1 else 0 end) over (partition by doc_id order by g) as k from p where part <> ''),
r as (select doc_id, k, string_agg(part, chr(10) || chr(10) order by g) as chunk from q where k > 0 group by doc_id, k),
a as (select doc_id from r group by doc_id having avg(length(chunk)) between 100 and 2000)
select doc_id, cast(k - 1 as int) as chunk_index, md5(chunk) as digest from r where doc_id in (select doc_id from a)""")
def _(tables):
    return digest(c.exploded(tables("documents"), "doc_id", c.elements(F.col("text"), [r"^(?:In|The|[A-Z]+) "])))


@query("c5_markdown")
def _(tables):
    return digest(c.exploded(tables("documents"), "doc_id", c.markdown(F.col("text"))))


@query("c6_sentences", f"""
with recursive s as (select doc_id, {SENTENCES} as s from documents),
w as (
  select doc_id, s, 1 as i, cast([] as varchar[]) as cur, 0 as n, cast([] as varchar[]) as o from s
  union all
  select doc_id, s, i + 1,
    case when n + length(s[i]) <= 2000 then list_append(cur, s[i]) when length(s[i]) > 2000 then [] else [s[i]] end,
    cast(case when n + length(s[i]) <= 2000 then n + length(s[i]) when length(s[i]) > 2000 then 0 else length(s[i]) end as int),
    case when n + length(s[i]) <= 2000 then o else
      list_concat(case when len(cur) > 0 and length(array_to_string(cur, ' ')) >= 100 then list_append(o, array_to_string(cur, ' ')) else o end,
        case when length(s[i]) > 2000 then list_filter(list_transform(range(0, length(s[i]), 2000), lambda k: regexp_replace(substr(s[i], k + 1, 2000), '^\\s+|\\s+$', '', 'g')), lambda z: z <> '') else [] end) end
  from w where i <= len(s)),
f as (select doc_id, case when len(cur) > 0 and length(array_to_string(cur, ' ')) >= 100 then list_append(o, array_to_string(cur, ' ')) else o end as o from w where i = len(s) + 1)
select doc_id, cast(generate_subscripts(o, 1) - 1 as int) as chunk_index, md5(unnest(o)) as digest from f""")
def _(tables):
    return digest(c.packed_sentences(tables("documents"), "doc_id", "text"))


FORCED = "list_filter(list_transform(range(0, greatest(length(text), 1), {n}), lambda i: regexp_replace(substr(text, i + 1, {n}), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query("c7_force_split", f"select doc_id, cast(generate_subscripts(p, 1) - 1 as int) as chunk_index, md5(unnest(p)) as digest from (select doc_id, {FORCED.format(n=2000)} as p from documents)")
def _(tables):
    return digest(c.exploded(tables("documents"), "doc_id", c.force_split(F.col("text"))))


@query("c8_boundaries", f"""
with b as (select doc_id, 0 as o from documents union select doc_id, i as o from (select doc_id, unnest(range(700 + doc_id % 90, length(text), 700)) as i from documents)),
s as (select doc_id, o, lead(o) over (partition by doc_id order by o) as t from b),
x as (select doc_id, o, {strip("substr(text, o + 1, coalesce(t, length(text)) - o)")} as text from s join documents using (doc_id))
select doc_id, cast(row_number() over (partition by doc_id order by o) - 1 as int) as chunk_index, md5(text) as digest from x where length(text) >= 100""")
def _(tables):
    d = tables("documents")
    first = 700 + F.col("doc_id").cast("int") % 90
    b = d.where(F.length("text") > first).select("doc_id", F.explode(F.sequence(first, F.length("text") - 1, F.lit(700))).alias("offset"))
    return digest(c.at_boundaries(d, b, "doc_id", "text"))


@query("c9_cascade")
def _(tables):
    return digest(c.cascade(tables("documents"), "doc_id", "text"), "strategy")


SECTION = r"(?i)^(?:(?:\d+\.?\s+)?[A-ZА-ЯЁ][A-ZА-ЯЁ\s]{5,50}|#{1,2}\s+.+)$"


@query("c10_sections", f"""
with l as (select doc_id, {LINES} from documents),
h as (select *, regexp_matches({strip('line')}, '{SECTION}') or regexp_matches({strip('line')}, '(?i)^(?:ГЛАВА|РАЗДЕЛ|ЧАСТЬ)\\s+\\d+[.\\s]*(.+)?$') as head from l),
g as (select *, sum(head::int) over (partition by doc_id order by i) as g from h),
p as (select doc_id, g, string_agg(line, chr(10) order by i) || chr(10) as content, min(i) - 1 as start_line, max(case when head then {strip('line')} end) as title from g group by doc_id, g)
select doc_id, cast(row_number() over (partition by doc_id order by g) - 1 as int) as section_index, coalesce(title, 'Введение') as title, md5(content) as digest, cast(start_line as int) as start_line from p where {strip('content')} <> ''
union all select doc_id, 0, 'Основной текст', md5(text), 0 from documents where {strip('text')} = ''""")
def _(tables):
    return c.sections(tables("documents"), "doc_id", "text").select("doc_id", "section_index", "title", F.md5("content").alias("digest"), "start_line")


@query("c11_hierarchical")
def _(tables):
    return digest(c.hierarchical(tables("documents"), "doc_id", "text"), "section_index", "title", "chunk_index_in_section", "strategy")


@query("c12_parent_child")
def _(tables):
    return c.parent_child(tables("documents"), "doc_id", "text").select("chunk_id", "type", "parent_id", "chunk_index", "parent_index", F.md5("text").alias("digest"))


@query("c13_parent_context", "select c.conv_id * 1000 + c.turn as chunk_id, p.text from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = 0 where c.turn > 0 and c.role = 'user'")
def _(tables):
    m = tables("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"), "text", "role")
    return c.parent_context(m, m.where("role = 'user' and parent_id is not null"))


@query("c14_clean", f"select doc_id, md5(text) as digest, left(text, 500) as preview from documents where length({strip('text')}) >= 50")
def _(tables):
    return c.clean(tables("documents").select("doc_id", "text")).select("doc_id", F.md5("text").alias("digest"), "preview")


@query("c15_section_summaries", f"""
with p as (select doc_id, generate_subscripts(p, 1) as i, unnest(p) as text from (select doc_id, {FORCED.format(n=3000)} as p from documents)),
s as (select doc_id, i, array_to_string(({SENTENCES})[1:3], '. ') as s from p)
select doc_id, count(*) as n, md5(string_agg(s, chr(10) || chr(10) order by i)) as digest from s group by doc_id""")
def _(tables):
    return c.section_summaries(tables("documents"), "doc_id", "text", 3000).select("doc_id", "n", F.md5("summary").alias("digest"))


@query("c16_statistics", "select source, count(*) as chunks, round(avg(length(text)), 4) as mean, min(length(text)) as shortest, max(length(text)) as longest from documents group by source")
def _(tables):
    return c.statistics(tables("documents"), "source")
