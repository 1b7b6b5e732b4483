"""Text expressions over documents, messages and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from .registry import query

TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
#: Words of the test data that stand for the default lists' languages.
EN_STOP, ASK, DO = ["the", "that", "and"], ["what", "the"], ["thing", "with"]


def tok(x: str) -> str:
    return TOK.format(x=x)


def strip(x: str) -> str:
    return STRIP.format(x=x)


def any_of(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


def words_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


NAME = "concat(source, '_', lang, '-doc ', doc_id, '!.txt')"


def name(d):
    return F.expr(NAME)


@query("t1_tokens", f"select doc_id, len({tok('text')}) as n_tokens, md5(array_to_string({tok('text')}, ' ')) as digest from documents")
def _(tables):
    return tables("documents").select("doc_id", t.tokens(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("digest"))


@query("t2_keywords", f"select doc_id, array_to_string(list_sort(list_distinct(list_filter({tok('text')}, lambda x: length(x) > 3 and x not in ('the', 'that', 'and')))), ' ') as keywords from documents")
def _(tables):
    return tables("documents").select("doc_id", F.array_join(F.array_sort(t.keywords(F.col("text"), 3, EN_STOP)), " ").alias("keywords"))


@query("t3_file_keywords", rf"select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(f, '\.[^.]*$', ''), '[_\-\s]+'), lambda x: length(x) > 2), lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}_\s]', '', 'g'))), lambda x: x <> ''))), ' ') as keywords from (select doc_id, {NAME} as f from documents)")
def _(tables):
    return tables("documents").select("doc_id", F.array_join(F.array_sort(t.file_keywords(name(None))), " ").alias("keywords"))


@query("t4_file_topics", "select doc_id, concat_ws(',', " + ", ".join(f"case when {any_of('f', w)} then '{k}' end" for k, w in {"doc": ["doc"], "english": ["_en"], "many": ["src1", "src2"]}.items()) + f") as topics from (select doc_id, lower({NAME}) as f from documents)")
def _(tables):
    return tables("documents").select("doc_id", F.array_join(t.file_topics(name(None), {"doc": ["doc"], "english": ["_en"], "many": ["src1", "src2"]}), ",").alias("topics"))


@query("t5_clean_spaces", "select doc_id, md5(" + strip(r"regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ") as digest from documents")
def _(tables):
    return tables("documents").select("doc_id", F.md5(t.clean_spaces(F.col("text"))).alias("digest"))


@query("t6_headings", f"select doc_id, md5(array_to_string(list_transform(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: case when x <> '' and length(x) < 80 and ((upper(x) = x and lower(x) <> x) or suffix(x, ':')) then '## ' || x else x end), chr(10))) as digest from documents")
def _(tables):
    return tables("documents").select("doc_id", F.md5(t.mark_headings(F.col("text"))).alias("digest"))


SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda x: {strip('x')}), lambda x: x <> '')"


@query("t7_sentences", f"select doc_id, len({SENTENCES}) as n, md5(array_to_string({SENTENCES}, '|')) as digest from documents")
def _(tables):
    return tables("documents").select("doc_id", t.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


def _markdown_sql() -> str:
    x = "text"
    for pattern, to, lines in t.MARKDOWN:
        # RE2 has no look-behind, so the characters beside an italic mark are taken along.
        if "(?<!" in pattern:
            pattern, to = r"(^|[^_*])_([^_\n]+?)_($|[^_*])", r"\1\2\3"
        to = "chr(10) || chr(10)" if to == "\n\n" else f"'{to}'"
        x = f"regexp_replace({x}, '{'(?m)' if lines else ''}{pattern}', {to}, 'g')"
    inner = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda x: {strip('x')}), chr(10))"
    return f"select doc_id, md5({strip(inner)}) as digest from documents"


@query("t8_strip_markdown", _markdown_sql())
def _(tables):
    return tables("documents").select("doc_id", F.md5(t.strip_markdown(F.col("text"))).alias("digest"))


@query("t9_truncate_answer", rf"""
with a as (select doc_id, text, case when doc_id % 3 = 0 then '' else repeat('1. ' || source || '. ', cast(doc_id % 3 as int) * 12) end as c from documents),
b as (select doc_id, c, case when length(text) > 800 then regexp_replace(left(text, 800), '(?s)\.[^.]*$', '') || '...' else text end as o from a),
d as (select doc_id, o || case when c <> '' then '{t.CITED}' || c else '' end as o from b)
select doc_id, {strip(r"case when length(o) > 1000 then regexp_replace(left(o, 1000), '(?s)\.[^.]*$', '') || '...' else o end")} as answer from d""")
def _(tables):
    cited = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.expr("repeat(concat('1. ', source, '. '), cast(doc_id % 3 as int) * 12)"))
    return tables("documents").select("doc_id", t.truncate_answer(F.col("text"), 1000, cited).alias("answer"))


@query("t11_normal_url", r"select page_id, regexp_replace(regexp_replace(regexp_replace(trim(lower(url)), '^https?://', ''), '^www\.', ''), '/+$', '') as url from pages")
def _(tables):
    return tables("pages").select("page_id", t.normal_url(F.col("url")).alias("url"))


@query("t12_hash_keys", "select doc_id, sha256(text) as cache_key, md5(concat_ws('_', source, '0', md5(text))) as chunk_key from documents")
def _(tables):
    return tables("documents").select("doc_id", F.sha2("text", 256).alias("cache_key"), F.md5(F.concat_ws("_", "source", F.lit("0"), F.md5("text"))).alias("chunk_key"))


@query("t13_question_answer", rf"""
with m as (select conv_id, turn, 'Q: ' || text || ' A: ' || role as x from conversations),
p as (select conv_id, turn, {strip(r"regexp_extract(x, '(?si)Q:\s*(.+?)\s*A:\s*(.+?)$', 1)")} as question, {strip(r"regexp_extract(x, '(?si)Q:\s*(.+?)\s*A:\s*(.+?)$', 2)")} as answer from m)
select conv_id, turn, case when question <> '' and answer <> '' then question end as question, case when question <> '' and answer <> '' then answer end as answer from p""")
def _(tables):
    qa = t.question_answer(F.concat(F.lit("Q: "), "text", F.lit(" A: "), "role"))
    return tables("conversations").select("conv_id", "turn", qa.alias("p")).select("conv_id", "turn", "p.question", "p.answer")


@query("t14_small_talk", rf"""
with m as (select conv_id, turn, {strip('lower(text)')} as x from conversations),
w as (select *, list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '') as w from m)
select conv_id, turn, x = 'the' or starts_with(x, 'the ') or contains(x, 'thing on') or (len(w) <= 2 and length(x) < 20 and not list_has_any(w, ['what'])) as small_talk from w""")
def _(tables):
    return tables("conversations").select("conv_id", "turn", t.is_small_talk(F.col("text"), ["the"], ["thing on"], ["what"]).alias("small_talk"))


GROUPS = {"summary": ["ingth", "resum"], "description": ["onthe"], "greeting": ["hello", "thed"], "general": ["help"]}


@query("t15_intent", "select conv_id, turn, case " + " ".join(f"when {any_of('lower(text)', w)} then '{k}'" for k, w in GROUPS.items()) + " else 'question' end as intent from conversations")
def _(tables):
    return tables("conversations").select("conv_id", "turn", t.intent(F.col("text"), GROUPS).alias("intent"))


@query("t16_complexity", rf"select conv_id, turn, case when n <= 5 and {any_of('x', ASK)} then 'simple' when n > 15 or {any_of('x', DO)} then 'complex' else 'medium' end as complexity from (select conv_id, turn, lower(text) as x, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda y: y <> '')) as n from conversations)")
def _(tables):
    return tables("conversations").select("conv_id", "turn", t.complexity(F.col("text"), ASK, DO).alias("complexity"))


@query("t17_strategy", f"select item_id, kind as question_type, kind <> 'content' as use_chunks, true as use_summaries, kind <> 'specific' as use_metadata, array_to_string(list_filter({tok('text')}, lambda x: length(x) > 2 and x not in ('the', 'that', 'and'))[1:5], ' ') as keywords from (select *, case when contains(lower(text), 'thedis') or contains(lower(text), 'ingth') then 'content' when contains(lower(text), 'what') or contains(lower(text), 'with') then 'specific' else 'search' end as kind from benchmark)")
def _(tables):
    s = t.strategy(F.col("text"), None, ["thedis", "ingth"], ["what", "with"], EN_STOP)
    return tables("benchmark").select("item_id", s.alias("s")).select("item_id", "s.question_type", "s.use_chunks", "s.use_summaries", "s.use_metadata", F.array_join("s.keywords", " ").alias("keywords"))


def _predicate(name_, words):
    @query(name_, f"select item_id, {any_of('lower(text)', words)} as found from benchmark")
    def _(tables):
        return tables("benchmark").select("item_id", t.has_any(F.lower("text"), words).alias("found"))


_predicate("t18_pricing", [*t.PRICING, "thing"])
_predicate("t19_content_question", [*t.CONTENT, "whon"])
_predicate("t20_refusal", [*t.REFUSALS, "not"])


@query("t21_excerpt", "select doc_id, md5(case when length(text) <= 3000 then text else left(text, 1000) || e'\\n\\n[...]\\n\\n' || substr(text, length(text) // 2 - 500 + 1, 1000) || e'\\n\\n[...]\\n\\n' || right(text, 1000) end) as digest, md5(case when length(text) <= 2000 then text else left(text, 1000) || e'\\n\\n[...]\\n\\n' || right(text, 1000) end) as short_digest from documents")
def _(tables):
    return tables("documents").select("doc_id", F.md5(t.excerpt(F.col("text"), 3000)).alias("digest"), F.md5(t.head_tail(F.col("text"), 2000)).alias("short_digest"))


@query("t22_token_estimates", "select doc_id, cast(length(text) // 4 as bigint) as answer_tokens, cast(length(text) // 4 * 3 as bigint) as context_chars from documents")
def _(tables):
    return tables("documents").select("doc_id", F.expr("cast(length(text) div 4 as bigint)").alias("answer_tokens"), F.expr("cast(length(text) div 4 * 3 as bigint)").alias("context_chars"))


@query("t23_status", "select doc_id, case when starts_with(text, 'An') then 'error' when text is null or starts_with(text, 'The') or length(text) < 100 then 'processing' else 'ready' end as status from documents")
def _(tables):
    return tables("documents").select("doc_id", t.status(F.col("text"), "The", "An").alias("status"))


@query("t24_size_tier", "select doc_id, case when n > 10000 then 'very_large' when n > 2500 then 'large' else 'normal' end as tier, case when n > 2500 then 1500 else 1000 end as chunk_size, case when n > 2500 then 300 else 200 end as overlap, case when n > 2500 then 3000 else 2000 end as longest from (select doc_id, length(text) as n from documents)")
def _(tables):
    return tables("documents").select("doc_id", t.size_tier(F.col("text"), 2500, 10_000).alias("s")).select("doc_id", "s.*")
