"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Counts of each text give three badness features. For each stratum (language) and feature, a fixed grid of cutoffs
is tested on the labelled holdout: a cutoff is certified if an exact binomial test rejects "more than ALPHA of the
good documents lie at or above it" (the Clopper-Pearson upper bound is below ALPHA). All strata, features and
cutoffs share the error DELTA by Bonferroni's correction; FEATURES share the total risk by the union bound. The
lowest certified cutoff applies. A stratum without enough labels certifies nothing, and only the base rules act.

A null or empty text has no words and fails the base rules; repeated rows are judged each for itself; a null
language is the stratum "none"; documents labelled more than once are good if any label says so; an empty label
table certifies nothing; an empty table gives an empty result; a text of any length is counted whole, in time that
grows in proportion to its words and lines; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Share of good documents that may be rejected, over all features of a stratum, and the chance that it is exceeded anywhere.
RISK, DELTA = 0.03, 0.05
#: Badness features and their grids of cutoffs.
FEATURES = {
    "symbols": ("n_symbols / word_chars", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
    "repeats": ("n_repeat_words / n_words", [0.02, 0.05, 0.1, 0.15]),
    "lines": ("n_dup_lines / n_words", [0.005, 0.01, 0.02, 0.05, 0.1]),
}


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and the columns to keep."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    solid = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    out = docs.select(docs[id_col].alias("doc_id"), *keep, text.alias("t"), F.length(solid).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    out = out.select("doc_id", *keep, "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr(r"transform(filter(split(t, '[\\x20\\x09-\\x0D]+', -1), x -> x <> ''), x -> xxhash64(x))").alias("w"))
    out = out.withColumn("n_words", F.size("w").cast("long"))
    windows = F.expr("if(n_words < 5, cast(array() as array<bigint>), transform(sequence(1, size(w) - 4), i -> xxhash64(w[i - 1], w[i], w[i + 1], w[i + 2], w[i + 3])))")
    out = out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", windows.alias("h"))
    # Windows that occur again stand side by side once sorted; their places, in order, cover five words each, less what the next one covers.
    twice = F.expr("if(size(array_distinct(h)) = size(h), cast(array() as array<struct<h:bigint, i:int>>), array_sort(transform(h, (x, i) -> struct(x as h, i as i))))")
    out = out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", twice.alias("s"))
    places = F.expr("sort_array(transform(filter(transform(s, (x, j) -> struct(x.i as i, (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h) as again)), x -> x.again), x -> x.i))")
    out = out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", places.alias("p"))
    covered = F.expr("aggregate(p, struct(0L as n, -5 as last), (a, i) -> struct(a.n + least(5, i - a.last) as n, i as last), a -> a.n)")
    return out.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _log_factorial(n: str) -> str:
    """SQL for ln(n!) by Stirling's series past 9, where its error is below 1e-13; sums of logarithms before."""
    x = f"(cast({n} as double) + 1)"
    y = f"({x} + 8)"
    series = f"(({y} - 0.5) * ln({y}) - {y} + {0.5 * 1.8378770664093453!r} + 1 / (12 * {y}) - 1 / (360 * power({y}, 3)) + 1 / (1260 * power({y}, 5)) - 1 / (1680 * power({y}, 7)))"
    return f"({series} - ({' + '.join(f'ln({x} + {i})' for i in range(8))}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial X(n, p), for k <= n p; terms below the k-th fall off geometrically and are summed until they vanish."""
    top = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({p!r}) + ({n} - {k}) * ln(1 - {p!r}))"
    last = f"cast(least({k}, 60 + 20 * sqrt({n})) as int)"
    steps = f"aggregate(sequence(0, {last}), struct(1D as term, 0D as total), (a, j) -> struct(a.term * ({k} - j) / ({n} - {k} + j + 1) * {(1 - p) / p!r} as term, a.total + a.term as total), a -> a.total)"
    return f"{top} * {steps}"


def certified_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, stratum: str = "lang") -> DataFrame:
    """(stratum, feature, cutoff, n, k): the lowest certified cutoff of each stratum and feature; those without one are absent. counted: text_counts with the stratum."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    held = counted.where(f"not ({BASE_FAILED})").join(good, "doc_id", "left_semi").withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("none")))
    at = [(name, f"coalesce({value}, 0D)", c) for name, (value, grid) in FEATURES.items() for c in grid]
    # One row for each stratum, with a count for each cutoff; then one for each cutoff.
    per = held.groupBy("stratum").agg(F.count("*").alias("n"), *(F.count_if(F.expr(f"{value} >= {c}D")).alias(f"k{i}") for i, (_, value, c) in enumerate(at)))
    rows = ", ".join(f"struct('{name}' as feature, {c}D as cutoff, k{i} as k)" for i, (name, _, c) in enumerate(at))
    tests = per.select("stratum", "n", F.expr(f"count(*) over () * {len(at)}").alias("m"), F.expr(f"inline(array({rows}))"))
    p = risk / len(FEATURES)
    passed = tests.where(f"k <= n * {p!r}").where(f"{binomial_tail('k', 'n', p)} <= {delta!r} / m")
    return passed.groupBy("stratum", "feature").agg(F.min("cutoff").alias("cutoff"), F.min_by("n", "cutoff").alias("n"), F.min_by("k", "cutoff").alias("k"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts of each row with base_failed and kept, in docs' order of columns doc_id, n_words, n_symbols ... and the stratum."""
    counted = cut(text_counts(docs.withColumn("__stratum", F.coalesce(docs[stratum].cast("string"), F.lit("none"))), id_col, text_col, ("__stratum",)), "counts")
    cutoffs = certified_cutoffs(counted, labels, risk, delta, "__stratum").groupBy("stratum").agg(*(F.min(F.when(F.col("feature") == name, F.col("cutoff"))).alias(f"c_{name}") for name in FEATURES))
    out = counted.join(cutoffs, counted["__stratum"] == cutoffs["stratum"], "left")
    over = " or ".join(f"coalesce({value} >= c_{name}, false)" for name, (value, _) in FEATURES.items())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), F.expr(f"not ({BASE_FAILED}) and not ({over})").alias("kept"), F.col("__stratum").alias("stratum"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, columns as they are. Rows of one id stay together: they stay if one of them is kept."""
    kept = judge(docs, labels).where("kept").select(F.col("doc_id").alias("__d")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__d")), "left_semi")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    at = [(name, value, c) for name, (value, grid) in FEATURES.items() for c in grid]
    p = RISK / len(FEATURES)
    grid = ", ".join(f"('{name}', cast({c} as double))" for name, _, c in at)
    pick = " ".join(f"when '{name}' then coalesce({value.replace(' / ', ' / nullif(')}, 0), 0)" for name, (value, _) in FEATURES.items())
    return rf"""
with w0 as (
  select doc_id, coalesce(lang, 'none') as stratum, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
r0 as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w0 where len(w) >= 5)),
r1 as (select doc_id, i, count(*) over (partition by doc_id, g) as n from r0),
r2 as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as k from r1 where n > 1) group by doc_id),
l0 as (select doc_id, unnest(string_split(t, chr(10))) as line from w0),
l1 as (select doc_id, count(*) - count(distinct line) as n_dup_lines from l0 where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
c as (
  select w0.doc_id, stratum, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols, cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from w0 left join r2 using (doc_id) left join l1 using (doc_id)),
b as (select *, {BASE_FAILED} as base_failed from c),
g(feature, cutoff) as (values {grid}),
v as (select b.*, feature, cutoff, case feature {pick} end as x from b, g),
q as (select distinct doc_id from labels where quality = 1),
k as (select stratum, feature, cutoff, count(*) as n, count(*) filter (x >= cutoff) as k from v join q using (doc_id) where not base_failed group by all),
m as (select k.*, count(distinct stratum) over () as s from k),
e as (
  select stratum, feature, cutoff, s, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) as tail
  from (select *, unnest(range(0, k + 1)) as j from m where k <= n * {p!r}) group by all),
z as (select stratum, feature, min(cutoff) as cutoff from e where tail <= {DELTA!r} / (s * {len(at)}) group by all),
bad as (select distinct doc_id from v join z using (stratum, feature) where x >= z.cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null as kept from b left join bad using (doc_id)
"""


SQL = _oracle()
