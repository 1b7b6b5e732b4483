"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find. DataFrame functions only.

Four kinds have patterns of their own (email, ip, card, phone). They, and tokens that have the form of a key (SECRET),
seed a graph of contexts and instances: an instance is a token with a digit outside the four kinds (an identifier),
or a hit of theirs; a context is the words beside it, runs of digits in it as one 0. In each round a context's
confidence is the sum of its distinct instances' beliefs over their number and PRIOR more, and a token is believed as
far as its confident contexts vouch for it together (1 - product of 1 - confidence, and of 1 - FORM for a key's form).
Contexts count whose last word introduces an instance in at least CUE of all its occurrences in the corpus, so that
common words, which any instance may follow, aren't patterns. Tokens that are believed in the end are added as kind
"id": keys whose form no context confirms are not.

Positions count code points, ends are exclusive. A null or empty text has no spans; repeated rows are searched each
for itself; extra columns are ignored; an empty table gives an empty result. Work and memory grow in proportion to a
text's length and spans, however long it is; of longer words a context has the last WORD letters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Patterns of the kinds in their order. A look-behind starts each run of characters once, and possessive repeats keep matching linear in the text; both leave what is matched as it is.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: runs of letters, digits, - and _ with a digit.
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+"
TOKEN_CHARS = 5
#: The form of a key: 24 letters and digits or more in a row, five digits and five letters among them at least.
SECRET = r"^(?=(?:[^0-9]*[0-9]){5})(?=(?:[^A-Za-z]*[A-Za-z]){5})[A-Za-z0-9_-]{24,}$"
#: Characters of context at either side, and letters of a word in it.
REACH, WORD = 60, 30
ROUNDS, CONFIDENT, BELIEVED, SUPPORT, PRIOR, CUE, FORM = 3, 0.7, 0.9, 5, 2, 0.2, 0.5
#: Items of an array that are added up one after the other; more are taken in blocks.
BLOCK = 128
SPAN = "array<struct<start:int, rank:int, kind:string, stop:int, value:string>>"

BESIDE = SPAN.replace("value:string", "value:string, left:string, right:string")

_octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, value: Callable[[Column], Column], add: Callable[[Column, Column], Column]) -> Column:
    """For each item the total (from 0) of those before it. Totals within blocks, then over blocks, so no array is copied once an item."""
    none = F.expr("cast(array() as array<int>)")

    def block(v, k):
        step = lambda a, x: F.struct(add(a["at"], value(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(F.slice(v, k + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK)), lambda k: block(v, k))
        step = lambda a, b: F.struct(add(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda x: add(a["at"], x)))).alias("out"))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out")), step)["out"])

    return _let(items, whole)


def _luhn(digits):
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _holds(kind: str, value):
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(rf"^{_octet}(?:\.{_octet}){{3}}$"),
        "card": lambda: F.length(digits).between(12, 19) & _luhn(digits),
        "phone": lambda: F.length(digits).between(9, 15),
        "token": lambda: F.length(value) >= TOKEN_CHARS,
    }[kind]()


def _spans(text: Column, kind: str, pattern: str, rank: int) -> Column:
    """The matches of a pattern that hold, in order, with their places and the characters beside them."""

    def placed(zipped):
        starts = _running(zipped, lambda x: F.length(x["b"]) + F.length(x["m"]), lambda a, b: a + b)
        end, begin = lambda x: F.substring(x, -REACH, REACH), lambda x: F.substring(x, 1, REACH)
        of = lambda x: F.coalesce(x, F.lit(""))

        def span(x, at):
            # Beside a match: the piece up to the next match, that match, and the piece beyond.
            left, right = end(F.concat(end(of(x["b0"])), of(x["m0"]), end(x["b"]))), begin(F.concat(begin(of(x["b1"])), of(x["m1"]), begin(of(x["b2"]))))
            start = at + F.length(x["b"])
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("stop"), x["m"].alias("value"), left.alias("left"), right.alias("right"))

        return F.filter(F.zip_with(zipped, starts, span), lambda s: _holds(kind, s["value"]))

    def zipped(got, between):
        # arrays_zip goes by the longest, the filter back to the matches.
        none = F.array(F.lit(""))
        both = F.arrays_zip(got.alias("m"), between.alias("b"), F.concat(none, between).alias("b0"), F.concat(none, got).alias("m0"), F.slice(between, 2, F.size(got) + 1).alias("b1"), F.slice(got, 2, F.size(got) + 1).alias("m1"), F.slice(between, 3, F.size(got) + 1).alias("b2"))
        return F.filter(both, lambda x: x["m"].isNotNull())

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda got: _let(F.split(text, pattern, -1), lambda between: _let(zipped(got, between), placed)))
    # Every match but an email's has a digit, and most texts none.
    need = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(need, found).otherwise(F.expr(f"cast(array() as {BESIDE})"))


def _free(spans: Column) -> Column:
    """Of spans sorted by start the tokens that no other overlaps: those behind the last stop before them, and before the first start after them."""
    base = lambda s, x: F.when(s["kind"] == "token", 0).otherwise(x)
    most, far = lambda a, b: F.greatest(a, b), 2**31 - 1
    before = _running(spans, lambda s: base(s, s["stop"]), most)
    after = F.reverse(_running(F.reverse(spans), lambda s: base(s, far - s["start"]), most))
    marked = F.zip_with(F.zip_with(spans, before, lambda s, x: F.struct(s.alias("s"), x.alias("x"))), after, lambda s, y: F.struct(s["s"].alias("s"), ((s["s"]["kind"] == "token") & (s["x"] <= s["s"]["start"]) & (far - y >= s["s"]["stop"])).alias("free")))
    return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["s"])


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, spans of the four kinds, and seen: these and the tokens outside them, each with the text beside it."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    out = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("row_key"), text.alias("t"))
    kinds = [*KINDS.items(), ("token", TOKEN)]
    out = out.select("doc_id", "row_key", F.array_sort(F.concat(*(_spans(F.col("t"), k, p, i) for i, (k, p) in enumerate(kinds)))).alias("all"))
    base = F.filter("all", lambda s: s["kind"] != "token")
    plain = F.transform(base, lambda s: F.struct(*(s[f].alias(f) for f in ("start", "rank", "kind", "stop", "value"))))
    return out.select("doc_id", "row_key", plain.alias("spans"), F.concat(base, _let(F.col("all"), _free)).alias("seen"))


def contexts(seen: DataFrame) -> DataFrame:
    """(context, cue, value, kind): the words beside each instance: two to the left, one to the left with the signs between, and one at each side. cue: the word next to the left."""
    # A word that begins before the window has its last letters there; what stands between words is cut to ten signs nearest the instance.
    left, right = (F.regexp_replace(F.lower(c), "[0-9]+", "0") for c in ("left", "right"))
    word = rf"(\p{{L}}{{1,{WORD}}})"
    two = F.regexp_extract(left, rf"{word}[^\p{{L}}]{{1,10}}{word}[^\p{{L}}]{{0,10}}$", 0)
    one = F.regexp_extract(left, rf"{word}[^\p{{L}}]{{0,10}}$", 0)
    near = F.regexp_extract(left, rf"{word}[^\p{{L}}]{{0,10}}$", 1)
    after = F.regexp_extract(right, rf"^[^\p{{L}}]{{0,10}}{word}", 1)
    named = F.array(F.when(two != "", F.concat(F.lit("two "), two)), F.when(one != "", F.concat(F.lit("one "), one)), F.when((near != "") & (after != ""), F.concat(F.lit("side "), near, F.lit(" _ "), after)))
    return seen.select(F.explode(F.array_compact(named)).alias("context"), near.alias("cue"), "value", "kind").distinct()


def cues(edges: DataFrame, docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(cue): words that introduce an instance in at least CUE of all their occurrences in the corpus, and SUPPORT times."""
    # Words of contexts that several instances share, which are few beside the words of the corpus.
    often = edges.groupBy("context", "cue").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("cue").distinct()
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(rf"\p{{L}}{{1,{WORD}}}(?!\p{{L}})"), F.lit(0)))
    all_ = docs.select(words(docs[text_col].cast("string")).alias("cue")).groupBy("cue").agg(F.count("*").alias("all"))
    near = F.regexp_extract(F.lower("s.left"), rf"(\p{{L}}{{1,{WORD}}})[^\p{{L}}]{{0,10}}$", 1)
    led = found.select(F.explode("seen").alias("s")).select(near.alias("cue")).groupBy("cue").agg(F.count("*").alias("led"))
    return all_.join(often, "cue", "left_semi").join(led, "cue").where(F.col("led") >= CUE * F.col("all")).select("cue")


def graph(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(context, value, kind) of contexts whose cue introduces instances; kind is base, form (a token with the form of a key) or token."""
    seen = found.select(F.explode("seen").alias("s")).select("s.value", "s.kind", "s.left", "s.right")
    kind = F.when(F.col("kind") != "token", "base").when(F.col("value").rlike(SECRET), "form").otherwise("token")
    edges = cut(contexts(seen.withColumn("kind", kind)), "edges")
    return cut(edges.join(cues(edges, docs, found, text_col), "cue", "left_semi").select("context", "value", "kind").distinct(), "graph")


def scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """((context, support, n, confidence) of the last round, (value, belief) of the tokens that confident contexts vouch for)."""
    seeds = edges.where("kind <> 'token'").select("value").distinct().withColumn("belief", F.lit(1.0))
    belief, scored, tokens = seeds, None, None
    for _ in range(rounds):
        b = F.coalesce("belief", F.lit(0.0))
        scored = edges.join(belief, "value", "left").groupBy("context").agg(F.round(F.sum(b), 9).alias("support"), F.count("*").alias("n")).withColumn("confidence", F.col("support") / (F.col("n") + PRIOR))
        good = scored.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT))
        doubt = F.exp(F.sum(F.ln(1 - F.col("confidence")))) * F.when(F.max("kind") == "token", 1.0).otherwise(1 - FORM)
        tokens = cut(edges.where("kind <> 'base'").join(good, "context").groupBy("value").agg((1 - F.round(doubt, 9)).alias("belief")), "tokens")
        # Seeds keep their belief; others have what their contexts gave them.
        belief = seeds.unionByName(tokens.join(seeds, "value", "left_anti"))
    return scored, tokens


def discovered(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(value): tokens that confident contexts introduce; found as base_spans gives it for docs."""
    return scores(graph(found, docs, text_col))[1].where(F.col("belief") >= BELIEVED).select("value")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, spans (the four kinds), more (kind "id") for each row; spans are structs of start, rank, kind, stop, value."""
    found = cut(base_spans(docs, id_col, text_col), "spans")
    tokens = found.select("doc_id", "row_key", F.explode(F.array_distinct(F.expr("filter(seen, s -> s.kind = 'token')"))).alias("s"))
    more = tokens.join(discovered(found, docs, text_col), F.col("s.value") == F.col("value"), "left_semi").distinct()
    more = more.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("id").alias("kind"), F.col("s.stop").alias("stop"), F.col("s.value").alias("value")))).alias("more"))
    more = more.select(F.col("doc_id").alias("d"), F.col("row_key").alias("r"), "more")
    out = found.join(more, found["doc_id"].eqNullSafe(more["d"]) & (found["row_key"] == more["r"]), "left")
    return out.select("doc_id", "row_key", "spans", F.coalesce(F.col("more"), F.expr(f"cast(array() as {SPAN})")).alias("more"))


def shown(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _between(text: Column, spans: Column) -> Column:
    """The text with spans (sorted by start), overlapping ones taken together, replaced by the kind of the first in brackets. The text is cut into short parts first, as finding a place in a text means to walk there."""
    small, large = 512, 65_536
    parts = lambda t, n: F.transform(F.sequence(F.lit(0), F.greatest(F.length(t) - 1, F.lit(0)), F.lit(n)), lambda i: F.substring(t, i + 1, F.lit(n)))

    def piece(p, a, b):
        first = F.floor(a / small).cast("int")
        return F.when(b <= a, "").otherwise(F.substring(F.array_join(F.slice(p, first + 1, F.floor((b - 1) / small).cast("int") - first + 1), ""), a - first * small + 1, b - a))

    def whole(p):
        shown_ = lambda s, at: F.when(s["start"] >= at, F.concat(piece(p, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        before = F.array_join(F.zip_with(spans, _running(spans, lambda s: s["stop"], lambda a, b: F.greatest(a, b)), shown_), "")
        return F.concat(before, piece(p, F.array_max(F.transform(spans, lambda s: s["stop"])), F.length(text)))

    return _let(F.flatten(F.transform(parts(text, large), lambda x: parts(x, small))), whole)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span, overlapping ones taken together, replaced by the kind of the first in brackets; columns stay, n_chars follows the text if there is one."""
    found = find(docs, id_col, text_col).where("size(spans) + size(more) > 0").dropDuplicates(["doc_id", "row_key"])
    found = found.select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__r"), F.array_sort(F.concat("spans", "more")).alias("__s"))
    out = docs.join(found, docs[id_col].eqNullSafe(F.col("__d")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__r")), "left")
    out = out.withColumn(text_col, F.when(F.col("__s").isNull(), F.col(text_col)).otherwise(_between(F.col(text_col).cast("string"), F.col("__s"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__s").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(shown(F.col("spans")), 256).alias("base_sha256"), shown(F.array_sort(F.concat("spans", "more"))).alias("spans"), F.size("more").cast("long").alias("n_more"))
