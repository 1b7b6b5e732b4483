"""Chunking: documents in, chunks out. Boundary windows and recursive splits run as Arrow table functions, all other strategies are array expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_spaces, mark_headings, sentences, strip
from ..sources.tables import cut

# Delimiters of windows, heading and section patterns, titles, separators.
DELIMITERS = (". ", ".\n", "! ", "!\n", "? ", "?\n", "\n\n", "\n")
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
HEADINGS = [r"^#{1,6}\s+.+$", r"^[А-ЯЁ][А-ЯЁ\s]{2,50}$", r"^\d+\.\s+[А-ЯЁ]", r"^[А-ЯЁ][а-яё\s]{5,100}:$"]
SECTIONS = [r"^(?:ГЛАВА|РАЗДЕЛ|ЧАСТЬ)\s+\d+[.\s]*(.+)?$", r"^(?:\d+\.?\s+)?[A-ZА-ЯЁ][A-ZА-ЯЁ\s]{5,50}$", r"^#{1,2}\s+.+$"]
PAGE = r"\[Page (\d+)\]\n"
INTRODUCTION, WHOLE = "Введение", "Основной текст"
SPLITS = ["\n\n\n", "\n\n", "\n---\n", "\n# ", "\n## ", "\n### ", "\n", ". "]
#: As Java's \\s.
SPACES = " \t\n\x0b\f\r"
SENTENCE_END = re.compile(f"[.!?]+[{SPACES}]+")
LEAST, MOST, ACCEPT_BOUNDARIES = 100, 2000, 10_000


def window_spans(text: str, size: int, overlap: int, delimiters: tuple[str, ...] = DELIMITERS) -> list[tuple[int, int]]:
    """Spans of windows. An end moves back behind the last delimiter of the first kind that lies beyond the overlap, so each window starts after the one before it."""
    if not text.strip():
        return []
    if len(text) <= size:
        return [(0, len(text))]
    overlap = min(overlap, size - 1)
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for d in delimiters:
                at = text.rfind(d, start + overlap, end)
                if at != -1 and at + len(d) > start + overlap:
                    end = at + len(d)
                    break
        end = min(end, len(text))
        if text[start:end].strip():
            out.append((start, end))
        if end == len(text):
            break
        start = end - overlap
    return out


def recursive_parts(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most size characters: split at the first separator that occurs, parts still too long at the next; neighbours are joined while they fit, and up to overlap characters are repeated."""
    i = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[i], separators[i + 1 :]
    if sep:
        pieces = text.split(sep)
        pieces = [pieces[0], *(sep + p for p in pieces[1:])]
    else:
        pieces = list(text)
    out, held, total = [], [], 0

    def close():
        if "".join(held).strip():
            out.append("".join(held).strip())

    for p in pieces:
        if len(p) > size and rest:
            close()
            held, total = [], 0
            out += recursive_parts(p, size, overlap, rest)
            continue
        if total + len(p) > size and held:
            close()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    close()
    return out


#: Bytes of the rows that Python holds at once, about; a longer row is held alone.
HELD = 1 << 21


def _slices(batches):
    """Arrow batches in slices of HELD bytes: texts, their windows and the columns made of them lie in memory side by side, so a whole batch would cost many times its size."""
    for b in batches:
        rows = max(1, int(b.num_rows * HELD / max(b.nbytes, 1)))
        lo, n = 0, min(rows, b.num_rows)
        while lo < b.num_rows:
            part = b.slice(lo, n)
            if part.nbytes > 2 * HELD and n > 1:
                n = (n + 1) // 2
                continue
            yield part
            lo, n = lo + n, rows


def _spread(df: DataFrame, id_col: str, text_col: str, split, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of split(text) for each text, with kept columns."""

    def run(batches):
        for b in _slices(batches):
            rows, columns = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for n, row in enumerate(split(t or "")):
                    rows.append(i)
                    columns.append((n, *row))
            rows = pa.array(rows, pa.int64())
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = [{"int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), *(pa.array([c[k] for c in columns], kinds[k]) for k in range(len(names))), *(b.column(2 + k).take(rows) for k in range(len(keep)))], ["id", *names, *keep])

    kind, kept = df.schema[id_col].dataType.simpleString(), "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep).mapInArrow(run, f"id {kind}, {schema}{kept}").withColumnRenamed("id", id_col)


def windows(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, chunk_index, start, end, text, kept columns): boundary windows; each text is its document's characters from start to end."""
    return _spread(df, id_col, text_col, lambda t: [(a, b, t[a:b]) for a, b in window_spans(t, size, overlap)], "chunk_index int, start int, end int, text string", keep)


#: Characters of the pieces that giant texts are cut into, and rounds in which pieces may hand each other another entry.
PIECE, ROUNDS = 200_000, 50


def _walk(text: str, at: int, start: int, until: int, whole: int, size: int, overlap: int) -> tuple[list[tuple[int, int]], int]:
    """Spans of windows from a start up to the first start at or behind until, and that start; text is the part of the document from at on, whole its length."""
    out = []
    while start < until:
        lo = start - at
        end = lo + size
        if start + size < whole:
            for d in DELIMITERS:
                found = text.rfind(d, lo + overlap, end)
                if found != -1 and found + len(d) > lo + overlap:
                    end = found + len(d)
                    break
        end = min(end, whole - at)
        if text[lo:end].strip():
            out.append((start, at + end))
        if at + end == whole:
            return out, whole
        start = at + end - overlap
    return out, start


def windows_of_giants(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, piece: int = PIECE) -> DataFrame:
    """The rows of windows(), with texts of more than a piece cut up, so that no task has a whole one.

    Where a window starts depends on the one before it, but windows from different starts soon meet at a delimiter. So
    every piece goes on from its own beginning first, then from where the piece before it really ends, and pieces whose
    entry has changed go again until none has. A text that never lets windows meet takes a round for each piece; after
    ROUNDS it is windowed as a whole. Ids of giant texts are unique.
    """
    overlap = min(overlap, size - 1)
    kind = df.schema[id_col].dataType.simpleString()
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    giant = F.length("text") > piece
    small = windows(own.where(~F.coalesce(giant, F.lit(False))), "id", "text", size, overlap)
    n = F.length("text")
    cuts = own.where(giant).select("id", n.alias("whole"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(piece))).alias("at"), "text")
    pieces = cut(cuts.select("id", "whole", "at", F.expr(f"substring(text, at + 1, {piece + size})").alias("text")).repartition("id", "at"), "pieces")

    def run(batches):
        for b in _slices(batches):
            spans, exits = [], []
            for r in b.select(["whole", "at", "text", "entry"]).to_pylist():
                found, leaves = _walk(r["text"], r["at"], r["entry"], min(r["at"] + piece, r["whole"]), r["whole"], size, overlap)
                spans.append([{"start": x, "end": y, "text": r["text"][x - r["at"] : y - r["at"]]} for x, y in found])
                exits.append(leaves)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(exits, pa.int32()), pa.array(spans, span), b.column(4)], ["id", "whole", "at", "leaves", "spans", "entry"])

    schema = f"id {kind}, whole int, at int, leaves int, spans array<struct<start: int, end: int, text: string>>, entry int"
    done = cut(pieces.select("id", "whole", "at", "text", F.col("at").alias("entry")).mapInArrow(run, schema), "walked")
    for _ in range(ROUNDS):
        handed = done.select("id", (F.col("at") + piece).alias("at"), F.col("leaves").alias("given"))
        changed = cut(done.select("id", "at", "entry").join(handed, ["id", "at"]).where("given <> entry").select("id", "at", F.col("given").alias("entry")), "entries")
        if changed.isEmpty():
            break
        again = pieces.join(changed, ["id", "at"]).select("id", "whole", "at", "text", "entry").mapInArrow(run, schema)
        done = cut(done.join(changed.select("id", "at"), ["id", "at"], "left_anti").unionByName(again), "walked")
    else:
        left = changed.select("id").distinct()
        small = small.unionByName(windows(own.where(giant).join(left, "id", "left_semi"), "id", "text", size, overlap))
        done = done.join(left, "id", "left_anti")
    # Numbers within a text: those of its pieces before, then the place in the piece.
    before = F.sum(F.size("spans")).over(Window.partitionBy("id").orderBy("at")) - F.size("spans")
    numbered = done.select("id", "at", "spans").withColumn("before", before.cast("int"))
    large = numbered.select("id", "before", F.posexplode("spans").alias("k", "s")).select("id", (F.col("before") + F.col("k")).alias("chunk_index"), "s.start", "s.end", "s.text")
    return small.unionByName(large).withColumnRenamed("id", id_col)


def recursive(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    return _spread(df, id_col, text_col, lambda t: [(p,) for p in recursive_parts(t, size, overlap)] if t.strip() else [], "chunk_index int, text string")


def register_table_functions(spark) -> None:
    """chunk_windows(text, size, overlap) and chunk_recursive(text, size, overlap) for SQL: `from documents d, lateral chunk_windows(d.text, 1000, 200) w`."""

    class Windows:
        def eval(self, text: str, size: int, overlap: int):
            for n, (a, b) in enumerate(window_spans(text or "", size, overlap)):
                yield n, a, b, text[a:b]

    class Recursive:
        def eval(self, text: str, size: int, overlap: int):
            for n, part in enumerate(recursive_parts(text, size, overlap) if text and text.strip() else []):
                yield n, part

    spark.udtf.register("chunk_windows", F.udtf(Windows, returnType="chunk_index int, start int, end int, text string", useArrow=True))
    spark.udtf.register("chunk_recursive", F.udtf(Recursive, returnType="chunk_index int, text string", useArrow=True))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gathered(parts: Column, starts, glue: str, lead: bool = False) -> Column:
    """Parts of an array joined from each one that starts a group to the next; those before the first are dropped, or (lead) form a group. Each part is copied once."""

    def whole(p):
        n = F.size(p)
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (starts(F.get(p, i)) | (F.lit(lead) & (i == 0))))
        return _let(first, lambda at: F.transform(at, lambda s, j: F.array_join(F.slice(p, s + 1, F.coalesce(F.get(at, j + 1), n) - s), glue)))

    return _let(parts, whole)


def pages(text: Column, marker: str = PAGE, least: int = LEAST) -> Column:
    """One chunk a page, with its header; a page shorter than least joins the one before it. Text without markers has none."""
    numbers = F.regexp_extract_all(text, F.lit(marker), F.lit(1))
    bodies = F.transform(F.slice(F.split(text, marker), 2, 1_000_000_000), clean_spaces)
    each = F.filter(F.zip_with(numbers, bodies, lambda n, b: F.struct(n.alias("n"), b.alias("b"))), lambda p: p["b"] != "")
    head = F.transform(each, lambda p: F.concat(F.lit("[Page "), p["n"], F.lit("]\n"), p["b"]))
    return gathered(head, lambda h: F.length(h) - F.instr(h, "\n") >= least, "\n\n", lead=True)


def is_heading(line: Column, patterns: list[str] | None = None) -> Column:
    found = F.lit(False)
    for p in patterns or HEADINGS:
        found = found | line.rlike(p)
    return found | ((F.length(line) < 80) & (F.upper(line) == line) & (F.lower(line) != line) & (F.size(F.split(line, r"\s+")) < 10))


def elements(text: Column, patterns: list[str] | None = None, least: int = LEAST, most: int = MOST) -> Column:
    """Chunks from heading to heading, short ones joined to the one before them, a short first one dropped; none if their mean length is out of bounds."""
    lines = F.transform(F.split(text, "\n"), strip)
    parts = F.filter(F.transform(gathered(lines, lambda x: (x != "") & is_heading(x, patterns), "\n", lead=True), strip), lambda x: x != "")
    none = F.expr("cast(array() as array<string>)")

    def fit(out):
        mean = F.aggregate(out, F.lit(0), lambda s, x: s + F.length(x)) / F.size(out)
        return F.when((F.size(out) > 0) & mean.between(least, most), out).otherwise(none)

    return F.when(text.isNotNull(), _let(gathered(parts, lambda x: F.length(x) >= least, "\n\n"), fit))


def force_split(text: Column, size: int = MOST) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size)), lambda i: strip(F.substring(text, i, F.lit(size))))
    return F.filter(cut, lambda x: x != "")


def markdown(text: Column, most: int = MOST, least: int = LEAST, separators: list[str] | None = None) -> Column:
    """Headings marked, then split at the first separator that occurs; parts still longer than most are split at the next ones, in the end at most characters. A part shorter than least joins the one before it, a short first one is dropped."""
    whole = F.array(F.struct(mark_headings(text).alias("p"), F.lit(False).alias("done")))
    for sep in separators or SPLITS:
        whole = F.flatten(F.transform(whole, _splitter(sep, most)))
    parts = F.flatten(F.transform(whole, lambda x: F.when(x["done"] | (F.length(x["p"]) <= most), F.array(x["p"])).otherwise(force_split(x["p"], most))))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    return gathered(parts, lambda x: F.length(x) >= least, "\n\n")


def _splitter(sep: str, most: int):
    def split(x):
        same = F.array(x)
        pieces = F.filter(F.transform(F.split(x["p"], re.escape(sep)), strip), lambda p: p != "")
        cut = _let(pieces, lambda ps: F.when(F.size(ps) > 0, F.transform(ps, lambda p: F.struct(p.alias("p"), (F.length(p) <= most).alias("done")))).otherwise(same))
        return F.when(x["done"] | ~x["p"].contains(sep), same).otherwise(cut)

    return split


def sentence_parts(text: str, most: int = MOST, least: int = LEAST) -> list[str]:
    """Sentences packed greedily up to most characters (spaces between them don't count); longer ones are split, chunks shorter than least dropped."""
    out, cur, n = [], [], 0

    def close():
        whole = " ".join(cur)
        if cur and len(whole) >= least:
            out.append(whole)

    for s in (x.strip(SPACES) for x in SENTENCE_END.split(text)):
        if not s:
            continue
        if n + len(s) <= most:
            cur.append(s)
            n += len(s)
            continue
        close()
        cur, n = ([s], len(s)) if len(s) <= most else ([], 0)
        if len(s) > most:
            out += [p for p in (s[i : i + most].strip(SPACES) for i in range(0, len(s), most)) if p]
    close()
    return out


def packed_sentences(df: DataFrame, id_col: str, text_col: str, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(id, chunk_index, text) of sentence_parts. A fold over an array would copy all chunks so far for each sentence, so this is an Arrow function."""
    return _spread(df, id_col, text_col, lambda t: [(p,) for p in sentence_parts(t, most, least)], "chunk_index int, text string")


def at_boundaries(docs: DataFrame, boundaries: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """Texts cut at given offsets (id, offset from 0): chunks of at least so many characters, numbered in order."""
    cuts = boundaries.select(id_col, "offset").unionByName(docs.select(id_col, F.lit(0).alias("offset"))).distinct()
    spans = cuts.withColumn("to", F.lead("offset").over(Window.partitionBy(id_col).orderBy("offset")))
    part = spans.join(docs.select(id_col, text_col), id_col)
    n = F.coalesce("to", F.length(text_col)) - F.col("offset")
    part = part.select(id_col, "offset", strip(F.substring(F.col(text_col), F.col("offset") + 1, n)).alias("text")).where(F.length("text") >= least)
    return part.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("offset")) - 1).alias("chunk_index"), "text")


def exploded(df: DataFrame, id_col: str, parts: Column, *keep) -> DataFrame:
    # The outer form keeps the planner from adding a filter that would compute the parts once more.
    return df.select(id_col, *keep, F.posexplode_outer(parts).alias("chunk_index", "text")).where("chunk_index is not null")


def cascade(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 200, boundaries: DataFrame | None = None) -> DataFrame:
    """(id, chunk_index, text, strategy): the first strategy that gives chunks wins: pages, elements, markdown, sentences, given boundaries for long texts, windows."""
    text = F.col(text_col)
    tried = [("page", pages(text)), ("element", elements(text)), ("recursive", F.when(F.length(text) > MOST, markdown(text)))]
    own = df.select(id_col, text_col, F.lit(None).cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("strategy"))
    for name, parts in tried:
        # One projection each, so a strategy is computed once, and only for texts that none before it has cut.
        own = own.withColumn("next", F.when(F.col("parts").isNull(), parts))
        found = F.size("next") > 0
        own = own.select(id_col, text_col, F.when(found, F.col("next")).otherwise(F.col("parts")).alias("parts"), F.when(found, name).otherwise(F.col("strategy")).alias("strategy"))
    done = own.select(id_col, F.posexplode_outer("parts").alias("chunk_index", "text"), "strategy").where("chunk_index is not null")
    # A null text gives no chunks; a filter on parts would be pushed down and compute them again.
    left = own.select(id_col, F.when(F.col("parts").isNull(), F.col(text_col)).alias(text_col))
    schema = "chunk_index int, text string, strategy string"
    by_sentence = lambda t: [(p, "sentence") for p in sentence_parts(t)]
    by_window = lambda t: [(t[a:b], "window") for a, b in window_spans(t, size, overlap)]
    if boundaries is not None:
        long = left.where(F.length(text_col) > ACCEPT_BOUNDARIES).join(boundaries.select(id_col).distinct(), id_col, "left_semi")
        packed = _spread(long, id_col, text_col, by_sentence, schema)
        bare = long.join(packed.select(id_col).distinct(), id_col, "left_anti")
        done = done.unionByName(packed).unionByName(at_boundaries(bare, boundaries.join(bare.select(id_col), id_col, "left_semi"), id_col, text_col).withColumn("strategy", F.lit("boundary")))
        left = left.join(long.select(id_col), id_col, "left_anti")
    return done.unionByName(_spread(left, id_col, text_col, lambda t: by_sentence(t) or by_window(t), schema))


def sections(df: DataFrame, id_col: str, text_col: str, patterns: list[str] | None = None, lead: str = INTRODUCTION, whole: str = WHOLE) -> DataFrame:
    """(id, section_index, title, content, start_line): parts from section heading to section heading, each line with its break. What precedes the first heading has its own title; a text of white space is one section as it is."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    heads = F.lit(False)
    for p in patterns or SECTIONS:
        heads = heads | strip(F.col("line")).rlike(f"(?iu){p}")
    w = Window.partitionBy(id_col).orderBy("line_no")
    own = lines.withColumn("head", heads).withColumn("g", F.sum(F.col("head").cast("int")).over(w))
    parts = own.groupBy(id_col, "g").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"), F.min("line_no").alias("start_line"), F.max(F.when(F.col("head"), strip(F.col("line")))).alias("title"))
    parts = parts.where(strip(F.col("content")) != "")
    numbered = parts.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("g")) - 1).alias("section_index"), F.coalesce("title", F.lit(lead)).alias("title"), "content", "start_line")
    blank = df.where(strip(F.col(text_col)) == "").select(id_col, F.lit(0).alias("section_index"), F.lit(whole).alias("title"), F.col(text_col).alias("content"), F.lit(0).alias("start_line"))
    return numbered.unionByName(blank)


def hierarchical(df: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """Chunks of each section, with its index and title, numbered within the section and within the document."""
    own = sections(df, id_col, text_col).withColumn("key", F.concat_ws("/", F.col(id_col).cast("string"), F.col("section_index").cast("string")))
    parts = cascade(own, "key", "content", **kw).withColumnRenamed("chunk_index", "chunk_index_in_section")
    out = parts.join(own.select("key", id_col, "section_index", "title"), "key").drop("key")
    return out.withColumn("chunk_index", F.row_number().over(Window.partitionBy(id_col).orderBy("section_index", "chunk_index_in_section")) - 1)


def parent_child(df: DataFrame, id_col: str, text_col: str, parent: int = 2000, child: int = 500, child_overlap: int = 100) -> DataFrame:
    """(id, chunk_id, type, parent_id, chunk_index, parent_index, text): parents with a quarter of overlap, and children within each."""
    tall = windows(df, id_col, text_col, parent, parent // 4).withColumn("chunk_id", F.concat_ws("_", F.col(id_col).cast("string"), F.lit("parent"), F.col("chunk_index").cast("string")))
    small = windows(tall.select("chunk_id", "text"), "chunk_id", "text", child, child_overlap).withColumnRenamed("chunk_id", "parent_id")
    small = small.join(tall.select(F.col("chunk_id").alias("parent_id"), id_col, F.col("chunk_index").alias("parent_index")), "parent_id")
    kids = small.select(id_col, F.concat_ws("_child_", "parent_id", F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit("child").alias("type"), "parent_id", "chunk_index", "parent_index", "text")
    return tall.select(id_col, "chunk_id", F.lit("parent").alias("type"), F.lit(None).cast("string").alias("parent_id"), "chunk_index", F.col("chunk_index").alias("parent_index"), "text").unionByName(kids)


def parent_context(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, text): the parent's text of each wanted child."""
    kids = chunks.join(wanted.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "parent_id")
    return kids.join(chunks.select(F.col("chunk_id").alias("parent_id"), "text"), "parent_id").select("chunk_id", "text")


def clean(chunks: DataFrame, least: int = 50, most: int | None = None, preview: int = 500) -> DataFrame:
    """Chunks of at least so many characters, whole (or cut at most, where a store has such a limit), with a preview."""
    own = chunks.where(F.length(strip(F.col("text"))) >= least)
    return (own if most is None else own.withColumn("text", F.substring("text", 1, most))).withColumn("preview", F.substring("text", 1, preview))


def section_summaries(df: DataFrame, id_col: str, text_col: str, size: int = 30_000, summarise=None, most: int | None = None) -> DataFrame:
    """(id, n, summary): a text's sections of a fixed size, each summed up (by default its first three sentences) and joined in order."""
    summarise = summarise or (lambda t: F.array_join(F.slice(sentences(t), 1, 3), ". "))
    parts = exploded(df, id_col, force_split(F.col(text_col), size)).select(id_col, "chunk_index", summarise(F.col("text")).alias("s"))
    out = parts.groupBy(id_col).agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "s"))), lambda x: x["s"]), "\n\n").alias("summary"))
    return out if most is None else out.withColumn("summary", F.substring("summary", 1, most))


def statistics(chunks: DataFrame, *by: str) -> DataFrame:
    n = F.length("text")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunks"), F.round(F.avg(n), 4).alias("mean"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"))
