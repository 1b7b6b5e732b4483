"""Main text of web pages by a site style tree: pages of a host are merged, and branches of low importance removed.

Each page is parsed into blocks (texts between block-level tags, references decoded) with the paths of tags and
classes above them; menus, footers and adverts are part of the tree like all else. Over the m pages of a host that
have a path, its presentation importance is the entropy of its sequences of children. Its content importance comes
from s, the mean over the characters of block texts below it of ln k / ln m, where k of the m pages share the text
(the entropy of a text over pages): 1 - s, or, outside articles, (S + EVEN) / (s + EVEN) if that is less, where S is
the same mean over all of the host: what recurs far more often than the host's text does is a template, even if
several take turns. Their mix counts in full on many pages, and less on few: a branch loses (m - 1) / (m + 1) of what
it lacks. Branches below LOW are removed with all that is below them.

Names are a prior: elements whose tag or class token names a role (menu, footer, advert, comments ...) and what stands
beside an article or main element that holds most of the page are marked, and a marked branch counts ROLE of its
importance. So it goes if anything in it recurs or its form is always the same, and stays if its children are as
varied and its text as new as those of a main text. A path on fewer than FEW pages of its host shows no entropy, and
the mark decides. An element that wraps an article, or three paragraphs and most of the page, isn't marked, nor are paragraphs
and headings of an article; and a page that class names alone would leave without any text keeps what they mark.

Null or empty html, and pages without text, give an empty text. Repeated rows are extracted each for itself, pages
without a host form a site of their own, extra columns are ignored, and an empty table gives an empty result. Pages of
any length are read whole in one pass over their characters; a tag, comment or script that the page never closes
reaches to its end. Elements nested deeper than DEPTH count as of that depth.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

LOW, ROLE, FEW, PRESENTATION, EVEN, DEPTH = 0.35, 0.36, 10, 0.1, 0.01, 64
#: Weak branches that are sent to all tasks (8 bytes each, and their host); where there are more, they are joined.
SENT = 500_000
#: Elements that flow within a block, and those that have no end tag.
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn del em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = set("script style textarea title xmp noembed noframes iframe".split())
#: Tags that are never content, those that may wrap it, and class or id tokens (their last or first part) and roles that say the same.
TAGS = set("head nav footer aside noscript template button select option svg canvas menu dialog object".split())
WRAPS = set("form header".split())
LAST = set("ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs side sidebar footer masthead comment comments commentlist replies reply respond disqus cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup social share sharing related recommended recommendations widget widgets toolbar pagination pager login search tags".split())
FIRST = set("ad ads advert adsense cookie cookies consent gdpr nav navbar menu breadcrumb breadcrumbs footer sidebar comment comments newsletter social share sponsor promo popup modal skip".split())
NEUTRAL = set("has with without no not is layout l".split())
HEADS = set("site page top global main".split())
ARIA = set("navigation banner complementary contentinfo search dialog alert menu menubar toolbar".split())
#: Elements that an opening tag ends if they are open in the same container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PROSE = set("p h1 h2 h3 h4 h5 h6".split())
CONTAINERS = set("ul ol dl table tbody thead article main section div body td th blockquote nav aside footer header form".split())
_name = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*+")
#: The rest of a tag: a value in quotes may hold >, an unclosed quote is a character like others.
_rest = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+""")
_attr = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_space = re.compile(r"\s+")
_part = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 16)
def _hash(s: str, above: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8, key=above.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


@lru_cache(1 << 14)
def names_role(token: str) -> bool:
    """Whether a class or id token names a role: footer, site-footer, adSlot, but not has-sidebar or search-term."""
    parts = [p.lower() for p in _part.split(token) if p]
    if not parts or len(parts) > 1 and parts[0] in NEUTRAL:
        return False
    return parts[-1] in LAST or parts[0] in FIRST or parts[-1] == "header" and (len(parts) == 1 or parts[0] in HEADS)


@lru_cache(1 << 14)
def _element(tag: str, rest: str) -> tuple[str, int, bool]:
    """(name with classes, role: 0 none, 1 one that a wrapper may have, 2 any; whether it is an article) of an opening tag."""
    attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _attr.findall(rest)} if "=" in rest else {}
    classes = attrs.get("class", "").split()
    aria = attrs.get("role", "").lower()
    named = tag not in ("html", "body") and (any(map(names_role, [*classes, *attrs.get("id", "").split()])) or aria in ARIA)
    return tag + "".join(f".{c}" for c in sorted(classes)), 2 if tag in TAGS else int(named or tag in WRAPS), tag in ("article", "main") or aria == "main"


class Page:
    """A parsed page. Nodes are its distinct paths, each after the one above it: path hash, node above, role, in an article, children. blocks: (text, node, whether a p)."""

    def __init__(self, source: str):
        self.path, self.above, self.role, self.article, self.kids = [0], [-1], [0], [False], [[]]
        self.blocks: list[tuple[str, int, bool]] = []
        self._known: dict[tuple[int, str], int] = {}
        self._parse(source)
        self.marks = self._judge()

    def _node(self, above: int, depth: int, name: str, role: int, article: bool) -> int:
        kids = self.kids[above]
        if not kids or kids[-1] != name:
            kids.append(name)
        if depth >= DEPTH:
            return above
        at = self._known.get((above, name))
        if at is None:
            at = self._known[above, name] = len(self.path)
            self.path.append(_hash(name, self.path[above]))
            self.above.append(above)
            # What heads or ends an article belongs to it.
            self.role.append(0 if role == 1 and self.article[above] and (name == "header" or name.partition(".")[0] in PROSE) else role)
            self.article.append(article or self.article[above])
            self.kids.append([])
        return at

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int]] = []
        open_: Counter = Counter()
        text: list[str] = []

        def flush():
            t = "".join(text)
            text.clear()
            t = _space.sub(" ", html.unescape(t) if "&" in t else t).strip()
            if t:
                self.blocks.append((t, stack[-1][1] if stack else 0, bool(stack) and stack[-1][0] == "p"))

        def shut(depth):
            for tag, _ in stack[depth:]:
                open_[tag] -= 1
            del stack[depth:]

        at, end = 0, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt == -1:
                break
            text.append(page[at:lt])
            m = _name.match(page, lt + 1)
            if not m:
                mark = page[lt + 1 : lt + 4]
                if mark == "!--":
                    close = page.find("-->", lt + 4)
                    at = end if close == -1 else close + 3
                elif mark[:1] in ("!", "?", "/"):
                    close = page.find(">", lt + 1)
                    at = end if close == -1 else close + 1
                else:
                    text.append("<")
                    at = lt + 1
                continue
            tag = m[0].lower()
            rest = _rest.match(page, m.end())
            at = rest.end() + 1
            if at > end:
                at = end  # the page ends within the tag
                break
            if tag[0] == "/":
                tag = tag[1:]
                if tag in INLINE and not open_[tag]:
                    continue
                flush()
                if open_[tag]:
                    depth = len(stack) - 1
                    while stack[depth][0] != tag:
                        depth -= 1
                    shut(depth)
                continue
            attrs = rest[0]
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                if tag in VOID or "=" not in attrs or not _element(tag, attrs)[1]:
                    continue
            flush()
            if tag in RAW:
                close = _close(tag).search(page, at)
                at = close.end() if close else end
                continue
            if tag in CLOSES:
                if any(open_[t] for t in CLOSES[tag]):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in CLOSES[tag]:
                            shut(i)
                            break
                        if stack[i][0] in CONTAINERS:
                            break
            elif stack and stack[-1][0] == "p" and tag not in INLINE:
                shut(len(stack) - 1)
            name, role, article = _element(tag, attrs)
            node = self._node(stack[-1][1] if stack else 0, len(stack), name, role, article)
            if tag in VOID or attrs.endswith("/"):
                continue
            stack.append((tag, node))
            open_[tag] += 1
        else:
            at = end
        if at < end:
            text.append(page[at:])
        flush()

    def _judge(self) -> list[tuple[list[int], bool]]:
        """(marked nodes at and above it, whether by more than class names) of each block."""
        n = len(self.path)
        chars, paras, holds = [0] * n, [0] * n, [False] * n
        for t, at, p in self.blocks:
            chars[at] += len(t)
            paras[at] += p
        for i in range(n - 1, 0, -1):
            up = self.above[i]
            chars[up] += chars[i]
            paras[up] += paras[i]
            holds[up] = holds[up] or holds[i] or self.article[i] and not self.article[up]
        marks: list[list[int]] = [[] for _ in range(n)]
        sure = [False] * n
        for i in range(1, n):
            up = self.above[i]
            wraps = holds[i] or paras[i] >= 3 and 2 * chars[i] > chars[0]
            own = self.role[i] == 2 or self.role[i] == 1 and not wraps
            marks[i] = [*marks[up], i] if own else marks[up]
            sure[i] = sure[up] or own and self.role[i] == 2
        left = sum(len(t) for t, at, _ in self.blocks if not marks[at])
        inside = sum(len(t) for t, at, _ in self.blocks if not marks[at] and self.article[at])
        if not inside or 2 * inside < left:
            return [(marks[at], sure[at]) for _, at, _ in self.blocks]
        out = []
        for _, at, _ in self.blocks:
            top = at
            while self.above[top] > 0 and not holds[self.above[top]]:
                top = self.above[top]
            out.append((marks[at], sure[at]) if self.article[at] else (marks[at] or [top], True))
        return out

    def line(self, at: int) -> list[int]:
        """Path hashes from a node up."""
        out = []
        while at > 0:
            out.append(self.path[at])
            at = self.above[at]
        return out


@lru_cache(64)
def _close(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*+>", re.I)


BLOCK = "array<struct<text:string, paths:array<bigint>, marks:array<bigint>, sure:boolean>>"
PARSED = f"page_id %s, url string, row_key long, site long, blocks {BLOCK}, facts array<struct<path:bigint, kind:int, value:bigint, n:int>>"


def facts_of(page: Page) -> Counter:
    """What a page tells about its paths, as {(path, kind, value): n}.

    Kind 0: it has the path (n: 1, or 2 within an article); 1: its children. A text's place is all its own paths on
    the page, with how often it has each: kind 2 tells the texts of a place (n: characters), 3 the paths above a place and how often the text lies below each. Kind 4: a block is marked by the path.
    """
    facts: Counter = Counter()
    places: dict[int, list[int]] = {}
    size: dict[int, int] = {}
    for t, at, _ in page.blocks:
        if at:
            h = _hash(t)
            size[h] = len(t)
            places.setdefault(h, []).append(at)
    used = {0}
    for h, own in places.items():
        place = page.path[own[0]] if len(own) == 1 else _hash(" ".join(sorted(str(page.path[i]) for i in own)))
        facts[place, 2, h] = size[h]
        if (place, 3, page.path[own[0]]) not in facts:
            for p, k in Counter(p for i in own for p in page.line(i)).items():
                facts[place, 3, p] = k
        for i in own:
            while i not in used:
                used.add(i)
                i = page.above[i]
    for own, _ in page.marks:
        for i in own:
            facts[page.path[i], 4, 0] = 1
    for i in used - {0}:
        facts[page.path[i], 0, 0] = 2 if page.article[i] else 1
        facts[page.path[i], 1, _hash(" ".join(page.kids[i]))] = 1
    return facts


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Blocks of each page with their marks, and the facts of its tree."""
    block = pa.list_(pa.struct([("text", pa.string()), ("paths", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64())), ("sure", pa.bool_())]))
    fact = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("n", pa.int32())]))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                page = Page(one.column(3)[0].as_py() or "")
                kept = [{"text": t, "paths": page.line(at), "marks": [page.path[i] for i in marks], "sure": sure} for (t, at, _), (marks, sure) in zip(page.blocks, page.marks, strict=True)]
                facts = [{"path": p, "kind": k, "value": v, "n": n} for (p, k, v), n in facts_of(page).items()]
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(2), one.column(4), pa.array([kept], block), pa.array([facts], fact)], ["page_id", "url", "row_key", "site", "blocks", "facts"])

    url, text = pages[url_col].cast("string"), pages[html_col].cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select(pages[id_col].alias("page_id"), url.alias("url"), F.xxhash64(url, text).alias("row_key"), text.alias("html"), F.xxhash64(host).alias("site")).mapInArrow(run, PARSED % pages.schema[id_col].dataType.simpleString())


def importance(pages: DataFrame) -> DataFrame:
    """(site, path, pages, importance, marked) of each branch of each host's tree; pages as parsed() gives them. All steps aggregate before they shuffle, so neither a host nor a text that all its pages share meets in one task as rows."""
    facts = pages.select("site", F.explode("facts").alias("f")).select("site", "f.*")
    shared = facts.where("kind <> 2").groupBy("site", "path", "kind", "value").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    has, style = F.col("kind") == 0, F.col("kind") == 1
    sums = shared.where("kind < 2 or kind = 4").groupBy("site", "path").agg(F.max(F.col("kind") == 4).alias("marked"), F.max(F.when(has, F.col("k"))).alias("pages"), F.max(F.when(has, F.col("n"))).alias("inside"), F.sum(F.when(style, F.col("k") * F.ln("k"))).alias("style"))
    above = shared.where("kind = 3").select("site", F.col("path").alias("place"), F.col("value").alias("path"), "n")
    texts = cut(facts.where("kind = 2").groupBy("site", F.col("value").alias("t"), F.col("path").alias("place")).agg(F.count("*").alias("k"), F.max("n").alias("chars")), "texts")
    # A page has a text at one place, so pages of places add up to those that have the text at all.
    total = texts.groupBy("site", "t").agg(F.sum("k").alias("all"), F.max("chars").alias("chars"))
    # Texts of one page of a host add ln 1 to each branch, so only the others are looked up for each path above them.
    again = cut(total.where("all > 1").select("site", "t", "all", "chars"), "again")
    count = texts.groupBy("site").agg(F.sum(F.col("k") * F.col("chars")).alias("chars"))
    # The host's own m is that of its commonest path.
    most = sums.groupBy("site").agg(F.max("pages").alias("m"))
    even = again.groupBy("site").agg(F.sum(F.col("all") * F.col("chars") * F.ln("all")).alias("x")).join(count, "site", "right").join(most, "site")
    even = even.select("site", F.when(F.col("m") > 1, F.coalesce("x", F.lit(0.0)) / F.col("chars") / F.ln("m")).otherwise(0.0).alias("even"))
    size = F.sum(F.col("k") * F.col("chars"))
    length = texts.groupBy("site", "place").agg(size.alias("k")).join(above, ["site", "place"]).groupBy("site", "path").agg(F.sum(F.col("k") * F.col("n")).alias("length"))
    more = texts.join(again.select("site", "t"), ["site", "t"]).join(above, ["site", "place"]).groupBy("site", "path", "t").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("n") * F.col("chars")).alias("n"))
    more = more.groupBy("site", "path").agg(F.sum(F.col("n") * F.ln("k")).alias("text"))
    below = length.join(more, ["site", "path"], "left").select("site", "path", F.coalesce("text", F.lit(0.0)).alias("text"), "length")
    sums = sums.join(below, ["site", "path"]).join(even, "site")
    # Entropy of styles with shares k / m, to the base m: 1 - sum(k ln k) / (m ln m).
    m, s = F.col("pages"), F.col("text") / F.col("length") / F.ln("pages")
    turns = F.when(F.col("inside") < 2, (F.col("even") + EVEN) / (s + EVEN)).otherwise(1.0)
    mixed = PRESENTATION * (1 - F.coalesce("style", F.lit(0.0)) / (m * F.ln(m))) + (1 - PRESENTATION) * F.least(1 - s, turns)
    return sums.select("site", "path", "pages", F.when(m > 1, 1 - (1 - mixed) * (m - 1) / (m + 1)).otherwise(1.0).alias("importance"), "marked")


def extract(pages: DataFrame, low: float = LOW, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of each page; without roles by the tree alone."""
    trees = cut(parsed(pages, id_col, url_col, html_col), "pages")
    weak, marked = F.col("importance") < low, F.col("marked") & ((F.col("importance") * ROLE < low) | (F.col("pages") < FEW))
    weak = cut(importance(trees).select("site", "path", weak.alias("weak"), marked.alias("marked")).where(F.col("weak") | F.col("marked") & F.lit(roles)), "weak")
    of = lambda how: (how(F.when(F.col("weak"), F.col("path"))).alias("gone"), how(F.when(F.col("marked"), F.col("path"))).alias("lost"))
    if weak.count() <= SENT:
        # Measured, so all tasks may have it; pages aren't moved.
        gone = weak.groupBy("site").agg(*of(F.collect_list))
        out = trees.select("page_id", "url", "site", "blocks").join(F.broadcast(gone), "site", "left")
    else:
        own = trees.select("page_id", "row_key", "site", F.explode(F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["paths"])))).alias("path"))
        gone = own.join(weak, ["site", "path"]).groupBy("page_id", "row_key").agg(*of(F.collect_set)).withColumnsRenamed({"page_id": "d", "row_key": "r"})
        out = trees.select("page_id", "url", "row_key", "blocks").join(gone, trees["page_id"].eqNullSafe(gone["d"]) & (trees["row_key"] == gone["r"]), "left")
    hit = lambda a, b: F.coalesce(F.arrays_overlap(a, F.col(b)), F.lit(False))
    strong = F.filter("blocks", lambda b: ~hit(b["paths"], "gone"))
    out = out.withColumn("strong", strong).withColumn("kept", F.filter("strong", lambda b: ~hit(b["marks"], "lost") & ~(F.lit(roles) & F.array_contains(b["marks"], F.lit(0).cast("long")))))  # text outside all elements has no branch
    kept = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.filter("strong", lambda b: ~b["sure"]))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return out.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
