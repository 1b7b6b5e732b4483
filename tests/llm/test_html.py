"""Main text: the tree against a brute-force version, wrappers, hostile pages, and the tree on its own."""

import math
import random
import re
import time
from collections import Counter

import pytest
from corpusloom.llm import htmlmain
from corpusloom.llm.registry import QUERIES

SF01, SMALL = "/root/testdata/sf0.1", "/root/testdata/sf0.001"


def own(page):
    """What a page that is alone on its host keeps."""
    p = htmlmain.Page(page)
    kept = [t for (t, _, _), (marks, _) in zip(p.blocks, p.marks, strict=True) if not marks]
    return " ".join(kept or [t for (t, _, _), (_, sure) in zip(p.blocks, p.marks, strict=True) if not sure])


CASES = {
    '<div class="content has-sidebar"><p>Main text': "Main text",
    '<div class="layout-sidebar-right"><article>hello</article></div>': "hello",
    '<p class="lead search-term">Lead text here</p>': "Lead text here",
    "<article>teaser</article><div>the long body of the page that is real</div>": "teaser the long body of the page that is real",
    '<p>text <span class="advert">buy <b>now</b></span> more</p>': "text more",
    '<form id="aspnet"><p>a b c</p><p>d e f</p><p>g h i</p></form>': "a b c d e f g h i",
    '<div class="site-header">logo</div><article><header><h1>Title</h1></header>body text</article><div class="adSlot">ad</div>': "Title body text",
    "a &lt; b and <3 c &amp; d": "a < b and <3 c & d",
    "<title>no</title><p>x\n\t y<br>z<!-- <p>gone --><p>end": "x y z end",
    '<p>kept</p><a title="a > b">link</a> <a href="cut': "kept link",
    "<div id=comments>c</div><ul class='main-nav'><li>m</ul><p>body": "body",
    "<script>if(a<b)'</p>'</script><style>p{}</style><noscript>n</noscript>t": "t",
    '<body><div class="post related"><p>only text</p></div></body>': "only text",
    '<p class="search">only text</p>': "only text",
    '<body><div class="side"><p>one</p><p>two</p></div></body>': "one two",
    "<main><p class='share'>Market share rose</p><p>and fell</p></main>": "Market share rose and fell",
    "<nav>menu</nav><footer>end</footer>": "",
    "": "",
}


@pytest.mark.parametrize("page", list(CASES))
def test_roles_of_one_page(page):
    assert own(page) == CASES[page]


@pytest.mark.parametrize("part", ['<a "', '<a ="', "<a ='\"", "<div>x", "</div>", "<!--", "<script>", '<p class="a b">', "&amp", "<li><center>", "<td><div>"])
def test_hostile_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    began = time.time()
    htmlmain.facts_of(htmlmain.Page(page[: len(page) // 4] if part == "<div>x" else page))
    assert time.time() - began < 2


def trees(rows):
    """Importance of each branch by counting, without Spark."""
    pages, kids, size, spread, inside = Counter(), {}, Counter(), {}, {}
    chars, known = 0, {}
    for i, source in rows:
        p = htmlmain.Page(source)
        for t, at, _ in p.blocks:
            if at:
                known.setdefault(t, set()).add(i)
        for t, at, _ in p.blocks:
            for q in p.line(at):
                size[q, t] += len(t)
                spread.setdefault((q, t), set()).add(i)
                inside[q] = p.article[p.path.index(q)]
        on = {q for _, at, _ in p.blocks for q in p.line(at)}
        pages.update(on)
        for q in on:
            kids.setdefault(q, Counter())[tuple(p.kids[p.path.index(q)])] += 1
        chars += sum(len(t) for t in {t for t, at, _ in p.blocks if at})
    m = max(pages.values(), default=1)
    even = sum(len(t) * len(k) * math.log(len(k)) for t, k in known.items()) / chars / math.log(m) if m > 1 else 0
    out = {}
    for q, m in pages.items():
        if m == 1:
            out[q] = 1.0
            continue
        style = 1 - sum(c * math.log(c) for c in kids[q].values()) / (m * math.log(m))
        mine = [(n, len(spread[x])) for x, n in size.items() if x[0] == q]
        s = sum(n * math.log(k) for n, k in mine) / sum(n for n, _ in mine) / math.log(m)
        content = 1 - s if inside[q] else min(1 - s, (even + htmlmain.EVEN) / (s + htmlmain.EVEN))
        out[q] = 1 - (1 - htmlmain.PRESENTATION * style - (1 - htmlmain.PRESENTATION) * content) * (m - 1) / (m + 1)
    return out


def test_importance_matches_brute_force(spark):
    r = random.Random(7)

    def dom(depth):
        if depth == 0 or r.random() < 0.3:
            return r.choice(["alpha", "beta words", "gamma delta", f"own {r.random()}"])
        tag = r.choice(["div", "section", "ul", "p", "article"])
        return f'<{tag} class="{r.choice(["", "x", "y"])}">' + " ".join(dom(depth - 1) for _ in range(r.randint(1, 3))) + f"</{tag}>"

    rows = [(i, f"https://h{i % 4}.example/{i}", "<body>" + dom(4) + "</body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    tree = htmlmain.parsed(df)
    site = {x.site: x.host for x in tree.selectExpr("site", "regexp_extract(url, '//([^/]*)', 1) as host").collect()}
    got = {}
    for x in htmlmain.importance(tree).collect():
        got.setdefault(site[x.site], {})[x.path] = x.importance
    for h in range(4):
        want = trees([(i, p) for i, u, p in rows if f"//h{h}." in u])
        assert set(want) == set(got[f"h{h}.example"])
        assert all(abs(want[q] - x) < 1e-9 for q, x in got[f"h{h}.example"].items())


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div class='box'>always the same words</div><div class='main'><p>text number {i}</p></div></body>") for i in range(30)]
    few = [(100 + i, f"https://few.example/{i}", f"<body><div class='box'>always the same words</div><p>text number {i}</p></body>") for i in range(2)]
    df = spark.createDataFrame([*rows, *few, (99, None, None), (98, "https://other.example/", "<p>lone page</p>"), (97, "https://other.example/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmlmain.extract(df).collect()}
    assert all(got[i][0] == f"text number {i}" for i in range(30)) and got[99] == ("", 0) and got[98] == ("lone page", 9) and got[97] == ("", 0)
    assert got[100][0] == "always the same words text number 0"  # two pages prove little
    assert htmlmain.extract(df.limit(0)).count() == 0


def test_texts_count_anywhere_below_a_branch_and_templates_take_turns(spark):
    box = "<div class='box'><p class='post-{0}'>{1}</p></div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{box.format(i, ['always the same words', 'or these for a change'][i % 2])}<div class='main'><p>text number {i}</p></div></body>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r.text == f"text number {r.page_id}" for r in htmlmain.extract(df).collect())


def test_many_weak_branches_are_joined_instead_of_sent(spark, monkeypatch):
    monkeypatch.setattr(htmlmain, "SENT", 0)
    test_style_tree_drops_what_a_host_repeats(spark)


def test_query_matches_article_text(spark):
    """On the given pages all that belongs to the text is in the article element."""
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op5_main_text"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for i, r in pages.items():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(?:h1|p|br)>", " ", article).replace("<b>", "").replace("</b>", ""))).strip()
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), r.url)


def test_tree_alone_removes_menus_and_footers(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    both = {r.page_id: r.text for r in htmlmain.extract(pages).collect()}
    alone = {r.page_id: r.text for r in htmlmain.extract(pages, roles=False).collect()}
    assert sum(both[i] == alone[i] for i in both) > 0.9 * len(both)
    off = {r.page_id: r.text for r in htmlmain.extract(pages, low=-1.0).collect()}
    assert sum(off[i] != both[i] for i in both) > 0.5 * len(both)


def test_a_named_branch_stays_if_its_form_and_text_are_new(spark):
    """Main text in an element with a role's name, on a host with many pages: the tree tells it from adverts."""
    tags = ["ul", "div", "h2", "blockquote", "table"]
    part = lambda i, k: f"<{tags[(i // 5**k) % 5]}><p>page {i} part {k} is new</p></{tags[(i // 5**k) % 5]}>"
    rows = [(i, f"https://h.example/{i}", f"<body><div class='related'>{''.join(part(i, k) for k in range(3))}</div><div class='intro'>hello {i}</div><div class='advert'><p>buy thing {i}</p></div></body>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in htmlmain.extract(df).collect():
        assert f"page {r.page_id} part 0" in r.text and f"hello {r.page_id}" in r.text and "buy" not in r.text
