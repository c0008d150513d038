import html
import re

from pyspark.sql import functions as F

from tablewright.llm.html_text import Page, main_text

LONG = "Some running text, long enough to be scored as part of an article. "


def test_blocks_references_and_markup():
    page = Page(
        "<!DOCTYPE html><html><head><title>no</title><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href=/>menu</a></ul></nav><header><h1>Site</h1></header>"
        f"<article><header><h1>Ti&eacute;tle</h1><p>by line</p></header><p><b>{LONG}<br>&amp;amp; x&nbsp;\n y<p>second <i>in</i>line {LONG}"
        "<!-- gone --><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><form>no</form><div class='related'>no</div>"
        f"<blockquote>q < 5 &lt; 6</blockquote><footer>no</footer></article><section class='comments'><p>{LONG}{LONG}{LONG}{LONG}{LONG}</p></section>"
        "<aside>no</aside><div class='cookie-notice'>no</div><footer>&copy;</footer></body></html>"
    )
    t = LONG.strip()
    assert page.text(None).split("\n\n") == ["Tiétle", f"{t} &amp; x y", f"second inline {t}", "one", "two", "a b", "c", "q < 5 < 6"]


def test_consensus_path_is_used(spark):
    body = f"<p>{LONG * 3}</p>"
    pages = [(i, f"https://H.example/{i}", f"<body><div class='x post-{i}'><h2>t{i}</h2>{body}</div><div class=y>{LONG}</div></body>") for i in range(5)]
    # By itself this page's best container is the other one.
    pages.append((9, "https://h.example/9", f"<body><div class='x post-9'><p>short</p></div><div class=y>{LONG * 9}</div></body>"))
    pages += [(10, None, f"<div>{LONG}</div>"), (11, "https://h.example/e", None), (12, "https://h.example/f", ""), (9, "https://h.example/9", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = {(r.page_id, r.url): r for r in main_text(df).collect() if r.text != "x"}
    assert got[9, "https://h.example/9"].text == "short"
    assert got[3, "https://H.example/3"].text == "t3\n\n" + (LONG * 3).strip()
    assert got[10, None].text == LONG.strip()
    assert got[11, "https://h.example/e"].text == "" and got[11, "https://h.example/e"].n_chars == 0
    assert main_text(df).count() == len(pages)
    assert main_text(df.limit(0)).count() == 0


def test_unequal_sections_are_all_taken(spark):
    big, small = f"<p>{(LONG * 16).strip()}</p>", f"<p>{(LONG * 3).strip()}</p>"
    parts = [f"<section class=part>{big}</section>", f"<section class=part>{small}</section>", "<section class=part></section>"]
    page = f"<body><div class=lead><p>{LONG}</p></div><div class=text><h1>Title</h1>{small}{''.join(parts)}</div></body>"
    # This page has one section only; its host's other pages say where the article is.
    one = f"<body><div class=text><h1>One</h1>{small}{parts[0]}</div></body>"
    rows = [(0, "https://h.example/0", page), (1, "https://h.example/1", page), (2, "https://h.example/2", one), (3, None, page)]
    got = {r.page_id: r.text.split("\n\n") for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    s, b = (LONG * 3).strip(), (LONG * 16).strip()
    assert got == {0: ["Title", s, b, s], 1: ["Title", s, b, s], 2: ["One", s, b], 3: ["Title", s, b, s]}
    # The winning path itself may be that of several containers.
    assert Page(page).text(">body>div.text>section.part").split("\n\n") == ["Title", s, b, s]


def test_all_pages_against_a_plain_reading(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        inner = re.sub(r"<(div|aside|form|section|ul|nav)\b[^>]*class=\"(?:ad|related|share)\".*?</\1>", "\0", inner, flags=re.S)
        parts = re.split(r"</?(?:p|h\d|article|div|ul|li|section|blockquote|tr|table|pre)\b[^>]*>|\0", inner)
        texts = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", p) and re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", p))).split()) for p in parts]
        want[r.page_id] = "\n\n".join(t for t in texts if t)
    got = {r.page_id: r for r in main_text(df).collect()}
    wrong = [p for p in want if got[p].text != want[p]]
    assert not wrong
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_class_words_do_not_silence_a_page():
    long = f"<p>{LONG * 5}</p>"
    t = (LONG * 5).strip()
    assert Page(f"<body><main><div class='discussion'>{long}</div></main></body>").text(None) == t
    assert Page(f"<body><article class='teaser'>{long}</article><footer>{long}</footer></body>").text(None) == t
    # Beside an article they still mark what is not one; and some mark it always.
    assert Page(f"<body><article>{long}</article><div class='login'>{long}{long}</div></body>").text(None) == t
    assert Page(f"<body><div class='cookie-notice'>{long}</div><div class='footer'>{LONG}</div></body>").text(None) == ""


def test_equal_votes_go_to_the_last_path(spark):
    rows = [(0, "https://t.example/0", f"<body><div class=a><p>{LONG}</p></div></body>"), (1, "https://t.example/1", f"<body><div class=b><p>{LONG}</p></div></body>")]
    rows.append((2, "https://t.example/2", f"<body><div class=a><p>{LONG}a</p></div><div class=b><p>{LONG}b</p></div></body>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: LONG.strip(), 1: LONG.strip(), 2: f"{LONG}b"}


def test_a_page_of_five_million_characters(spark):
    body = "".join(f"<p>{LONG}{k}</p>" for k in range(65_000))
    rows = [(1, "https://l.example/", f"<body><nav>menu</nav><article>{body}</article></body>"), (2, None, "<div>" * 20_000 + LONG)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n\n".join(f"{LONG}{k}" for k in range(65_000)) and len(rows[0][2]) > 4_500_000
    assert got[2] == LONG.strip()


def test_parts_of_articles_that_look_like_something_else():
    t = (LONG * 6).strip()
    long = f"<p>{t}</p>"
    page = Page(
        f"<body><article><h1>Paper</h1>{long}<h2 id='related-work'>Related work</h2>{long}<h2 id='search'>Search</h2><h2 id='tags'>Tags</h2><p class='comment'>remark</p>"
        f"<section id='discussion'><h2>Discussion</h2>{long}</section><section class='share-prices'><h2>Shares</h2><p>They fell.</p></section>"
        "<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> there.</p></article></body>"
    )
    want = ["Paper", t, "Related work", t, "Search", "Tags", "remark", "Discussion", t, "Shares", "They fell.", "Energy is E=m there."]
    assert page.text(None).split("\n\n") == want
    results = f"<main><p>{LONG * 3}</p><div class='search-results'><p>{LONG * 8}</p></div></main>"
    assert Page(results).text(None).split("\n\n") == [(LONG * 3).strip(), (LONG * 8).strip()]


A, B, C = ((LONG * k + f"It ends as number {k}.").strip() for k in (3, 4, 5))
NOT = "This is not the article, though it runs on for a good while and reads like one. " * 4
LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Read another story of ours, number {k}</a></li>" for k in range(5)) + "</ul>"
#: name: (page around the text, its blocks). A long text under a doubtful name (related posts without links) stays: nothing tells it from a section.
LAYOUTS = {
    "article": (f"<body><nav>m</nav><article><p>{A}</p><p>{B}</p></article><footer>f</footer></body>", [A, B]),
    "main and divs": (f"<body><div class=topbar>t</div><main><div><p>{A}</p></div><div><p>{B}</p></div></main></body>", [A, B]),
    "docs with heading ids": (f"<main><h1 id=menu>The menu</h1><p>{A}</p><h2 id=navigation>Navigation</h2><p>{B}</p><h3 id=footer>Footer</h3><p>{C}</p></main>", ["The menu", A, "Navigation", B, "Footer", C]),
    "docs with sidebar": (f"<div class=sidebar><p>{NOT}</p></div><div class=content><h1>Guide</h1><p>{A}</p><pre>x = 1</pre></div>", ["Guide", A, "x = 1"]),
    "blog with comments": (f"<div class=post><h1>Post</h1><p>{A}</p></div><div id=comments><p>{NOT}</p><p>{NOT}</p></div>", ["Post", A]),
    "blog, comment list": (f"<article><p>{A}</p><p>{B}</p><ol class='comment-list'><li class=comment><p>{NOT}</p></li></ol></article>", [A, B]),
    "forum post": (f"<main><div class='thread'><div class='message-body'><p>{A}</p></div><div class='message-body'><p>{B}</p></div></div></main>", [A, B]),
    "paper": (f"<article><h1>T</h1><section id=abstract><p>{A}</p></section><section class=related-work><p>{B}</p></section><section id=discussion><p>{C}</p></section></article>", ["T", A, B, C]),
    "math": (f"<article><p>{A}</p><p>So <math><mi>a</mi><mo>&lt;</mo><mi>b</mi></math> holds.</p></article>", [A, "So a<b holds."]),
    "related links": (f"<article><p>{A}</p><div class=related>{LINKS}</div></article>", [A]),
    "related posts": (f"<article><p>{A}</p><section class=related-posts><p>{NOT}</p></section><p>{B}</p></article>", [A, NOT.strip(), B]),
    "share buttons": (f"<article><p>{A}</p><div class='share-buttons'><span>Share this</span></div><p>{B}</p></article>", [A, B]),
    "share prices": (f"<article><p>{A}</p><div class='share-prices'><p>Up 3 per cent.</p></div></article>", [A, "Up 3 per cent."]),
    "ad slot": (f"<article><p>{A}</p><div class='ad-slot'><p>{NOT}</p></div><p>{B}</p></article>", [A, B]),
    "cookie notice": (f"<div class=cookie-notice><p>{NOT}</p><p>{NOT}</p></div><div class=text><p>{A}</p></div>", [A]),
    "newsletter": (f"<article><p>{A}</p><div class='newsletter-signup'><p>{NOT}</p></div><p>{B}</p></article>", [A, B]),
    "tags": (f"<article><p>{A}</p><ul class=tags><li><a href=/a>alpha</a></li><li><a href=/b>beta</a></li></ul></article>", [A]),
    "pagination": (f"<article><p>{A}</p><div class=pagination><a href=/2>2</a></div></article>", [A]),
    "breadcrumbs": (f"<main><ol class=breadcrumb><li>Home</li><li>Here</li></ol><h1>H</h1><p>{A}</p></main>", ["H", A]),
    "figure": (f"<article><p>{A}</p><figure><img src=x><figcaption>A caption.</figcaption></figure><p>{B}</p></article>", [A, "A caption.", B]),
    "table": (f"<article><p>{A}</p><table><tr><th>k</th><td>v</td></tr></table></article>", [A, "k v"]),
    "table layout": (f"<table><tr><td class=nav>{LINKS}</td><td><h1>Old</h1><p>{A}</p><p>{B}</p></td></tr></table>", ["Old", A, B]),
    "quotes": (f"<article><p>{A}</p><blockquote class=pullquote>{B}</blockquote><p>{C}</p></article>", [A, B, C]),
    "lists": (f"<article><p>{A}</p><ul><li>one</li><li>two</li></ul></article>", [A, "one", "two"]),
    "definition list": (f"<article><p>{A}</p><dl><dt>term</dt><dd>meaning</dd></dl></article>", [A, "term", "meaning"]),
    "header in article": (f"<article><header><h1>Head</h1><p>by someone</p></header><p>{A}</p></article>", ["Head", A]),
    "inline classes": (f"<article><p>{A} <span class=comment>kept</span> <a class=share href=/>too</a></p></article>", [f"{A} kept too"]),
    "code": (f"<article><p>{A}</p><pre class=menu><span class=comment># note</span> run()</pre></article>", [A, "# note run()"]),
    "form and button": (f"<article><p>{A}</p><form><p>{NOT}</p></form><button>Buy</button><p>{B}</p></article>", [A, B]),
    "hidden": (f"<article><p>{A}</p><div hidden><p>{NOT}</p></div><div style='display: none'><p>{NOT}</p></div></article>", [A]),
    "roles": (f"<div role=navigation>{LINKS}</div><div role=main><p>{A}</p><div role=complementary><p>{NOT}</p></div><p>{B}</p></div>", [A, B]),
    "sections of unequal length": (f"<div class=body><section class=s><p>{C}</p></section><section class=s><p>{A}</p></section></div><div class=footer><p>{NOT}</p></div>", [C, A]),
    "search results": (f"<main><p>{A}</p><div class=search-results><p>{B}</p></div></main>", [A, B]),
    "search box": (f"<main><div class=search-box><p>Search this site</p></div><p>{A}</p></main>", [A]),
    "camel case": (f"<article><p>{A}</p><div class='relatedPosts'>{LINKS}</div><div class='adBox'><p>{NOT}</p></div></article>", [A]),
    "numbered classes": (f"<article><div class='post-17 text'><p>{A}</p></div><div class='widget-3'><p>{NOT}</p></div></article>", [A]),
}


def test_page_layouts():
    right = found = want = 0
    for name, (source, blocks) in LAYOUTS.items():
        got = [b for b in Page(source).text(None).split("\n\n") if b]
        assert got == blocks, name
        right += sum(len(b) for b in got if b in blocks)
        found, want = found + sum(map(len, got)), want + sum(map(len, blocks))
    assert len(LAYOUTS) >= 30 and right / found > 0.99 and right / want > 0.99
