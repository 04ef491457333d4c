import random

from glyphlake.llm.common import Workspace
from glyphlake.llm.htmltext import DROPPED, KEPT, OPEN, _neighbours, blocks_of, common_lines, main_text, split_url, without_shared

SCHEMA = "page_id long, url string, html string"


def kept(page):
    return " ".join(t for t, s in blocks_of(page) if s == KEPT)


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <main><article><h1>Head &lt;1&gt;</h1><p>One <b>two</b>
      three&nbsp;four&amp</p><form><input>go</form><p>unclosed<p>next<br>line<div class="cookie-notice"><p>x</p></div>
      <ul><li>a<li>b</ul><aside>side</aside><p>in<span class="advert">AD</span>line</p><noscript>ns</noscript></article></main>
    <section class="comments"><article><p>first!</p></article></section><footer>&copy;</footer></body></html>"""
    assert kept(page) == "Head <1> One two three four& unclosed next line a b in line"


def test_odd_pages():
    assert blocks_of(None) == blocks_of("") == blocks_of("<p></p>") == []
    assert blocks_of("plain &eacute;") == [("plain é", OPEN)]
    assert kept("<article>a<script>never closed") == "a"
    assert kept("<article>a<!-- never closed <p>x") == "a"
    assert kept("</div></p><article><p>a</article></p>") == "a"
    assert kept("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert kept('<article><p data-x="a > b">q</p></article>') == "q"
    assert [s for _, s in blocks_of('<div class="nav">m</div><p>t</p>')] == [DROPPED, OPEN]


def left(page):
    return " ".join(t for t, s in blocks_of(page) if s != DROPPED)


def test_words_in_longer_names_and_what_holds_the_article():
    assert left("<div class='layout no-sidebar'><p>a</p></div>") == "a"
    assert kept("<main class='with-sidebar'><p>a</p></main>") == kept("<article class='post comments-open'><p>a</p></article>") == "a"
    assert left("<article class='notice'><p>a</p></article>") == left("<article><p class='social-share'>a</p></article>") == "a"
    assert kept("<header>Site</header><article><header><h1>a</h1></header><p>b</p></article>") == "a b"
    assert left("<form id='form'><div class='search'><article><p>text</p><div class='ad'>x</div></article></div></form><footer>f</footer>") == "text"
    assert left("<article><p>long text</p></article><div class='comments'><article>an even longer comment</article></div>") == "long text"
    assert left("<p>the page's text</p><aside><article>teaser</article></aside>") == "the page's text"
    assert [s for _, s in blocks_of("<div class='main side'>m</div><p class='side-by-side'>t</p>")] == [DROPPED, OPEN]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_against_the_table():
    rnd = random.Random(3)
    for _ in range(1500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 11))] for _ in range(2))
        found = common_lines(a, b)
        assert len(found) == lcs(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in sorted(found))


def nearest(pages):
    """Brute force over the sorted paths of a host."""
    out = {}
    rows = sorted({(*split_url(u), h) for _, u, h in pages})
    for k, (host, path, html) in enumerate(rows):
        best = (-1, None)
        for j in (k - 1, k + 1):
            if 0 <= j < len(rows) and rows[j][0] == host and rows[j][2] != html:
                same = next((n for n, (x, y) in enumerate(zip(path, rows[j][1], strict=False)) if x != y), min(len(path), len(rows[j][1])))
                if same > best[0]:
                    best = (same, rows[j][2])
        out[host, path, html] = best[1]
    return out


def test_differencing_of_pages_without_an_article(spark):
    rnd = random.Random(4)
    pages = []
    for k in range(60):
        host = "hot.example" if k % 3 else f"h{k % 7}.example"
        lines = ["Our menu line", "Copyright line"]
        body = [f"text {rnd.random()}" for _ in range(3)]
        pages.append((k, f"https://{host}/{rnd.choice('ab')}/{rnd.randint(0, 40):02d}", "<body>" + "".join(f"<div>{x}</div>" for x in [lines[0], *body, lines[1]]) + "</body>"))
    rows = pages + [pages[0], (100, None, "<p>alone</p>"), (101, "http://[bad", "<div>x</div>"), (102, "u", None), (103, "u", ""), (None, "https://solo.example/x", "<div>lonely</div>")]
    out = main_text(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, lines int")).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.text for r in out}
    partner = nearest(pages)
    for i, url, html in pages:
        other = partner[(*split_url(url), html)]
        lines = [t for t, _ in blocks_of(html)]
        assert by[i] == without_shared(lines, [OPEN] * len(lines), [t for t, _ in blocks_of(other)] if other else [])
    assert "menu" not in by[1] and by[102] == by[103] == "" and by[100] == "alone" and by[None] == "lonely"


def test_neighbours_across_partitions(spark):
    keys = [("h", f"/{k:03d}", f"c{k}") for k in range(50)]
    found = _neighbours(spark.createDataFrame(keys, "host string, path string, content string").repartition(4), Workspace(spark, "test")).collect()
    want = {(h, p): o for (h, p, _), o in nearest([(0, f"http://h{p}", c) for _, p, c in keys]).items()}
    assert {(r.host, r.path): r.partner for r in found} == want


def test_differencing_within_articles(spark):
    said = [[f"page {k} says {w} in a line of its own" for w in ("one", "two")] for k in range(6)]
    page = lambda k: f"<article><h1>Head {k}</h1><p>{said[k][0]}</p><p>Site notice</p><div>{said[k][1]}</div></article><div class='box'>Ask us</div>"
    rows = [(k, f"https://site.example/a/{k}", page(k)) for k in range(6)]
    rows += [(10, "https://teaser.example/1", "<article><p>teaser</p></article><div id='text'>main text</div>"), (11, "https://none.example/1", "<nav>n</nav>")]
    long = [f"<p>paragraph {k} of a long article</p>" for k in range(30)]
    rows += [(20 + k, f"https://copy.example/{k}", f"<article>{''.join(long)}<p>edit {k}</p></article>") for k in range(2)]
    by = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(by) == len(rows)
    assert [by[k] for k in range(6)] == [f"Head {k} {' '.join(said[k])}" for k in range(6)]  # shared lines go, in the article and beside it
    assert by[10] == "teaser main text" and by[11] == ""
    assert by[20].count("paragraph") == by[21].count("paragraph") == 30 and by[21].endswith("edit 1")  # versions of one article


def test_page_that_its_partner_contains_keeps_its_text():
    assert without_shared(["a", "b"], [OPEN, OPEN], ["a", "b", "c"]) == "a b"


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], SCHEMA)).collect() == []
