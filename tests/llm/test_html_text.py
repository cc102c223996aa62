import html
import re
import time

from lumenfold.llm.html_text import best_path, blocks, extract_main_text, host_of, op1_html_text, scores

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="sidebar-2"><p>Popular things, that are long enough to be mistaken for text.</p></div>
<div class=cookie-notice>We use cookies.</div>
<main><article><h1>Title &amp; more</h1><p>First   <b>bold</b>&nbsp;word,
 goes on &lt;here&gt; and on.<p>Second one<br>breaks.<script>var a="</p>"</script><ul><li>one<li>two</ul>
<div class="ad">Buy now</div><form>Name <input></form><section id="comments"><p>I liked it a lot, thank you.</p></section></article></main>
<footer>&copy; Site</footer></body>"""
TEXT = "Title & more\nFirst bold word, goes on <here> and on.\nSecond one breaks.\none\ntwo"


def test_article_without_the_rest(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/y", ""), (1, "http://a.example/x", PAGE), (None, "nonsense", "<p>just &#233;")]
    pages = spark.createDataFrame([(*r, "other", 4) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect())
    assert [x[2] for x in got] == [TEXT, TEXT, "", "", "just é"]
    assert all(n == len(t) for _, _, t, n in got)
    assert extract_main_text(pages.limit(0)).count() == 0


def test_a_page_follows_its_host(spark):
    # three pages agree on the div; the fourth alone would have chosen its long list of teasers
    body = "<body><div class='c7 story'><p>{}</p></div><div class=teasers>{}</div></body>"
    pages = [(i, "https://h.example/" + str(i), body.format("A sentence of the story, number %d, which goes on for a while." % i, "<p>Short teaser.</p>")) for i in range(3)]
    pages.append((3, "https://h.example/3", body.format("Brief.", "<p>A teaser that is long, very long, longer than the story of its page is.</p>" * 3)))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Brief." and got[0].startswith("A sentence")


def test_unclosed_and_hostile_markup():
    assert [t for _, t, _ in blocks("<p>a<p>b</div></p>c<!-- x")] == ["a", "b", "c"]
    assert blocks("<script>never closed <p>x") == []
    assert [t for _, t, _ in blocks("1 < 2 <b>&amp</b>")] == ["1 < 2 &"]
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert [t for _, t, _ in blocks(deep)] == ["text"]
    assert best_path([]) == ("", 0.0) and scores([]) == {}


def test_hosts(spark):
    urls = ["http://U:p@Host.example:80/x?y", "//h/x", "x", "", None, "https://h#f"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_of(df.u)).collect()] == ["host.example", "h", "", "", "", "h"]


def test_whole_table_equals_a_brute_force_version(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op1_html_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, page in pages.items():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " "))
        wanted = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[i] == "\n".join(x for x in wanted if x)


def test_names_that_mark_and_names_that_do_not():
    keeps = ['title="Hidden treasures of Rome"', 'data-id="sidebar-3"', 'data-state="hidden"', 'class="legal-analysis"', 'class="print"', 'class="with-sidebar"', "class=story-body", 'alt="a > b" id=x']
    drops = ['class="modal-body"', 'class="cookie-content"', 'class="post-navigation"', 'class="social-text"', "class='newsletter-content'", "hidden", 'aria-hidden="true"', 'style="color:red; display : none"', "role=navigation", 'id="comments"', 'class="x share-buttons"', "class=ad"]
    for names in keeps:
        assert [t for _, t, _ in blocks(f"<div {names}><p>some words</p></div>")] == ["some words"], names
    for names in drops:
        assert blocks(f"<div {names}><p>some words</p></div>") == [], names


def test_a_megabyte_of_hostile_markup():
    n = 100_000
    pages = ["<a " * n, '<a "' * n, "<a '" * n + ">", "<div>" * n + "x" + "</section>" * n, "<b>" * n + "<div></div>" * n, "<p><b>" * n, "<li>" * n, "<" * 5 * n, "&" * 5 * n, "<!" * n, "<!-- " * n, "<a b=" * n + ">", "</p>" * n, "<td><p>" * n, "<ul><li>" * (n // 10)]
    for page in pages:
        began = time.process_time()
        best_path(blocks(page))
        assert time.process_time() - began < 20, page[:20]
