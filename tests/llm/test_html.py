import itertools
import random

from retort.llm import html_text
from retort.llm.html_text import main_text, source_side

PAGE = """<!doctype html><html class="no-js menu"><body class="page sidebar-left"><header class="site-header"><a href=/>Home</a><h1>Name of a site.</h1></header>
<div id="cookie-notice">We use cookies to make this site better for you. Please accept all of them now.</div>
<div class="content"><div class="post-body"><header class="entry-header"><h2>Title here</h2></header><p>First paragraph with some words, so it is
 long &amp; good&nbsp;here.<p>Short.<ul><li>one<li>two</ul><blockquote>Quoted <b>te</b>xt.</blockquote></div>
<aside>Related stories you may like to read on this site, with many words, really.</aside>
<form><label>Your mail</label><input><button>Go</button></form>
<section id="comments"><article class="comment"><p>I am a reader and I think that this is wonderful, thanks.</p></article></section></div>
<div class="sidebar"><p>Long text in the sidebar with a lot of words, sentences and so on. It goes on.</p></div>
<footer>&copy; 2020</footer><script>if (a<b) {"</p>"}</script><style>p{}</style><!-- gone --></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Title here\n\nFirst paragraph with some words, so it is long & good here.\n\nShort.\n\none\n\ntwo\n\nQuoted text."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<script>x</script>") == ""
    assert main_text("a page of plain text") == "a page of plain text"
    assert main_text("<article><p>&eacute;&#x20AC;<br>b</article></div></p>") == "é€ b"
    deep = main_text("<div>" * 5000 + "<p>word word word.</p>" * 3000)
    assert deep == "\n\n".join(["word word word."] * 3000)


def test_wrappers_are_not_furniture():
    text = "A paragraph of the article with a good number of words in it, so that it is long enough."
    for tag in ("main", "article", "div role=main"):
        body = f"<{tag}><h2>Heading</h2><p>{text}</p><p>Short.</p></{tag.split()[0]}>"
        want = f"Heading\n\n{text}\n\nShort."
        for name in ("wrapper has-sidebar", "layout-sidebar-right", "page with-banner", "post-share-enabled"):
            assert main_text(f"<div class='{name}'><div>{body}</div></div>") == want
            assert main_text(f"<div id='{name.split()[-1]}'>{body}</div>") == want
        assert main_text(f"<form id=aspnetForm><div class=nav><a href=/>Home</a></div><div>{body}</div></form>") == want
        for outer in ("aside", "nav", "footer", "div class=comments", "div role=navigation"):
            assert main_text(f"<p>{text}</p><{outer}>{body}</{outer.split()[0]}>") == text
    assert main_text(f"<form><header>Site</header><div class=content><p>{text}</p></div><label>Mail</label></form>") == text
    assert main_text(f"<div class='wrapper has-sidebar'><div class=content><p>{text}</p></div></div>") == text
    teaser = "<div class=related-posts><article><h3><a href=/x>Other page</a></h3><p>Some words on it.</p></article></div>"
    assert main_text(f"<main><p>{text}</p>{teaser}</main>") == text
    assert main_text(f"<article><p>{text}</p></article><form><p>{text}</p></form><div class=sidebar><p>{text}</p></div>") == text


def test_formulas_are_text():
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=x>E=m</annotation></math>"
    assert main_text(f"<article><p>So {formula} holds.</p></article>") == "So E=m holds."


def test_junk_is_no_text_and_never_raises():
    text = "A paragraph with enough words in it to be read as the text of a page."
    for junk in ("<![ foo>", "<![foo[x]]>", '<?php echo "a>b" ?>', "<?import x>", "<![CDATA[ a>b ]]>", "<!x>", "<!>", "<!-->", "<!--->", "<!-- a > b -->", "</>", "<?>"):
        assert main_text(f"{junk}<p>{text}</p>{junk}<p>{text}</p>") == f"{text}\n\n{text}", junk
    assert main_text(f"<p>{text}</p><!-- open") == main_text(f"<p>{text}</p><![ open") == main_text(f"<p>{text}</p><?open") == text
    r = random.Random(1)
    bits = ["<", "!", "[", "?", ">", "--", "p", "div", "/", '"', "'", "=", " ", "&", "#", "x", "article", "script", "CDATA[", "]]", "nav", "\n", "é", "<!", "<?", "</", "\x00", "&#xD800;"]
    for _ in range(2000):
        main_text("".join(r.choices(bits, k=r.randint(1, 25))))


def test_only_the_cut_is_right():
    text = "A paragraph of the text with a good number of words in it, so that it is long enough."
    linked = "<p><a href=/x>the paper that is meant</a></p>"
    page = f"<div><p>{text}</p>{linked}<p>{text}</p></div>" + "<div><div><a href=/a>Some other page</a></div><div><a href=/b>One more of them</a></div></div>"
    blocks = html_text.blocks_of(page)
    costs = (html_text.marks(blocks) @ html_text.PRIOR_WEIGHTS).tolist()
    assert [c > 0 for c in costs] == [True, False, True, False, False]
    assert html_text.kept_blocks(blocks, costs) == [True, True, True, False, False]


def test_weights_are_learned_from_documents(spark):
    r = random.Random(2)
    say = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    pages, docs = [], []
    for k in range(60):
        lines = [say(r.randint(1, 40)) + "." for _ in range(5)]
        docs.append((k, "\n".join(lines)))
        body = "".join(f"<div class=x>{t}</div>" for t in lines)
        pages.append((k, f"http://h/en/{k}?q=1", f"<div class=sidebar>{say(12)}.</div><section>{body}</section><p><a href=/>{say(4)}</a></p>"))
    pages += [(90, None, None), (91, "http://h/5", None), (92, "http://h/en/7000", "<p>x</p>")]
    frame, texts = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame([*docs, (None, "x"), (3, None)], "doc_id long, text string")
    w = html_text.train(frame, texts)
    assert (w == html_text.train(frame.repartition(5), texts)).all() and not (w == html_text.PRIOR_WEIGHTS).all()
    got = {g.page_id: g.text for g in html_text.extracted(frame, w).collect()}
    assert sum(got[k] == t.replace("\n", "\n\n") for k, t in docs) >= 58
    for empty in (html_text.train(frame.limit(0), texts), html_text.train(frame, texts.limit(0))):
        assert (empty == html_text.PRIOR_WEIGHTS).all()


def test_cut_is_least():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 8)
        costs = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.4]

        def price(keep, costs=costs, edges=edges):
            return sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep, strict=True)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        best = min(map(price, itertools.product((False, True), repeat=n)))
        assert abs(price(source_side(costs, edges)) - best) < 1e-6


def test_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article>x.</article>")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extracted(pages).collect()
    assert [(g.page_id, g.url, g.text) for g in got] == [(i, u, main_text(h)) for i, u, h in rows]
    assert all(g.n_chars == len(g.text) for g in got)
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_unclosed_tags_are_linear():
    import time

    from retort.llm.html_text import main_text

    start = time.perf_counter()
    for junk in ("<a" * 2_500_000, "</a" * 1_500_000, "<a x='" * 400_000, "<!--" * 500_000, "<a <b>" * 30_000):
        main_text("<article><p>One two three four five six seven.</p></article>" + junk)
    assert time.perf_counter() - start < 10


def test_what_follows_the_last_tag():
    from retort.llm.html_text import blocks_of

    text = lambda html: [b.text for b in blocks_of(html)]
    assert text("<p>one</p>two &amp; three") == ["one", "two & three"]
    assert text("a < b and 1 <2") == ["a < b and 1 <2"]
    assert text("<p>one</p>two<a href='x") == ["one", "two"]
    assert text("<p>one</p>two<!-- no end") == ["one", "two"]
    assert text("no tags at all") == ["no tags at all"]
    assert text("") == [] and text(None) == []
