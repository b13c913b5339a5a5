"""op3 on pages by another hand than the training pages' writer, its decoding against all choices, and hostile pages."""

import itertools
import random
import time

import numpy as np
import pytest

import html_unseen
from turnwise.llm import html_extract

M, B = "<<", ">>"  # around main text in the pages below; taken out before reading
PAGES = {
    "blog": """<html><head><title>x</title></head><body class="home blog logged-out"><div id="page" class="hfeed"><div class="site-branding"><p class="site-title"><a href="/">The Bread Diary</a></p></div>
<nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav>
<div id="primary" class="content-area"><article class="post-112 type-post hentry"><h1 class="entry-title"><<Why sourdough sinks in July>></h1><div class="entry-content"><p><<Every summer my loaves come out flat, and every summer I forget the reason.>></p>
<p><<Warm dough ferments faster than the clock suggests, so the strength is gone before the oven is hot.>></p><h2><<What to change>></h2><ul><li><<Use cooler water, about 18 degrees.>></li><li><<Shorten the bulk rise by a third.>></li></ul></div>
<div class="sharedaddy"><ul><li><a href="#">Tweet</a></li><li><a href="#">Pin</a></li></ul></div></article>
<div id="comments" class="comments-area"><h2>3 thoughts</h2><ol class="comment-list"><li class="comment"><p>Thank you, this saved my weekend bake, I had no idea!</p></li><li class="comment"><p>Mine sinks in winter as well.</p></li></ol></div></div>
<aside id="secondary" class="widget-area"><h2>Recent posts</h2><ul><li><a href="/a">Rye for beginners</a></li></ul></aside><footer class="site-footer">Powered by yeast</footer></div></body></html>""",
    "news": """<body><div class="css-1x9f"><div class="masthead-wide"><a href="/">The Daily Ledger</a></div><div class="nav-strip"><a href="/w">World</a> <a href="/s">Sport</a></div></div>
<main id="maincontent"><div class="css-77aa"><h1><<Harbour bridge to close for two weeks>></h1><div class="article-text"><p><<The city will close the harbour bridge from Monday so that crews can replace four worn bearings, officials said.>></p>
<div class="ad-slot" id="dfp-ad-3"><p>Try the new Ledger app today</p></div><p><<Ferries will run every ten minutes in the meantime, and cyclists may use the rail crossing.>></p><blockquote><<It is the least bad choice, the harbour master said on Friday.>></blockquote></div></div></main>
<div class="related-stories"><h3>More on this</h3><ul><li><a href="/1">Ferry fares rise</a></li><li><a href="/2">Tunnel delayed</a></li></ul></div><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
<footer><p>Copyright Ledger Media</p></footer></body>""",
    "docs": """<body><header class="navbar"><a href="/">widgetlib</a><form class="search-box"><input type="text"><label>Search the docs</label></form></header><div class="row"><div class="toc-sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>
<div role="main" class="document"><section id="install"><h1><<Installing>></h1><p><<Unpack the archive and put the folder on your path.>></p><pre><<widget --init demo>></pre><p><<Then open a new shell, since the path is read once.>></p></section>
<section id="use"><h2><<First steps>></h2><dl><dt><<init>></dt><dd><<makes an empty project in the folder that you name>></dd></dl></section></div></div><div class="page-footer">Built on Tuesday</div></body>""",
    "german": """<body><div id="kopfbereich" class="header-wrapper"><h1>Garten und Hof</h1></div><div id="content"><div class="beitrag post"><h2><<Tomaten richtig ausgeizen>></h2><p><<Wer im Juni die Seitentriebe entfernt, erntet sp&auml;ter weniger, aber gr&ouml;&szlig;ere Fr&uuml;chte.>></p>
<p><<Am besten bricht man sie morgens mit der Hand aus, dann trocknet die Wunde bis zum Abend.>></p></div><div class="newsletter-signup"><form><p>Jede Woche Tipps per Post</p><input type="email"></form></div></div><div class="footer-links"><ul><li><a href="/i">Impressum</a></li></ul></div></body>""",
    "plain": """<body><ul class="topmenu"><li><a href="/">Start</a></li><li><a href="/l">Links</a></li></ul><article><p><<A page needs no more than words to be read with profit by anyone who comes.>><p><<It may leave its paragraphs open, and still the reader sees where each one ends.>></article><div id="copyright">2009 by the author</div></body>""",
}

#: PAGES served while features and writer were made. Of MORE 5 of 17 blocks were found when it was written, of HELD 0 of 10; the
#: writer then got tables that lay a page out, numbered lists and more names of chance, the features headings, the largest sibling,
#: the page's best name and runs alone in a block. So none of these pages is untouched by the work any more.
MORE = {
    "recipe": """<body class="single"><div class="top-bar"><a href="/login">Sign in</a></div><div class="l-wrap"><div class="crumbs"><a href="/">Home</a> <a href="/soups">Soups</a></div><div class="recipe-card"><h1><<Lentil soup with lemon>></h1><p><<Ready in forty minutes and better the next day.>></p>
<h2><<Ingredients>></h2><ul><li><<200 g red lentils>></li><li><<one lemon, juice and zest>></li><li><<two onions>></li></ul><h2><<Method>></h2><ol><li><<Fry the onions in oil until they are brown at the edges.>></li><li><<Add the lentils with a litre of water and simmer for half an hour.>></li><li><<Stir in the lemon just before serving.>></li></ol></div>
<div class="reviews-section"><h3>Reviews</h3><div class="review"><p>Made this twice, my children asked for more.</p></div></div><div class="you-may-also-like"><ul><li><a href="/p">Pea soup</a></li><li><a href="/o">Onion soup</a></li></ul></div></div><footer>All recipes tested</footer></body>""",
    "table": """<body bgcolor=white><table width=100%><tr><td colspan=2><h1>Club of Amateur Astronomers</h1></td></tr><tr><td width=150 class="leftmenu"><a href=a.html>Events</a><br><a href=b.html>Members</a><br><a href=c.html>Archive</a></td><td><h2><<The comet of this spring>></h2><p><<The comet can be seen in the west after sunset until the middle of April, low above the horizon.>>
<p><<Field glasses are enough, and its tail spans about three moons. Look for it between the two bright stars of the Ram.>></td></tr></table><center>Last changed 3 March 1999</center></body>""",
    "app": """<body><div id="__next"><div class="Layout_outer__x81"><nav class="Nav_bar__a1"><a href="/">Fieldnotes</a></nav><div class="Post_wrapper__k2"><h1 class="Post_title__9f"><<On keeping a pond>></h1><div class="Post_meta__1"><span>By Ro</span> <span>4 min read</span></div><div class="Post_body__77"><p><<A pond wants sun for half of the day and a shallow edge, so that frogs can leave it.>></p><p><<Ours froze in January and nothing died, because a log floated in it.>></p><figure><img src=p.jpg><figcaption><<The log in question>></figcaption></figure></div>
<div class="Subscribe_box__3"><p>Get new notes by mail</p><form><input><button>Go</button></form></div></div><div class="Footer_root__8"><p>Fieldnotes, since 2019</p></div></div></div></body>""",
}
HELD = {
    "lesson": """<body><div id="wrap"><div id="logo"><a href="/">Open Grammar</a></div><ul id="mainmenu"><li><a href="/1">Nouns</a></li><li><a href="/2">Verbs</a></li></ul><div id="lesson"><h2><<The past tense>></h2><p><<Most verbs take an ending and nothing else.>></p><table><tr><th><<walk>></th><td><<walked>></td></tr><tr><th><<call>></th><td><<called>></td></tr></table><p><<Some verbs change their vowel instead, and these have to be learnt one by one.>></p></div>
<div id="promo-right"><p>Buy the printed grammar in our shop</p></div><div id="bottom">Free for use in schools</div></div></body>""",
    "press": """<body><section class="hero-banner"><p>Spring sale on all pumps</p></section><section class="press-release"><h1><<Norpump opens works in Tampere>></h1><p><<Norpump will make its small pumps in Tampere from May, the company announced today.>></p><p><<About forty people will work there by the end of the year, most of them from the region.>></p></section><section class="contact-form"><form><label>Your question</label><textarea></textarea></form></section><div class="social-links"><ul><li><a href="/x">Follow us</a></li></ul></div></body>""",
}


@pytest.mark.parametrize(("pages", "share"), [(PAGES, 0.9), (MORE, 0.8), (HELD, 0.8)])
def test_pages_of_another_writer(pages, share):
    model, hit, extra, missed = html_extract.fit(), 0, 0, 0
    for page in pages.values():
        nodes = html_extract.nodes_of(html_extract.parse(page.replace(M, "\x01").replace(B, "\x02")))
        leaves = [html_extract.text_of(n) for n in nodes if n.tag == "#"]
        want = {t.strip("\x01\x02") for t in leaves if t[:1] == "\x01"}
        nodes = html_extract.nodes_of(html_extract.parse(page.replace(M, "").replace(B, "")))
        kept = html_extract.decode(nodes, html_extract.boosting.log_odds(model[1], html_extract.features(nodes, model[0])))
        got = {t for n in nodes if n.tag == "#" and kept[n.order] and (t := html_extract.text_of(n))}
        hit, extra, missed = hit + len(got & want), extra + len(got - want), missed + len(want - got)
    print(f"blocks: {hit} right, {extra} extra, {missed} missed")
    assert hit >= share * (hit + extra) and hit >= share * (hit + missed)


def test_decode_against_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        nodes = [html_extract.Node("div", None)]
        for _ in range(rng.randint(0, 8)):
            up = rng.choice(nodes)
            nodes.append(html_extract.Node("div", up, hidden=rng.random() < 0.1))
            up.kids.append(nodes[-1])
        nodes = html_extract.nodes_of(nodes[0])
        odds = np.array([rng.gauss(0, 2) for _ in nodes])

        def cost(choice):
            return sum(np.logaddexp(0, -o if c else o) for c, o in zip(choice, odds, strict=True))

        allowed = [c for c in itertools.product((True, False), repeat=len(nodes)) if c[0] and all(not c[n.order] or (c[n.parent.order] and not n.hidden) for n in nodes[1:])]
        kept = html_extract.decode(nodes, odds)
        assert tuple(kept) in set(allowed) and abs(cost(kept) - min(map(cost, allowed))) < 1e-9


def test_token_weights_know_pieces():
    tokens = html_extract.fit()[0]
    score = {w: tokens("div", frozenset(w.split())) for w in ("mainnavigation", "advertising", "commentary", "articletext", "storybody")}
    assert max(score["mainnavigation"], score["advertising"]) < min(score["articletext"], score["storybody"])


def test_hostile_pages_in_time():
    n = 100_000
    at = time.process_time()
    for page in ('<a title="x ' * n, "<div>" * n + "</p>" * n, "<noscript>" * n, "<!" * n, "<a" * n, "<p>" * n, "<div>" * n + "</div></section>" * n, '<p x="' * n + "<"):
        html_extract.nodes_of(html_extract.parse(page))
    assert time.process_time() - at < 60
    assert html_extract.extract(['<article><p>one sentence stands here.</p><a href="x>two</a></article>'], html_extract.fit()) != [""]


def test_tables(spark):
    page = "<nav><a href=x>menu</a></nav><article><p>Some words that are the text of this page.</p></article>"
    rows = [(None, None, page, "a"), (7, "u", page, "b"), (7, "u", page, "b"), (8, "u", None, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "n_chars")
    got = sorted(html_extract.op3(pages).collect(), key=str)
    text = "Some words that are the text of this page."
    assert [(r.page_id, r.text) for r in sorted(got, key=lambda r: (r.page_id or 0, r.text))] == [(None, text), (7, text), (7, text), (8, "")]
    assert html_extract.op3(pages.where("false")).count() == 0


_TEXT = "Rain fell on the hills all night, and by the morning the river stood higher than anyone could remember, so the ferry stayed on its side."
_PAGE = "<html><body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><article{}><h1>The river</h1><p>{}</p><p>{}</p></article><footer>Imprint</footer></body></html>"


@pytest.mark.parametrize("attribute", [
    'aria-hidden="false"', 'data-hidden="0"', 'title="the hidden truth"', 'data-style="display:none"', "title='style=\"display:none\"'", "data-x=hidden", "width=5", 'data-class="footer nav"', 'data-id="comments"', "title=\"it's hidden\"",
    'style="color:red;--display:none"', 'style="display:none;display:block"', "xhidden", "hidden-x", "hidden_=1", 'alt="a > b hidden"', '"hidden"', "=hidden=", "aria-hidden", "data-role=navigation", 'x:style="display:none"', "onclick=\"hide('hidden')\"",
])
def test_attributes_that_merely_contain_a_name(attribute):
    model, body = html_extract.fit(), (_TEXT, _TEXT.replace("Rain", "Snow"))
    assert html_extract.extract([_PAGE.format(" " + attribute, *body)], model) == html_extract.extract([_PAGE.format("", *body)], model) == ["The river " + " ".join(body)]


def test_attributes_are_read_one_by_one():
    rng = random.Random(8)
    names = ["class", "id", "hidden", "style", "data-class", "aria-hidden", "idx", "x-style", "HIDDEN"]
    for _ in range(2000):
        want, source = {}, ""
        for _ in range(rng.randint(0, 5)):
            name, value = rng.choice(names), rng.choice(["", "a", "hidden", "id=3", "class='x'", "style=display:none", "a b", "x>y"])
            form = rng.random()
            if form < 0.2:
                source, value = f"{source} {name}", ""
            elif form < 0.4 and value and not set(value) & set(" '=>"):
                source += f"{rng.choice([' ', chr(10)])}{name}{rng.choice(['', ' '])}={value}"
            else:
                source += f' {name}={rng.choice(["", " "])}"{value}"'
            want.setdefault(name.lower(), value)
        assert html_extract.attributes(source) == want


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "HIDDEN='until-found'", 'class="x" hidden', 'style="display: none"', "style='color:red; DISPLAY:none !important'"])
def test_hidden_blocks_stay_out(attribute):
    page = _PAGE.format("", _TEXT, _TEXT).replace("</article>", f"<div {attribute}><p>{_TEXT.upper()}</p></div></article>")
    assert _TEXT.upper() not in html_extract.extract([page], html_extract.fit())[0]


def test_unseen_pages():
    """The reading of pages that were written after the model: 41 of 48 blocks of main text, 2 others; this guards the figure."""
    model, hit, extra, all_of = html_extract.fit(), 0, 0, 0
    for page in html_unseen.PAGES.values():
        blocks = [html_extract.text_of(n) for n in html_extract.nodes_of(html_extract.parse(page.replace(M, "\x01").replace(B, "\x02"))) if n.tag == "#"]
        want = {t.strip("\x01\x02") for t in blocks if t[:1] == "\x01"}
        nodes = html_extract.nodes_of(html_extract.parse(page.replace(M, "").replace(B, "")))
        kept = html_extract.decode(nodes, html_extract.boosting.log_odds(model[1], html_extract.features(nodes, model[0])))
        got = {html_extract.text_of(n) for n in nodes if n.tag == "#" and kept[n.order]} - {""}
        hit, extra, all_of = hit + len(got & want), extra + len(got - want), all_of + len(want)
    assert all_of == 48 and hit >= 41 and extra <= 2
