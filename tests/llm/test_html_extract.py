import itertools
import random

import pytest

from gridlake.llm import html_extract as h
from tests.llm.common import as_dict, table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x > y --><div class="ad">Buy this now, please.</div>
<article><h1>A &amp; B</h1><p>First <b>para\n graph</b>.<br>Next&nbsp;line<p>Second, with <a href=x>a link</a> &lt;ok&gt; caf&eacute; &#8212; end.
<div class="comments"><p>Nice one!</p></div><form><label>Mail</label></form></article><aside>See also</aside>
<footer>&copy; site</footer>"""


def test_page():
    assert h.main_text(PAGE) == "A & B\n\nFirst para graph. Next line\n\nSecond, with a link <ok> café — end."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></div>", "<script>never ends", "<!-- never ends", "a < b & c", '<a href="x>y', "<p>" * 3000, "<div><ul><li>" * 500])
def test_broken_pages_do_not_crash(page):
    assert isinstance(h.main_text(page), str)


def test_plain_page_without_landmarks():
    text = "This is a long paragraph, with commas, and a full stop at its end. " * 4
    page = f"<body><div><a href=/>Home</a> <a href=/x>More</a></div><div>{text}</div><div>{text}</div><div>&copy; 2020 us</div>"
    assert h.main_text(page) == f"{text.strip()}\n\n{text.strip()}"


@pytest.mark.parametrize("tag", ["button", "svg", "object", "math", "video", "select", "canvas", "audio", "template"])
@pytest.mark.parametrize("closed", [True, False])
def test_inline_elements_end_with_their_parent(tag, closed):
    text = "The article goes on here, in a long sentence, with commas, and it ends. " * 3
    page = f"<article><h1>Head</h1><div><{tag}>" + f"</{tag}>" * closed + f"</div><p>{text}</p></article><article><p>{text}</p></article>"
    assert h.main_text(page) == f"Head\n\n{text.strip()}\n\n{text.strip()}"


def test_text_that_is_shown_is_kept():
    page = "<article><p>Press <button>go</button> for <math><mi>x</mi></math> and <object>this</object>, or <xmp>that</xmp>.</p></article>"
    assert h.main_text(page) == "Press go for x and this, or that."
    page = "<article><p>Seen<select><option>one</select> here<svg><text>no</text></svg>.</p><video><p>no player</p></video><p>End.</p></article>"
    assert h.main_text(page) == "Seen here .\n\nEnd."


def test_deep_pages_take_linear_room():
    import time
    import tracemalloc

    for page, n in (("<div>x " * 20_000, 20_000), ("<div>" * 20_000 + "</p>" * 20_000 + "x", 1), ("<div>" * 20_000 + "<li>x" * 5_000, 5_000)):
        tracemalloc.start()
        begin = time.time()
        assert len(h.blocks(page)) == n
        assert time.time() - begin < 10 and tracemalloc.get_traced_memory()[1] < 60 << 20
        tracemalloc.stop()


def brute(cost, edges):
    best = None
    for side in itertools.product((False, True), repeat=len(cost)):
        c = sum((-x if x < 0 else 0) if s else (x if x > 0 else 0) for x, s in zip(cost, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])
        best = c if best is None else min(best, c)
    return best


def test_cut_is_minimal():
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randrange(1, 9)
        cost = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = {(a, b): rnd.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.4}
        cut = h.Cut(n)
        for i, c in enumerate(cost):
            cut.edge(cut.s, i, max(c, 0.0))
            cut.edge(i, cut.t, max(-c, 0.0))
        for (a, b), w in edges.items():
            cut.edge(a, b, w, w)
        flow = cut.flow()
        side = cut.side()
        value = sum((-x if x < 0 else 0) if s else (x if x > 0 else 0) for x, s in zip(cost, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])
        assert flow == pytest.approx(brute(cost, edges)) and value == pytest.approx(flow)


def test_neighbours_decide_short_blocks():
    found = [h.Block(t, "div", 0, 0, 2, 1, 1) for i, t in enumerate(["A long sentence, which is surely content, says much. " * 3, "Ok", "Another long sentence, which is content, stands here. " * 3])]
    assert h.label(found, h.PLAIN) == [True, True, True]
    assert h.label(found[1:2], h.PLAIN) == [False]


def test_table(spark):
    import html
    import re

    t = table(spark, "pages")
    got = as_dict(h.extract(t), "page_id")
    for r in t.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id]["text"] == "\n\n".join(x for x in want if x)
        assert got[r.page_id]["n_chars"] == len(got[r.page_id]["text"]) and got[r.page_id]["url"] == r.url
    odd = spark.createDataFrame([(1, None, None, "z"), (1, "u", "", "z"), (None, "u", PAGE, "z")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in h.extract(odd).collect())[:2] == [0, 0]
    assert h.extract(odd.limit(0)).count() == 0


SENTENCE = "This sentence belongs to the article, says what it has to say, and ends here."


@pytest.mark.parametrize("fitted", [False, True])
@pytest.mark.parametrize("attribute", ['id="market-share"', 'class="side-effects"', 'class="form-factor"', 'class="head"', 'class="form"', 'id="comments-on-policy"', 'class="header"', 'class="navy"', 'class="widget share"'])
@pytest.mark.parametrize("tag", ["p", "div", "h2", "section"])
def test_names_do_not_drop_text_of_the_article(spark, tag, attribute, fitted):
    weights = fitted_weights(spark) if fitted else h.PLAIN
    page = f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{SENTENCE}</p><{tag} {attribute}>{SENTENCE}</{tag}><p>{SENTENCE}</p></article><footer>© site</footer>"
    assert h.main_text(page, weights) == "\n\n".join(["Title", SENTENCE, SENTENCE, SENTENCE])


@pytest.mark.parametrize("fitted", [False, True])
@pytest.mark.parametrize("attribute", ['class="comments"', 'class="comment-list"', 'id="cookie-banner"', 'class="newsletter-signup box"', 'class="ad"', 'class="site-footer"', 'class="social_links"', 'role="navigation"', "hidden", 'class="sidebar"'])
def test_boilerplate_inside_the_article_goes(spark, attribute, fitted):
    weights = fitted_weights(spark) if fitted else h.PLAIN
    page = f"<article><h1>Title</h1><p>{SENTENCE}</p><div {attribute}><p>{SENTENCE}</p><p>Nice one!</p></div><p>{SENTENCE}</p></article>"
    assert h.main_text(page, weights) == "\n\n".join(["Title", SENTENCE, SENTENCE])


_weights = []


def fitted_weights(spark):
    if not _weights:
        _weights.append(h.train(table(spark, "pages")))
    return _weights[0]
