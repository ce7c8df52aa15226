"""HTML extraction: hand-made pages, suffix arrays by brute force, and host boilerplate."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import htmltext, queries

PAGES = [
    ("<article><h1>A &amp; B</h1><p>one\n two<br>three<p>f&ouml;ur &lt;x&gt;</article><footer>no</footer>", "A & B one two three föur <x>"),
    ("<body><header>no</header><main><p>yes</p><aside>no</aside><form>no</form><!-- no --><script>'</main>'</script><p>too</main>", "yes too"),
    ("<article><p>a<b>b</b>c</p><div class='comments'><p>no</p></div><ul><li>x<li>y</ul></article>", "abc x y"),
    ("<article>1 < 2 &am <3 &#65;&#x42;</article>", "1 < 2 &am <3 AB"),
    ("<div role=main>t<div id=cookie-notice>no</div>u</div><nav>no", "t u"),
    ("<article><p>cut off", "cut off"),
    ("<article><style>p{}</style><template>no</template></article>", ""),
    ("<title>no</title><article data-x='>'>ok</article>", "ok"),
    ("<article>a&amp;lt;b</article>", "a&lt;b"),
    ("", ""),
    (None, ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.io/", p, 1) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], 1)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (got[i].text, got[i].n_chars) == (want, len(want))
    assert got[None].text == PAGES[0][1] and len(got) == len(PAGES) + 1
    assert htmltext.main_text(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.integers(0, 2), max_size=14)), max_size=5), st.integers(1, 4))
def test_repeated_tokens(blocks, least):
    pages, streams = [p for p, _ in blocks], [s for _, s in blocks]
    got = htmltext.repeated_tokens([np.array(s, np.int64) for s in streams], pages, least)
    for i, s in enumerate(streams):
        want = [False] * len(s)
        for a in range(len(s) - least + 1):
            if any(s[a : a + least] == o[b : b + least] for j, o in enumerate(streams) if pages[j] != pages[i] for b in range(len(o) - least + 1)):
                want[a : a + least] = [True] * least
        assert got[i].tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-2, 3), min_size=1, max_size=40))
def test_suffix_array(tokens):
    order = htmltext.suffix_array(np.array(tokens))
    assert order.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])


@pytest.mark.parametrize("share", [2000, 15])
def test_host_boilerplate(spark, share):
    menu, foot = "Home News About Contact Imprint Search", "All rights reserved by the owners of this"
    rows = [(i, f"http://one.io/{i}", f"<div>{menu}</div><div>story {i} about thing{i} and place{i}</div><div>{foot}</div>") for i in range(40)]
    rows.append((99, "http://two.io/", f"<div>{menu}</div><div>alone</div>"))
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), share_pages=share).collect()}
    assert all(got[i] == f"story {i} about thing{i} and place{i}" for i in range(40))
    assert got[99] == f"{menu} alone"


@pytest.mark.parametrize("share", [2000, 15])
def test_rare_boilerplate(spark, share):
    """Runs that stand on two or three of a host's pages, wherever the pages are dealt."""
    rows = []
    for i in range(60):
        own = " ".join(f"w{i}x{k}" for k in range(7))
        pair, three = (" ".join(f"{kind}{i % n}y{k}" for k in range(8)) for kind, n in (("pair", 30), ("three", 20)))
        short = " ".join(f"short{i % 30}z{k}" for k in range(5))
        rows.append((i, "http://one.io/", f"<div>{own} {own}</div><p>{pair} tail{i}</p><p>{short}</p><p>a{i} {three}</p>"))
    rows.append((60, "http://two.io/", rows[0][2]))
    texts = {i: [b for _, b in htmltext.blocks(page)[1]] for i, _, page in rows}
    where = {}
    for i, found in texts.items():
        for b in found:
            ws = b.split(" ")
            for k in range(len(ws) - 5):
                where.setdefault((i == 60, *ws[k : k + 6]), set()).add(i)
    want = {}
    for i, found in texts.items():
        left = []
        for b in found:
            ws = b.split(" ")
            gone = {k + j for k in range(len(ws) - 5) if len(where[(i == 60, *ws[k : k + 6])]) > 1 for j in range(6)}
            left += [w for k, w in enumerate(ws) if k not in gone]
        want[i] = " ".join(left)
    assert want[3].endswith(" tail3 " + " ".join(f"short3z{k}" for k in range(5)) + " a3") and len(want[60].split(" ")) == 37
    got = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5), share_pages=share).collect()}
    assert got == want


def test_regions():
    page = "<nav>Home<ul><li>News</ul></nav><p>before <span class=ad>buy now</span>after</p><article>in</article><footer>end<script>no</script></footer>tail"
    assert htmltext.blocks(page) == (True, [(2, "Home"), (2, "News"), (2, "buy now"), (1, "before after"), (0, "in"), (2, "end"), (1, "tail")])
    assert htmltext.blocks("<p>" * 3000 + "deep" + "<div>" * 3000 + "x")[1] == [(1, "deep"), (1, "x")]


@pytest.mark.parametrize("share", [2000, 3])
def test_every_page_is_measured(spark, share):
    """Pages with an article too: what stands outside it and on another page of the host is counted."""
    menu, ad = "a menu of six words here", "an advert of only this one page"
    rows = [(i, "http://one.io/", f"<nav>{menu}</nav><article>story {menu} {i}</article><div class=ad>{ad} {i if i else ''}</div>") for i in range(5)]
    rows += [(9, "http://two.io/", rows[0][2]), (10, None, None), (11, "http://one.io/", "<article>" + "word " * 300000 + "</article>")]
    got = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), share_pages=share).collect()}
    assert [got[i].n_boilerplate for i in (0, 1, 9, 10, 11)] == [6 + 7, 6 + 7, 0, 0, 0]
    assert got[1].text == f"story {menu} 1" and got[9].text == f"story {menu} 0" and got[10].text == "" and got[11].n_chars == 5 * 300000 - 1


def test_boilerplate_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    where, outer = {}, {}
    for p in pages:
        host = p.url.split("://")[1].split("/")[0].lower()
        outer[p.page_id] = host, [b.split(" ") for k, b in htmltext.blocks(p.html)[1] if k != htmltext.MAIN]
        for ws in outer[p.page_id][1]:
            for k in range(len(ws) - 5):
                where.setdefault((host, *ws[k : k + 6]), set()).add(p.page_id)
    want = {}
    for i, (host, found) in outer.items():
        want[i] = sum(len({k + j for k in range(len(ws) - 5) if len(where[(host, *ws[k : k + 6])]) > 1 for j in range(6)}) for ws in found)
    got = {r.page_id: r.n_boilerplate for r in queries.op8_html_main_text(spark, sf).collect()}
    assert got == want and sum(v > 0 for v in want.values()) > 50
