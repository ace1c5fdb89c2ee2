import random
from collections import Counter

import pytest

from tidewright.llm import html
from tidewright.llm.common import table

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; go</div>
<article><header><h1>Title &amp; more</h1></header><p><b>Lead &eacute;<br>line<p>One <i>two</i>\n  three&nbsp;four</p><aside>side</aside>
<div class="cookie-notice"><p>We use cookies</p></div><form><input>Name</form><p>Last <span class="ad">ad</span>part 1 &lt; 2</p>
<section id="comments"><article class="comment"><p>First!</p></article></section></article><footer>&copy; me</footer></body></html>"""


def test_markup_decides():
    kept = [t for t, s in html.blocks(ARTICLE) if s == html.KEEP]
    assert kept == ["Title & more", "Lead é line", "One two three four", "Last", "part 1 < 2"] or kept == ["Title & more", "Lead é line", "One two three four", "Last part 1 < 2"]
    assert html.blocks(None) == [] and html.blocks("") == []


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><title>T</title><body><article><p>The story</p></article>",
        "<head><title>T</title><article><p>The story</p></article>",
        "<article><svg viewBox='0 0 1 1'/><iframe src=\"a\" /><video src='b'/><p>The story</p></article>",
        "<div class='content has-sidebar'><article><p>The story</p></article></div>",
        "<div id='page-with-comments'><main><p>The story</p></main></div>",
        "<form id=f action=/x><div class='page search'><article><p>The story</p></article></div></form>",
        "<main><div class='wide-search'><article class='post comments-open'><p>The story</p></article></div></main>",
    ],
)
def test_markup_slips_lose_no_text(page):
    assert html.blocks(page) == [("The story", html.KEEP)]


def test_wrappers_without_article():
    assert html.blocks("<head><title>T</title>The story") == [("The story", html.OPEN)]
    assert html.blocks("<form><div class='content'><p>The story</p></div></form>") == [("The story", html.OPEN)]
    assert html.blocks("<article><p>A</p><div class=comments><article><p>B</p></article></div><iframe src=a/>x</iframe></article>") == [("A", html.KEEP), ("B", html.DROP)]


def brute(streams, depth):
    """positions covered by a depth-long token string that occurs on another page of the host."""
    seen = {}
    for page, host, tokens in streams:
        for i in range(len(tokens) - depth + 1):
            seen.setdefault((host, *tokens[i : i + depth]), set()).add(page)
    return {
        (page, i + j)
        for page, host, tokens in streams
        for i in range(len(tokens) - depth + 1)
        if len(seen[(host, *tokens[i : i + depth])]) > 1
        for j in range(depth)
    }


@pytest.fixture(scope="module")
def pages(spark):
    menu = "home news about us contact the team today and more links here"
    rows = [(i, f"https://a.example/{i}", f"<body><p>{menu}</p><p>unique story number {i} about topic {i * 7} told at length for page {i} only {i}</p></body>", "t") for i in range(4)]
    rows += [(10, "https://b.example/1", f"<p>{menu}</p>", "t"), (11, None, None, "t"), (12, "https://a.example/z", "", "t"), (13, "x", ARTICLE, "t"), (None, "https://a.example/n", f"<p>{menu}</p><p>short</p>", "t")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string"), rows, menu


def test_repeats_across_pages_go(pages):
    frame, rows, menu = pages
    out = {r.page_id: r for r in html.extract(frame).collect()}
    assert len(out) == len(rows)
    for i in range(4):
        assert out[i].text.startswith("unique story") and "home" not in out[i].text
    assert out[10].text == menu and out[11].text == "" and out[12].text == "" and out[None].text == "short"
    assert out[13].text.split("\n")[0] == "Title & more" and all(r.n_chars == len(r.text) for r in out.values())
    streams = [(r[0] if r[0] is not None else -9, (r[1] or "").split("/")[2] if "//" in (r[1] or "") else "", [t for text, s in html.blocks(r[2]) if s != html.KEEP for t in text.split(" ")]) for r in rows]
    covered = brute(streams, html.DEPTH)
    assert all((i, j) in covered for i in range(4) for j in range(len(menu.split())))
    assert html.extract(frame.limit(0)).count() == 0


def test_repeats_inside_articles_go(spark):
    notice = "you may read this page and share it with friends as long as our name stays on it"
    short = "write to the desk if you find a mistake"
    page = "<nav>n</nav><article><h1>Title {0}</h1><p>" + notice + "</p><p>story {0} is told here for the {1} readers of page {0} and others of {1}</p><p>this is the way we say things</p><p>so ends story {0}</p><p>" + short + "</p></article>"
    rows = [(i, f"https://a.example/{i}", page.format(i, i * 7)) for i in range(4)] + [(9, "https://b.example/9", page.format(9, 63))]
    out = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert out[i] == [f"Title {i}", f"story {i} is told here for the {i * 7} readers of page {i} and others of {i * 7}", "this is the way we say things", f"so ends story {i}", short]
    assert len(out[9]) == 6


def test_copies_keep_their_text(spark):
    menu = "home news about us contact the team today and more links here"
    rng = random.Random(8)
    story = [" ".join(rng.choices([f"w{i}" for i in range(900)], k=120)) for _ in range(3)]
    plain = "<p>" + menu + "</p><p>{}</p><p>read at {}</p>"
    rows = [(1, "https://a.example/1", plain.format(story[0], 1)), (2, "https://a.example/1?utm_source=x", plain.format(story[0], 1)), (3, "https://a.example/1?utm_source=y", plain.format(story[0], "noon"))]
    alone = [(page + 10, url.replace("a.", "b."), page_html) for page, url, page_html in rows]
    rows += [(4, "https://a.example/4", plain.format(story[1], 4)), (None, "https://a.example/5", plain.format(story[2], 5)), *alone]
    rows += [(20, "https://c.example/1", f"<article><p>{story[0]}</p></article>"), (21, "https://c.example/1?utm_source=x", f"<article><p>{story[0]}</p></article>")]
    out = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, n, at in ((1, 0, 1), (2, 0, 1), (3, 0, "noon"), (4, 1, 4), (None, 2, 5)):
        assert out[page] == [story[n], f"read at {at}"]
    for page, at in ((11, 1), (12, 1), (13, "noon")):
        assert out[page] == [menu, story[0], f"read at {at}"]
    assert out[20] == out[21] == [story[0]]


def test_anchors_lose_no_prefix():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    shared = rng.choices(words, k=80)
    texts = []
    for _ in range(30):
        at, n = rng.randrange(60), rng.randint(5, 20)
        texts.append(" ".join(rng.choices(words, k=rng.randint(3, 20)) + shared[at : at + n] + rng.choices(words, k=9)))
    windows = [[tuple(t.split()[i : i + html.DEPTH]) for i in range(len(t.split()) - html.DEPTH + 1)] for t in texts]
    count = Counter(w for ws in windows for w in ws)
    pages, hosts = [[t] for t in texts], ["h"] * len(texts)
    found = list(zip(*(x.tolist() for x in html.anchor_names(pages, hosts)), strict=True))
    seen = Counter(n for _, _, n in found)
    assert sum(n > 1 for n in count.values()) > 20
    page, at, names = html.prefix_names(pages, hosts, [[p for q, p, n in found if q == i and seen[n] > 1] for i in range(len(texts))])
    got = set(zip(page.tolist(), at.tolist(), strict=True))
    assert {(i, j) for i, ws in enumerate(windows) for j, w in enumerate(ws) if count[w] > 1} <= got
    named = dict(zip(zip(page.tolist(), at.tolist(), strict=True), names.tolist(), strict=True))
    by_window = {}
    for (i, j), n in named.items():
        assert by_window.setdefault(windows[i][j], n) == n
    assert len(set(by_window.values())) == len(by_window)


def test_pages_of_a_batch_together():
    """Names, places and sketches of pages do not depend on the pages beside them."""
    rng = random.Random(4)
    pages = [[" ".join(rng.choices("a bb ccc é d".split(), k=n)) for n in sizes] for sizes in ((30, 9), (), (3,), (8,), (40, 2, 11), (13,))]
    hosts = ["h", "", "h", "i", "h", "j"]
    together = list(zip(*(x.tolist() for x in html.anchor_names([p for p in pages if p], [h for p, h in zip(pages, hosts, strict=True) if p])), strict=True))
    some = [(p, h) for p, h in zip(pages, hosts, strict=True) if p]
    alone = [(n, a, b) for n, (p, h) in enumerate(some) for _, a, b in zip(*(x.tolist() for x in html.anchor_names([p], [h])), strict=True)]
    assert together == alone
    assert html.sketches(pages, hosts) == [html.sketches([p], [h])[0] for p, h in zip(pages, hosts, strict=True)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>A<p class='advert'>Buy<p>B</article>", ["A", "B"]),
        ("<article><p>A</p><ul><li>one<li class=comment>First!<li>two</ul><p>B</p></article>", ["A", "one", "two", "B"]),
        ("<article><table><tr><td>x</td><td class=sidebar>side</td><td>y</td></tr></table></article>", ["x", "y"]),
        ("<article><p>A <a class='share' href=#>Share</a> and <a href=#>a link</a> B</p></article>", ["A and a link B"]),
        ("<article><h2 class='related'>See also</h2><p class='intro'>A</p><label class=newsletter>Mail</label></article>", ["A"]),
        ("<article><li class=comments><ul><li>deep</ul>still</li><p>A</p></article>", ["A"]),
    ],
)
def test_role_words_on_every_element(page, want):
    assert [t for t, s in html.blocks(page) if s == html.KEEP] == want


def test_deep_nesting_is_linear():
    import time

    def seconds(n):
        start = time.process_time()
        assert html.blocks("<div>" * n + "story")[0][0] == "story"
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)


def test_window_names():
    tokens, owner = html.token_names(["a b c d e a b c d e f"])
    names = html.window_names(tokens, 5)
    assert len(names) == 7 and names[0] == names[5] and len(set(names.tolist())) == 6 and not owner.any()
    assert len(html.window_names(tokens[:4], 5)) == 0
    words = [f"{a}{b}{c}" for a in "ab0é" for b in "xyz" for c in "q1ü日"]
    names, owner = html.token_names([" ".join(words), words[3], " ".join(words[::-1])])
    n = len(words)
    assert len(set(names.tolist())) == n and names[n] == names[3] and names[n + 1 :].tolist() == names[:n][::-1].tolist() and owner.tolist() == [0] * n + [1] + [2] * n


def test_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.text for r in rows)
    assert not any("<" in r.text or "©" in r.text for r in rows)


def brute_extract(rows):
    """Kept text of pages whose contents all differ much: blocks covered by DEPTH-token strings of most pages of their host, three at least, go."""
    streams = {}
    for page, url, page_html in rows:
        found = html.blocks(page_html)
        wanted = html.KEEP if any(s == html.KEEP for _, s in found) else html.OPEN
        streams[page] = ((url or "").split("/")[2] if "//" in (url or "") else "", [t for t, s in found if s == wanted])
    hosts = Counter(host for host, texts in streams.values() if texts)
    seen = Counter()
    windows = {}
    for page, (host, texts) in streams.items():
        tokens = " ".join(texts).split(" ") if texts else []
        windows[page] = [(host, *tokens[i : i + html.DEPTH]) for i in range(len(tokens) - html.DEPTH + 1)]
        seen.update(set(windows[page]))
    out = {}
    for page, (host, texts) in streams.items():
        hit = {i + j for i, w in enumerate(windows[page]) if seen[w] >= html.FEWEST and 2 * seen[w] > hosts[host] for j in range(html.DEPTH)}
        kept, at = [], 0
        for text in texts:
            n = text.count(" ") + 1
            if not hit.issuperset(range(at, at + n)):
                kept.append(text)
            at += n
        out[page] = "\n".join(kept)
    return out


def test_passages_that_some_stories_share_stay(spark):
    """A line of two of five stories stays in both, one of four of five goes; headings and short lines stay."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    quoted, notice, line = say(30), say(16), say(9)
    rows = []
    for i in range(5):
        parts = [f"<h1>{say(4)}</h1>", f"<p>{line}</p>", f"<p>{say(60)}</p>", f"<p>{quoted}</p>" if i < 2 else "", f"<p>{notice}</p>" if i else "", f"<p>{say(50)}</p>"]
        rows.append((i, f"https://a.example/{i}", "<article>" + "".join(parts) + "</article>"))
    rows += [(i, f"https://b.example/{i}", f"<article><p>{notice}</p><p>{say(60)}</p></article>") for i in (10, 11)]
    out = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == brute_extract(rows)
    assert all(quoted in out[i] for i in (0, 1)) and all(line in out[i] for i in range(5)) and not any(notice in out[i] for i in range(5)) and notice in out[10]


def test_no_text_of_the_documents_is_lost(spark):
    """On all pages: what goes of an article is what brute force says, and no line of the documents."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    lines = {" ".join(line.split()) for r in table(spark, sf, "documents").select("text").collect() for line in (r.text or "").split("\n")}
    out = {r.page_id: r.text.split("\n") for r in html.extract(table(spark, sf, "pages")).collect()}
    lost = [(page, t) for page, _, page_html in rows for t, s in html.blocks(page_html) if s == html.KEEP and t not in out[page]]
    assert not [x for x in lost if x[1] in lines]
    want = brute_extract(rows)
    assert all(set(out[page]) >= set(want[page].split("\n")) for page, *_ in rows)


def test_very_long_page(spark):
    text = " ".join(f"t{i}" for i in range(120_000))
    rows = [(1, "https://a.example/1", f"<article><h1>Long</h1><p>{text}</p></article>"), (1, "https://a.example/1", f"<article><h1>Long</h1><p>{text}</p></article>")]
    assert [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [f"Long\n{text}"] * 2
