import itertools
import math
import random
import re

import numpy as np
import pytest

from docquery.llm import html, html as extraction, urls

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div><script>var a="</p><p>x";</script>
<article><header><h1>Big &lt;news&gt;</h1></header><p>One <b>bo</b>ld&nbsp;word<br>and more <p>Two<!-- <p>no --></p>
<div class="ad">Buy</div><form>Mail <input></form><ul><li>first<li>second &copy; &eacute;</ul><section id="comments"><p>Nice!</section></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_blocks():
    assert html.blocks(PAGE) == [(t, True) for t in ("Big <news>", "One bold word and more", "Two", "first", "second © é")]
    assert html.blocks("<article><p>cut &am") == [("cut &am", True)]
    assert html.blocks('<p title="a > b">x</p><script>never closed <p>y') == [("x", False)]
    assert html.blocks("a < b <p") == [("a < b", False)]
    assert html.blocks("") == [] and html.blocks("<div") == []


def test_repeated_is_brute_force():
    r = random.Random(3)
    for _ in range(60):
        pages = [[r.randrange(3) for _ in range(r.randrange(0, 25))] for _ in range(r.randrange(1, 6))]
        ids, page = [], []
        for i, p in enumerate(pages):
            ids += [*p, 1000 + i]
            page += [i] * (len(p) + 1)
        least = r.randrange(2, 4)
        want = []
        for i, p in enumerate(pages):
            gone = [False] * (len(p) + 1)
            for a in range(len(p) - 3):
                if sum(any(q[b : b + 4] == p[a : a + 4] for b in range(len(q) - 3)) for q in pages) >= least:
                    gone[a : a + 4] = [True] * 4
            want += gone
        assert html.repeated(np.array(ids), np.array(page), 4, least).tolist() == want


def test_extract(spark):
    menu = "<div>Welcome to the site of many words, here is all that every page of it says</div>"
    rows = [(i, "http://A.b/x", f"<html><body>{menu}<p>Own text {i} of the page</p></body></html>") for i in range(6)]
    rows += [(6, "http://a.b/y", PAGE), (6, "http://a.b/y", PAGE), (7, None, None), (8, "", ""), (None, "http://c.d", menu)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert {got[i] for i in range(6)} == {f"Own text {i} of the page" for i in range(6)}
    assert got[6].startswith("Big <news>\nOne bold") and got[7] == got[8] == "" and got[None].startswith("Welcome")
    assert html.extract(df).count() == len(rows) and html.extract(df.limit(0)).count() == 0


def test_urls(spark):
    rows = ["http://X.example.net/de/1", "http://x.example.net/en/1", "http://example.com/de/", "http://a.org/fr/2?x#y", "http://a.org/fr", "nonsense", None, "http://badnet/x", "https://net/", "http://net?x", "x://h/a/b/c/d/e/f"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].rule for i in range(len(rows))] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, "net/", None, None]
    assert [got[i].verdict for i in range(4)] == ["block", "allow", "block", "allow"]
    assert (got[0].host, got[0].path, got[5].host, got[5].path, got[6].path, got[9].path) == ("x.example.net", "/de/1", "", "", "", "")
    assert got[10].template == "a/b/c/d/**"
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_of_a_host_are_judged(spark):
    ruled = [f"http://spam.com/bad/{i}" for i in range(20)] + [f"http://spam.com/good/p{chr(97 + i)}/x" for i in range(20)]
    near = ["http://spam.com/bad", "http://spam.com/good"]
    df = spark.createDataFrame(list(enumerate(ruled + near)), "page_id long, url string")
    rules = (urls.Rule.of("block", "spam.com/bad/1"), urls.Rule.of("allow", "spam.com/good/"))
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    assert got[2].template == "bad/*" and got[2].rule is None and got[2].verdict == "block"
    assert got[25].template == "good/*/x" and got[25].verdict == "allow"
    assert got[40].verdict == "allow"


def test_a_hot_host_blocks_no_other(spark):
    few = [f"http://a.org/fr/{i}" for i in range(30)] + [f"http://a.org/en/{i}" for i in range(5)] + ["http://b.org/x", "http://c.org/fr/1"]
    rules = (*urls.RULES, urls.Rule.of("allow", "one.com/a/1"))
    few += ["http://one.com/a/1", "http://one.com/a/2"]
    hot = [f"http://hot.net/{i}" for i in range(1500)]
    before, after = ({r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(x)), "page_id long, url string"), rules).collect()} for x in (few, few + hot))
    assert all(after[i] == before[i] == "allow" for i in range(len(few))) and after[len(few)] == "block"


def test_deep_branches_are_judged_apart(spark):
    base = "http://a.com/blog/2024/05/12/x/y"
    bad, good = [f"{base}/spam/{c}/{c}" for c in "abcdefghijkl"], [f"{base}/ok/{c}/z" for c in "abcdefghijkl"]
    rules = (*(urls.Rule.of("block", u[7:]) for u in bad[:6]), *(urls.Rule.of("allow", u[7:]) for u in good[:6]))
    df = spark.createDataFrame(list(enumerate(bad + good + [f"{base}/spam", "http://b.com/1/2/3/4/5/6"])), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, rules).collect()}
    assert got[18].verdict == "allow" and got[18].template == "blog/*/*/*/x/y/ok/*/z"
    assert got[24].template == "blog/*/*/*/x/y/spam" and got[25].template == "*/*/*/*/**"
    deep = [f"{base}/{k}/{i}" for i in range(9) for k in ("spam", "ok")]
    rules = (urls.Rule.of("block", "a.com/blog/2024/05/12/x/y/spam/1"), urls.Rule.of("allow", "a.com/blog/2024/05/12/x/y/ok/1"))
    deep += [f"{base}/{k}/1{c}" for k in ("spam", "ok") for c in "abcdefghijkl"]
    got = urls.judge(spark.createDataFrame(list(enumerate(deep)), "page_id long, url string"), rules).collect()
    assert all(r.verdict == ("block" if "/spam/" in r.path else "allow") for r in got)


def test_a_large_host_loses_its_menu(spark):
    menu = "<div>Welcome to the site of many words, here is all that every page of it says</div>"
    rows = [(i, "http://a.b/x", f"<body>{menu}<p>Own text {i} of the page</p></body>") for i in range(6)]
    rows.append((9, "http://a.b/big", "<body><p>big</p><!--" + " " * 20_000_000 + "--></body>"))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i} of the page" for i in range(6)} | {9: "big"}


def test_a_section_loses_its_menu(spark):
    menu = "<div>Welcome to the section of many words, here is all that every page of it says</div>"
    rows = [(i, "http://a.b/x", f"<body>{menu if i < 20 else ''}<p>Own text {i} of the page</p></body>") for i in range(100)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own text {i} of the page" for i in range(100)}


def test_suffix_array_is_brute_force():
    r = random.Random(5)
    for _ in range(80):
        ids = [r.randrange(3) for _ in range(r.randrange(0, 40))] + [-1]
        order, shared = html.suffix_array(np.array(ids))
        want = sorted(range(len(ids)), key=lambda i: ids[i:])
        assert order.tolist() == want
        prefix = lambda a, b: next((k for k in range(len(ids)) if max(a, b) + k >= len(ids) or ids[a + k] != ids[b + k]), 0)
        assert shared.tolist() == [0] + [prefix(a, b) for a, b in zip(want, want[1:], strict=False)]


def plain_extract(rows):
    """The operator's rows without arrays, hashes or parts: every run is looked up on every page."""
    parsed = [(k, u, html.shown(h or ""), bool(re.search(r"<(article|main)[\s/>]", h or "", re.I))) for k, u, h in rows]
    host = lambda u: (re.match(r"(?s).*?://([^/?#]*)", u or "") or [None, ""])[1].lower()
    out = []
    for k, u, page, names in parsed:
        peers = {tuple(p) for _, v, p, n in parsed if host(v) == host(u) and n == names}
        streams = [[w for t, kind in p if kind != html.ARTICLE for w in ("\n", *t.split(" "))] for p in peers]
        seen = {}
        for i, s in enumerate(streams):
            for a in range(len(s) - 7):
                seen.setdefault(tuple(s[a : a + 8]), set()).add(i)
        least = max(3, math.ceil(min(0.3 * len(peers), math.sqrt(len(peers)))))
        own = [w for t, kind in page if kind != html.ARTICLE for w in ("\n", *t.split(" "))]
        gone = [any(len(seen.get(tuple(own[a : a + 8]), ())) >= least for a in range(max(i - 7, 0), min(i, len(own) - 8) + 1)) for i in range(len(own))]
        at, removed, left = 0, 0, []
        for t, kind in page:
            if kind != html.ARTICLE:
                words = t.split(" ")
                here = gone[at + 1 : at + 1 + len(words)]
                at += 1 + len(words)
                runs = [(g, len(list(x))) for g, x in itertools.groupby(here)]
                here = [g and n >= min(8, len(words)) for g, n in runs for _ in range(n)]
                removed += sum(here)
                t = " ".join(w for w, g in zip(words, here, strict=True) if not g)
            if t and kind != html.MARKED:
                left.append((t, kind))
        plain, article = (sum(len(t) for t, k in left if k == kind) for kind in (html.PLAIN, html.ARTICLE))
        out.append((k, "\n".join(t for t, k in left if k == html.ARTICLE or plain > article), removed))
    return out


def made_pages(seed, n=60):
    r = random.Random(seed)
    said = [" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randrange(4, 20))) for _ in range(8)]
    rows = []
    for i in range(n):
        body = [f"<{t}>{r.choice(said) if r.random() < 0.6 else ' '.join(r.choice('xyzuvw') + str(r.randrange(9)) for _ in range(r.randrange(1, 15)))}</{t}>" for t in r.choices(["div", "p", "li", "nav", "footer"], k=r.randrange(0, 6))]
        if r.random() < 0.4:
            body.insert(len(body) // 2, f"<article><p>Article {i % 7} {r.choice(said)}</p></article>")
        rows.append((i, r.choice(["http://a.b/x", "http://A.b/y", "https://c.d", None, "none"]), "".join(body)))
    return rows + [(n, "http://a.b/z", rows[0][2]), (n + 1, "http://a.b/null", None), (n + 2, "http://a.b/e", "")]


def test_extract_is_brute_force_whatever_an_array_covers(spark):
    for seed in range(2):
        rows = made_pages(seed)
        df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "page_id long, url string, html string, text string, site string")
        want = sorted(plain_extract(rows))
        assert sum(n for _, _, n in want) > 0
        for limit in (1 << 22, 1000, 50):
            got = sorted((x.page_id, x.text, x.n_removed) for x in html.extract(df, array_chars=limit).collect())
            assert got == want


def test_words_of_a_name_must_all_fit():
    for name in ("social-history", "related-work", "menu-prices", "adaptive"):
        assert html.blocks(f'<article><div class="{name}">x</div></article>') == [("x", True)]
    for name in ("cookie-notice", "adBanner", "sidebar left", "ad-slot-3", "x share-buttons comments"):
        assert html.blocks(f'<article><div class="{name}">x</div></article>') == []


def test_a_teaser_is_not_all_of_a_page(spark):
    page = "<article>Short</article><div>The main text of this page is much longer</div>"
    df = spark.createDataFrame([(1, "http://a.b", page)], "page_id long, url string, html string")
    assert html.extract(df).first().text == "Short\nThe main text of this page is much longer"


def test_long_pages(spark):
    rows = [(i, "http://a.b", "<p>" + f"w{i} " * 300_000 + "</p>") for i in range(3)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: " ".join([f"w{i}"] * 300_000) for i in range(3)}


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article><p class="ad">Buy<p>Real text one.<p>Real text two.</article>', "Real text one.\nReal text two."),
        ('<article><ul><li class="share">Share<li>Real item</ul></article>', "Real item"),
        ('<article><svg class="icon"/><p>Real text.</article>', "Real text."),
        ('<article><svg><g class="banner"/></svg>Real <b class="ad"/>gone</b> text</article>', "Real\ntext"),
        ('<article><p>A</p><div hidden="hidden">no</div><p hidden="">no</p><img alt="the hidden valley"><p title="a hidden b">B</p></article>', "A\nB"),
        ('<article><div class="site-header">no</div><header>yes</header></article>', "yes"),
        ('<article><table><tr><td class="ad">x<td>y<tr><th>z</table></article>', "y\nz"),
        ('<article><p class="ad">Buy<div>Real</div></article>', "Real"),
        ('<article><ul><li class="share">S<ul><li>inner</ul><li>Real</ul></article>', "Real"),
    ],
)
def test_tags_that_are_left_out(html, text):
    assert extraction.unique_runs([extraction.shown(html)])[0][0] == text
