"""Page lines, alignment and page differencing on small sites."""

import random

import numpy as np
import pytest

from lamina.llm import page_text
from lamina.llm.page_lines import page_lines
from lamina.llm.page_text import align, extract_text

SCHEMA = "page_id bigint, url string, html string, text string, host int, gone string, lines string"


def texts(html):
    return [line.text for line in page_lines(html)]


@pytest.mark.parametrize("html, want", [
    (None, []), ("", []), ("plain  text\n here", ["plain text here"]), ("<p>a<p>b &amp; c&lt;", ["a", "b & c<"]),
    ("<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><p>x</p></body>", ["x"]),
    ("<nav><ul><li><a>m</a></ul></nav><div class='ad'>buy</div><article><h1>H</h1><p><b>one<br>two<p>three</article><footer>f", ["H", "one two", "three"]),
    ("<body class='has-sidebar'><div id=sidebar>s</div><div class='content no-sidebar'>c<span class=share>tw</span>d</div>", ["cd"]),
    ("<main><h1>T</h1><article><p>a</p><div class='comments'><article><p>c</p></article></div></article><aside>x</aside></main>", ["T", "a"]),
    ("<p>cut <b>off</b> her", ["cut off her"]), ("<p>a</p><p cla", ["a"]), ("a <!-- b --> c <!-- d", ["a c"]), ("<p>1 < 2 <3</p>", ["1 < 2 <3"]),
    ("<form><label>n</label><input></form><table><tr><td>a<td>b<tr><td>c</table>", ["a b", "c"]), ("<p title='a>b'>x</p><p title=\"q>y</p>", ["x", "y"]),
    ("<nav><a>m</a><article><p>left open</p></article>", ["left open"]), ("<div hidden>h</div><div style='display: none'>i</div><p aria-hidden=true>j</p>k", ["k"]),
    ("<header><h1>site</h1></header><article><header><h1>Own</h1></header>t</article>", ["Own", "t"]), ("<div class='newsletter'>all there is</div>", ["all there is"]),
    ("<p>a&nbsp;b&#8212;c &copy &am</p>", ["a b—c © &am"]), ("<div class=cookie-notice>c</div><div>x</div><script>never ends", ["x"])])
def test_lines(html, want):
    assert texts(html) == want


def test_very_long_page():
    assert len(texts("<p>word</p>" * 50_000)) == 50_000
    assert texts("<a " * 100_000) == []
    assert len(texts("<div>" * 3000 + "deep")) == 1


def longest(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, best[j] = best[j], last + 1 if x == y else max(best[j], best[j - 1])
    return best[-1]


@pytest.mark.parametrize("cells", [1 << 26, 20])
def test_alignment(monkeypatch, cells):
    monkeypatch.setattr(page_text, "ALIGNED", cells)
    r = random.Random(cells)
    for _ in range(300):
        kinds = r.choice([2, 4, 30])
        a, b = (np.array([r.randrange(kinds) for _ in range(r.randrange(25))], np.uint64) for _ in "ab")
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a.tolist(), b.tolist())


def article(k, n=6):
    r = random.Random(k)
    return [" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(n)]


def soup(site, k, lines=None):
    blocks = [f"Welcome to {site}", "Home", "About us", *(lines or article(k)), "All rights reserved", f"{site} is a site"]
    return "<body>" + "".join(f"<div>{b}</div>" for b in blocks)


def plain(rows):
    """The rule over all pages at once."""
    by_host, result = {}, []
    for _, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, _, path = rest.partition("/")
        key = tuple(page_lines(html))
        own = by_host.setdefault(host, {})
        own[key] = min(own.get(key, "\U0010ffff"), ("/" + path if rest and "/" in rest else "").split("?")[0])
    gone = {}
    for host, own in by_host.items():
        order = sorted(own, key=lambda key: (own[key], page_text.hashlib.blake2b(b"".join(page_text.hashlib.blake2b(x.text.encode(), digest_size=8).digest() for x in key) + bytes(x.inside for x in key), digest_size=16).digest()))
        pages = [(np.array([hash(x.text) & (1 << 62) - 1 for x in key], np.uint64), np.array([len(x.text) for x in key]), np.array([x.inside for x in key], bool)) for key in order]
        for key, flags in zip(order, page_text.shared_lines(pages, range(len(pages)))):
            gone[host, key] = flags
    for page_id, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        key = tuple(page_lines(html))
        text = "\n".join(x.text for x, g in zip(key, gone[rest.partition("/")[0], key]) if not g)
        result.append((page_id, url, text, len(text)))
    return sorted(result, key=str)


def extract(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "g", "l") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in extract_text(df).select("page_id", "url", "text", "n_chars").collect()), key=str)


def test_shared_lines_go_and_own_text_stays(spark):
    rows = [(k, f"http://a.org/p{k:03}?q={k}", soup("a.org", k)) for k in range(20)] + [(100 + k, f"http://b.org/{k}", soup("b.org", 50 + k)) for k in range(3)]
    rows += [(200, "http://lone.org/x", soup("lone.org", 77)), (300, "http://a.org/copy", soup("a.org", 3)), (301, "http://a.org/p003b", soup("a.org", 3)), (301, "http://a.org/p003b", soup("a.org", 3))]
    got = {r[0]: r[2] for r in extract(spark, rows)}
    for k in range(20):
        assert got[k].split("\n") == article(k)
    assert got[300] == got[301] == "\n".join(article(3))
    assert all(got[100 + k].split("\n") == article(50 + k) for k in range(3))
    assert len(got[200].split("\n")) == 11


def test_versions_of_a_page_keep_their_text(spark):
    versions = [(k, f"http://a.org/{k}", soup("a.org", 1, [*article(1), f"version {k}"])) for k in range(2)] + [(9, "http://a.org/9", soup("a.org", 9))]
    got = {r[0]: r[2] for r in extract(spark, versions)}
    assert got[0].split("\n") == [*article(1), "version 0"] and got[9].split("\n") == article(9)


def test_common_line_inside_articles_stays(spark):
    page = lambda k: "<article>" + "".join(f"<p>{x}</p>" for x in [*article(k), *(["As they say, so it goes"] if k % 3 == 0 else [])]) + "</article>"
    got = {r[0]: r[2] for r in extract(spark, [(k, f"http://a.org/{k:02}", page(k)) for k in range(12)])}
    assert all(got[k].endswith("As they say, so it goes") == (k % 3 == 0) for k in range(12))


def test_runs_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(page_text, "RUN", 9)
    r = random.Random(2)
    rows = []
    for k in range(70):
        site = r.choice(["a.org", "a.org", "a.org", "b.org", "c.org"])
        rows.append((k, f"http://{site}/{r.randrange(400):03}", soup(site, r.randrange(60), r.choice([None, None, ["Home"], article(1)[:2]]))))
    rows += [(None, None, soup("n", 1)), (None, "no scheme", soup("n", 2)), (71, "http://a.org/1", None), (72, "http://a.org/1", ""), (0, *rows[0][1:])]
    assert extract(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert extract(spark, []) == []
