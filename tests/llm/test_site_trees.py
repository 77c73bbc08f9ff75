"""Main text: the page reader on broken and awkward markup, the trees against direct counts, whole sites."""

import collections
import math
import random

import pytest

pytest.importorskip("cohortspan.llm")

from cohortspan.llm import site_trees as st
from tests.llm.test_operators import prose


def texts(markup):
    return [t for t in st.Page(markup, st.Labels()).text if t is not None]


@pytest.mark.parametrize("markup, want", [
    ("", []),
    ("only text &amp; more", ["only text & more"]),
    ("<p>one<p>two</p>three", ["one", "two", "three"]),
    ("<p>a <b>bo</b>ld<br>line\n\n x&nbsp;y &#233;&am &ampz</p>", ["a bold line x\xa0y é&am &z"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>", ["1", "2", "3"]),
    ("<script>var t = '</p><p>no';</script><style>p{}</style><p>yes", ["yes"]),
    ("<script>never ends <p>x", []),
    ("a<!-- b <p>c --> d<!-- open <p>e", ["a d"]),
    ("<p title='don>t'>x</p><p title=don't>y</p><p>z's</p>", ["x", "y", "z's"]),
    ("1 < 2 <3 & x<y>z", ["1 < 2 <3 & xz"]),
    ("<head><title>t</title><body>x", ["x"]),
    ("<nav>n</nav><header><h1>site</h1></header><article><header><h1>T</h1></header>x<footer>f</footer></article><footer>f</footer>", ["T", "x"]),
    ("<div class='ad'>n</div><div id=sidebar-2>n</div><div role=navigation>n</div><div class=no-sidebar>y</div><div hidden>n</div>", ["y"]),
    ("<section class='user-comments'><div>n</div><p>n</section><p class='comment-free badge'>n<p>y", ["y"]),
    ("<p>a<span class=ad>n<span>n</span>n</span>b", ["ab"]),
    ("<form>n<article>y</article>n<input><p>n</form>y", ["y", "y"]),
    ("<aside>n<main>y<aside>n</aside></main>n</aside>", ["y"]),
    ("<a href='", []), ("<", ["<"]), ("</nope>x</div></p>", ["x"]), ("<DIV>A</Div><P>B", ["A", "B"]),
])
def test_page(markup, want):
    assert texts(markup) == want


def test_page_deep_and_long():
    assert texts("<div>" * 50_000 + "x") == ["x"]
    assert texts("<p>" + "word " * 200_000) == ["word " * 199_999 + "word"]
    assert texts("<a '\"" * 20_000 + "<b class='" * 1000) == []
    page = st.Page("<div>" * 3000 + "x", st.Labels())
    assert len(set(page.keys()[0])) == len(page.label)


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", 5, "l") for r in rows], "page_id long, url string, html string, text string, n_chars int, low string")


def site(rnd, k, host="a.example", extra=""):
    body = "".join(f"<p>{prose(rnd, 12)}</p>" for _ in range(rnd.randint(1, 5)))
    return (k, f"https://{host}/{k}", f"<body><div><b>Home</b> <i>News</i></div><div><h1>{prose(rnd, 4)}</h1>{body}{extra}</div><div>All rights with us</div></body>")


def test_site_tree_matches_direct_counts(spark):
    rnd = random.Random(4)
    pages = [site(rnd, k, "A.example:80" if k % 2 else "b.example", "<ul><li>x</li></ul>" if k % 3 else "") for k in range(40)]
    pages += [(100 + k, f"https://b.example/c{k}", pages[2][2]) for k in range(9)]  # copies count once
    pages += [(200, None, "<p>lone"), (201, "no host", "<p>lone"), (202, None, None)]
    got = {(r.host, r.node, r.is_text): r for r in st.site_tree(table(spark, pages).repartition(5)).collect()}
    held, seen = collections.defaultdict(lambda: collections.defaultdict(set)), set()
    for _, url, markup in pages:
        host = "" if not url or "://" not in url else url.split("/")[2].split(":")[0].lower()
        page = st.Page(markup or "", st.Labels())
        body = (host, *(t for t in page.text if t is not None))
        if len(body) == 1 or body in seen:
            continue
        seen.add(body)
        key, style = page.keys()
        for k, t in enumerate(page.text):
            if t is not None or style[k]:
                held[host, key[k], t is not None][style[k] if t is None else t].add(body)
    assert len(held) == len(got)
    for (host, key, leaf), features in held.items():
        r = got[host, key - 2**64 if key >= 2**63 else key, leaf]
        m, n = len(set().union(*features.values())), [len(v) for v in features.values()]
        assert r.pages == m
        if m == 1:
            want = 1.0
        elif leaf:
            want = 1 - sum(math.log(c, m) for c in n) / len(n)
        else:
            want = -sum(c / sum(n) * math.log(c / sum(n), m) for c in n)
        assert r.importance == pytest.approx(want, abs=1e-9)


def test_extract_removes_what_a_site_repeats(spark):
    rnd = random.Random(5)
    pages = [site(rnd, k) for k in range(12)]
    copied = "<body><div><b>Home</b> <i>News</i></div><div><h1>Same</h1><p>The same story.</p><blockquote>everywhere</blockquote></div><div>All rights with us</div></body>"
    pages += [(50 + k, f"https://a.example/c{k}", copied) for k in range(30)]
    pages += [(90, "https://lone.example/", "<div>Home</div><div><p>Only page</p></div>"), (91, "https://a.example/e", ""), (None, None, None)]
    got = {r.page_id: r for r in st.extract(table(spark, pages).repartition(6)).collect()}
    assert len(got) == len(pages)
    for k, url, markup in pages[:12]:
        want = " ".join(texts(markup)[1:-1])
        assert (got[k].url, got[k].text, got[k].n_chars) == (url, want, len(want))
    assert {got[50 + k].text for k in range(30)} == {"Same The same story. everywhere"}
    assert got[90].text == "Home Only page" and got[91].text == "" and got[None].text == "" and got[None].url is None


def test_varied_presentation_keeps_repeated_text(spark):
    """A licence that all pages repeat stays where the article arranges its parts in ever other ways, and goes from a fixed place."""
    rnd = random.Random(6)
    parts = ["<h2>{}</h2>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<blockquote>{}</blockquote>"]
    pages = []
    for k in range(16):
        inner = "".join(rnd.choice(parts).format(prose(rnd, 3)) for _ in range(6))
        pages.append((k, f"http://h.example/{k}", f"<div><p>Shared words.</p>{inner}</div><div><p>Fixed words.</p></div>"))
    got = st.extract(table(spark, pages)).collect()
    assert all(r.text.startswith("Shared words. ") and "Fixed" not in r.text for r in got)


def test_empty_table(spark):
    nothing = table(spark, [(1, "http://a/", "x")]).filter("false")
    assert st.extract(nothing).count() == 0 and st.site_tree(nothing).count() == 0
