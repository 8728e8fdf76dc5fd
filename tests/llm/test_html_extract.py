import re
import time

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reelproof.llm import html_extract as h

PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="page with-sidebar">
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Head {i} &amp; more</h1><span>by me</span></header>
<script>var x = "</p><p>no";</script><p>First&nbsp;{i}  line<br>goes on <b>bold<i>er</b></i> x &lt; y<p>Second <a href="u">link</a>: caf&eacute; &#x41;
<div class="ad-slot">Buy {i}</div><blockquote>Quote {i}</blockquote><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<p>Like what you read? Tell a friend today.</p><form><input><button>Go</button></form><pre>a
  b</pre></article><section class="comments"><article class="comment"><p>{c}</p></article></section></main>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""
WANT = ["Head {i} & more", "First {i} line goes on bolder x < y", "Second link: café A", "Quote {i}", "one", "two", "a b", "Like what you read? Tell a friend today.", "a b"]


def page(i):
    return PAGE.format(i=i, c="reader says " * 40)


def test_article_alone():
    assert h.extract(page(7)).split("\n") == [w.format(i=7) for w in WANT]


def test_broken_pages():
    assert h.extract(None) == h.extract("") == ""
    assert h.extract("just text &am") == "just text &am"
    assert h.extract("<p>a<p>b <!-- c") == "a\nb"
    assert h.extract("<article><p>a < b</p><p title='x>y'>c") == "a < b\nc"
    assert h.extract("<div>" * 5000 + "deep") == "deep"
    assert h.extract("<p " + 'a="' * 20000).strip() == ""


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pab \"'=!-&;&amp", max_size=60))
def test_any_string_parses(text):
    h.extract(text)


def test_tree_matching():
    a, b = (h.parse(t) for t in ("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>", "<div><p>1</p><h2>n</h2><p>2</p></div>"))
    shapes = h.Shapes()
    assert shapes.likeness(shapes.shape(("html", [a])), shapes.shape(("html", [b]))) == 4
    assert h.similar(a, a) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.sampled_from([1_000_000, 4]))
def test_best_pairing(a, b, table):
    """The pairing has the highest total, by the plain recurrence, whether its table is one or halved."""
    weight = {x: k + 1 for k, x in enumerate("abc")}
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (weight[x] if x == y else 0))
    scores = np.array([[weight[x] if x == y else 0 for y in "abc"] for x in "abc"])
    before, h.TABLE = h.TABLE, table
    found = h.align(np.array(["abc".index(x) for x in a], int), np.array(["abc".index(x) for x in b], int), scores)
    h.TABLE = before
    assert sum(weight[a[i]] for i, j in found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
    assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:], strict=False))


def plain_likeness(a, b):
    """Simple tree matching from its definition, by recursion over every pair of children."""
    if a[0] != b[0]:
        return 0
    if len(a[1]) > 1 or len(b[1]) > 1:
        return min(len(a[1]), len(b[1]))
    x, y = h.runs(a[1][0]), h.runs(b[1][0])
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_likeness(p, q))
    return 1 + best[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<ul>", "</ul>", "<li>x</li>", "<p>t</p>"]), max_size=24), st.lists(st.sampled_from(["<div>", "</div>", "<ul>", "</ul>", "<li>x</li>", "<p>t</p>"]), max_size=24))
def test_likeness_from_its_definition(a, b):
    x, y = h.parse("".join(a)), h.parse("".join(b))
    shapes = h.Shapes()
    assert shapes.likeness(shapes.shape(("", [x])), shapes.shape(("", [y]))) == plain_likeness(("", [x]), ("", [y]))


def test_deep_and_wide_pages_align_fast():
    began = time.time()
    deep = [h.parse("<div>" * 100 + f"<p>{i}</p><span></span>" * (i + 1) + "</div>" * 100) for i in range(2)]
    assert h.similar(*deep) > 0.9
    sides = ["".join(f"<div><div><p>a</p>{'<b></b>' * (k % (i + 2))}</div></div>" for k in range(200)) for i in range(2)]
    assert 0.5 < h.similar(*(h.parse("<div>" * 90 + x) for x in sides)) < 1
    wide = [h.parse("".join(f"<div class='c{(k * (i + 3)) % 50}'><p>x</p></div>" for k in range(3000))) for i in range(2)]
    h.similar(*wide)
    assert len(h.layouts([h.parse("<div>" * 100 + f"<h1>Title {i}</h1><p>Story {i} told at some length here.</p>") for i in range(6)], 4)) == 1
    assert time.time() - began < 6


def test_articles_side_by_side():
    page = "<body><nav>Menu</nav><div><article><p>First story.</p></article><aside>Ad</aside><article><p>Second story, longer.</p><article>Inner</article></article></div><footer>End</footer></body>"
    assert h.extract(page) == "First story.\nSecond story, longer.\nInner"


def test_wrappers_alone_find_the_article():
    """On the given pages with every tag and class name taken away that tells the article from the rest."""
    rows = duckdb.sql("SELECT lower(regexp_extract(url, '://([^/:?#]+)', 1)), html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html <> '' ORDER BY page_id").fetchall()
    plain = lambda x: re.sub(r"<(/?)(?:article|footer|nav)>", r"<\1div>", x).replace(' class="ad"', "")
    hosts = {k: [x for o, x in rows if o == k] for k, _ in rows}
    learned = {k: h.layouts([h.parse(plain(x)) for x in sorted(set(own))[:16]], 4) for k, own in hosts.items()}
    shared = [k for k, own in hosts.items() if len(set(own)) > 1]
    assert len(shared) > 20 and sum(bool(learned[k]) for k in shared) >= 0.9 * len(shared)
    pages = [(k, x) for k in shared if len(hosts[k]) > 5 for x in hosts[k]]
    good = sum(h.extract(plain(x), learned[k]) == re.sub(r"\s*\n\s*", "\n", h.extract(x)) for k, x in pages)
    assert good >= 0.95 * len(pages)


def test_two_layouts():
    one = "<body><div><p>Menu of one</p></div><div><h2>Head {i}</h2><p>Story {i} of the first kind, told at some length.</p></div></body>"
    two = "<body><table><tr><td>Top<td><p>Report {i}, which is quite another thing, and rather longer.</p></table><ul><li>x<li>y</ul></body>"
    learned = h.layouts([h.parse(x.format(i=i)) for i in range(6) for x in (one, two)], 4)
    assert len(learned) == 2
    assert h.extract(one.format(i=9), learned) == "Head 9\nStory 9 of the first kind, told at some length."
    assert h.extract(two.format(i=9), learned) == "Report 9, which is quite another thing, and rather longer."


def test_no_article_uses_wrapper_and_links():
    body = "<body><div class=top>Welcome to the daily paper</div><div><p>Story {i} is here.</p></div><div><a href=1>more</a> <a href=2>links</a></div><div>All rights kept</div></body>"
    pages = [h.parse(body.format(i=i)) for i in range(5)]
    assert h.extract(body.format(i=9), h.layouts(pages, 4)) == "Story 9 is here."


def test_tables(spark):
    rows = [(i, f"https://a.example/{i}", page(i), "x") for i in range(12)] + [(50, "https://b.example/1", page(1), "x"), (51, None, None, "x"), (52, "nonsense", "", "x")]
    rows += [(1, "https://a.example/1", page(1), "x"), (60, "https://a.example/60", "<p>" + "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    want = {i: "\n".join(w.format(i=i) for w in WANT if "{i}" in w) for i in range(12)}
    want |= {50: "\n".join(w.format(i=1) for w in WANT), 51: "", 52: "", 60: ("word " * 100_000).strip()}
    for limit in (h.BROADCAST_IDS, 0):
        h.BROADCAST_IDS, h.BROADCAST_CHARS = limit, limit
        got = h.main_texts(df.filter("page_id <> 60")).collect()
        assert len(got) == len(rows) - 1
        for r in got:
            assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert h.main_texts(df).filter("page_id = 60").first().n_chars == 499_999
    assert h.main_texts(df.limit(0)).count() == 0
