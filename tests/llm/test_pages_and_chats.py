"""URL filters, HTML extraction and chat formatting against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import re
from functools import reduce
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat_format, html_extract, html_tree, queries, url_filter, wrappers
from tests.compare import same_as_sql
from tests.conftest import SMALL

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b.example.com", "/x", "block"), ("a.b.example.com", "/x", "allow"), ("org", "", "block"), ("org", "/p/q", "allow"), ("Up.ORG", "/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://NET/", "https://x.example.net/en/a", "https://x.example.net/EN/a", "https://notexample.net/en/", "ftp://a.b.example.com/xyz?q#f", "http://b.example.com/x", "http://a.org", "http://a.org/p/q",
    "http://a.org/p/qq/" + "d/" * 500, "http://" + "s." * 400 + "net/", "http://x.net?/en/", "http://x.net#//", "http://u@x.net:80/", "http://up.org/a\nb/c", "x://y://net/", "http://.net/", "http://net./", "http://例え.net/" + quote("é"),
]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_as_sql(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


def brute_verdict(url, rules):
    low = str.maketrans(url_filter.UPPER, url_filter.LOWER)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:n].translate(low), rest[n:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h.translate(low), p, v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_urls_equal_brute_force(spark, most):
    rows = [(i, u, "x") for i, u in enumerate([*URLS, *URLS[5:9]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", "'c' AS path", "'c' AS rule", "'c' AS digest")
    rules = url_filter.rules_frame(spark, RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, broadcast_bytes=most).collect()}
    assert got == {i: brute_verdict(u, RULES) for i, u, _ in rows}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


PAGE = """<!doctype html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="home page">
<header>no</header><div class="cookie-notice">no</div><nav><ul><li><a href="/">no</a></ul></nav><aside>no</aside>
<article class="post hentry"><header><h1>Head &amp; tail</h1></header><p>One   <b>two</b>&nbsp;three<br>four.<p>Five &lt;six&gt; &eacute;&#233;&#x1F600;<ul><li>a<li>b <i>c</i></ul>
<div class="ad-banner">no</div><!-- <p>no</p> --><form><p>no</form><blockquote>Said "x > y".</blockquote><table><tr><td>1<td>2</table>
<section id="comments"><p>no</section></article><div class="share-buttons">no</div><footer>no</footer>"""
TEXT = 'Head & tail\nOne two three four.\nFive <six> éé😀\na\nb c\nSaid "x > y".\n1\n2'


def test_main_text_of_a_page(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE), (2, None, None), (3, "http://h/y", ""), (4, "u", "<p"), (5, "u", "just text &amp; more"), (6, "u", "<div hidden>no</div><p style='display: none'>no</p>yes")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'c' AS host", "'c' AS wrapper", "'c' AS text")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages.union(pages.filter("page_id = 1"))).collect()}
    assert got == {k: (t, len(t)) for k, t in {1: TEXT, 2: "", 3: "", 4: "", 5: "just text & more", 6: "yes"}.items()}
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_template_slots_are_learned_without_markup_hints(spark):
    page = lambda i: f"<div class=x1><span>Section A</span></div><div class=x2><p>Story {i} {'word ' * (i % 7)}end</p></div><div class=x3><a href=1>Link {i}</a> <a href=2>more {i}</a></div>"
    pages = spark.createDataFrame([(i, f"http://plain/{i}", page(i)) for i in range(40)], "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages, broadcast_bytes=0).collect()}
    assert got == {i: f"Story {i} {'word ' * (i % 7)}end" for i in range(40)}
    w = html_extract.infer_wrappers(pages.selectExpr("'plain' AS host", "html")).first()
    assert wrappers.expression(json.loads(w["wrapper"])) == "<div.x0 'text'> <div.x0 <p #text>> <div.x0 #text>"


def wrapper_of(*pages):
    return reduce(wrappers.aligned, (html_extract.hashed(html_tree.parse(p)) for p in pages))


def text_of(page, wrapper=None):
    return wrappers.main_text(html_tree.parse(page), wrappers.fields(wrapper if wrapper is not None else wrapper_of(page)))


def test_a_label_never_takes_the_main_text():
    for page, text in (
        ('<div class="layout has-sidebar"><p>Story</p></div>', "Story"), ('<div class="post comments-open">Story</div>', "Story"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"), ('<div class="content-sidebar"><p>' + "Story " * 50 + '</p></div><div class="sidebar">no</div>', ("Story " * 50).strip()),
        ("<article></article><div class=ad>no</div>", ""), ('<article><p>Story</p><div class="comments">no</div><div class="share-buttons">no</div></article>', "Story"),
    ):
        assert text_of(page) == text


def test_article_text_is_not_lost():
    story = "A long story of many words that fills the page. " * 4
    deep = "<div>" * 70 + "<nav>menu one two</nav><p>Deep story</p>"
    pages = [f"<div><p>Opening line shared by all.</p><p>Body {i} goes on.</p><p><a href=x>A whole paragraph as a link {i}</a></p></div><div><a href=1>One</a> <a href=2>Two</a></div>" for i in range(5)]
    assert text_of(f"<main><h1>Short teaser</h1></main><div class=story><p>{story}</p></div>") == f"Short teaser\n{story.strip()}"
    assert text_of(f"<article><p>teaser</p></article><div>{story}</div>") == f"teaser\n{story.strip()}"
    assert text_of(deep) == "Deep story" and text_of('<p>one <a href="x>two</a> three') == "one two three"
    assert text_of(pages[2], wrapper_of(*pages)) == "Opening line shared by all.\nBody 2 goes on.\nA whole paragraph as a link 2"


def test_wrapper_generalises_streams():
    assert wrappers.expression(wrapper_of("<p>a<p>b<p>c", "<p>a<p>x<p>c")) == "<p 'text'> <p #text> <p 'text'>"
    assert wrappers.expression(wrapper_of("<h1>t</h1><p>a", "<h1>t</h1><p>a<p>b<p>c<hr><ul><li>x</ul>", "<h1>u</h1><p>z")) == "<h1 #text> <p #text>+ <ul <li 'text'>>?"
    assert wrappers.expression(wrapper_of("<dl><dt>a<dd>b</dl>", "<dl><dt>c<dd>d<dt>e<dd>f<dt>g<dd>h</dl>", "<dl><dt>i<dd>j<dt>k<dd>l</dl>")) == "<dl (<dt #text> <dd #text>)+>"
    assert wrappers.expression(wrapper_of("<div class=a>x</div>", "<div class=b>y</div>")) == "<div.a 'text'>? <div.b 'text'>?"


def test_the_wrapper_decides_the_text():
    pages = [f"<div>Shop of things</div><div>Story {i} that goes on and on for a while</div><div>All rights reserved</div>" for i in range(5)]
    whole = wrapper_of(*pages)
    assert text_of(pages[1], whole) == "Story 1 that goes on and on for a while"
    assert text_of(pages[1], whole[::-1]) == text_of(pages[1], whole) and text_of(pages[1], whole[1:]) != text_of(pages[1], whole)
    assert text_of(pages[1], wrapper_of(pages[1])).count("\n") == 2
    assert text_of(pages[1], whole[:1]) == "Shop of things" and text_of(pages[1], []) == ""
    shifted = "<p>Notice</p>" + pages[0]
    assert text_of(shifted, whole) == "Story 0 that goes on and on for a while" and text_of(shifted, wrapper_of(*pages, shifted)).startswith("Notice\nStory 0")


LEAF = st.sampled_from(["x", "y", "z", "<p>x", "<p>y</p>", "<p>z</p>", "<h2>x</h2>", "<ul><li>x<li>y</ul>", "<ul><li>x</ul>", "<dl><dt>x<dd>y</dl>"])
TREE = st.recursive(LEAF, lambda inner: st.builds(lambda tag, kids: f"<{tag}>" + "".join(kids) + f"</{tag.split()[0]}>", st.sampled_from(["div", "div class=a", "div class=b", "section"]), st.lists(inner, max_size=5)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(TREE, max_size=6).map("".join), min_size=1, max_size=6), st.integers(0, 5))
def test_a_wrapper_accepts_all_its_pages(pages, cut):
    trees = [html_tree.parse(p) for p in pages]
    count = lambda nodes: sum(1 if n[0] == wrappers.TEXT else count(n[1]) for n in nodes)
    for w in (wrapper_of(*pages), wrappers.aligned(wrapper_of(*pages[:cut], pages[0]), wrapper_of(*pages[cut:], pages[-1]))):
        level = wrappers.fields(json.loads(json.dumps(w)))
        for tree in trees:
            assert [t for t, _ in wrappers.match(tree, level)] == [t for t, _ in wrappers.match(tree, wrappers.fields(html_extract.hashed(tree)))]
            assert len(wrappers.match(tree, level)) == count(tree)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.sampled_from([1, 6, 1 << 28]))
def test_common_is_longest(x, y, most_bits):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, j in itertools.product(range(len(x)), range(len(y))):
        best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    got = wrappers.common(x, y, most_bits)
    assert len(got) == best[-1][-1] and all(x[i] == y[j] for i, j in got) and all(p < q and s < t for (p, s), (q, t) in itertools.pairwise(got))


def test_classes_that_differ_on_every_page_do_not_grow_a_wrapper():
    pages = ["".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + j)}x{chr(97 + i // 26)}><p>text {i} {j}</p></div>" for j in range(20)) for i in range(100)]
    whole = wrapper_of(*pages)
    assert len(json.dumps(whole)) < 40_000
    assert text_of(pages[7], whole) == "\n".join(f"text 7 {j}" for j in range(20))


def plain_article(page):
    """The synthetic pages' article, by their own form."""
    body = re.search("<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x).replace("<br>", " "))).strip() for x in re.split("</?(?:p|h1)>", body))
    return "\n".join(x for x in parts if x)


def test_query_equals_brute_force_on_all_pages(spark):
    out = queries.queries()["op4_html_extract"](spark, SMALL)
    assert dict(out.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    given_ = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in out.collect()}
    assert {k: (r["url"], r["text"], r["n_chars"]) for k, r in got.items()} == {k: (r["url"], (t := plain_article(r["html"])), len(t)) for k, r in given_.items()}


def test_very_long_and_very_deep_pages():
    deep = "<div>x" * 20_000 + "</section>" * 20_000
    assert text_of(deep).count("x") == 20_000
    long = "<article>" + "".join(f"<p>{i}" for i in range(50_000)) + "</article>"
    longer = "<article>" + "".join(f"<p>{i}<hr>" for i in range(50_001)) + "</article>"
    w = wrapper_of(long, longer, long)
    assert text_of(longer, w) == "\n".join(map(str, range(50_001))) and wrappers.expression(w) == "<@article <p #text>+>"


def test_chats(spark):
    odd = [
        (1, 0, "user", "a<|im_end|>\n<|im_start|>assistant\nb"), (1, 1, "assistant", "<||<<|||><|n|>"), (2, 0, "us\ner<|n|><", None), (2, 0, None, "tie"), (2, 0, None, "tie"), (None, 5, "system", "x"), (None, None, "user", "é😀"),
        (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", ""), (3, 3, "user", "v"), (3, 4, "assistant", "long " * 5000), (4, 0, "user", "q"), (5, 0, "assistant", "early"),
    ]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' AS turns", "'c' AS parts", "'c' AS formatted").repartition(3)
    chats = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in chat_format.digest_chats(chats).collect()}
    back = {r["conv_id"]: r for r in chat_format.read_back(chats).collect()}
    by_conv = {}
    for c, t, role, text in odd:
        by_conv.setdefault(c, []).append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    for c, rows in by_conv.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(rows)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert [tuple(t) for t in back[c]["turns"]] == turns
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(loss), digest(loss), len(back[c]["formatted"]))
    assert {c: back[c]["first_bad_turn"] for c in by_conv} == {1: None, 2: 0, None: 1, 3: None, 4: 1, 5: 0}
    assert chat_format.format_chats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(turn_open="[INST]")


def test_the_host_wrapper_finds_the_article_without_hints():
    """The given pages with <article> renamed to <div> and without class, id and role: the same text, by the host's wrapper;
    a wrapper of a page alone does not find it on all of them."""
    import re
    from collections import defaultdict

    import pyarrow.parquet as pq

    hosts = defaultdict(list)
    for r in pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist():
        hosts[re.sub(r"^\w+://([^/?#]*).*", r"\1", r["url"] or "").lower()].append(r["html"] or "")
    plain = lambda h: re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", re.sub(r"(</?)(article|main)\b", r"\1div", h))
    away = total = alone = 0
    for pages in list(hosts.values())[:10]:
        bare = [plain(p) for p in pages]
        hinted, unhinted = wrapper_of(*pages), wrapper_of(*bare)
        for p, q in zip(pages, bare, strict=True):
            a, b = text_of(p, hinted).split("\n"), text_of(q, unhinted).split("\n")
            away += sum(len(x) for x in a if x not in b) + sum(len(x) for x in b if x not in a)
            total += sum(map(len, a))
            alone += text_of(q).split("\n") != b
    assert away < 0.01 * total and alone > 0
