import random
import re
import time
from collections import Counter

import pytest
from oracle import SF, connect, same_rows
from pyspark.sql import functions as F

from inkframe.llm import pages, urls
from inkframe.llm.queries import ORACLES, op9_url_filter

SCHEMA = "page_id long, url string, html string"
ARTICLE = "<article><h1>A &amp; B</h1><p>First <b>bold</b>\n  line<br>more<p>Second&nbsp;one &eacute; with a good deal of text in it.</article>"


def extract(spark, *htmls, host="x.org"):
    rows = [(k, None if host is None else f"http://{host}/{k}", h) for k, h in enumerate(htmls)]
    return [r.text for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


WANT = "A & B\n\nFirst bold line more\n\nSecond one é with a good deal of text in it."


@pytest.mark.parametrize(
    "html",
    [
        f"<html><body>{ARTICLE}</body></html>",
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>menu</a><li>x</ul></nav><!-- ad --><div class=ad>buy now</div>{ARTICLE}<footer>&copy; x</footer>",
        f"<body><header>site <b>name</b></header><aside>side bar words</aside>{ARTICLE}<section id='comments'><p>a reader says this and a lot more than that</p></section></body>",
        f"<body><div class='cookie-notice'>we use cookies</div><div id=main>{ARTICLE}</div><form><input value=x>your mail<button>go</button></form></body>",
        ARTICLE.replace("<article>", "<div class='post-body'>").replace("</article>", "<div class='comments'><p>nice one</p></div><div class='share-buttons'>share</div></div>"),
        ARTICLE.replace("</article>", "<script>if (a < b) x();</script><div class='newsletter'>sign up</div></article>"),
        ARTICLE.replace("</article>", ""),
    ],
)
def test_main_text(spark, html):
    assert extract(spark, html) == [WANT]


def test_odd_pages(spark):
    assert extract(spark, None, "", "just text &lt;here", "<p>", "<script>x") == ["", "", "just text <here", "", ""]
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    assert extract(spark, long, host=None) == ["\n\n".join(["word"] * 20000)]
    none = pages.main_text(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0


def test_host_votes_overrule_a_page(spark):
    usual = "<body><div class='left'><p>{}</p></div><div class='right'><p>{}</p></div></body>"
    htmls = [usual.format("the real story of this page " * 5, "x") for _ in range(5)] + [usual.format("short story", "some other long words " * 20)]
    assert extract(spark, *htmls)[-1] == "short story"
    assert extract(spark, htmls[-1])[0].startswith("some other")


def test_repeats_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "http://a/b", ARTICLE, "p", "h")] * 2 + [(2, None, ARTICLE, "p", "h")], SCHEMA + ", path string, host string")
    assert [(r.page_id, r.text, r.n_chars) for r in pages.main_text(rows).orderBy("page_id").collect()] == [(i, WANT, len(WANT)) for i in (1, 1, 2)]


def test_urls_equal_sql(spark):
    same_rows(op9_url_filter(spark, SF), connect(), ORACLES["op9_url_filter"])


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("HTTP://WWW.Example.ORG/es/x?y#z", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://notexample.org/es/x", "notexample.org", "/es/x", "org/", "allow"),
        ("http://org", "org", "", None, "allow"),
        ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
        ("http://a.com?x=/de/", "a.com", "", None, "allow"),
        ("x://y://example.org/es/", "y:", "//example.org/es/", None, "allow"),
        ("www.cheap-pills.example.net/", "", "", None, "allow"),
        ("http://www.cheap-pills.example.net/a", "www.cheap-pills.example.net", "/a", None, "block"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    rows = spark.createDataFrame([(1, url, "k")] * 2, "page_id long, url string, key string")
    assert [tuple(r) for r in urls.judge_by_rules(rows).collect()] == [(1, host, path, rule, verdict)] * 2


def test_bloom_passes_all_listed_and_the_join_removes_others(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".net/")).alias("key"), F.lit("block").alias("verdict"), F.lit(True).alias("named"))
    rows = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".net/x")).alias("url"))
    for most in (200_000, 10):
        found = urls.judge_urls(rows, listed, broadcast_keys=most)
        assert found.filter("verdict = 'block'").count() == 3000 and found.filter("(page_id < 3000) = (verdict = 'block')").count() == 6000
    assert urls.judge_urls(rows, listed.limit(0)).filter("verdict = 'allow'").count() == 6000
    assert urls.judge_by_rules(rows.limit(0)).count() == 0


def test_listed_hosts_fit_canonical_urls_and_come_from_a_table(spark):
    forms = ["http://cheap-pills.example.net", "http://cheap-pills.example.net?x", "HTTPS://www.cheap-pills.example.net:443/a", "http://cheap-pills.example.net.:80#x", "http://me@cheap-pills.example.net./"]
    others = ["http://cheap-pills.example.net:8080/", "http://org", "http://example.org.:80/es/", "http://cheap-pills.example.net.a/"]
    rows = spark.createDataFrame([*enumerate([*forms, *others]), (20, "http://m.cheap-pills.example.com/x"), (21, "http://spam-farm.example.org")], "page_id long, url string")
    blocked = lambda *more: {r.page_id for r in urls.judge_by_rules(rows, *more).collect() if r.verdict == "block"}
    assert blocked() == set(range(len(forms)))
    table = spark.createDataFrame([("cheap-pills.example.com/",), ("spam-farm.example.org/",)], "key string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_by_rules(rows, table).collect()}
    assert blocked(table) == {*range(len(forms)), 20, 21} and found[21] == ("spam-farm.example.org", "", None, "block") and len(found) == 11


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='site-content has-sidebar'>", "<div class='content no-sidebar'>", "<div class='post comments-open'>", "<div class='post-body legal'>", "<form id=aspnetForm>", "<div class='has-sidebar'>", "<header>"],
)
@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_wrappers_with_away_words_keep_their_text(spark, wrapper, tag):
    end = f"</{wrapper[1:].split()[0].strip('>')}>"
    body = ARTICLE.replace("article>", f"{tag}>")
    html = f"<body><nav>menu words</nav>{wrapper}{body}<div class='sidebar'>side</div>{end}<footer>foot</footer></body>"
    assert extract(spark, html) == [WANT]


def test_comments_stay_apart(spark):
    talk = "<p>a reader says this and a lot more than that</p>" * 30
    for html in (f"<body>{ARTICLE}<section id='comments'>{talk}</section></body>", f"<body>{ARTICLE}<div class='comments'><article>short</article></div></body>", f"<body><div class='content'>{ARTICLE}</div><div class='comment-body'>{talk}</div></body>"):
        assert extract(spark, html) == [WANT]


def test_siblings_of_the_winning_path_are_joined_and_other_templates_kept(spark):
    part = "<div class='post-body'><p>{}</p></div>"
    two = "<body><div class='wrap'>" + part.format("first part " * 9) + "<div class='ad'>buy</div>" + part.format("second part " * 5) + "</div></body>"
    want = "\n\n".join([("first part " * 9).strip(), ("second part " * 5).strip()])
    assert extract(spark, two, two, two) == [want] * 3
    usual = f"<body><div class='content'><p>{'the usual story ' * 20}</p></div></body>"
    other = f"<body><div class='content'><p>a short box</p></div><div class='story'><p>{'another template ' * 20}</p></div></body>"
    assert extract(spark, *[usual] * 4, other, other)[-1] == ("another template " * 20).strip()
    rest = f"<body><div class='box'><div class='content'><p>{'most of it ' * 16}</p></div><p>{'the rest of it ' * 4}</p></div></body>"
    assert extract(spark, rest) == [("most of it " * 16).strip() + "\n\n" + ("the rest of it " * 4).strip()]


@pytest.mark.parametrize(
    ("path", "want"),
    [("", "/"), ("/a/./b/../c", "/a/c"), ("/a/..", "/"), ("/../x/.", "/x/"), ("/%7Euser/%2f%zz%4", "/~user/%2F%zz%4"), ("/a%2Eb/%c3%a9", "/a.b/%C3%A9"), ("/x..y/.z", "/x..y/.z"), ("/%2e%2E/q", "/q"), ("/50%", "/50%")],
)
def test_canonical_paths(spark, path, want):
    assert spark.range(1).select(urls.canonical_path(F.lit(path)).alias("p")).first().p == want


def test_full_and_tiny_filters_judge_alike(spark, monkeypatch):
    listed = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit(".net/a")).alias("key"), F.lit("block").alias("verdict"), F.lit(False).alias("named"))
    rows = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.h"), "id", F.lit(".net:443/./ab")).alias("url"))
    found = sorted(map(tuple, urls.judge_urls(rows, listed).collect()))
    assert sum(r[-1] == "block" for r in found) == 500
    monkeypatch.setattr(urls, "FILTER_BYTES", 64)
    assert sorted(map(tuple, urls.judge_urls(rows, listed, broadcast_keys=3).collect())) == found


def test_entries_of_one_length_go_by_name(spark):
    listed = spark.createDataFrame([("b.org/x", "block", True), ("b.org/x", "allow", True), ("b.org/y", "allow", True)], "key string, verdict string, named boolean")
    rows = spark.createDataFrame([(1, "http://b.org/x"), (2, "http://b.org/y"), (2, "http://b.org/y")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(rows, listed).collect()) == [(1, "b.org/x", "block"), (2, "b.org/y", "allow"), (2, "b.org/y", "allow")]


@pytest.mark.parametrize(
    ("name", "html", "size"),
    [
        ("quotes", "<a " + '"' * 10_000, 10_003), ("both quotes", "<a " + "\"'" * 10_000 + "> x", 1), ("values never end", "<a b='" * 20_000 + ">t", 1), ("nested", "<div>" * 100_000 + "x", 1),
        ("nested and apart", "<div class=ad>" * 50_000 + "x" * 100, 100), ("inline", "<b>" * 50_000 + "<div>y</div>" * 20_000, 59_998), ("unmatched", "<div>" * 50_000 + "</p></i>" * 50_000, 0), ("no end", "<a " * 50_000, 149_999),
    ],
)
def test_broken_pages_take_linear_time(name, html, size):
    began = time.process_time()
    page = pages.Page(html)
    assert len(page.text(*page.chosen(None, frozenset()))) == size
    assert time.process_time() - began < 20


def tree(r, depth=0):
    """(tag, class, children), children being trees or words."""
    tag = r.choice(("div", "section", "div", "p")) if depth else "body"
    inner = [] if tag == "p" else [tree(r, depth + 1) for _ in range(r.randrange(0, 4))] if depth < 4 else []
    words = " ".join(r.choice(("stone", "river", "lamp")) for _ in range(r.randrange(0, 30)))
    return tag, r.choice(("", "a1", "b2", "c")), [*inner, words] if r.random() < 0.7 or not inner else inner


def written(node):
    tag, cls, inner = node
    return f"<{tag}{f' class={cls}' if cls else ''}>" + "".join(x if isinstance(x, str) else written(x) for x in inner) + f"</{tag}>"


def listed_nodes(node, path=(), depth=1):
    """(path, depth, text length, blocks) of the containers, in page order, and of what they hold."""
    tag, cls, inner = node
    path = (*path, tag + ("." + re.sub(r"\d+", "#", cls) if cls else ""))
    size, blocks, below = 0, [], []
    for x in inner:
        if isinstance(x, str):
            size, blocks = size + len(x), blocks + [x] * bool(x)
        else:
            own_size, own_blocks, own = listed_nodes(x, path, depth + 1)
            size, blocks, below = size + own_size, blocks + own_blocks, below + own
    return size, blocks, ([] if tag == "p" else [(path, depth, size, blocks)]) + below


def brute_best(nodes, total):
    nodes = [((), 0, total, None), *nodes]
    kept = Counter()
    for path, _, size, _ in nodes:
        kept[path] += size
    best, top = (), -1
    for path, depth, _, _ in nodes:
        score = kept[path] * (1 + 0.05 * min(depth, 10))
        if score > top:
            best, top = path, score
    for k in range(len(best) - 1, -1, -1):
        if kept[best] < 0.9 * kept[best[:k]]:
            best = best[:k]
    return best, kept, top


def test_votes_and_extraction_equal_brute_force(spark):
    r = random.Random(3)
    trees = [(k, f"h{k % 3}.org" if k % 9 else "", tree(r)) for k in range(60)]
    votes, seen, own = Counter(), Counter(), {}
    for k, host, t in trees:
        size, blocks, nodes = listed_nodes(t)
        best, kept, score = brute_best(nodes, size)
        own[k] = best, kept, nodes, blocks
        if host and score > 0:
            votes[host, best] += 1
            seen.update((host, p) for p, n in kept.items() if n)
    want = {}
    for k, host, _ in trees:
        best, kept, nodes, blocks = own[k]
        mine = [(p, v) for (h, p), v in votes.items() if h == host]
        most = max((v for _, v in mine), default=0)
        pages_of = sum(v for _, v in mine)
        aside = {p for p, v in mine if 2 * v < seen[host, p] and 10 * seen[host, p] >= pages_of}
        choices = [p for p, v in mine if v == most] or [best]  # ties go by the path's hash: any of them
        texts = set()
        for path in choices:
            taken = best if not kept[path] or kept[path] < pages.FAR * kept[best] and best not in aside else path
            texts.add("\n\n".join(blocks if not taken else [b for p, _, _, own_blocks in nodes if p == taken for b in own_blocks]))
        want[k] = texts
    rows = spark.createDataFrame([(k, f"http://{h}/{k}" if h else None, written(t)) for k, h, t in trees], SCHEMA)
    for row in pages.main_text(rows).collect():
        assert row.text in want[row.page_id], row.page_id


def test_tied_votes_give_one_path_for_a_host(spark):
    one, other = ("<body><div class={}><p>" + "words of it " * 9 + "</p></div></body>" for _ in range(2))
    htmls = [one.format("left"), other.format("right")] * 3
    rows = spark.createDataFrame([(k, "http://t.org/", h) for k, h in enumerate(htmls)], SCHEMA)
    first = pages.main_text(rows).orderBy("page_id").collect()
    assert first == pages.main_text(rows.repartition(5)).orderBy("page_id").collect() and {r.text for r in first} == {("words of it " * 9).strip()}
