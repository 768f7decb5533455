"""URL templates, HTML extraction and web archives on small pages."""

import base64
import hashlib

from tidelink.llm import html_extract as H
from tidelink.llm import url_templates as U
from tidelink.llm import web_archive as W

URLS = [(1, "http://A.example.NET/en/1?x=/de/"), (2, "https://example.com/de/2#t"), (3, None), (4, "no scheme"),
        (5, "http://sub.example.com/de"), (6, "http://other.org/fr/x/"), (7, "http://net/"), (8, "http://x.net"),
        (9, "http://badexample.net/en/"), (10, "http://example.com?de/"), (11, "ftp://h/a/b/c/d/e/f"), (1, "http://q.net/z")]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, _ in U.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_rules_equal_plain_reading(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in URLS], "page_id long, url string, host string")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "") for r in U.judge_urls(pages).collect())
    want = sorted((i, *(x or "" for x in plain_rule(u))) for i, u in URLS)
    assert got == want
    verdict = {r["rule"]: r["verdict"] for r in U.judge_urls(pages).collect() if r["rule"]}
    assert all(dict(U.RULES)[r] == v for r, v in verdict.items())


def test_method_blocks_templates_of_blocked_urls(spark):
    rows = [(i, f"http://example.com/de/post-{i}/") for i in range(30)]
    rows += [(100 + i, f"http://example.com/en/post-{i}/") for i in range(30)]
    rows += [(200 + i, f"http://shop.example.org/{w}/") for i, w in enumerate("abcdefghijklmnop")]
    got = {r["page_id"]: r for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[0]["template"] == "/de/post-{n}" and got[0]["purity"] > 0.9
    assert got[100]["verdict"] == "allow" and got[100]["template"].endswith("/post-{n}")
    assert {got[200 + i]["template"] for i in range(16)} == {"/*"}
    # A bare host is judged by its template alone.
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- <p>c</p> --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First
 line<br>second &eacute;<p>Third&nbsp;&lt;x&gt; <i>in</i>line</p><aside>Side</aside><form>F<input></form>
<div class="share-buttons">Share</div><p>By %s</p><section id="comments"><p>Reader</p></section></article>
<footer>Foot</footer></body></html>"""


def test_article_text():
    text = H.main_text(H.read_page(PAGE), frozenset())
    assert text == "Title & more\n\nFirst line second é\n\nThird <x> inline\n\nBy %s"
    assert H.main_text(H.read_page("<p>a &am"), frozenset()) == "a &am"
    for odd in ("", "<", "<<>", "</p>", "<p", "<!--", "<script>", "a<b", "<a href='x>y", "<p class=>x</p >", None):
        H.main_text(H.read_page(odd), frozenset())


def test_text_that_all_pages_share_stays_inside_the_article(spark):
    page = ("<html><body><article><h1>Story %d</h1><p>Our daily offer</p><p>Body text %d of page</p>"
            "<p>Read on tomorrow</p><p>Thanks for reading</p></article></body></html>")
    rows = [(i, f"http://h.org/{i}", page % (i, i)) for i in range(40)]
    rows += [(100, "http://few.org/1", page % (1, 1)), (101, None, None), (102, "http://h.org/x", ""),
             (5, "http://h.org/5", page % (5, 5))]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, constants string")
    got = {r["page_id"]: r for r in H.extract(frame.repartition(3)).collect()}
    assert got[3]["text"] == "Story 3\n\nOur daily offer\n\nBody text 3 of page\n\nRead on tomorrow\n\nThanks for reading" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"].count("\n\n") == 4
    assert (got[101]["text"], got[101]["n_chars"], got[102]["text"]) == ("", 0, "")
    assert H.extract(frame).count() == len(rows)
    assert H.extract(frame.limit(0)).collect() == []


def brute_archive(rows, min_bytes):
    def digest(p):
        return base64.b32encode(hashlib.sha1(p).digest()).decode()

    out, best = [], {}
    data = [(i, (h or "").encode()) for i, _, h in rows]
    for i, p in data:
        best[p] = max(best.get(p, i), i)
    for i, p in data:
        first = len(p) < min_bytes or best[p] == i
        out.append((i, len(p), digest(p), "response" if first else "revisit", None if first else best[p]))
    return sorted(out, key=str)


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 2_000)
    rows = [(i, f"http://h/{i} x", f"<p>{i % 7}</p>\r\n\r\nWARC/1.0\r\n" * (i % 4)) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://ü/\n", "é🙂\x00\n" * 400), (103, "http://h/103", "\n")]
    frame = spark.createDataFrame([(*r, b"x") for r in rows], "page_id long, url string, html string, payload binary")
    for least in (0, 20):
        back = W.round_trip(frame.repartition(3), least)
        got = back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(map(tuple, got), key=str) == brute_archive(rows, least)
        texts = {r["page_id"]: r["payload"] for r in back.collect() if r["record_type"] == "response"}
        assert all(texts[i] == (h or "").encode() for i, _, h in rows if i in texts)
    assert W.round_trip(frame.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "other"), (None, "u", "same")]
    got = W.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    same = [r for r in got if r["payload_bytes"] == 4]
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in same) == [(0, "revisit"), (1, "response"), (1, "revisit")]
    assert {r["refers_to"] for r in same if r["record_type"] == "revisit"} == {1}


def test_arc_versions_parse_alike():
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\nbody\n\nfiledesc://"
    for version in (1, 2):
        data = W.arc_filedesc(version, "a.arc") + W.arc_record(version, "http://x y/", block) + W.arc_record(version, None, b"")
        found = list(W.parse_arc(data))
        assert [(r["version"], r["url"], r["block"]) for r in found] == [(version, "http://x%20y/", block), (version, "-", b"")]
        assert data[found[0]["offset"]:].startswith(b"http://x%20y/")


def text_of(page, template=frozenset()):
    return H.main_text(H.read_page(page), template)


def test_classes_around_an_article_do_not_remove_it():
    for name in ("layout with-sidebar", "has-comments", "no-ads", "page sidebar", "content overflow-hidden"):
        assert text_of(f'<div class="{name}"><article><h1>A</h1><p>Body</p></article></div>') == "A\n\nBody", name
    assert text_of('<article><p class="teaser">Lead</p><p>Body</p></article>') == "Lead\n\nBody"
    page = '<article><p>Long body of the page</p></article><div class="sidebar"><article><p>Card %s</p></article></div>'
    assert text_of(page % "") == text_of(page % ("x" * 99)) == "Long body of the page"
    assert text_of('<div><p>A page without one</p></div><div class="comments"><article>Me</article></div>') == "A page without one"
    assert text_of('<article class="ad"><p>Buy all of this now</p></article><article><p>Body</p></article>') == "Body"


def test_region_is_chosen_by_its_text():
    body = "Body of the page. " * 5
    assert text_of(f"<main><h1>Title</h1><article><p>{body}</p></article></main>") == f"Title\n\n{body.strip()}"
    assert text_of(f"<main><h1>T</h1><p>{body}</p><article><p>Other story</p></article></main>") == f"T\n\n{body.strip()}"
    assert text_of(f"<article><p>{body}</p><article><p>I agree</p></article></article>") == body.strip()
    assert text_of(f"<article><p>{body}</p></article><article><p>{body}</p></article>") == "\n\n".join([body.strip()] * 2)
    # A template tells that the text outside the card is the page's own.
    page = f"<body><p>Banner</p><p>{body}</p><article><p>Card</p></article></body>"
    banner = frozenset(x.token for x in H.read_page(page) if x.text == "Banner")
    assert text_of(page, banner) == body.strip()


def test_broken_pages_take_linear_time():
    import time
    n = 50_000
    for page in ("<b>" * n + "</i>" * n, "<a " * n + '"', "<a '" * n + '"', "<div><p>" + "<b>" * n + "<address>" * n,
                 "<li><b>" * n, "<p><div>" * n, "<td><tr>" * n, "<!-- " * n, "</x" * n, "<article>" * n + "x"):
        start = time.time()
        text_of(page)
        assert time.time() - start < 4, page[:20]
