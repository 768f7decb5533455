"""Occurrence vectors, equivalence classes and nesting against a plain version on whole pages."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidelink.llm import html_extract as H


def make_pages(host, n, seed):
    rng = random.Random(seed)
    words = ["tide", "harbour", "signal", "lamp", "stone", "river", "glass", "north"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        paragraphs = "".join(f"<p>{prose(12)} {i}</p>" for _ in range(rng.randrange(1, 5)))
        shown = "<div>Read more soon</div>" if i % 20 else ""
        out.append(f"<html><body><div>Site {host}</div><div>All stories</div><ul><li>Menu</li><li>Menu</li></ul>"
                   f"<section><h1>{prose(3)}</h1>{paragraphs}</section>{shown}"
                   f"<div>Follow us</div><div>Imprint of {host}</div></body></html>")
    return out


def plain_template(sources):
    """Token numbers of a host's template, from full vectors over its distinct pages."""
    pages = [H.read_page(s) for s in dict.fromkeys(sources)]
    vectors, places, is_text = defaultdict(lambda: [0] * len(pages)), defaultdict(list), {}
    for i, nodes in enumerate(pages):
        for token, count in Counter(x.token for x in nodes if x.token).items():
            vectors[token][i] = count
            place, node = next((k, x) for k, x in enumerate(nodes) if x.token == token)
            places[token].append(place / len(nodes))
            is_text[token] = is_text.get(token, False) or bool(node.text and not node.text.isspace())
    classes = defaultdict(list)
    for token, vector in vectors.items():
        support = sum(v > 0 for v in vector)
        if support >= H.MIN_PAGES and support >= H.SUPPORT * len(pages):
            classes[tuple(vector)].append(token)
    mean = {t: sum(p) / len(p) for t, p in places.items()}
    valid = {v: t for v, t in classes.items() if len(t) >= H.MIN_CLASS}
    skeleton = [mean[t] for v, ts in valid.items() if max(v) == 1 for t in ts]
    low, high = (min(skeleton), max(skeleton)) if skeleton else (0.0, 1.0)
    inside = [t for ts in valid.values() if all(low - 1e-9 <= mean[x] <= high + 1e-9 for x in ts) for t in ts]
    return {t for t in inside if is_text[t]}


def found_templates(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    keyed = pages.withColumn("host", F.regexp_extract("url", "//([^/]*)", 1)).withColumn("page", F.xxhash64("page_id", "url"))
    return {r["host"]: set(r["constants"]) for r in H.deduce_templates(keyed).collect()}


def test_templates_equal_plain_version(spark):
    hosts = {"a.example": make_pages("a.example", 30, 1), "b.example": make_pages("b.example", 24, 2),
             "few.example": make_pages("few.example", 9, 3)}
    hosts["a.example"] += hosts["a.example"][:3] * 7  # copies of three pages
    rows = [(i, f"http://{h}/{i}", s) for h, sources in hosts.items() for i, s in enumerate(sources)]
    rows += [rows[0], rows[0], (900, "http://a.example/x", None), (901, "http://b.example/y", "")]
    got = found_templates(spark, rows)
    want = {h: t for h, t in ((h, plain_template([r[2] for r in rows if r[1].startswith(f"http://{h}/")])) for h in hosts) if t}
    assert got == want and set(got) == {"a.example", "b.example"} and all(len(t) >= 4 for t in got.values())


def test_copies_of_one_page_make_no_template(spark):
    source = make_pages("c.example", 1, 4)[0]
    rows = [(i, f"http://c.example/{i}", source) for i in range(40)]
    assert found_templates(spark, rows) == {}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r["text"] for r in H.extract(pages).collect()}
    text = texts.pop()
    assert not texts and source.split("<p>")[1].split("</p>")[0] in text
