"""Text that all pages of a host share inside their articles is article text."""

from tidelink.llm import html_extract as H

ARTICLE = ("<html><body><nav><p>Menu</p></nav><p>Site banner</p><article><h1>One story</h1><p>First part</p><p>Second part</p>"
           "<p>Third part</p></article><footer>Foot</footer></body></html>")
WHOLE = "One story\n\nFirst part\n\nSecond part\n\nThird part"


def texts(spark, rows):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(frame.repartition(3)).collect()}


def test_copies_of_one_article_keep_their_text(spark):
    main = ARTICLE.replace("article>", "main>")
    bare = ARTICLE.replace("<article>", "").replace("</article>", "")
    rows = [(i, f"http://copies.org/{i}", ARTICLE) for i in range(12)]
    rows += [(100 + i, f"http://session.org/{i}", ARTICLE.replace("</article>", f"<p>Session {i}</p></article>")) for i in range(12)]
    rows += [(200 + i, f"http://main.org/{i}", main) for i in range(12)]
    rows += [(300 + i, f"http://bare.org/{i}", bare) for i in range(12)]
    got = texts(spark, rows)
    for i in range(12):
        assert got[i] == got[200 + i] == (WHOLE, len(WHOLE))
        assert got[100 + i][0] == WHOLE + f"\n\nSession {i}"
        assert got[300 + i][0] == "Site banner\n\n" + WHOLE


def test_common_headings_inside_stay_and_boilerplate_outside_goes(spark):
    page = "<body><p>Banner</p>%s<h2>Summary</h2><p>Text %d</p><h2>Sources</h2><p>Wire</p>%s<p>Imprint</p></body>"
    rows = [(i, f"http://news.org/{i}", page % ("<article>", i, "</article>")) for i in range(20)]
    rows += [(100 + i, f"http://plain.org/{i}", page % ("", i, "")) for i in range(20)]
    got = texts(spark, rows)
    assert got[3][0] == "Summary\n\nText 3\n\nSources\n\nWire"
    assert got[103][0] == "Text 3"  # no article element: the template alone tells slots apart
