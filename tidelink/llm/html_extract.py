"""HTML extraction by equivalence-class template deduction.

Pages of one host share a template.  Every page is read as a sequence of
tokens: tags and text nodes, each told apart by the path of elements it
stands in.  Tokens of a host whose occurrence vectors (how often in each page)
are equal form an equivalence class.  A class is valid if it is frequent
(in at least ``SUPPORT`` of the host's pages, and the host has ``MIN_PAGES``)
and has several tokens; valid classes are ordered by mean place and nested by
span to the host's template.  In a page, text between template tokens fills
slots: the slots' text is kept, constant text of the template is not.

Every article and main element is a region, all text outside them one more.
The slots tell which region holds the page's own text: the one with most slot
text is chosen, an article before the rest unless the rest's slots hold
``REST`` times all its text (a page with teaser cards only).  The chosen
region is a slot as a whole: its text is kept even where all pages of the host
share it (copies of one article, repeated headings).  With it go regions beside
it with at least half its text, an article in the main element likewise, and
the slots that the elements around it hold before it (a title).  An article in
an article is a reader comment or a card, unless it holds most text itself.
Elements that HTML, an ARIA role or a class or id name marks as menu, header,
footer, sidebar, notice, advert, form, comment, script or style are left out;
a class that marks an element around an article (``layout with-sidebar``) only
makes that article second to unmarked regions.

Occurrence vectors are never gathered: a page adds (count, place, xor of a
hash of page and count) for each token, which Spark sums per (host, token) -
partially before the shuffle, so one host with a third of all pages is a few
rows.  Equal pages of a host count as one.  Templates (tokens in nearly all pages of a host, so no more than one
page has) meet their pages in one join; the pages' side is only shuffled where
the templates are too large to broadcast by Spark's own size check.

Defined results: null html is an empty page; a page without article text gives
an empty text and 0; a page without text in an article or main element that holds nothing
but constant text is judged by its elements alone; repeated rows are extracted each; hosts with few pages
have no template and are judged by their elements alone; a null url is host
''; broken markup is read as far as it goes; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_codec
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelink.llm.common import materialise
from tidelink.llm.jaccard_join import BITMAP_BITS, _bitmap
from tidelink.llm.url_templates import host_and_path

SUPPORT = 0.9
MIN_PAGES = 10
MIN_CLASS = 3            # tokens of a valid class
REST = 4

_SCAN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)[^>]*+(?:>|\Z)|([^<]+|<)""",
    re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements that break a text into blocks.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table
    tbody td tfoot th thead tr ul""".split())
#: Elements that are never article text.
OUTSIDE = frozenset("""nav footer aside form button select option datalist label input script style textarea title head
    noscript iframe template svg math canvas object audio video dialog menu""".split())
#: Words of class or id names that mark other parts of a page.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar sidebar aside widget widgets footer
    masthead topbar cookie cookies consent gdpr notice notices alert disclaimer copyright legal popup modal overlay
    newsletter subscribe subscription signup login search comment comments commentlist reply replies respond disqus
    discussion share sharing social related recommended recommendations teaser outbrain taboola form hidden""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Start tags that end an open element of the listed kinds.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements that an implied end does not cross.
SCOPE = frozenset("ul ol dl table article section main div body html td th".split())


#: Elements whose number of open ones decides implied ends, as bits.
BIT = {tag: 1 << i for i, tag in enumerate(sorted({"p"}.union(*IMPLIED.values())))}
#: First words that make a class name tell of another element.
ABOUT = frozenset("with without has have no non not is".split())
#: Marks that name a part of an article inside one, or nothing outside a whole name.
LEAD, WHOLE = frozenset(("teaser",)), frozenset(("hidden",))


def _marked(tag: str, value: str, in_article: bool) -> bool:
    """Whether a class or id value names another part of a page."""
    if tag in ("html", "body"):
        return False
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not words or words[0] in ABOUT and len(words) > 1:
            continue
        found = MARKS.intersection(words) - (LEAD if in_article else frozenset())
        if found - WHOLE or found and len(words) == 1:
            return True
    return False


def _left_out(tag: str, attrs: str, in_article: bool) -> int:
    """2 for an element that is never article text, 1 for one that only its class or id marks so, else 0."""
    if tag in OUTSIDE or (tag == "header" and not in_article):
        return 2
    if not attrs.strip():
        return 0
    out = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if _marked(tag, value, in_article):
                out = 1
        elif name == "role":
            if value in ROLES:
                return 2
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return out


class Region:
    """An article or main element: the region around it, and whether a class marks an element around it."""

    __slots__ = ("around", "article", "marked")

    def __init__(self, around: Region | None, article: bool, marked: bool):
        self.around, self.article, self.marked = around, article, marked


class Node:
    """A text node or tag in page order."""

    __slots__ = ("token", "text", "block", "region", "kept")

    def __init__(self, token: int, text: str | None, block: bool, region: Region | None, kept: bool):
        self.token, self.text, self.block, self.region, self.kept = token, text, block, region, kept


def _token(path: int, value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"), path) - (1 << 63)


def read_page(source: str | None) -> list[Node]:
    """Tokens of a page, in time linear in its length however its markup is broken."""
    out: list[Node] = []
    if not source:
        return out
    # tag, and what holds around it: path, region, left out (0 to 2), bits of BIT open in its scope
    stack: list[tuple[str, int, Region | None, int, int]] = []
    opened: Counter[str] = Counter()
    path, region, left, bits = 0, None, 0, 0
    at, n = 0, len(source)

    def close(to: int) -> None:
        nonlocal path, region, left, bits
        _, path, region, left, bits = stack[to]
        for entry in stack[to:]:
            opened[entry[0]] -= 1
        del stack[to:]

    def close_first(ends: frozenset[str] | set[str]) -> None:
        """Close the innermost open element of ``ends`` within the scope, if ``bits`` tells of one."""
        if any(bits & BIT[tag] for tag in ends):
            close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends))

    while at < n:
        m = _SCAN.match(source, at)
        if not m:
            break
        at = m.end()
        if m[4] is not None:
            text = " ".join(html_codec.unescape(m[4]).split())
            spaced = m[4][0].isspace() * " " + text + (" " if text and m[4][-1].isspace() else "")
            if text:
                out.append(Node(_token(path, text), spaced, False, region, not left))
            elif out:
                out.append(Node(0, " ", False, region, not left))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.append(Node(_token(path, "/" + tag), None, tag in BLOCK, region, not left))
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        if tag in BLOCK:  # a block ends an open paragraph
            close_first({"p"})
        close_first(IMPLIED.get(tag, frozenset()))
        out.append(Node(_token(path, tag), " " if tag == "br" else None, tag in BLOCK, region, not left))
        attrs = m[3] or ""
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK | RAW:
            continue
        stack.append((tag, path, region, left, bits))
        opened[tag] += 1
        bits = BIT.get(tag, 0) | (0 if tag in SCOPE else bits)
        own = _left_out(tag, attrs, region is not None and region.article)
        if tag == "article" or tag == "main" or re.search(r"""\brole\s*=\s*["']?main\b""", attrs):
            # A class around a region does not remove it; one of its own does.
            region = Region(region, tag == "article", left == 1 or region is not None and region.marked)
            left = 2 if left == 2 else own
        else:
            left = max(left, own)
        path = xxhash.xxh3_64_intdigest(tag.encode(), path)
        if tag in RAW:
            stop = re.compile(r"</" + re.escape(tag) + r"(?=[\s/>])", re.I).search(source, at)
            at = stop.start() if stop else n
    return out


def _chosen(nodes: list[Node], template: frozenset[int]) -> tuple[set[Region], Region | None]:
    """The regions whose text is kept whole, and the first of them by size; none where the rest is the page's text."""
    sizes: dict[Region | None, list[int]] = {None: [0, 0]}  # slot text, all text
    for x in nodes:
        if x.kept and x.text and x.token:
            size = sizes.setdefault(x.region, [0, 0])
            length = len(x.text.strip())
            size[0] += length * (x.token not in template)
            size[1] += length
    rest = sizes.pop(None)[0]
    plain = [r for r in sizes if not r.marked]
    found = plain or [r for r in sizes if sizes[r][0] >= rest]  # ties: the first in the page
    if not found:
        return set(), None
    best = max(found, key=lambda r: sizes[r])
    if template and rest >= REST * sizes[best][1]:
        return set(), None

    def beside(r: Region) -> bool:
        return (2 * sizes[r][1] >= sizes[best][1]
                and (r.around is best.around or r.around is best and not best.article))

    return {best, *(r for r in found if beside(r))}, best


def main_text(nodes: list[Node], template: frozenset[int]) -> str:
    """Text of the chosen regions, or of the template's slots in a page without one: blocks joined by a blank line."""
    whole, best = _chosen(nodes, template)
    around = set()
    outer = best.around if best else None
    while outer is not None:
        around.add(outer)
        outer = outer.around
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    before = True
    for x in nodes:
        if x.block:
            flush()
        if x.text is None or not x.kept:
            continue
        if x.region in whole:
            before = before and x.region is not best
            held.append(x.text)
        elif (x.region in around and before or not whole and x.region is None) and x.token not in template:
            held.append(x.text)
    flush()
    if template and not blocks:  # no slot is filled: the page tells nothing apart
        return main_text(nodes, frozenset())
    return "\n\n".join(blocks)


def _token_counts(pages: DataFrame) -> DataFrame:
    """``host, token, pages, total, places, vector, is_text``, summed for each batch of pages."""

    def run(batches):
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, page, source in zip(*(c.to_pylist() for c in batch.columns)):
                counts: dict[int, int] = {}
                first: dict[int, tuple[int, bool]] = {}
                nodes = read_page(source)
                for place, x in enumerate(nodes):
                    if x.token:
                        counts[x.token] = counts.get(x.token, 0) + 1
                        first.setdefault(x.token, (place, bool(x.text and not x.text.isspace())))
                for token, count in counts.items():
                    place, is_text = first[token]
                    row = sums.setdefault((host, token), [0, 0, 0.0, 0, is_text])
                    row[0] += 1
                    row[1] += count
                    row[2] += place / len(nodes)
                    row[3] ^= xxhash.xxh3_64_intdigest(b"%d/%d" % (page, count))
            values = list(sums.values())
            signed = np.array([v[3] for v in values], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in sums], pa.string()), pa.array([t for _, t in sums], pa.int64()),
                 pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()),
                 pa.array([v[2] for v in values], pa.float64()), pa.array(signed, pa.int64()),
                 pa.array([v[4] for v in values], pa.bool_())],
                names=["host", "token", "pages", "total", "places", "vector", "is_text"])

    found = pages.select("host", "page", "html").mapInArrow(
        run, "host string, token long, pages long, total long, places double, vector long, is_text boolean")
    return found.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("places").alias("places"),
        F.bit_xor("vector").alias("vector"), F.max("is_text").alias("is_text"))


def _template(pdf: pd.DataFrame) -> pd.DataFrame:
    """One host's template from its frequent tokens: valid classes, ordered and nested.

    The classes with one token per page make the skeleton, ordered by mean
    place; a class is nested if its span lies in the skeleton's, and only
    nested classes belong to the template.
    """
    pdf = pdf.assign(place=pdf["places"] / pdf["pages"]).sort_values(["place", "token"], kind="stable")
    groups = pdf.groupby(["vector", "pages", "total"], sort=False)
    spans = groups["place"].agg(["min", "max", "size"]).reset_index()
    valid = spans[spans["size"] >= MIN_CLASS]
    tokens: list[int] = []
    if len(valid):
        skeleton = valid[valid["total"] == valid["pages"]]
        low, high = (skeleton["min"].min(), skeleton["max"].max()) if len(skeleton) else (0.0, 1.0)
        nested = valid[(valid["min"] >= low) & (valid["max"] <= high)]
        member = pdf.merge(nested[["vector", "pages", "total"]], on=["vector", "pages", "total"])
        tokens = member.loc[member["is_text"], "token"].astype(int).tolist()
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "constants": [tokens]})


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``host, page, html`` with one row of every host's equal pages: copies of a page support no class.

    Contents are counted by hash.  A fixed-size bitmap of those met more than
    once lets all other pages past the shuffle; the rest, and the few whose bit
    is set by chance, lose their copies in an aggregation that begins before it.
    """
    marked = pages.select("host", "page", "html", F.xxhash64("host", "html").alias("doc_id"))
    repeated = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    table = pages.sparkSession.sparkContext.broadcast(_bitmap(repeated))

    @F.pandas_udf("boolean")
    def listed(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy(dtype=np.int64)
        words = np.frombuffer(table.value, dtype=np.uint32)
        return pd.Series(((words[at // 32] >> (at % 32).astype(np.uint32)) & np.uint32(1)).astype(bool))

    marked = marked.withColumn("listed", listed(F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))))
    out = ["host", "page", "html"]
    return marked.filter("not listed").select(*out).unionByName(
        marked.filter("listed").dropDuplicates(["host", "doc_id"]).select(*out))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """``host, constants``: token numbers of the text that a host's template holds."""
    pages = distinct_pages(pages)
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = (_token_counts(pages).filter(F.col("pages") >= MIN_PAGES).join(hosts, "host")
                .filter(F.col("pages") >= F.col("host_pages") * SUPPORT)
                .select("host", "token", "pages", "total", "places", "vector", "is_text"))
    return frequent.groupBy("host").applyInPandas(_template, "host string, constants array<long>").filter(
        F.size("constants") > 0)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    keyed = rows.withColumn("host", host_and_path(F.col("url"))[0]).withColumn(
        "page", F.xxhash64("page_id", "url"))
    templates = materialise(deduce_templates(keyed), "html-templates")
    joined = keyed.join(templates, "host", "left").select("page_id", "url", "html", "constants")
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(read_page(source), frozenset(constants or ()))
                     for source, constants in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
