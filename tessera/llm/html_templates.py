"""Main text of web pages by equivalence-class template deduction.

Pass 1 turns each page into tokens: block elements, told apart by their path
(tags with their id and class words), and texts of blocks, told apart by their
element's path and by how many times the page had them before. For every host
and token the occurrence vector over the host's pages is summed into a
signature; tokens with equal signatures form an equivalence class. A class is
valid if it is frequent (``SUPPORT`` of the host's pages), has several members
and each occurs once on a page that has it. Members nest by their paths; the
valid classes' elements are the host's frame, and their texts its constant
text, whatever their names say. The slot that holds the article is chosen: by
meaning (article, main, content names; these may repeat on a page) if that
holds most of the host's text, else the deepest member that does.

Pass 2 reads that slot on each page: the text of its blocks without the host's
constant text and without parts that are menus, headers, footers, side bars,
notices, adverts, forms, comments, scripts or styles by their element or by a
class, id or role. A name alone removes nothing that holds most of a page's text,
unless the page has an article beside it; names of layouts (``has-sidebar``,
``sidebar-right-layout``) say nothing, and inside an article a name must be of
such words only. A slot with a meaning is all elements of that meaning that
aren't nested in each other. Pages of hosts without a template (too few
pages), or without the chosen token, fall back on the same choice within the
page.

Less than the whole method: the order of a class's members is not compared,
and varying text of a nested member (a heading, a byline) stays with the slot.
If constant text is most of a host's text (``MOST_TEXT``: its pages are copies
of each other), it stays.

Host statistics are sums with partial aggregation; a host's template is one
row of its slot and its constant texts, so hot hosts cost no more than others, and pages are only shuffled if the
templates don't fit a broadcast (``BROADCAST_HOSTS``).

Defined results: null and empty pages give an empty text; pages without tags
are one block; a null or odd address belongs to no host; rows are kept one to
one, repeated rows each count in their host's statistics; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A class is frequent if it occurs on this share of the host's pages, and on LEAST pages.
SUPPORT, LEAST_PAGES, LEAST_TOKENS = 0.5, 3, 3
#: The slot chosen without meaning holds at least this share of the host's text.
MOST_TEXT = 0.7
#: A meaning counts if its elements hold at least this share of the text.
MEANT_TEXT = 0.5
#: Template rows and constant texts that may be broadcast; with more pages are joined by a shuffle.
BROADCAST_HOSTS = 200_000

# --- fixed values of HTML ------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe noframes noembed xmp".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby
s samp small span strike strong sub sup time tt u var wbr""".split())
#: A start tag of the first kind closes an open element of the second.
CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
          "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Elements across which a start tag closes nothing.
SCOPE = frozenset("article section main div table ul ol dl body html nav aside header footer form blockquote td th select".split())

# --- what a part of a page is ---------------------------------------------------

BOILERPLATE_TAGS = frozenset("nav aside footer form script style noscript template iframe button select dialog svg object head menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar side
aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus respond replies reply share sharing social
related recommended recommendations pagination pager widget toolbar masthead topbar skip""".split())
ARTICLE_WORDS = frozenset("article content post entry story main body text articlebody maincontent".split())
#: A class with one of these is about the layout of what it encloses.
LAYOUT_WORDS = frozenset("has no not with without layout".split())
#: Words that may stand beside boilerplate words in the name of a boilerplate part.
NEUTRAL_WORDS = frozenset("""area bar block body bottom box button buttons center col column container content footer form global group head
header heading icon icons inner item items js left link links list main node outer page panel post posts article articles right row
section site small story stories text title top ui unit wrap wrapper""".split())
#: A part that its name calls boilerplate is kept if it holds this share of the page's text.
TOO_MUCH = 0.5

#: What stands for the meaning of a text token.
TEXT = -1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip("/ \t\r\n") else {}


def _words(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each class and of the id."""
    said = " ".join(attributes.get(k, "") for k in ("class", "id")).split()
    return [w for w in ([x for x in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()) if x] for name in said) if w]


#: Why an element is outside: its kind, or only what it is called.
KIND, NAME = 2, 1


class Element:
    """An open block element: its token, the token's path, what it means, whether it is
    inside an article, and whether it or an ancestor is boilerplate (known when the page is read)."""

    __slots__ = ("tag", "token", "path", "depth", "meaning", "outside", "start", "end", "parent", "why", "article")

    def __init__(self, tag, parent, attributes, start):
        names = _words(attributes)
        words = {w for name in names for w in name}
        self.tag, self.start, self.end, self.parent = tag, start, start, parent
        self.token = ".".join([tag, *sorted(words)])
        self.depth = parent.depth + 1 if parent else 0
        self.path = xxhash.xxh3_64_intdigest(self.token, seed=parent.path if parent else 0)
        role = attributes.get("role", "").lower()
        inside = bool(parent and parent.article)
        self.why = 0
        if tag in BOILERPLATE_TAGS and tag != "form" or role in BOILERPLATE_ROLES and role != "form" or tag == "header" and not inside:
            self.why = KIND
        elif tag == "form" or role == "form" or tag not in ("body", "html", "main", "article") and any(
                not BOILERPLATE_WORDS.isdisjoint(name) and LAYOUT_WORDS.isdisjoint(name)
                and not (inside and set(name) - BOILERPLATE_WORDS - NEUTRAL_WORDS) for name in names):
            self.why = NAME
        self.meaning = 0 if self.why == KIND else 3 if tag == "article" else 2 if (
            tag == "main" or role == "main" or "articlebody" in attributes.get("itemprop", "").lower()) else 1 if (
            tag in ("div", "section", "td") and not ARTICLE_WORDS.isdisjoint(words) and not self.why) else 0
        self.article = inside or self.meaning >= 1
        self.outside = False


def _settle(created: list[Element], texts: list[tuple[int, str, int]]) -> list[bool]:
    """Decide which elements are outside (parents come before children); the texts in them."""
    def inherit(spared: frozenset) -> None:
        for e in created:
            e.outside = bool(e.parent and e.parent.outside) or e.why == KIND or (e.why == NAME and e not in spared)

    def gone(of) -> np.ndarray:
        edge = np.zeros(len(texts) + 1, np.int64)
        for e in created:
            if of(e):
                edge[e.start] += 1
                edge[e.end] -= 1
        return np.cumsum(edge)[:-1] > 0

    inherit(frozenset())
    if any(e.why == NAME for e in created):
        size = np.array([len(t[1].strip()) for t in texts], np.int64)
        upto = np.concatenate([[0], np.cumsum(np.where(gone(lambda e: e.why == KIND), 0, size))])
        holds = lambda e: upto[e.end] - upto[e.start]
        much = [e for e in created if e.why == NAME and holds(e) > 0 and holds(e) >= TOO_MUCH * upto[-1]]
        # an article beside them (or around them, with text of its own) says that they aren't it
        clean = np.concatenate([[0], np.cumsum(np.where(gone(lambda e: e.outside), 0, size))])
        if much and not any(e.meaning and not e.outside and clean[e.end] > clean[e.start] for e in created):
            inherit(frozenset(much))
    for e in created:
        if e.outside:
            e.meaning = 0
    return gone(lambda e: e.outside).tolist()


def parse(page: str) -> tuple[list[tuple[Element, int, int]], list[tuple[int, str, int]]]:
    """Block elements as (element, first text, end) and the page's texts as (kind, text, path).

    Texts of boilerplate parts are empty. Kind 0 is text that goes on with
    what stands before it, 1 text that starts a block."""
    created: list[Element] = []
    texts: list[tuple[int, str, int]] = []
    stack: list[Element] = []
    #: open elements by tag, and the places in the stack where a start tag may close something or must stop
    open_, stops = Counter(), []
    fresh, skip = 1, None
    find = _TOKEN.finditer

    def close(count):
        for _ in range(count):
            e = stack.pop()
            e.end = len(texts)
            open_[e.tag] -= 1
            if stops and stops[-1] == len(stack):
                stops.pop()

    at, n = 0, len(page)
    while at < n:
        for m in find(page, at):
            at = m.end()
            tag = m["tag"]
            if tag is None:
                part = m[0]
                if part[0] != "<" or part == "<":
                    texts.append((fresh, unescape(part) if "&" in part else part, stack[-1].path if stack else 0))
                    fresh = 0
                continue
            tag = tag.lower()
            if m["end"]:
                if tag in INLINE:
                    continue
                if open_[tag]:
                    close(next(k for k, e in enumerate(reversed(stack), 1) if e.tag == tag))
                fresh = 1
                continue
            if tag == "br":
                texts.append((0, " ", 0))
                continue
            if tag in RAW or (tag == "title" and stack and stack[-1].tag == "head"):
                if not m[0].endswith("/>"):
                    skip = tag
                    break
                continue
            if tag in VOID:
                fresh = 1 if tag == "hr" else fresh
                continue
            if tag in INLINE:
                continue
            closes, down = CLOSES.get(tag, ()), len(stack)
            for k in reversed(stops):  # one of each kind at most, up to the next scope
                if stack[k].tag == "p" or stack[k].tag in closes:
                    down = k
                elif stack[k].tag in SCOPE:
                    break
            close(len(stack) - down)
            if tag == "p" or tag in CLOSES or tag in SCOPE:
                stops.append(len(stack))
            stack.append(Element(tag, stack[-1] if stack else None, _attributes(m["rest"]), len(texts)))
            created.append(stack[-1])
            open_[tag] += 1
            fresh = 1
        if skip:
            end = re.compile(rf"</{skip}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at, skip = (end.end() if end else n), None
            continue
        break
    close(len(stack))
    gone = _settle(created, texts)
    return [(e, e.start, e.end) for e in created], [(k, "", p) if g else (k, t, p) for (k, t, p), g in zip(texts, gone, strict=True)]


def blocks(texts: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(first text, text, token) of each block that isn't blank, its white space made single blanks."""
    out, seen = [], Counter()
    starts = [0, *(i for i, t in enumerate(texts) if t[0] and i), len(texts)]
    for a, b in zip(starts, starts[1:], strict=False):
        if said := " ".join("".join([t[1] for t in texts[a:b]]).split()):
            token = xxhash.xxh3_64_intdigest(said, seed=texts[a][2])
            seen[token] += 1
            out.append((a, said, _signed(xxhash.xxh3_64_intdigest(f"text {seen[token]}", seed=token))))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def page_tokens(page: str) -> dict[int, list]:
    """path -> [occurrences, characters inside, meaning, depth] of a page's elements and texts
    (``TEXT`` stands for their meaning); path 0 stands for the page."""
    elements, texts = parse(page)
    found = blocks(texts)
    size = np.zeros(len(texts), np.int64)
    size[[b[0] for b in found]] = [len(b[1]) for b in found]
    upto = np.concatenate([[0], np.cumsum(size)])
    out: dict[int, list] = {0: [1, int(upto[-1]), 0, -1]}
    for _, said, token in found:
        out[token] = [1, len(said), TEXT, -1]
    for e, start, end in elements:
        if e.outside:
            # a token of the template, whatever it holds
            row = out.setdefault(_signed(e.path), [0, 0, 0, e.depth])
        else:
            row = out.setdefault(_signed(e.path), [0, 0, e.meaning, e.depth])
            row[1] += int(upto[end] - upto[start])
        row[0] += 1
    return out


def outermost(elements: list[tuple[Element, int, int]]) -> list[tuple[int, int]]:
    """Extents of the elements that hold text and aren't nested in another of them, in page order."""
    out, upto = [], 0
    for _, start, end in sorted(elements, key=lambda x: (x[1], x[0].depth)):
        if start >= upto and end > start:
            out.append((start, end))
            upto = end
    return out


def main_text(page: str, path: int | None, meaning: int = 0, constant: frozenset[int] = frozenset()) -> str:
    """Text of the slot at ``path`` with its ``meaning`` (or, without one, of the page's best
    elements), without the host's ``constant`` texts."""
    elements, texts = parse(page)
    found = [(at, said) for at, said, token in blocks(texts) if token not in constant]
    there = [x for x in elements if _signed(x[0].path) == path] if path is not None else []
    if there:
        slot = outermost([x for x in elements if x[0].meaning == meaning] if meaning else there)
        return "\n".join(said for at, said in found if any(a <= at < b for a, b in slot))
    least = MEANT_TEXT * sum(len(said) for _, said in found)
    for wanted in (3, 2, 1):
        slot = outermost([x for x in elements if x[0].meaning == wanted])
        inside = [said for at, said in found if any(a <= at < b for a, b in slot)]
        if inside and sum(map(len, inside)) >= least:
            return "\n".join(inside)
    return "\n".join(said for _, said in found)


# --- Spark -----------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null if it has none."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def tokens(pages: DataFrame) -> DataFrame:
    """host, path, occurrences n, mark of the page, characters, meaning and depth of every page's tokens."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            hosts, marks, html = (batch.column(c).to_pylist() for c in ("host", "mark", "html"))
            cols: list[list] = [[] for _ in range(7)]
            for host, mark, page in zip(hosts, marks, html, strict=True):
                for path, (n, chars, meaning, depth) in page_tokens(page).items():
                    for c, v in zip(cols, (host, path, n, mark, chars, meaning, depth), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)],
                ["host", "path", "n", "mark", "chars", "meaning", "depth"])

    return pages.where("host is not null").select("host", "mark", "html").mapInArrow(
        run, "host string, path bigint, n int, mark bigint, chars bigint, meaning int, depth int")


def templates(found: DataFrame) -> DataFrame:
    """host, main_path, meaning, constant: the token whose slot holds the article, what it is, and
    the constant texts, for hosts with a template."""
    # the occurrence vector's signature: two sums of page marks mixed with the count there
    mixed = [F.pmod(F.xxhash64("mark", "n", F.lit(i)), F.lit((1 << 31) - 1)) for i in (1, 2)]
    vectors = found.groupBy("host", "path").agg(
        F.count("*").alias("pages"), F.max("n").alias("most"), F.sum("chars").alias("chars"), F.max("meaning").alias("meaning"),
        F.max("depth").alias("depth"), F.sum(mixed[0]).alias("s1"), F.sum(mixed[1]).alias("s2"))
    # a class has equal vectors, so rare tokens are whole classes that can't be valid
    vectors = stored(vectors.where(f"path = 0 or pages >= {LEAST_PAGES}"), "html-vectors")
    whole = vectors.where("path = 0").select("host", F.col("pages").alias("all_pages"), F.col("chars").alias("all_chars"))
    members = vectors.where("path <> 0").withColumn("size", F.count("*").over(Window.partitionBy("host", "s1", "s2")))
    meant = (F.col("meaning") > 0) & (F.col("chars") >= MEANT_TEXT * F.col("all_chars"))
    once = (F.col("most") == 1) & (F.col("size") >= LEAST_TOKENS)
    valid = members.join(whole, "host").where(
        (F.col("pages") >= SUPPORT * F.col("all_pages")) & (F.col("chars") > 0) & (once | meant))
    big = F.col("chars") >= MOST_TEXT * F.col("all_chars")
    is_text = F.col("meaning") == TEXT
    # by meaning, then the deepest that holds most text, then the most text
    said = F.when(meant, F.col("meaning")).otherwise(0)
    rank = F.struct(said.alias("said"), big.cast("int").alias("big"), F.when(big, F.col("depth")).otherwise(0).alias("deep"), "chars", "path")
    chosen = valid.groupBy("host").agg(
        F.max(F.when(~is_text, rank)).alias("best"), F.collect_list(F.when(is_text, F.col("path"))).alias("constant"),
        F.sum(F.when(is_text, F.col("chars"))).alias("constant_chars"), F.first("all_chars").alias("all_chars"))
    copies = F.coalesce(F.col("constant_chars") >= MOST_TEXT * F.col("all_chars"), F.lit(False))
    return chosen.where("best is not null").select(
        "host", F.col("best.path").alias("main_path"), F.col("best.said").alias("meaning"),
        F.when(copies, F.array().cast("array<bigint>")).otherwise(F.col("constant")).alias("constant"))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    kinds = dict(pages.dtypes)
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"),
                        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"), host_of(F.col(url_column)).alias("host"))
    chosen = stored(templates(tokens(rows.withColumn("mark", F.xxhash64("page_id", "url")))), "html-templates")
    held = chosen.agg(F.sum(F.size("constant") + 1)).first()[0] or 0
    hosts = F.broadcast(chosen) if held <= BROADCAST_HOSTS else chosen

    def run(batches):
        for batch in batches:
            html, paths, meanings, constant = (batch.column(c).to_pylist() for c in ("html", "main_path", "meaning", "constant"))
            texts = [main_text(h, p, m or 0, frozenset(c or ())) for h, p, m, c in zip(html, paths, meanings, constant, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return (rows.join(hosts, "host", "left").select("page_id", "url", "html", "main_path", "meaning", "constant")
            .mapInArrow(run, f"page_id {kinds[id_column]}, url {kinds[url_column]}, text string"))
