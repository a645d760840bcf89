"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold outside links and
furniture; a container's path is the generalised chain of tags and classes
from the root (digits become ``#``). A page votes for the path of its best
container; votes are summed for each host in Spark, and the paths with a tenth
of a host's votes win, one or more for each template. Every page of the host is
extracted again at the first of them whose containers hold a fair part of what
the page's best ones do; a page without such a path falls back to its own best
container, so that no page is left out.

Furniture is what the contract of a main text excludes: menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments, known by their tags, by words of their class, id or role, and by
being hidden. It goes at any length; a page of nothing else has an empty text.
Layout wrappers are told apart by how they are named and built, not by size: a
word says nothing after no-, has- or with-; words that layouts use too (form,
search, widget) count only as the last part of a name, where all of the
element's classes are such names; and an element around a ``main`` is none.
The main text is the container's blocks: white space inside a block becomes
one blank, blocks are joined by one line break.

Edge cases: null and empty pages give an empty text; plain text without tags
is one block of the page; broken markup is read as browsers do, roughly (open
elements end with their parent). Pages whose url names no host share no votes:
each has its own best path. Ties between paths go to the larger text, then to the first in code-point order. Repeated
rows each get a row and a vote. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import stored, tidy

_markup = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    # a tag with a quote left open ends at the next >
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*>""", re.S
)
_attribute = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_name_parts = re.compile(r"[a-z]+").findall
_unseen = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)").search

# Tags of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe svg math object canvas video audio textarea title".split())
FURNITURE_TAGS = set("nav header footer aside form button select option input label fieldset dialog menu head".split())
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
CONTAINERS = set("article body div main section td html center".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notification popup promo promotion related respond "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar".split()
)
#: Words that name layouts too: they count as the last part of a name.
LAST_WORDS = set("form forms search widget widgets".split())
#: What may follow the last word, and what makes another word of it.
TAIL_WORDS = set("area bar block box container inner list panel section wrap wrapper".split())
OTHER_FORMS = set("free long short".split())
COMMENT_WORDS = set("comment comments commentlist disqus respond".split())
#: With these a class says what a layout has or lacks.
WITHOUT = set("no has with without".split())
#: Roles of landmarks outside a page's main part.
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu".split())


#: Share of a host's votes from which on a path wins, and of the best container's score from which on it is taken.
VOTE_SHARE = 0.1
SCORE_SHARE = 0.05


@dataclass
class Element:
    tag: str
    path: str
    furniture: bool  # itself or one above
    parent: Element | None
    named: str = ""  # furniture by its class or id: "word", or "comments" for readers' comments
    main: bool = False  # by its role
    text: int = 0  # characters outside links and furniture, with all elements below
    linked: int = 0


def _generalised(tag: str, attrs: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attrs.get("class", "").split()})
    return ".".join([tag, *classes])


def _is_furniture(tag: str, attrs: dict[str, str]) -> bool:
    unseen = attrs.get("aria-hidden") == "true" or "hidden" in attrs or ("style" in attrs and _unseen(attrs["style"].lower()) is not None)
    return tag in FURNITURE_TAGS or attrs.get("role", "").lower() in FURNITURE_ROLES or unseen


def _last_word(words: list[str]) -> bool:
    """Whether a name's last part, generic words aside, is one of ``LAST_WORDS``."""
    end = len(words)
    while end > 1 and words[end - 1] in TAIL_WORDS:
        end -= 1
    return bool(words) and words[end - 1] in LAST_WORDS and not (end > 1 and words[end - 2] in OTHER_FORMS)


def _named(tag: str, attrs: dict[str, str]) -> str:
    if tag in ("html", "body", "article", "main"):
        return ""
    names = [_name_parts(n) for n in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()]
    plain = [n for n in names if not WITHOUT.intersection(n)]
    if any(COMMENT_WORDS.intersection(n) for n in plain):
        return "comments"
    if any(FURNITURE_WORDS.intersection(n) for n in plain):
        return "word"
    return "word" if names and len(plain) == len(names) and all(map(_last_word, names)) else ""


def _mark_named(every: list[Element]) -> None:
    """Furniture by name, and all below it; an element around a ``main`` is readers' comments or none."""
    if not any(e.named for e in every):
        return
    around: set[int] = set()
    for e in every:
        if e.tag == "main" or e.main:
            at = e.parent
            while at is not None and id(at) not in around:
                around.add(id(at))
                at = at.parent
    for e in every:  # parents come first
        by_name = e.named == "comments" or (e.named and id(e) not in around)
        e.furniture = e.furniture or bool(by_name) or (e.parent is not None and e.parent.furniture)


def parse(page: str) -> tuple[list[Element], list[tuple[Element, bool, str]]]:
    """The page's elements, and its text runs in order as (element, in a link, text); a None text breaks a block."""
    root = Element("", "", False, None)
    every, runs, stack, links, at = [root], [], [root], 0, 0
    position = 0
    while position <= len(page):
        m = _markup.search(page, position)
        end = m.start() if m else len(page)
        if end > at:
            runs.append((stack[-1], links > 0, page[at:end]))
        if not m:
            break
        at = position = m.end()
        tag, closes, inner = (m["tag"] or m["tag2"] or "").lower(), m["end"] or m["end2"], m["attrs"] or ""
        if not tag:
            continue
        if tag in RAW:
            if not closes:  # its content is not markup
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = position = close.end() if close else len(page)
            continue
        if tag in BLOCKS:
            runs.append((stack[-1], False, None))
        if closes:
            # an end tag closes up to its start, but not beyond a block of another kind when it is inline
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag in VOID or tag == "br":
            continue
        attrs = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _attribute.findall(inner)} if "=" in inner else {}
        if "hidden" in inner and re.search(r"(?:^|\s)hidden(?:\s|/|$)", inner):
            attrs["hidden"] = ""
        if tag in CLOSES or tag in BLOCKS:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    links -= sum(e.tag == "a" for e in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        above = stack[-1]
        # inline elements share the path of the block they stand in
        path = f"{above.path}>{_generalised(tag, attrs)}" if tag in BLOCKS else above.path
        element = Element(tag, path, above.furniture or _is_furniture(tag, attrs), above, _named(tag, attrs), attrs.get("role", "").lower() == "main")
        every.append(element)
        stack.append(element)
        links += tag == "a"
        if inner.rstrip().endswith("/") and tag not in BLOCKS:
            links -= tag == "a"
            stack.pop()
    _mark_named(every)
    return every, runs


def candidates(page: str) -> list[tuple[str, float]]:
    """(path, score) of the page's best containers, best first: one for each path."""
    return _candidates(*parse(page))


def _candidates(elements: list[Element], runs: list[tuple[Element, bool, str]]) -> list[tuple[str, float]]:
    for element, linked, text in runs:
        if text is None or element.furniture:
            continue
        n = len(text.strip())
        if not n:
            continue
        e: Element | None = element
        depth = 0
        while e is not None:
            if linked:
                e.linked += n
            else:
                # text counts fully for the block's parent and less further up, so that the tightest container wins
                e.text += n if depth <= 2 else n * 8 // 10 if depth <= 3 else n // 2
            depth += e.tag in BLOCKS
            e = e.parent
    best: dict[str, float] = {}
    for e in elements:
        if e.tag in CONTAINERS and not e.furniture and e.text:
            bonus = 1.25 if e.tag in ("article", "main") or re.search(r"article|content|entry|main|post|story", e.path.rsplit(">", 1)[-1]) else 1.0
            worth = bonus * e.text * e.text / (e.text + 2 * e.linked)
            best[e.path] = best.get(e.path, 0.0) + worth
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def extract(page: str, paths: list[str]) -> str:
    """Blocks of all containers at the first of ``paths`` that holds enough here, or of the page's best container; without furniture."""
    elements, runs = parse(page)
    own = _candidates(elements, runs)
    score = dict(own)
    least = SCORE_SHARE * own[0][1] if own else 0.0
    path = next((p for p in paths if p in score and score[p] >= least), own[0][0] if own else "")
    inside: dict[int, bool] = {}

    def kept(e: Element) -> bool:
        at = e
        while at is not None and id(at) not in inside:
            if at.path == path or path == "":
                inside[id(at)] = True
                break
            at = at.parent
        found = at is not None and inside[id(at)]
        inside[id(e)] = found
        return found

    blocks, parts = [], []
    for element, _, text in runs:
        if text is None:
            blocks.append("".join(parts))
            parts = []
        elif not element.furniture and kept(element):
            parts.append(text)
    blocks.append("".join(parts))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths): the paths with a share of each host's votes, most votes first. ``pages``: host, html; no host, no votes."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(h, *c[0]) for h, page in zip(pdf["host"], pdf["html"], strict=True) if page and (c := candidates(page))]
            if got:  # votes are summed by task before they are shuffled
                votes = pd.DataFrame(got, columns=["host", "path", "score"])
                yield votes.groupby(["host", "path"], as_index=False).agg(votes=("score", "size"), score=("score", "sum"))

    votes = pages.where("host <> ''").select("host", "html").mapInPandas(tidy(vote), "host string, path string, votes long, score double")
    # stored: the totals and the winners both need the votes, and pages are parsed for them once
    summed = stored(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.round(F.sum("score"), 3).alias("score")), "html-votes")
    # the most voted path wins whatever its share
    top = summed.groupBy("host").agg(F.sum("votes").alias("every"), F.max("votes").alias("most"))
    won = summed.join(top, "host").where((F.col("votes") >= VOTE_SHARE * F.col("every")) | (F.col("votes") == F.col("most")))
    # descending (votes, score), ties to the first path. Where no path has a share, those with the most votes may be
    # as many as the host's pages: one is enough, as a page has its own
    shared = F.col("votes") >= VOTE_SHARE * F.col("every")
    some = F.collect_list(F.when(shared, F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    one = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path"))
    return won.groupBy("host").agg(some.alias("some"), one.alias("one")).select(
        "host", F.when(F.size("some") > 0, F.array_sort("some")).otherwise(F.array("one")).getField("path").alias("paths")
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, host_path and text for each row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    paths = stored(winning_paths(rows), "html-paths")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = [[] if p is None else list(p) for p in pdf["paths"]]
            texts = [extract(page, p) if page else "" for page, p in zip(pdf["html"], paths, strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host_path": [p[0] if p else None for p in paths], "text": texts})

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInPandas(tidy(run), f"page_id {kind}, url string, host_path string, text string")
