"""Main text of web pages by site style trees.

Pages of one host are merged: for every element path (the tags and classes that lead to it) the
site's pages show some mix of presentations (sequences of child elements) and of contents
(texts). An element whose presentations and contents hardly vary over the site is of low
importance, and its branch is cut from every page. Importance is entropy, normalised by the
number of occurrences, so it needs no list of texts and no page is compared with another.
A site of few pages takes over what its paths are like on other sites.

Elements that announce themselves as navigation, advert, form, comment and the like have no
importance from the start, which also serves sites with too few pages for statistics. Names that
may as well be the layout's say nothing of an article below them, nor of its paragraphs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import map_rows
from waymesh.session import cut

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input map menu nav noembed "
    "noframes noscript object option optgroup output progress script select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = ("article", "main")
#: An open element of the left side ends where one of the right side begins.
ENDED_BY = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
        "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
ENDS = {tag: [o for o, enders in ENDED_BY.items() if tag in enders] for tag in frozenset().union(*ENDED_BY.values())}
#: Where the search for an open element to end stops.
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
MARKING_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social footer header masthead cookie "
    "cookies consent gdpr notice notices alert alerts announcement popup modal overlay newsletter subscribe subscription signup "
    "login search comment comments disqus discussion reply replies respond responses pagination pager toolbar copyright skip "
    "topbar subnav sidenav sitenav adbox adslot adunit adsense cookiebar infobar trending popular teaser teasers".split()
)
#: Marking words for what comes from elsewhere. These hold for articles below, too; the others,
#: like a form around the page, say how a page is laid out as often as what it holds.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored adbox adslot adunit adsense sidebar sidenav "
    "widget widgets related recommended teaser teasers popular trending comments comment disqus discussion reply replies respond "
    "responses newsletter cookie cookies cookiebar consent gdpr".split()
)
#: Before a marking word: the element is not the thing but has it, or lacks it.
MODIFIERS = frozenset("has have no not non without with is hide hides show shows hidden".split())
#: After a marking word: a state or a kind of page.
STATES = frozenset("page layout fixed sticky open closed enabled visible active board".split())
MARKING_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())

TAG = re.compile(r"<(?:!--(.*?)(?:-->|$)|[!?][^>]*>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Za-z]+")

#: How far a mark reaches: to articles below, through them, or to everything.
LAYOUT, FOREIGN, ALL = 1, 2, 3
#: What text is set in; inside an article it is judged by the tree, not by its name.
SET_TEXT = HEADINGS | frozenset("p pre blockquote figcaption".split())

#: Levels that paths tell apart; an element below them is known by the path of the last.
PATH_DEPTH = 64
#: So many pages of a site weigh as much as what a path is like on other sites, and so many sites as much as no knowledge.
PAGES_OF_PRIOR = 8
SITES_OF_PRIOR = 3
#: Share of content in importance; presentation has the rest.
CONTENT_SHARE = 0.9
#: A branch goes if its importance is below this share of the site's most important element.
LEAST_OUTSIDE, LEAST_INSIDE = 0.7, 0.3


@dataclass
class Node:
    """An element: path from the root and its last step, depth, text and children in order."""

    tag: str
    name: str
    path: str
    depth: int
    mark: int
    inside: bool
    parts: list = field(default_factory=list)

    @property
    def marked(self) -> bool:
        return self.mark > 0

    def elements(self):
        return [p for p in self.parts if isinstance(p, Node)]


def attributes_of(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(source)} if source else {}


def marking_words(names: str) -> set[str]:
    """The marking words of a class or id: a name means one by its first part or its last, without modifiers and states."""
    found = set()
    for name in names.split():
        parts = [w.lower() for w in PART.findall(name)]
        if len(parts) > 1 and (parts[0] in MODIFIERS or parts[-1] in STATES):
            continue
        found |= {*parts[:1], *parts[-1:]} & MARKING_WORDS
    return found


def mark_of(tag: str, given: dict[str, str], inside: bool, lifted: bool) -> int:
    """0, or how far the mark reaches that an element has by its kind, a role, a marking word or being hidden."""
    if tag == "form" and not inside:
        return 0 if lifted else LAYOUT
    if tag in DROPPED:
        return ALL
    if tag in ("html", "body", *MAIN):
        return 0
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in MARKING_ROLES:
        return ALL
    if re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return ALL
    if inside and tag in SET_TEXT:
        return 0
    words = marking_words(given.get("class", "")) | marking_words(given.get("id", ""))
    return FOREIGN if words & FOREIGN_WORDS else LAYOUT if words else 0


def parse(source: str) -> Node:
    """The tree of a page. Where marks leave no text, forms don't mark and no word does beyond an article's start."""
    root = tree_of(source)
    return root if has_text(root) else tree_of(source, True)


def has_text(node: Node) -> bool:
    waiting = [node]
    while waiting:
        n = waiting.pop()
        if not n.marked and any(isinstance(p, str) and p.strip() for p in n.parts):
            return True
        waiting += n.elements()
    return False


class Opened:
    """The open elements, with where each kind stands, so none is searched for."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def open(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Where the innermost ``tag`` stands, 0 if none is open."""
        places = self.at.get(tag)
        return places[-1] if places else 0

    def close(self, depth: int) -> None:
        """Ends what stands at ``depth`` and all within it; the root stays."""
        while depth and len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()


def tree_of(source: str, lifted: bool = False, marks: bool = True) -> Node:
    """The tree of a page by its marks; tags left open or closed twice do no harm, nor does any depth.

    Without ``marks`` no element is judged and none is told from others by its names.
    """
    opened = Opened(Node("html", "html", "html", 0, 0, False))
    at = 0

    def text(raw: str) -> None:
        if raw:
            opened.top.parts.append(html.unescape(raw))

    while True:
        match = TAG.search(source, at)
        if not match:
            text(source[at:])
            return opened.stack[0]
        text(source[at : match.start()])
        at = match.end()
        tag = (match[3] or "").lower()
        if not tag or tag == "html":
            continue
        if match[2]:
            opened.close(opened.last(tag))
            continue
        for open_ in ENDS.get(tag, ()):
            place = opened.last(open_)
            if place and place > max(map(opened.last, FENCES.get(open_, ("button", "table", "td", "th", "object")))):
                opened.close(place)
        parent = opened.top
        if not marks:
            node = Node(tag, tag, parent.path, parent.depth + 1, 0, False)
        else:
            given = attributes_of(match[4])
            first = PART.search(given.get("class", "") or given.get("id", ""))
            name = f"{tag}.{first[0].lower()}" if first and tag not in INLINE else tag
            inside = parent.inside or tag in MAIN
            keeps_heading = tag in HEADINGS and parent.tag == "header" and parent.inside
            mark = 0 if keeps_heading else max(parent.mark, mark_of(tag, given, parent.inside, lifted))
            if tag in MAIN and mark <= (FOREIGN if lifted else LAYOUT):
                mark = 0
            path = f"{parent.path}/{name}" if parent.depth < PATH_DEPTH else parent.path
            node = Node(tag, name, path, parent.depth + 1, mark, inside)
        parent.parts.append(node)
        if tag in VOID or match[4].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            close = raw_end(tag).search(source, at)
            at = close.end() if close else len(source)
            continue
        opened.open(node)


@cache
def raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def blocks_of(node: Node, cut_paths: frozenset[str] = frozenset(), marked_too: bool = False) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without cut paths and marked branches."""
    blocks: list[list[str]] = [[]]
    waiting = [(node, iter(node.parts), False)]
    while waiting:
        n, parts, block = waiting[-1]
        for part in parts:
            if isinstance(part, str):
                if marked_too or not n.marked:
                    blocks[-1].append(part)
            elif part.path in cut_paths:
                blocks.append([])
            elif part.tag != "wbr":
                inline = part.tag in INLINE
                if not inline:
                    blocks.append([])
                waiting.append((part, iter(part.parts), not inline))
                break
        else:
            waiting.pop()
            if block:
                blocks.append([])
    return [t for t in (" ".join("".join(b).split()) for b in blocks) if t]


def main_text(source: str | None, cut_paths: frozenset[str] = frozenset()) -> str:
    """The article's text: of the article elements if some hold text, else of main, else of the body."""
    if not source:
        return ""
    root = parse(source)
    for tag in MAIN:
        found: list[Node] = []
        waiting = [root]
        while waiting:
            n = waiting.pop()
            if n is not root and n.tag == tag and not n.marked:
                found.append(n)
            else:
                waiting += [c for c in reversed(n.elements()) if c.path not in cut_paths]
        blocks = [b for n in found for b in blocks_of(n, cut_paths)]
        if blocks:
            return " ".join(blocks)
    return " ".join(blocks_of(root, cut_paths))


#: Contents are hashed as sequences of texts: what an element holds is put together from its children's hashes.
MODULUS = (1 << 61) - 1
BASE = 0x1B3F5D79A2C4E687 % MODULUS


def features_of(source: str | None) -> list[tuple[str, bool, int, int]]:
    """``(path, inside main, presentation, content)`` of every element that may be content."""
    found: list[tuple[str, bool, int, int]] = []
    if not source:
        return found
    root = parse(source)
    waiting = [[root, iter(root.parts), 0, 0]]  # node, parts to come, hash and number of the texts so far
    while waiting:
        n, parts, content, count = level = waiting[-1]
        for part in parts:
            if not isinstance(part, str):
                waiting.append([part, iter(part.parts), 0, 0])
                break
            own = " ".join(part.split())
            if own:
                level[2] = content = (content * BASE + (xxhash.xxh64_intdigest(own) >> 3) + 1) % MODULUS
                level[3] = count = count + 1
        else:
            waiting.pop()
            if n.marked or not count:
                continue
            if n.tag not in INLINE:
                style = "".join(f"</{e.name}" for e in n.elements() if e.tag not in INLINE)
                found.append((n.path, n.inside, xxhash.xxh64_intdigest(style) >> 1, content))
            if waiting:
                above = waiting[-1]
                above[2] = (above[2] * pow(BASE, count, MODULUS) + content) % MODULUS
                above[3] += count
    return found


def page_key(found: list[tuple[str, bool, int, int]], inside: bool) -> int:
    """What stands for a page among those of its host: its article alone for what is inside one, else the whole page."""
    known = [f for f in found if f[1]] if inside else found
    return xxhash.xxh64_intdigest(repr(known)) >> 1


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def site_tree(pages: DataFrame) -> DataFrame:
    """The merged tree of every site of ``pages(page_id, host, html)``.

    ``host, path, inside, occurrences, pages, presentation, content, importance``: entropies of
    an element's presentations and contents, from 0 (always the same) to 1 (never twice).
    Pages that are equal in all elements count once, and so do articles for what is inside them:
    a copy says nothing about what varies.
    """

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for host, source in zip(batch["host"], batch["html"], strict=True):
                found = features_of(source)
                known = {side: page_key(found, side) for side in (False, True)}
                seen = set()
                for (path, inside, style, content), n in Counter(found).items():
                    rows.append((host, known[inside], path, inside, style, content, n, int(path not in seen)))
                    seen.add(path)
            return pd.DataFrame(rows, columns=["host", "key", "path", "inside", "style", "content", "n", "page"])

        return work

    schema = "host string, key long, path string, inside boolean, style long, content long, n long, page long"
    # Equal pages give equal rows, of which one counts. Most fall together before rows are sent.
    elements = map_rows(pages.select("host", "html"), make, schema).distinct()
    # Either kind of feature is counted per value before paths are summed up, so no path gathers in one task.
    kinds = elements.select("host", "path", "inside", "n", F.expr("stack(2, 's', style, page, 'c', content, 0L) as (kind, value, page)"))
    counts = kinds.groupBy("host", "path", "inside", "kind", "value").agg(F.sum("n").alias("n"), F.sum("page").alias("pages"))
    sums = counts.groupBy("host", "path", "inside").agg(
        F.sum(F.when(F.col("kind") == "c", F.col("n"))).alias("occurrences"),
        F.sum("pages").alias("pages"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n") * F.log("n"))).alias(f"{k}_log") for k in "sc"],
    )
    total = F.log("occurrences")
    entropy = lambda k: F.when(F.col("occurrences") > 1, 1 - F.col(f"{k}_log") / (F.col("occurrences") * total)).otherwise(1.0)
    return sums.select("host", "path", "inside", "occurrences", "pages", entropy("s").alias("presentation"), entropy("c").alias("content")).withColumn(
        "importance", CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.col("presentation")
    )


def low_branches(tree: DataFrame) -> DataFrame:
    """``host, paths``: what to cut from a site's pages, never a branch that holds one to keep."""
    several = tree.where("pages > 1").withColumn("weight", F.col("occurrences") * F.log("occurrences"))
    over_all = several.groupBy("path").agg(
        (F.sum(F.col("importance") * F.col("weight")) / F.sum("weight")).alias("usual"), F.count("*").alias("sites")
    )
    # What is known from few sites or few pages counts little, and what is not known is important.
    usual = (F.col("sites") * F.col("usual") + SITES_OF_PRIOR) / (F.col("sites") + SITES_OF_PRIOR)
    backed = (F.col("pages") * F.col("importance") + PAGES_OF_PRIOR * F.col("usual")) / (F.col("pages") + PAGES_OF_PRIOR)
    judged = tree.join(over_all.select("path", usual.alias("usual")), "path", "left").withColumn("usual", F.coalesce("usual", F.lit(1.0)))
    judged = judged.withColumn("importance", backed)
    best = judged.groupBy("host").agg(F.max("importance").alias("best"))
    least = F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST_OUTSIDE)
    low = judged.join(best, "host").where(F.col("importance") < least * F.col("best")).select("host", "path")
    kept = tree.select("host", "path").join(low, ["host", "path"], "left_anti")
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    holders = kept.where(F.size(steps) > 1).select("host", F.explode(above).alias("path")).distinct()
    return low.join(holders, ["host", "path"], "left_anti").groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    A null page counts as empty; a page without main text has an empty one. Elements may be nested
    to any depth; below ``PATH_DEPTH`` levels they share the path of the last level. Pages whose url is
    null or names no host form a site of their own. Repeated rows keep their rows and count as one
    page; an empty table gives none; further columns are ignored.
    """
    own = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html")
    ).withColumn("host", host_of(F.col("url")))
    low = cut(low_branches(cut(site_tree(own), "site_tree")), "low_branches")

    def make():
        def work(batch: pd.DataFrame) -> pd.DataFrame:
            texts = [
                main_text(source, frozenset(paths) if paths is not None else frozenset())
                for source, paths in zip(batch["html"], batch["paths"], strict=True)
            ]
            return pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

        return work

    # Spark sends the cut list to all tasks if its files are small, else it joins by host and splits crowded ones.
    return map_rows(own.join(low, "host", "left").drop("host"), make, "page_id long, url string, text string, n_chars long")
