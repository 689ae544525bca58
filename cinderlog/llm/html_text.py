"""Main text of raw web pages, by scoring the tree.

A page becomes a tree of elements, with the closing rules of HTML that matter for blocks.
Elements that can't be part of an article (menus, forms, scripts and so on, by tag, role
or name) are cut off. Every run of text in a block is a paragraph: it earns points for its
length and its commas and passes them to its ancestors, less with every level. A
container's score is discounted by the share of its text that lies in links. From the best
container it is climbed to the article element around it, or else the main element, or
else, if siblings of the container score well too, their common ancestor. All of that is
kept but what was cut, and of its siblings those that score well or are plain paragraphs.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cinderlog.llm.common import in_slices, table, texts

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=$|[\s/"'])""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Blocks of text that never hold the article themselves.
LEAF = frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd figcaption caption th option legend summary address".split())
#: Tags that are never part of the article.
CUT = frozenset(
    "head nav header footer aside form menu dialog button select option input textarea label "
    "script style noscript template iframe svg canvas object embed audio video title".split()
)
CUT_ROLES = frozenset(
    "navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split()
)
#: Words in class and id that mark such parts; the second set even if they hold most text.
CUT_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer foot sidebar aside rail breadcrumb "
    "breadcrumbs pagination pager toolbar banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay share sharing social related recommended newsletter subscribe subscription signup "
    "login search widget skip toc tags byline".split()
)
CUT_ALWAYS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "comment comments commentlist disqus respond replies reply".split()
)
#: What such a word may be joined with in one class name and still mean the same part.
LAYOUT = frozenset(
    "area bar block body bottom box center column container content form group holder inner items "
    "left link links list main item outer page panel post right section site slot top unit widget wrap wrapper".split()
)
#: Elements that no name cuts.
WHOLE = frozenset("#page html body main article".split())
GOOD_NAMES = frozenset("article body content entry main page post story text blog hentry".split())
#: What an opening tag closes, up to the nearest element of the third item.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Blocks that end an open paragraph, and what shields it.
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
SHIELD = frozenset("table td th caption button object body html".split())

#: A paragraph of fewer characters earns nothing.
LEAST = 25
#: Levels a paragraph's points climb.
LEVELS = 5
TAG_POINTS = {"article": 10, "main": 8, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys(
    "address ol ul dl dd dt li form".split(), -3
) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)


@dataclass
class Tree:
    """Elements by number, parents before children, and the page's text in order.

    An item of `items` is (element, text), or (element, None) where a block begins or ends.
    """

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])
    items: list[tuple[int, str | None]] = field(default_factory=list)


def parse(page: str) -> Tree:
    tree, stack, at = Tree(), [0], 0
    depth: dict[str, int] = {}  # how many elements of a tag are open

    def close_to(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            depth[tree.tags[node]] -= 1
            if tree.tags[node] in BLOCK:
                tree.items.append((stack[-1], None))

    def open_tag(tag: str, shields) -> int | None:
        """Where in the stack the nearest open element of the tag is, within its shields."""
        for k in range(len(stack) - 1, 0, -1):
            name = tree.tags[stack[k]]
            if name == tag:
                return k
            if name in shields:
                return None
        return None

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            tree.items.append((stack[-1], html.unescape(text)))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        if not m[2] and not page.endswith(">", 0, at):
            break  # a tag that the page's end cuts off
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                tree.items.append((stack[-1], " "))
            elif depth.get(tag):
                k = open_tag(tag, () if tag in BLOCK else SHIELD)
                if k is not None:
                    close_to(k)
            continue
        if tag in ENDS_P and depth.get("p"):
            k = open_tag("p", SHIELD)
            if k is not None:
                close_to(k)
        if tag in CLOSES:
            closes, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                name = tree.tags[stack[k]]
                if name in stop:
                    break
                if name in closes and not any(tree.tags[x] in stop for x in stack[k:]):
                    close_to(k)
        if tag == "br":
            tree.items.append((stack[-1], " "))
        if tag in VOID:
            if tag == "hr":
                tree.items.append((stack[-1], None))
            continue
        tree.tags.append(tag)
        tree.parents.append(stack[-1])
        tree.attributes.append(m[3] if m[2] else m[6])
        node = len(tree.tags) - 1
        if tag in BLOCK:
            tree.items.append((node, None))
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not tree.attributes[node].rstrip().endswith("/") or tag in BLOCK:
            stack.append(node)
            depth[tag] = depth.get(tag, 0) + 1
    return tree


def _named(attributes: str) -> tuple[set[str], set[str], str, bool]:
    """(words of class and id, those that name the part, role, whether hidden).

    A class name names a part if it is a word, or a word and layout: `ad-box` an ad, but
    neither `ad-free` nor `related-work` an ad or related pages.
    """
    words, parts, role, hidden = set(), set(), "", False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            for one in value.split():
                own = re.findall("[a-z]+", one)
                words.update(own)
                named = [w for w in own if w not in LAYOUT]
                if all(w in CUT_NAMES or w in CUT_ALWAYS for w in named):
                    parts.update(own)
        elif name == "role":
            role = value
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            hidden |= name == "hidden" or value == "true"
    return words, parts, role, hidden


def _runs(tree: Tree) -> list[tuple[int, str, int]]:
    """(block, text, characters in links) of each run of text between block borders."""
    block, link = [0] * len(tree.tags), [False] * len(tree.tags)
    for k in range(1, len(tree.tags)):
        up = tree.parents[k]
        block[k] = k if tree.tags[k] in BLOCK else block[up]
        link[k] = link[up] or tree.tags[k] == "a"
    out, parts, linked, where = [], [], 0, 0
    for node, text in [*tree.items, (0, None)]:
        if text is not None:
            if not parts:
                where = block[node]
            parts.append(text)
            linked += len(text.strip()) if link[node] else 0
        elif parts:
            if joined := " ".join("".join(parts).split()):
                out.append((where, joined, linked))
            parts, linked = [], 0
    return out


def main_text(page: str) -> str:
    """The blocks of the article, one per line; white space inside a block is one space."""
    tree = parse(page)
    count = len(tree.tags)
    runs = _runs(tree)
    names = [_named(a) if a.strip() else (frozenset(), frozenset(), "", False) for a in tree.attributes]

    # cut what is no article; a name of layout doesn't cut what holds most of the text
    total = sum(len(t) - n for _, t, n in runs) or 1
    held = [0] * count
    for node, text, linked in runs:
        held[node] += len(text) - linked
    for k in range(count - 1, 0, -1):
        held[tree.parents[k]] += held[k]
    cut = [False] * count
    for k in range(1, count):
        _, named, role, hidden = names[k]
        tag = tree.tags[k]
        by_name = tag in BLOCK and tag not in WHOLE
        most = held[k] >= 0.6 * total
        cut[k] = (
            cut[tree.parents[k]]
            # a form around the page is no form of it; its fields are cut one by one
            or (tag in CUT and not (tag == "form" and most))
            or (role in CUT_ROLES and tag not in WHOLE)
            or hidden
            or (by_name and bool(named & CUT_ALWAYS))
            or (by_name and bool(named & CUT_NAMES) and not most)
        )

    # points climb from paragraphs to their ancestors
    points: dict[int, float] = {}
    chars, links = [0] * count, [0] * count
    for node, text, linked in runs:
        if cut[node]:
            continue
        chars[node] += len(text)
        links[node] += min(linked, len(text))
        if len(text) < LEAST:
            continue
        earned = 1 + text.count(",") + min(len(text) / 100, 3.0)
        up, level = node if tree.tags[node] not in LEAF else tree.parents[node], 0
        while up and level < LEVELS:
            if tree.tags[up] in BLOCK:
                points[up] = points.get(up, 0.0) + earned / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = tree.parents[up]
    for k in range(count - 1, 0, -1):
        chars[tree.parents[k]] += chars[k]
        links[tree.parents[k]] += links[k]

    def density(k: int) -> float:
        return links[k] / chars[k] if chars[k] else 0.0

    def score(k: int) -> float:
        bonus = TAG_POINTS.get(tree.tags[k], 0) + (10 if names[k][0] & GOOD_NAMES else 0)
        return (points[k] + bonus) * (1 - density(k))

    keep = [False] * count
    whole = False
    if points:
        scores = {k: score(k) for k in points}
        best = max(scores, key=lambda k: (scores[k], k))
        least = max(10.0, 0.2 * scores[best])
        around = [best]
        while around[-1]:
            around.append(tree.parents[around[-1]])
        named = [k for tag in ("main", "article") for k in around if tree.tags[k] == tag]
        beside = [k for k in scores if k != best and tree.parents[k] == tree.parents[best] and not cut[k] and scores[k] >= least]
        whole = bool(named)
        if named:
            best = named[-1]  # the outermost article, or else the outermost main element
        elif tree.tags[best] not in ("html", "body") and (beside or names[tree.parents[best]][0] & GOOD_NAMES):
            best = tree.parents[best]
        keep[best] = True
        paragraphs: dict[int, list[str]] = {}
        for node, text, _ in runs:
            paragraphs.setdefault(node, []).append(text)
        for k in range(1, count):
            if k == best or tree.parents[k] != tree.parents[best] or cut[k]:
                continue
            if scores.get(k, 0.0) >= least:
                keep[k] = True
            elif tree.tags[k] == "p" and k in paragraphs:
                text = " ".join(paragraphs[k])
                keep[k] = density(k) < 0.25 and len(text) > 80 or not links[k] and bool(re.search(r"\.( |$)", text))
    else:
        keep[0] = True
    for k in range(1, count):
        # lists of links that lie in an article or main element belong to it
        listed = not whole and tree.tags[k] in ("ul", "ol", "table", "div", "section") and chars[k] and density(k) > 0.6
        keep[k] = (keep[k] or keep[tree.parents[k]]) and not cut[k] and not listed
    return "\n".join(text for node, text, _ in _runs_kept(tree, keep))


def _runs_kept(tree: Tree, keep: list[bool]) -> list[tuple[int, str, int]]:
    inside = Tree(tree.tags, tree.parents, tree.attributes, [x for x in tree.items if x[1] is None or keep[x[0]]])
    return _runs(inside)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row's whole page.

    Null and empty pages, and pages without an article, have the empty text. Character
    references are decoded, also without their semicolon where HTML allows that. A page
    that is cut off ends where it ends. Rows that repeat each get a row; null ids and urls
    are kept; an empty table gives no rows; other columns are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(x) for x in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    kinds = (df.schema[c].dataType.simpleString() for c in (id_col, url_col))
    return df.select(id_col, url_col, html_col).mapInArrow(
        in_slices(work), "page_id {}, url {}, text string, n_chars long".format(*kinds)
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
