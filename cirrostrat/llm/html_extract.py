"""Main text of HTML pages by tree scoring.

A page becomes a tree in one pass over its tags. Parts that cannot be main text (scripts, menus,
forms, page headers and footers, adverts, notices, comments) are cut by element, role and the
words of class and id. Every paragraph then passes points for its length and commas to its
ancestors, the less the further up, discounted by the share of its text that is links. The best
container is kept, with the siblings that read like its continuation.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cirrostrat.llm.text import in_small_batches, slices

_TAG = re.compile(
    r"""<!--.*?(?:-->|$)|<svg(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*(?<=/)>"""  # a self-closed svg is empty
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|$)"
    r"""|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[a-zA-Z][^>]*>|<[!?/][^>]*(?:>|$)|<[a-zA-Z][^>]*$""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/"'>]+)""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0 -     　]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no main text wherever they stand.
_CUT = frozenset("nav footer aside form button select input dialog menu fieldset object applet audio video canvas map datalist".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: Words of class or id that name a part beside the main text.
_CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted comment comments commentlist disqus respond replies reply "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer masthead share sharing social related recommended recommendations widget toolbar skip tags outbrain taboola feedback discussion".split()
)
#: Of these, words that also name parts of articles: there they cut only with a second word, or where links or form controls agree.
_WEAK_WORDS = frozenset(
    "discussion side tags related feedback respond reply replies rail skip recommended promotion signup login pager masthead widget menu alert banner consent social footer modal overlay toolbar promoted".split()
)
#: Words beside them in a name that tell nothing else; in an article a name with other words (``ad-hoc``, ``social-history``) counts as weak.
_FRAME_WORDS = frozenset(
    "article area auto bar block body bottom box btn button buttons card center centre class col column container content contents count desktop end first float footer form frame google group header heading "
    "holder icon icons id image in inline inner item items js large last left link links list lists main mid middle mobile module native new note outer page panel post reader readers right row section site "
    "slot small sticky text thread title top unit user users video visitor wrap wrapper zone".split()
)
_CONTROLS = frozenset("form input button select textarea".split())
_GOOD_WORDS = frozenset("article body content entry main post story text page hentry".split())
#: A start tag of the first kind ends an open one of the second.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th", "thead", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"),
}
_FENCE = frozenset("table td th ul ol dl div section article main body html blockquote form aside nav header footer".split())


class Node:
    """An element; ``measure`` adds the characters, characters in links and commas below it, and whether form controls are."""

    __slots__ = ("attrs", "commas", "controls", "kids", "links", "names", "parent", "score", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs, self.kids, self.score = tag, parent, attrs, [], 0.0
        self.total = self.links = self.commas = 0
        self.controls = False
        named = f"{attrs.get('class', '')} {attrs.get('id', '')}" if attrs else ""
        self.names = [[w.lower() for w in _WORD.findall(n)] for n in named.split()]

    @property
    def words(self) -> list[str]:
        return [w for n in self.names for w in n]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower() if m[1] else m[5].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def parse(page: str) -> Node:
    """The tree of a page, as deep as its tags nest; texts stand among the children as strings, character references decoded."""
    root = at = Node("html", None, {})
    end, still = 0, Counter()  # tags that are open, so that an end tag without a start costs no walk

    def closed(upto: Node) -> Node:
        nonlocal at
        while at is not upto:
            still[at.tag] -= 1
            at = at.parent
        return at

    for m in _TAG.finditer(page):
        if m.start() > end:
            at.kids.append(html.unescape(page[end : m.start()]))
        end = m.end()
        if tag := m["start"]:
            tag = tag.lower()
            if tag in ("html", "body", "head") and at is not root and tag != "body":
                continue
            closed(_close_for(at, tag, still))
            node = Node(tag, at, _attributes(m["attrs"]))
            at.kids.append(node)
            if tag not in _VOID and not (m["attrs"].endswith("/") and tag not in _BLOCK):
                at = node
                still[tag] += 1
        elif tag := m["end"]:
            tag = tag.lower()
            if not still[tag]:
                continue
            up = at
            while up is not root and up.tag != tag:
                if tag not in _BLOCK and up.tag in _FENCE:  # an inline end tag does not close blocks around it
                    up = root
                    break
                up = up.parent
            if up is not root:
                closed(up.parent)
    if end < len(page):
        at.kids.append(html.unescape(page[end:]))
    return root


def _close_for(at: Node, tag: str, still: Counter) -> Node:
    if still["p"] and tag in _BLOCK and tag not in ("body", "html"):  # a block ends an open paragraph
        up = at
        while up.parent is not None and up.tag != "p" and up.tag not in _FENCE and up.tag != "li":
            up = up.parent
        if up.tag == "p":
            at = up.parent
    if tag in _CLOSES and any(still[t] for t in _CLOSES[tag]):
        ends, up = _CLOSES[tag], at
        while up.parent is not None and (up.tag in ends or up.tag not in _FENCE):
            if up.tag in ends:
                at = up.parent
            up = up.parent
    return at


def walk(node: Node) -> Iterator[Node]:
    """A node and all below it, in page order."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo += [k for k in reversed(node.kids) if not isinstance(k, str)]


def _count(kids: list) -> tuple[int, int, int]:
    """Characters, characters in links, and commas of measured children."""
    total = links = commas = 0
    for k in kids:
        if isinstance(k, str):
            total += len(k.strip())
            commas += k.count(",") + k.count("，") + k.count("、")
        else:
            total, links, commas = total + k.total, links + k.links, commas + k.commas
    return total, links, commas


def measure(root: Node) -> None:
    for node in reversed(list(walk(root))):
        node.total, node.links, node.commas = _count(node.kids)
        if node.tag == "a":
            node.links = node.total
        node.controls = node.tag in _CONTROLS or any(k.controls for k in node.kids if not isinstance(k, str))


def _is_cut(node: Node, within: bool) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in _CUT or (tag in ("header", "head") and not within):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("role", "").lower() in _CUT_ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main"):
        return False
    told = [{w for k, w in enumerate(n) if w in _CUT_WORDS and (k == 0 or n[k - 1] not in ("no", "has", "with", "without"))} for n in node.names]
    named = set().union(*told)
    if tag == "article":
        named &= {"comment", "comments", "related", "reply", "ad", "promo", "sponsored"}
    if within and len(named) == 1 and not _is_beside(node):
        plain = any(t & named and all(w in t or w in _FRAME_WORDS or len(w) < 2 or w.isdigit() for w in n) for t, n in zip(told, node.names, strict=True))
        if named <= _WEAK_WORDS or not plain:
            named = set()
    return bool(named) or (not within and "header" in node.words)


def _is_beside(node: Node) -> bool:
    """Whether a part of an article reads like none of its text: it is half links, or holds form controls."""
    return node.links > 0.5 * node.total or node.controls


def prune(root: Node) -> None:
    """Cut what cannot be main text, at any depth; the tree is measured before."""
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.tag in ("article", "main") or node.attrs.get("role") in ("main", "article")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _is_cut(k, within)]
        todo += [(k, within) for k in node.kids if not isinstance(k, str)]


def _is_paragraph(node: Node) -> bool:
    if node.tag in ("p", "pre", "blockquote", "td", "li", "dd"):
        return not any(not isinstance(k, str) and k.tag in ("p", "div", "ul", "ol", "table", "section", "article") for k in node.kids)
    return node.tag in ("div", "section", "article", "main", "body") and any(isinstance(k, str) and len(k.strip()) > 20 for k in node.kids)


def best_container(root: Node) -> Node:
    scored: list[Node] = []
    wide = ("div", "section", "article", "main", "body")
    for node in walk(root):
        if _is_paragraph(node):
            total, links, commas = _count([k for k in node.kids if isinstance(k, str) or k.tag not in _BLOCK] if node.tag in wide else node.kids)
            if node.tag == "a":
                links = total
            if total:
                points = (1 + commas + min(total / 100, 3)) * (1 - links / total)
                up, share = (node if node.tag in wide else node.parent), 1.0
                for level in range(5):
                    if up is None:
                        break
                    if up.tag not in ("p", "b", "i", "em", "strong", "span", "a", "font", "ul", "ol"):
                        up.score += points * share
                        scored.append(up)
                        share = 0.5 if level == 0 else share / 2
                    up = up.parent
    best, top = None, -1.0
    for node in dict.fromkeys(scored):
        weight = 1.5 if node.tag in ("article", "main") else 1.2 if _GOOD_WORDS & set(node.words) else 1.0
        value = node.score * weight * (1 - (node.links / node.total if node.total else 0))
        if value > top:
            best, top = node, value
    if best is None:
        best = next((n for n in walk(root) if n.tag in ("article", "main")), root)
    up = best  # the article around the best part is all main text
    while up is not None:
        if up.tag == "article" or up.attrs.get("itemprop") == "articleBody":
            return up
        up = up.parent
    up = best
    while up is not None:
        if up.tag == "main" or up.attrs.get("role") == "main":
            return up
        up = up.parent
    return best


def with_siblings(best: Node) -> list[Node]:
    """The best container and the siblings that go on with its text, in page order."""
    if best.parent is None or best.tag in ("body", "html", "main"):
        return [best]
    keep = []
    for k in best.parent.kids:
        if k is best:
            keep.append(k)
        elif not isinstance(k, str):
            total, density = k.total, k.links / k.total if k.total else 1.0
            if k.score >= max(10.0, 0.2 * best.score) and density < 0.3:
                keep.append(k)
            elif best.tag == k.tag == "article" and density < 0.3 and any(_is_paragraph(n) and not n.links and _ends(n) for n in walk(k)):
                keep.append(k)  # an article with text of its own
            elif best.tag != "article" and total and k.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and density < 0.3 and (k.tag[0] == "h" or total > 80 or _ends(k)):
                keep.append(k)
    return keep


def _ends(node: Node) -> bool:
    text = "".join(k for n in walk(node) for k in n.kids if isinstance(k, str)).rstrip()
    return text.endswith((".", "!", "?", ":", "…"))


def _is_menu(node: Node) -> bool:
    if node.tag not in ("ul", "ol", "dl"):
        return False
    return bool(node.total) and node.links > 0.9 * node.total and sum(1 for k in node.kids if not isinstance(k, str)) > 2


def _in_article(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main") or node.attrs.get("role") in ("main", "article") or node.attrs.get("itemprop") == "articleBody":
            return True
        node = node.parent
    return False


def _introduced(node: Node) -> bool:
    """Whether a heading, or a block that ends in a colon, stands right before."""
    before = None
    for k in node.parent.kids if node.parent else ():
        if k is node:
            break
        if not (isinstance(k, str) and not k.strip()):
            before = k
    if before is None:
        return False
    if isinstance(before, str):
        return before.rstrip().endswith(":")
    text = "".join(k for n in walk(before) for k in n.kids if isinstance(k, str)).rstrip()
    return before.tag in ("h1", "h2", "h3", "h4", "h5", "h6") or text.endswith(":")


def blocks(node: Node, out: list[str], line: list[str], article: bool = False) -> None:
    """Append the text of each block; inline text gathers in ``line``. Lists of links are menus unless they stand in an ``article`` or are introduced."""
    todo: list[tuple[Node | None, Iterator]] = [(None, iter([node]))]
    while todo:
        own, kids = todo[-1]
        k = next(kids, None)
        if k is None:
            todo.pop()
            if own is not None and own.tag in _BLOCK:
                _flush(out, line)
        elif isinstance(k, str):
            line.append(k)
        elif k.tag == "br":
            line.append(" ")
        elif article or k is node or not _is_menu(k) or _introduced(k):
            if k.tag in _BLOCK:
                _flush(out, line)
            todo.append((k, iter(k.kids)))


def _flush(out: list[str], line: list[str]) -> None:
    if line:
        if text := _SPACE.sub(" ", "".join(line)).strip(" "):
            out.append(text)
        line.clear()


def main_text(page: str | None) -> str:
    """The main text of a page: blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    measure(root)
    prune(root)
    measure(root)
    out: list[str] = []
    line: list[str] = []
    for node in with_siblings(best_container(root)):
        blocks(node, out, line, _in_article(node))
        _flush(out, line)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points of the text).

    Null and empty pages, and pages without main text, give an empty text. Repeated rows give equal
    rows; other columns are not read. Pages are parsed whole and cut at nothing; a tag that the page
    ends in is dropped, unclosed elements end with their parents.
    """
    return in_small_batches(pages.select("page_id", "url", "html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
