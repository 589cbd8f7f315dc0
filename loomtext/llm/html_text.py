"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree.  Paragraphs pass points, for their length and commas, to their parent (whole), the
next ancestor (half) and those above (a third a level); each container's points are discounted by its share of linked text.
The best container, or the article or main element around it, is kept with the text beside it and those siblings that score a
fifth of it or hold more other text than links.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are cut from the tree first, by element and by whole names in class and role, and in id outside of articles.

Nulls: a null html counts as empty; an empty page, or one without text, has the text "".  Very long pages are taken whole.
Equal rows get equal answers.  Other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|$)|display\s*:\s*none", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas", "audio", "video"}
GONE = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "input", "label", "fieldset"}
#: A name of a part that is no article text.
NOISE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|side-?bar\w*|comments?|commentlist|disqus|respond|repl(?:y|ies)|cookies?|consent|notices?|notification\w*|alert|pop-?up|modal|overlay|"
    r"menu\w*|nav\w*|breadcrumbs?|footer\w*|header|masthead|share|sharing|social|related|recommend\w*|subscribe|newsletter|sign-?up|log-?in|pagination|pager|widget\w*|toolbar|skip-?link|complementary|contentinfo|search)",
    re.I,
)
#: What may stand beside such a name in a compound one; with any other word it names something else.
BESIDE = set("area bar block bottom box button buttons container content footer group header holder icons inner item items left link links list main middle outer page panel post posts right row section sections site slot space text title toggle top unit user widget wrap wrapper".split())
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
PARAGRAPH = {"p", "pre", "blockquote", "td", "li", "dd"}
ENDS_P = BLOCK - {"body", "html"} | {"nav", "footer", "aside", "form", "fieldset", "menu"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "table", "dl", "article", "section", "div", "body", "html", "main"}


class Node:
    __slots__ = ("tag", "noise", "up", "kids", "points")

    def __init__(self, tag, noise, up):
        self.tag, self.noise, self.up, self.kids, self.points = tag, noise, up, [], 0.0


def names_noise(value: str) -> bool:
    for name in value.split():
        if NOISE.fullmatch(name):
            return True
        parts = re.split(r"[_-]+", name.strip("_-"))
        if len(parts) > 1 and all(NOISE.fullmatch(x) or x.lower() in BESIDE or x.isdigit() for x in parts) and any(NOISE.fullmatch(x) for x in parts):
            return True
    return False


def noisy(tag: str, attrs: str, inside: bool) -> bool:
    """inside: in an article or main element."""
    if tag in GONE:
        return True
    if tag in ("html", "body", "article", "main") or tag != "header" and not attrs:
        return False
    if tag == "header" and not inside:
        return True
    # Within an article an id names its own parts.
    return bool(_HIDDEN.search(attrs)) or any(names_noise(m[2] or m[3] or m[4] or "") for m in _NAMES.finditer(attrs) if not inside or m[1].lower() != "id")


class Tree:
    """A tree under construction: its root, the innermost open node, and how many of each tag are open."""

    def __init__(self):
        self.root = self.at = Node("html", False, None)
        self.open: Counter[str] = Counter()

    def add(self, node: Node, enter: bool) -> None:
        self.at.kids.append(node)
        if enter:
            self.at = node
            self.open[node.tag] += 1

    def leave(self, node: Node) -> None:
        """Closes the node, which is open, and all within."""
        while self.at is not node.up:
            self.open[self.at.tag] -= 1
            self.at = self.at.up


def tree(page: str) -> Node:
    t = Tree()
    i, n = 0, len(page)
    while i < n:
        m = _TOKEN.search(page, i)
        if not m:
            t.at.kids.append(html.unescape(page[i:]))
            break
        if m.start() > i:
            t.at.kids.append(html.unescape(page[i : m.start()]))
        i = m.end()
        if m["cdata"] is not None:
            t.at.kids.append(m["cdata"])
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if t.open[tag]:
                t.leave(next(x for x in lineage(t.at) if x.tag == tag))
            continue
        if tag in RAW:
            if not m["attrs"].endswith("/") and (end := re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, i)):
                i = end.end()
            elif tag not in ("svg", "math", "object", "audio", "video", "canvas", "iframe"):
                i = n  # raw text without an end holds the rest
            continue
        if tag == "html" or tag == "body" and t.open["body"]:
            continue
        if tag in ENDS_P and t.open["p"]:
            p = next((x for x in lineage(t.at) if x.tag in STOPS or x.tag == "p"), None)
            if p and p.tag == "p":
                t.leave(p)
        if tag in SAME:
            p = next((x for x in lineage(t.at) if x.tag in STOPS or x.tag in SAME[tag]), None)
            if p and p.tag in SAME[tag]:
                t.leave(p)
                if tag == "tr" and t.at.tag == "tr" and t.at.up:
                    t.leave(t.at)
        t.add(Node(tag, noisy(tag, m["attrs"], t.open["article"] + t.open["main"] > 0), t.at), tag not in VOID and not (m["attrs"].endswith("/") and tag not in BLOCK))
    return t.root


def lineage(node: Node):
    while node:
        yield node
        node = node.up


def clean(node: Node) -> None:
    """Cuts noise, without recursion: pages may nest deeply."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.kids = [k for k in x.kids if isinstance(k, str) or not k.noise]
        todo += [k for k in x.kids if not isinstance(k, str)]


def measures(root: Node) -> dict[int, tuple[int, int, int]]:
    """Characters, linked characters and commas under each node."""
    order, todo = [], [(root, False)]
    while todo:
        x, linked = todo.pop()
        linked = linked or x.tag == "a"
        order.append((x, linked))
        todo += [(k, linked) for k in x.kids if not isinstance(k, str)]
    found: dict[int, tuple[int, int, int]] = {}
    for x, linked in reversed(order):
        n = l = c = 0
        for k in x.kids:
            if isinstance(k, str):
                m = len(k.strip())
                n, l, c = n + m, l + m * linked, c + k.count(",") + k.count("，") + k.count("、")
            else:
                a, b, d = found[id(k)]
                n, l, c = n + a, l + b, c + d
        found[id(x)] = n, l, c
    return found


def nodes(root: Node):
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo += [k for k in reversed(x.kids) if not isinstance(k, str)]


def best(root: Node) -> list[Node | str]:
    size = measures(root)
    density = lambda x: size[id(x)][1] / max(1, size[id(x)][0])
    scored = {}
    for x in nodes(root):
        n, _, commas = size[id(x)]
        direct = x.tag == "div" and any(isinstance(k, str) and k.strip() for k in x.kids)
        if not n or not (x.tag in PARAGRAPH or direct):
            continue
        points = 1 + commas + min(n // 100, 3)
        for level, up in enumerate(lineage(x if direct else x.up)):
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            if level == 4:
                break
    final = {k: x.points * (1 - density(x)) for k, x in scored.items()}
    whole = [x for x in nodes(root) if x.tag in ("article", "main") and size[id(x)][0]]
    if not scored:
        return whole[:1] or [root]
    top = max(scored.values(), key=lambda x: (final[id(x)], size[id(x)][0]))
    score = final[id(top)]
    around = next((a for a in lineage(top) if a.tag in ("article", "main")), None)
    top = around or top
    if not top.up:
        return [top]
    # Menus and the like are gone, so of the siblings only lists of links are left out, and all loose text is kept.
    kept = lambda x: x is top or final.get(id(x), 0) >= max(10, 0.2 * score) or size[id(x)][0] and density(x) < 0.5
    return [x for x in top.up.kids if isinstance(x, str) or kept(x)]


def blocks(roots: list[Node | str]) -> list[str]:
    out, own = [], []

    def end():
        if text := " ".join("".join(own).split()):
            out.append(text)
        own.clear()

    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            own.append(x)
        elif x.tag == "br":
            own.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.kids)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = tree(page)
    clean(root)
    return "\n".join(blocks(best(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches):
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
