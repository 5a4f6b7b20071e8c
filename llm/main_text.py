"""Main text of web pages by scoring the element tree.

Each paragraph earns points for its length and its commas, discounted by the share of its text
that stands in links; its parent gets them in full, further ancestors in shrinking parts.  The element
with the most points, again discounted by link density, holds the article; siblings that look like
parts of it are kept.  Elements that are never part of an article (menus, forms, scripts,
adverts, comments and so on) are left out before scoring, by tag, attribute or class; the class of a
wrapper around the article does not count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title select svg math object canvas "
                "audio video".split())
DROPPED = RAW | frozenset("head nav aside footer form button menu dialog label fieldset input datalist map".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
                  "section summary table tbody td tfoot th thead title tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3".split())
# Words in class, id and role that mark what does not belong to an article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login search share sharing social comment comments commentlist disqus reply replies respond related recommended "
    "recommendations widget hidden contentinfo complementary dialog form skip tags".split())
#: In a class such as has-sidebar or modal-open, words that tell the state of a page or a wrapper and not what it holds.
STATE_BEFORE = frozenset("has no not with without overflow".split())
STATE_AFTER = frozenset("open opened closed enabled disabled active collapsed expanded".split())
ARTICLE = frozenset("article main content body post entry story text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
#: Attributes as name and value; names inside another attribute's value are part of that value.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_MARKS = frozenset("class id role hidden aria-hidden style itemprop".split())
_WORD = re.compile(r"[a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A start tag ends the open elements named here, looking no further up than the limits.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
           "option": ("option",)}
_LIMITS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_TABLE = {"table"}

PARAGRAPH_CHARS = 25


class _Node:
    __slots__ = ("tag", "parent", "dropped", "hidden", "wrapper", "score", "chars", "links", "prior", "inside")

    def __init__(self, tag, parent, dropped, prior, hidden=False, wrapper=None):
        self.tag, self.parent, self.dropped, self.prior = tag, parent, dropped, prior
        # hidden: left out whatever its class; wrapper: the place in the page if its class alone leaves it out
        self.hidden, self.wrapper = hidden, wrapper
        self.score, self.chars, self.links = 0.0, 0, 0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)


def _kind_words(value: str) -> set[str]:
    """Words of class names, ids and roles, without those that only tell a state."""
    kinds = set()
    for name in value.split():
        listed = _WORD.findall(name)
        if len(listed) > 1 and listed[-1] in STATE_AFTER:
            continue
        state = next((k for k, word in enumerate(listed) if word in STATE_BEFORE), len(listed))
        kinds.update(listed[:state])
    return kinds


def _marks(rest: str) -> tuple[bool, bool, bool, float]:
    """Whether attributes hide an element, whether its class, id or role marks boilerplate, whether they do so
    beside a word for an article, and the points they give it to start with."""
    hidden, boilerplate, mixed, prior = False, False, False, 0.0
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name = name.lower()
        if name not in _MARKS:
            continue
        value = (a or b or c).lower()
        if name == "style":
            hidden |= bool(_INVISIBLE.search(value))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value == "true"
        else:
            marked = bool(_kind_words(value) & BOILERPLATE)
            if set(_WORD.findall(value)) & ARTICLE:
                prior = 15.0
                mixed |= marked
            else:
                boilerplate |= marked
    return hidden, boilerplate, mixed, prior


def _parse(page: str, spared: frozenset | None = frozenset()) -> tuple[list[tuple[_Node, str, int]], frozenset]:
    """Blocks of a page in order (element, text, characters in links), and the places of elements that their
    class leaves out though they hold the page's main element, or its articles if none stands elsewhere.

    Elements at the places ``spared`` stay whatever their class; None spares all.
    """
    root = _Node("#root", None, False, 0.0)
    around_main, around_article, free_article = set(), set(), False
    node, blocks, parts, in_link, linked = root, [], [], 0, 0
    at, end, raw = 0, len(page), None

    def flush(owner):
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not owner.dropped:
                while owner.parent is not None and owner.tag not in BLOCK:
                    owner = owner.parent
                blocks.append((owner, text, min(linked, len(text))))
            parts, linked = [], 0

    def say(text):
        nonlocal linked
        if text and not node.dropped:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(upto):
        nonlocal node, in_link
        while node is not upto:
            if node.tag in BLOCK:
                flush(node)
            if node.tag == "a":
                in_link = max(0, in_link - 1)
            node = node.parent

    while at < end:
        if raw is not None:  # no markup before the end tag
            stop = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            raw = None
            continue
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        if token.start() > at:
            say(page[at:token.start()])
        at = token.end()
        name = token["name"] or token["name2"]
        if name is None:
            if token[0].startswith("<![CDATA["):
                say(token[0][9:].removesuffix("]]>"))
            continue
        name, rest = name.lower(), token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            found = node
            while found is not root and found.tag != name:
                if found.tag in BLOCK and name not in BLOCK:
                    found = root
                    break
                found = found.parent
            if found is not root:
                close(found.parent)
            elif name == "a" and in_link:
                in_link -= 1
            continue
        if name == "br":
            if not node.dropped:
                parts.append(" ")
            continue
        if name in BLOCK:
            inner = node
            while inner is not root and inner.tag != "p" and (inner.tag not in BLOCK):
                inner = inner.parent
            if inner.tag == "p":
                close(inner.parent)
        if name in _CLOSES:
            limit, inner, last = _LIMITS.get(name, _TABLE), node, None
            while inner is not root and inner.tag not in limit:
                if inner.tag in _CLOSES[name]:
                    last = inner
                inner = inner.parent
            if last is not None:
                close(last.parent)
        if name in BLOCK:
            flush(node)
        if name in VOID:
            continue
        if name in RAW:
            if not rest.endswith("/"):
                raw = name
            continue
        if rest.endswith("/") and name not in BLOCK and name != "a":
            continue
        hides, boilerplate, mixed, prior = _marks(rest) if rest else (False, False, False, 0.0)
        named = name in ("html", "body", "article", "main")
        hidden = node.hidden or name in DROPPED or (hides and not named) or (name == "header" and not node.inside)
        by_class = boilerplate and not named and spared is not None and token.start() not in spared
        drop = node.dropped or hidden or by_class
        if not hidden and (name == "main" or (name == "article" and not boilerplate and not mixed)):
            around, up = set(), node
            while up is not None:
                if up.wrapper is not None:
                    around.add(up.wrapper)
                up = up.parent
            if name == "main":
                around_main |= around
            elif around:
                around_article |= around
            else:
                free_article = True
        if drop and not node.dropped and name not in BLOCK:
            parts.append(" ")
        if name == "a":
            in_link += 1
        node = _Node(name, node, drop, prior + (25.0 if name in ("article", "main") else 0.0), hidden,
                     token.start() if by_class and not hidden else None)
    close(root)
    flush(root)
    return blocks, frozenset(around_main if free_article else around_main | around_article)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by newlines; empty if there is none.

    A wrapper whose class marks boilerplate stays if it holds the page's main element or its only articles.
    Where classes leave no text, the page is scored again without them.
    """
    page = page or ""
    blocks, wrappers = _parse(page)
    if wrappers:
        blocks, _ = _parse(page, wrappers)
    return _best_text(blocks) or _best_text(_parse(page, None)[0])


def _best_text(blocks: list[tuple[_Node, str, int]]) -> str:
    """The blocks of the best element and of the siblings that belong to it."""
    if not blocks:
        return ""
    scored = {}
    for owner, text, links in blocks:
        up = owner
        while up is not None:
            up.chars += len(text)
            up.links += links
            up = up.parent
        if len(text) < PARAGRAPH_CHARS:
            points = 0.1
        else:
            points = 1 + text.count(",") + min(len(text) / 100, 3)
        points *= 1 - links / len(text)
        holder, part = owner.parent if owner.tag in PARAGRAPHS and owner.parent is not None else owner, 1.0
        depth = 0
        while holder is not None and holder.tag != "#root":
            holder.score += points * part
            scored[id(holder)] = holder
            depth += 1
            part = 0.5 if depth == 1 else 1 / (3 * depth)
            holder = holder.parent

    def worth(node):
        return (node.score + (node.prior if node.chars >= PARAGRAPH_CHARS else 0)) * (1 - node.links / max(1, node.chars))

    if not scored:
        return "\n".join(text for _, text, _ in blocks)
    best = max(scored.values(), key=worth)
    limit = max(10.0, 0.2 * worth(best))

    def belongs(node):
        """A sibling of the best element, or of what stands around it, that is kept."""
        density = node.links / max(1, node.chars)
        if node.tag in HEADINGS or (node.tag == "p" and node.chars >= 80):
            return density < 0.25
        return worth(node) >= limit and density < 0.25

    kept, known = [], {id(best): True}
    for owner, text, _ in blocks:
        chain, up = [], owner
        while up is not None and id(up) not in known and up.parent is not best.parent:
            chain.append(up)
            up = up.parent
        if up is None:
            verdict = False
        elif id(up) in known:
            verdict = known[id(up)]
        else:
            verdict = known[id(up)] = best.parent is not None and belongs(up)
        for node in chain:
            known[id(node)] = verdict
        if verdict:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns but ``column``, and text and n_chars (code points) of the main text.

    A null page is empty and has an empty text.  Columns named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    pages = pages.select(*keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few pages at a time: texts are held twice only for these.
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(page) for page in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*keep, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {kind}" for c, kind in pages.dtypes[:-1]] + ["text string", "n_chars long"])
    return pages.mapInArrow(run, schema)


def op7_html_extraction(spark, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extract(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"))
