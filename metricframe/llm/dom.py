"""A tolerant HTML reader that gives block elements and runs of text in page order, with features of each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is in these is never text of the page.
SILENT = frozenset("script style template noscript iframe svg math object select textarea head title audio video canvas".split())
RAW = frozenset("script style textarea title".split())
BLOCKS = frozenset(
    "html body div section article main nav header footer aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption address fieldset details summary dialog menu center hr button".split()
)
#: Start tags that end an open element of these kinds, up to the nearest of the second set.
_ENDS = {
    **dict.fromkeys(BLOCKS - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "button"}, (frozenset({"p"}), frozenset({"td", "th", "li", "body"}))),
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
}
_TAGS = (
    ("#text",), ("p",), ("div",), ("section",), ("article",), ("main",), ("nav", "menu"), ("header",), ("footer", "address"), ("aside",),
    ("form", "fieldset", "button"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("h1",), ("h2", "h3", "h4", "h5", "h6"),
    ("table", "thead", "tbody", "tr", "td", "th"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body"),
)
_TAG = {name: i for i, names in enumerate(_TAGS) for name in names}
_MEANS = (
    "article content entry main post story text body copy prose page document reader",
    "nav navigation menu menubar navbar breadcrumb breadcrumbs toc pagination pager tabs skip links toolbar",
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner dfp commercial",
    "sidebar side widget widgets aside rail related recommended recommendations popular trending teaser teasers more",
    "footer foot bottom copyright colophon legal contentinfo credits imprint",
    "header head masthead top branding logo topbar site",
    "comment comments reply replies respond discussion disqus thread reader feedback review",
    "cookie cookies consent notice notices alert alerts gdpr modal popup overlay warning message announcement privacy",
    "form login signin signup subscribe newsletter search register contact input poll survey donate",
    "share sharing social follow author byline meta tags tag rating print tools",
)
_MEANING = {word: 1 << i for i, words in reversed(list(enumerate(_MEANS))) for word in words.split()}
_KINDS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "footer": 2, "header": 3, "aside": 4, "form": 5}


@dataclass
class Page:
    """Nodes in page order, so that a node's subtree is the stretch up to ``end``; text runs are the leaves."""

    tag: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    means: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)


def _meaning(attributes: str) -> int:
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for word in _WORD.findall(m[1] or m[2] or m[3] or ""):
            found |= _MEANING.get(word.lower(), 0)
    return found


def read(html: str) -> Page:
    """The page's nodes; never fails, whatever the markup."""
    page = Page()
    stack: list[tuple[str, int]] = []  # open elements and their nodes, -1 for inline ones
    parts: list[str] = []
    state = {"linked": 0, "links": 0, "inputs": 0}
    silent: list[str] = []

    def add(tag: str, attributes: str, text: str | None) -> int:
        i = len(page.tag)
        up = next((node for _, node in reversed(stack) if node >= 0), -1)
        page.tag.append(_TAG.get(tag, len(_TAGS)))
        page.parent.append(up)
        page.end.append(i + 1)
        page.depth.append(page.depth[up] + 1 if up >= 0 else 0)
        page.means.append(_meaning(attributes) if attributes else 0)
        page.above.append(page.above[up] | page.means[up] if up >= 0 else 0)
        kind = 1 << _KINDS[tag] if tag in _KINDS else 0
        page.kinds.append((page.kinds[up] if up >= 0 else 0) | kind)
        page.chars.append(len(text) if text else 0)
        page.linked.append(min(state["linked"], len(text)) if text else 0)
        page.stops.append(sum(map(text.count, ".!?,;")) if text else 0)
        page.inputs.append(0)
        page.texts.append(text)
        page.marks.append(attributes)
        return i

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if text:
            add("#text", "", text)
        state["linked"] = 0

    def close(upto: int) -> None:
        for tag, node in stack[upto:]:
            if tag == "a":
                state["links"] -= 1
            if node >= 0:
                page.end[node] = len(page.tag)
        del stack[upto:]

    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        m = _TOKEN.match(html, less) if less >= 0 else None
        if less < 0:
            less = n
        if less > at and not silent:
            parts.append(html[at:less])
            if state["links"] > 0:
                state["linked"] += less - at
        if m is None:
            if less < n and not silent:
                parts.append("<")
            at = less + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if silent:
                if tag == silent[-1]:
                    silent.pop()
                continue
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag in BLOCKS:
                flush()
            if found >= 0 and (tag in BLOCKS or not any(node >= 0 for _, node in stack[found:])):
                close(found)
            continue
        tag, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if not tag:
            continue
        if silent and not (tag == "body" and silent[-1] == "head"):
            if tag == silent[-1] and tag not in RAW and not attributes.endswith("/"):
                silent.append(tag)
            elif tag in RAW:
                at = _after(html, tag, at)
            continue
        silent.clear()
        if tag in SILENT:
            if tag in RAW:
                at = _after(html, tag, at)
            elif not attributes.endswith("/"):
                silent.append(tag)
            continue
        if tag == "br":
            flush()
        elif tag in ("input", "img") and tag == "input":
            up = next((node for _, node in reversed(stack) if node >= 0), -1)
            if up >= 0:
                page.inputs[up] += 1
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            ends, until = _ENDS.get(tag, (frozenset(), frozenset()))
            lowest = len(stack)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in ends:
                    lowest = i
            close(lowest)
            stack.append((tag, add(tag, attributes, None)))
        else:
            if tag == "a":
                state["links"] += 1
            stack.append((tag, -1))
    flush()
    close(0)
    return page


def _after(html: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
    return m.end() if m else len(html)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of the pages, one after another, and the characters of each subtree."""
    sizes = [len(p.tag) for p in pages]
    base = np.cumsum([0, *sizes])
    join = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
    n = int(base[-1])
    own = np.repeat(np.arange(len(pages)), sizes)
    at = np.arange(n)
    end = join("end") + base[own]
    parent = join("parent")
    top = parent < 0
    up = np.where(top, at, parent + base[own])
    tag, means, above, kinds = join("tag"), join("means"), join("above"), join("kinds")

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return (sums[end] - sums[at]).astype(float)

    chars = join("chars")
    sums = np.concatenate([[0], np.cumsum(chars)])
    whole = (sums[base[1:]] - sums[base[:-1]])[own].astype(float) + 1
    text, linked, stops, inputs = below(chars), below(join("linked")), below(join("stops")), below(join("inputs"))
    tags = below(np.ones(n))
    siblings = np.bincount(up, minlength=n)[up].astype(float)
    sibling_chars = np.bincount(up, text, minlength=n)[up]
    kin = tag + up * (len(_TAGS) + 1)
    order = np.unique(kin, return_inverse=True, return_counts=True)
    alike = order[2][order[1]] / siblings
    density = linked / (text + 1)
    columns = [
        *[(tag == i).astype(float) for i in range(len(_TAGS) + 1)],
        *[(means >> i & 1).astype(float) for i in range(len(_MEANS))],
        *[(above >> i & 1).astype(float) for i in range(len(_MEANS))],
        *[(kinds >> i & 1).astype(float) for i in range(6)],
        join("depth").astype(float),
        np.log1p(text),
        density,
        text / tags,
        text / whole,
        (sums[at] - sums[base[:-1]][own]) / whole,
        (sums[base[1:]][own] - sums[end]) / whole,
        siblings,
        text / (sibling_chars + 1),
        alike,
        stops / (text + 1),
        np.log1p(below((tag == _TAG["p"]).astype(np.int64))),
        np.log1p(below((tag == _TAG["li"]).astype(np.int64))),
        inputs,
        text / np.maximum(below((chars > 0).astype(np.int64)), 1),
        np.minimum(below(np.isin(tag, (_TAG["article"], _TAG["main"])).astype(np.int64)), 2),
        np.minimum(below((tag == _TAG["h1"]).astype(np.int64)), 2),
        below(np.isin(tag, (_TAG["nav"], _TAG["footer"], _TAG["aside"], _TAG["form"])).astype(np.int64)),
        below((means >> 1 > 0).astype(np.int64)),
        density[up],
        (text / tags)[up],
        np.log1p(text)[up],
    ]
    return np.stack(columns, axis=1), text
