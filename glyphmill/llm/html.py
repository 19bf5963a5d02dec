"""HTML extraction by a tree-structured graphical model.

A page becomes a tree of elements and text. Each node is content or not; a node's own evidence
(tag, names in its class, id and role attributes, length, share of linked text, place) gives
its unary potential, and each edge a parent-child potential, also by kind of tag. Messages go
up from the leaves and down from the root once (sum-product, exact on a tree); what is left at
a node is the marginal probability that it is content. Unary and pairwise weights are trained
from labelled pages by gradient descent on the likelihood of the labels, whose gradient is the
difference between labelled and expected features under those same marginals.

Text nodes whose marginal is at least one half are the main text, in page order; blocks end at
block elements. Scripts, styles, comments and the like never are text.

Defined results: null and empty html give an empty text; broken markup is read on as far as it
goes (unclosed elements end with their parents); a page without content gives an empty text.
"""

from __future__ import annotations

import html as entities
import re
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# -- fixed values: what HTML says about elements
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption option select button legend".split()
)
P_ENDS = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "button", "select"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("table td th div ul ol article section aside nav header footer main form body blockquote".split())
HELD = frozenset("p b i a u s span em strong li small big font sub sup code tt abbr cite q mark label h1 h2 h3 h4 h5 h6 dt dd option button".split())

#: Kinds of tag; a node's features and its edge are by kind.
KINDS = {
    "article": "main", "main": "main", "nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "button": "form", "select": "form", "option": "form",
    "label": "form", "fieldset": "form", "dialog": "side", "legend": "form",
    "p": "para", "blockquote": "para", "pre": "para", "figcaption": "para", "h1": "title", "h2": "title", "h3": "title", "h4": "title", "h5": "title", "h6": "title",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "dd": "item", "dt": "item", "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "a": "link",
    "#": "text", "body": "body", "html": "body", "figure": "para", **dict.fromkeys("b i u s em strong span small big font sub sup code tt abbr cite q mark".split(), "inline"),
}
#: Parts of class, id and role values that speak for or against content.
AGAINST = {
    "menu": ("nav", "menu", "breadcrumb", "toc", "pager", "pagination", "toolbar", "tabs"),
    "advert": ("ad", "ads", "advert", "adv", "sponsor", "promo", "banner", "adsense", "advertisement", "sponsored", "outbrain", "taboola"),
    "edge": ("footer", "header", "masthead", "copyright", "legal", "bottom", "topbar"),
    "side": ("sidebar", "aside", "widget", "related", "recommend", "recommended", "share", "social", "tags", "meta", "author", "trending", "popular"),
    "notice": ("cookie", "consent", "notice", "popup", "modal", "alert", "newsletter", "subscribe", "signup", "login", "gdpr", "overlay", "paywall"),
    "reply": ("comment", "comments", "reply", "replies", "disqus", "discussion", "respond", "feedback"),
}
FOR = ("article", "content", "post", "entry", "story", "body", "text", "main", "prose")
_WORD_OF = {w: k for k, ws in AGAINST.items() for w in ws} | {w: "for" for w in FOR}

#: A list word may be a whole class or id, or a part of a longer one ("market-share"), which says less.
FEATURES = ["bias", *sorted(set(KINDS.values()) | {"other"}), *AGAINST, "for", *(f"{k}-" for k in (*AGAINST, "for")), "short", "long", "linked", "hidden", "stop", "most", "rich", "replies"]
_F = {n: i for i, n in enumerate(FEATURES)}
KIND_NAMES = sorted(set(KINDS.values()) | {"other"})
_K = {n: i for i, n in enumerate(KIND_NAMES)}

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPLIT = re.compile(r"[^a-z]+")
#: What stands above the comments of readers.
_REPLIES = re.compile(r"\W*(\d+\s+)?(reader\s+|user\s+)?(comments?|repl(y|ies)|responses?)(\s*\(?\d+\)?)?\W*", re.I)
_STOP = frozenset(".!?:;…")
_SPACE = re.compile(r"\s+")


def tokens(source: str):
    """(text before, whether it is an end tag, tag or "", attributes, whether it ends in itself), in page order and in linear time.

    A tag ends at the first > outside quotes; a quote counts if a space, / or > follows its end, so an unclosed one
    does not take in what comes after. A tag that never ends takes in the rest. What is inside raw elements is left out.
    """
    at, n = 0, len(source)
    ahead: dict[str, int] = {}

    def find(what: str, start: int) -> int:
        """Like source.find, n if there is none; what was found stays known, so nothing is searched twice."""
        known = ahead.get(what, -1)
        if known < start:
            known = source.find(what, start)
            ahead[what] = known = n if known < 0 else known
        return known

    lower = None
    begin = 0
    while True:
        lt = find("<", at)
        if lt >= n:
            if begin < n:
                yield source[begin:], False, "", "", False
            return
        mark = source[lt + 1 : lt + 2]
        if source.startswith("<!--", lt):
            stop = find("-->", lt + 4) + 3
        elif source.startswith("<![CDATA[", lt):
            stop = find("]]>", lt + 9) + 3
        elif mark in ("!", "?"):
            stop = find(">", lt + 2) + 1
        else:
            m = _TAG.match(source, lt + 1 + (mark == "/"))
            if not m:
                at = lt + 1  # a lone < is text
                continue
            k = find(">", m.end())
            quote = m.end()
            while True:
                quote = min(find('"', quote), find("'", quote))
                if quote >= k:
                    break
                close = find(source[quote], quote + 1) if source[max(m.end(), quote - 3) : quote].rstrip()[-1:] == "=" else n
                if close < n and source[close + 1 : close + 2] in (" ", "\t", "\n", "\r", "\f", "/", ">", ""):
                    quote = close + 1
                    k = find(">", quote) if k < quote else k
                else:
                    quote += 1
            name, attrs = m[0].lower(), source[m.end() : k]
            yield source[begin:lt], mark == "/", name, attrs, attrs.endswith("/")
            at = begin = min(n, k + 1)
            if name in RAW and mark != "/":
                lower = source.lower() if lower is None else lower
                if len(lower) != n:
                    lower = "".join(c.lower() if c.isascii() else c for c in source)
                end = f"</{name}"
                known = ahead.get(end, -1)
                if known < at:
                    known = lower.find(end, at)
                    ahead[end] = known = n if known < 0 else known
                at = begin = min(n, find(">", known) + 1) if known < n else n
            continue
        if begin < lt:
            yield source[begin:lt], False, "", "", False
        at = begin = min(n, stop)


class Tree:
    """Nodes in page order: parent, tag, attributes, and the raw text of text nodes."""

    __slots__ = ("parent", "tag", "attrs", "text")

    def __init__(self, source: str):
        self.parent, self.tag, self.attrs, self.text = [-1], ["#root"], [""], [""]
        open_ = [0]
        where: dict[str, list[int]] = {}  # for each tag the places in open_ where it is open
        stops = [0]  # the places in open_ that hold back the end of what is outside them

        def cut_to(k: int) -> None:
            while len(open_) > k:
                t = self.tag[open_.pop()]
                where[t].pop()
                if t in STOPS:
                    stops.pop()

        for text, closing, name, attrs, whole in tokens(source):
            if text:
                self._add(open_[-1], "#", "", " " if text.isspace() else text)
            if not name:
                continue
            at = where.get(name)
            if closing:
                # an inline element, a paragraph or an item does not end what stands around it
                if at and (at[-1] > stops[-1] or name not in HELD):
                    cut_to(at[-1])
                continue
            ends = max((where[t][-1] for t in (*SAME_ENDS.get(name, ()), *(("p",) if name in P_ENDS else ())) if where.get(t)), default=-1)
            if ends >= stops[-1] > 0 or ends > 0 and not stops[-1]:
                cut_to(ends)
            node = self._add(open_[-1], name, attrs, "")
            if name not in RAW and name not in VOID and not whole:
                where.setdefault(name, []).append(len(open_))
                if name in STOPS:
                    stops.append(len(open_))
                open_.append(node)

    def ends(self) -> list[int]:
        """For each node the number after its last descendant's."""
        out = [i + 1 for i in range(len(self.parent))]
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] = max(out[self.parent[i]], out[i])
        return out

    def _add(self, parent: int, tag: str, attrs: str, text: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        return len(self.parent) - 1


_SEEN: dict[tuple, tuple[tuple[int, ...], int]] = {}


def _traits(tag: str, attrs: str, *on: bool) -> tuple[tuple[int, ...], int]:
    """The features that hold for such a node, by number, and its kind; on: those of _MEASURED."""
    kind = KINDS.get(tag, "other")
    found = {0, _F[kind]}
    for name, a, b, c in _ATTR.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            for one in (a or b or c).lower().split():
                whole = one in _WORD_OF
                found.update(_F[_WORD_OF[w] if whole else f"{_WORD_OF[w]}-"] for w in ((one,) if whole else _SPLIT.split(one)) if w in _WORD_OF)
        elif name in ("hidden", "aria-hidden") or name == "style" and "none" in (a or b or c):
            found.add(_F["hidden"])
    found.update(_F[n] for n, is_ in zip(_MEASURED, on) if is_)
    return tuple(sorted(found)), _K[kind]


_MEASURED = ("short", "long", "linked", "stop", "most", "rich", "replies")


def evidence(tree: Tree) -> tuple[list[tuple[int, ...]], list[int]]:
    """The features that hold for each node, and its kind."""
    parent, tags, attrs, texts = tree.parent, tree.tag, tree.attrs, tree.text
    n = len(parent)
    total, linked, longs, first = [0] * n, [0] * n, [0] * n, [n] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if tags[i] == "#":
            total[i] = len(texts[i]) if texts[i] != " " else 0
            longs[i] = total[i] > 80
            first[i] = i if total[i] else n
        elif tags[i] == "a":
            linked[i], longs[i] = total[i], 0
        total[p] += total[i]
        linked[p] += linked[i]
        longs[p] += longs[i]
        if first[i] < first[p]:
            first[p] = first[i]
    # what begins with a heading over the comments of readers, as far as it is no main element
    replies = set()
    for i in range(1, n):
        if tags[i] == "#" and total[i] < 40 and _REPLIES.fullmatch(texts[i]):
            j = i
            for _ in range(3):
                j = parent[j]
                if j <= 0 or first[j] != i or KINDS.get(tags[j]) in ("main", "body"):
                    break
                replies.add(j)
    held, kind = [], []
    if len(_SEEN) > 50_000:
        _SEEN.clear()
    for i in range(n):
        size = total[i]
        text = tags[i] == "#"
        key = (tags[i], attrs[i], size < 25, size > 120, linked[i] > 0.5 * size, texts[i].rstrip()[-1:] in _STOP, not text and size > 0.6 * total[0], not text and longs[i] > 1, i in replies)
        one = _SEEN.get(key)
        if one is None:
            one = _traits(*key)
            if len(key[1]) < 200:
                _SEEN[key] = one
        held.append(one[0])
        kind.append(one[1])
    return held, kind


def _score(held: list[tuple[int, ...]], w: list[float]) -> list[float]:
    known: dict[tuple[int, ...], float] = {}
    out = []
    for h in held:
        s = known.get(h)
        if s is None:
            s = known[h] = sum([w[j] for j in h])
        out.append(s)
    return out


def messages(parent: list[int], score: list[float], kind: list[int], edge: list, pairs: bool = False):
    """Sum-product on a tree whose nodes come after their parents, in ratios of content to not.

    score[i]: log potential of content against not; edge[k]: the potentials of a child of kind
    k as (00, 01, 10, 11), parent's state first. Returns the log odds of content of each node
    and, if asked, the pair marginals of each edge.
    """
    n = len(parent)
    inside = list(score)
    sent = [0.0] * n
    for i in range(n - 1, 0, -1):  # upward
        e = edge[kind[i]]
        q = exp(min(60.0, max(-60.0, inside[i])))
        sent[i] = m = log((e[2] + e[3] * q) / (e[0] + e[1] * q))
        inside[parent[i]] += m
    total = inside[:]
    pair = [(1.0, 0.0, 0.0, 0.0)] * n if pairs else None
    for i in range(1, n):  # downward
        e = edge[kind[i]]
        q = exp(min(60.0, max(-60.0, total[parent[i]] - sent[i])))
        total[i] = inside[i] + log((e[1] + e[3] * q) / (e[0] + e[2] * q))
        if pairs:
            own = exp(min(60.0, max(-60.0, inside[i])))
            a, b, c, d = e[0], e[1] * own, e[2] * q, e[3] * q * own
            s = a + b + c + d
            pair[i] = (a / s, b / s, c / s, d / s)
    return total, pair


# -- labelled pages ------------------------------------------------------------------------

_TEXTS = (
    "The river rose during the night and by morning the lower meadows were under water as far as the mill. Nobody had expected it so early in the year.",
    "Her report on the harvest covers twelve counties, compares yields with the decade before, and ends with a short list of proposals for the council.",
    "Short closing line.",
    "They met.",
    "So it was.",
    "The.",
    "Not of them all.",
    "In the second part we describe how the bridge was measured, which instruments were used and why the first readings had to be thrown away, and we give the corrected figures in a table at the end of the article.",
    "Prices fell again, though less than in spring; traders blame the weather, and the weather service blames the traders for reading only the headline of its forecasts.",
)
_SHORT = ("Home", "About us", "Read more", "Contact", "All rights reserved.", "Sign in", "Next page", "Terms of use", "The", "of")


def labelled_pages(n: int = 400) -> list[str]:
    """Training pages by rule. Content is wrapped in <x-c>, which the reader of labels takes out."""
    rng = np.random.default_rng(11)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    maybe = lambda p: rng.random() < p
    para = lambda: pick(_TEXTS) + (" " + pick(_TEXTS) if maybe(0.4) else "")
    links = lambda k: "".join(f'<li><a href="/{i}">{pick(_SHORT)}</a></li>' for i in range(k))
    c = lambda s: f"<x-c>{s}</x-c>"
    plain = lambda: pick(("", "", " class=x", ' class="col-8"', " id=page", ' class="wrapper"', " class=inner"))

    # class words that speak against content, on content: as a part of a longer name, seldom whole
    topic = lambda: pick(("market", "data", "time", "author", "page", "long", "group", "law", "x"))
    against = lambda: pick([w for k in AGAINST for w in AGAINST[k] if k != "notice" or maybe(0.3)])
    odd = lambda: pick((f"{topic()}-{against()}", f"{against()}-{topic()}", f"{topic()}-on-the-{against()}", f"has-{against()}"))
    heading = lambda: pick(("3 Comments", "Comments", "12 comments", "Comments (4)", "Replies", "2 responses", "1 reply"))

    def block() -> str:
        if maybe(0.06):
            tag = pick(("section", "div"))
            return c(f'<{tag} class="{odd() if maybe(0.8) else pick(("discussion", "meta", "share", "tags", "legal"))}"><h2>{pick(_TEXTS)[:30]}</h2><p>{para()}</p><p>{para()}</p></{tag}>')
        if maybe(0.03):
            return "<template><p>" + pick(_TEXTS) + "</p></template>"
        kind = rng.random()
        if kind < 0.48:
            return c(f"<p>{para()}</p>" if maybe(0.6) else f"<p><b>{para()}<br>" if maybe(0.3) else f"<div{plain()}>{para()}</div>" if maybe(0.4) else f"<p>{para()} <a href='/x'>{pick(_SHORT)}</a> {pick(_TEXTS)}</p>")
        if kind < 0.56:
            return c(f"<{pick(('h2', 'h3', 'h4'))}>{pick((pick(_TEXTS)[:30], pick(_SHORT)))}</h2>")
        if kind < 0.64:
            return c("<ul>" + "".join(f"<li>{pick((pick(_TEXTS), pick(_SHORT)))}</li>" for _ in range(3)) + "</ul>")
        if kind < 0.70:
            return c(f"<{(k := pick(('ul', 'ol')))}>{links(int(rng.integers(2, 5)))}</{k}>")
        if kind < 0.74:
            return c(f"<blockquote><p>{para()}</p></blockquote>")
        if kind < 0.78:
            return c(f"<table><tr><td>{pick(_SHORT)}</td><td>{pick(_TEXTS)}</td></tr><tr><td>{pick(_SHORT)}<td>{pick(_SHORT)}</table>")
        if kind < 0.80:
            return c(f"<pre>{pick(_TEXTS)}</pre>")
        if kind < 0.83:
            return c(f"<figure><img src=x><figcaption>{pick(_TEXTS)[:40]}</figcaption></figure>")
        if kind < 0.85:
            return c(f"<dl><dt>{pick(_SHORT)}</dt><dd>{para()}</dd></dl>")
        if kind < 0.90:
            return f'<div class="{pick(("ad", "advert", "ad-slot", "sponsored", "promo-box"))}">{para()}</div>'
        if kind < 0.93:
            return f'<aside{pick(("", " class=related"))}><p>{para()}</p></aside>'
        if kind < 0.97:
            return f'<div class="{pick(("share", "social-links", "newsletter-signup", "author-meta", "related-posts"))}"><p>{pick(_TEXTS)}</p></div>'
        return f"<form><label>{pick(_SHORT)}</label><p>{pick(_TEXTS)}</p><button>{pick(_SHORT)}</button></form>"

    pages = []
    for _ in range(n):
        title = c(f"{pick(('<h1>', '<h1 class=\"title\">'))}{pick(_TEXTS)[:60]}</h1>") if maybe(0.7) else ""
        body = title + (c(pick((f"<p>{para()}</p>", f"<p><b>{para()}<br>", f"<p><b>{para()}</b> {para()}", f"{para()}<br><i>{para()}</i>"))) if maybe(0.3) else "".join(block() for _ in range(int(rng.integers(0, 9)))))
        body = body or c(f"<p>{para()}</p>")
        if maybe(0.06):  # little text, with an advert or a template beside it
            few = c(f"<p>{pick(_TEXTS)}</p>")
            body = pick((f'<div class="{pick(("ad", "advert", "ads"))}">{pick(_SHORT)} {pick(_TEXTS)}</div>{few}', f"{few}<template><p>{pick(_SHORT)}</p></template>{c(f'<p>{pick(_TEXTS)}</p>')}"))
        wrap = rng.random()
        frame = (
            f"<article>{body}</article>" if wrap < 0.4 else f"<main>{body}</main>" if wrap < 0.52 else f'<div class="{pick(("content", "post-body", "entry-content", "article-text", "site-content", "main-column"))}">{body}</div>' if wrap < 0.7
            else f'<main><article class="post">{body}</article></main>' if wrap < 0.8 else f"<section{plain()}>{body}</section>" if wrap < 0.88 else f"<div{plain()}>{body}</div>"
        )
        if maybe(0.1):
            frame = pick((f'<article id="{odd()}">{body}</article>', f'<div class="{odd()}">{body}</div>', f'<section class="{odd()}">{body}</section>', f'<main class="{odd()}">{body}</main>'))
        if maybe(0.15):
            frame = f"<div{plain()}>{frame}</div>"
        if maybe(0.12):  # a fragment without anything around it
            pages.append(frame if maybe(0.7) else f"<html><body>{frame}")
            continue
        out = "<!DOCTYPE html><html><head><title>x</title><style>p{}</style><script>var t='</p>'</script></head><body>"
        out += f"<nav><ul>{links(int(rng.integers(2, 8)))}</ul></nav>" if maybe(0.6) else f'<div class="{pick(("menu", "nav-bar", "breadcrumb", "topbar"))}"><ul>{links(4)}</ul></div>' if maybe(0.6) else f"<div{plain()}><ul>{links(int(rng.integers(4, 9)))}</ul></div>" if maybe(0.3) else ""
        out += f"<header><h1>{pick(_SHORT)}</h1><p>{para()}</p></header>" if maybe(0.35) else f'<div id="header">{pick(_TEXTS)}</div>' if maybe(0.15) else ""
        out += f'<div class="{pick(("ad", "ads", "banner", "cookie-notice", "cookie-banner", "alert", "consent", "popup"))}">{pick(("<p>%s</p>", "%s")) % para()}</div>' if maybe(0.6) else ""
        out += f'<div role="{pick(("alert", "banner"))}">{para()}</div>' if maybe(0.1) else ""
        shell = pick((f'<div class="{odd()}">', f'<div id="{odd()}">', '<form id="aspnetForm" method=post>', "<form>")) if maybe(0.2) else ""
        if shell:
            at = out.index("<body>") + 6
            out = out[:at] + shell + out[at:]
        out += frame
        out += f'<{pick(("aside", "div class=sidebar", "div id=sidebar", "section class=widget"))}><h3>{pick(_SHORT)}</h3>' + pick((f"<p>{para()}</p>", f"<ul>{links(4)}</ul>")) if maybe(0.5) else "<div class=x>" if maybe(0.2) else "<div>"
        out += "</aside></section></div>"
        if maybe(0.45):
            replies = [pick((f'<div class="comment"><p>{para()}</p></div>', f"<article><p>{para()}</p></article>", f'<li class="comment"><p>{para()}</p></li>', f"<p>{para()}</p>")) for _ in range(int(rng.integers(1, 4)))]
            out += f'<{pick(("section", "div", "ol"))} {pick(("class=comments", "id=comments", "class=\"comment-list\"", "id=disqus_thread", "class=replies", "id=c", "class=box", ""))}><h3>{heading()}</h3>' + "".join(replies) + "</ol></section></div>"
        out += f'<form class="{pick(("login", "search", "subscribe"))}"><p>{pick(_TEXTS)}</p><button>{pick(_SHORT)}</button></form>' if maybe(0.3) else ""
        out += pick((f"<footer>&copy; {pick(_SHORT)} &middot; {para()}</footer>", f"<footer><p>{para()}</p></footer>", f'<div class="footer"><p>{para()}</p></div>', f"<footer><ul>{links(3)}</ul><p>{pick(_SHORT)}</p></footer>", ""))
        pages.append(out + ("</form></div>" if shell else "") + "</body></html>")
    return pages


def _labels(tree: Tree) -> tuple[Tree, np.ndarray]:
    """The tree without the marking elements, and which nodes are content (what leads to it, too)."""
    keep = [i for i in range(len(tree.tag)) if tree.tag[i] != "x-c"]
    new = {i: j for j, i in enumerate(keep)}
    inside = [False] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        inside[i] = inside[tree.parent[i]] or tree.tag[i] == "x-c"
    out = Tree("")
    out.parent, out.tag, out.attrs, out.text = [], [], [], []
    for i in keep:
        p = tree.parent[i]
        while p >= 0 and tree.tag[p] == "x-c":
            p = tree.parent[p]
        out.parent.append(new.get(p, -1))
        out.tag.append(tree.tag[i])
        out.attrs.append(tree.attrs[i])
        out.text.append(tree.text[i])
    y = np.array([inside[i] for i in keep])
    has = y.copy()
    for i in range(len(keep) - 1, 0, -1):  # what holds content is on its side
        if has[i]:
            has[out.parent[i]] = True
    return out, has


_MODEL: dict[str, tuple[list[float], list]] = {}


def train(pages: list[str], steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights and, for each kind of child, a 2 x 2 table of log potentials; RMS-scaled ascent."""
    data = []
    for page in pages:
        tree, y = _labels(Tree(page))
        held, kind = evidence(tree)
        x = np.zeros((len(held), len(FEATURES)))
        for i, h in enumerate(held):
            x[i, list(h)] = 1
        data.append((tree.parent, x, np.array(kind), y.astype(int)))
    w, e = np.zeros(len(FEATURES)), np.zeros((len(KIND_NAMES), 2, 2))
    sw, se = np.full_like(w, 1e-8), np.full_like(e, 1e-8)
    for step in range(steps):
        gw, ge, n = -0.002 * w, -0.002 * e, 0
        gw, ge = gw * len(data), ge * len(data)
        table = np.exp(e).reshape(-1, 4).tolist()
        for parent, x, kind, y in data:
            odds, pair = messages(parent, (x @ w).tolist(), kind.tolist(), table, pairs=True)
            gw += x.T @ (y - 1 / (1 + np.exp(-np.clip(odds, -60, 60))))
            gold = np.zeros((len(parent), 4))
            gold[np.arange(1, len(parent)), 2 * y[np.asarray(parent)[1:]] + y[1:]] = 1
            np.add.at(ge, kind[1:], (gold - np.array(pair))[1:].reshape(-1, 2, 2))
            n += len(parent)
        sw, se = 0.9 * sw + 0.1 * (gw / n) ** 2, 0.9 * se + 0.1 * (ge / n) ** 2
        rate = 0.3 / (1 + step / 20)
        w = w + rate * gw / n / np.sqrt(sw + 1e-8)
        e = e + rate * ge / n / np.sqrt(se + 1e-8)
    return w, e


def model() -> tuple[list[float], list]:
    """Unary weights, and for each kind of child the potentials (00, 01, 10, 11)."""
    if "html" not in _MODEL:
        w, e = train(labelled_pages())
        _MODEL["html"] = w.tolist(), np.exp(e).reshape(-1, 4).tolist()
    return _MODEL["html"]


def main_text(source: str | None, w: list[float], e: list) -> str:
    """The main text; w and e as from model()."""
    if not source:
        return ""
    tree = Tree(source)
    held, kind = evidence(tree)
    odds = messages(tree.parent, _score(held, w), kind, e)[0]
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    inside: list[int] = []  # open block elements
    end = tree.ends()
    for i in range(1, len(tree.tag)):
        while inside and end[inside[-1]] <= i:
            inside.pop()
            close()
        if tree.tag[i] == "#":
            if odds[i] >= 0 or tree.text[i] == " " and line:
                line.append(tree.text[i])
        elif tree.tag[i] in BLOCKS:
            close()
            inside.append(i)
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    w, e = model()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def run(batches):
        for batch in slices(batches, 500):
            text = [main_text(h, w, e) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema[0].dataType.simpleString()}, url {rows.schema[1].dataType.simpleString()}, text string, n_chars long")
