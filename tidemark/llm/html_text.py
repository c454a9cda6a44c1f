"""Main text of web pages by gradient-boosted trees over DOM-node features.

A page is tokenised once and built into a tree of blocks; each block gets
features (tag, attribute tokens, depth, place among its siblings, subtree
density, links) and trees give the log-odds that it holds main text.  Decoding
is hierarchical: a block ruled out takes its whole subtree with it, and the
best consistent labelling of the page is found by one bottom-up sweep, so that
no ancestor contradicts a descendant.

The model is fitted on :data:`FIT_PAGES` pages that a generator composes here
(the bound of the fit); nothing of the tables is used for it.
Defined cases: null and empty pages, and pages without main text, give the
empty text; unclosed and stray tags are closed as browsers do; a tag that the
page's end cuts off is dropped.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 1_500
ROUNDS, DEPTH, BINS, RATE = 50, 4, 32, 0.25

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas audio video select textarea title head".split())
#: Attributes that end in a value without quotes, to which a last slash belongs.
_UNQUOTED = re.compile(r"=\s*[^\s\"']*/\Z")
RAW_TEXT = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul button label caption".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An open element of these is ended by the start of one of the others, unless one of the last stands between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("td th table button html body caption".split())
# What attribute tokens (class, id, role, ...) commonly mean.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip topbar toolbar",
    "head": "header masthead banner brand logo top hero sitehead",
    "foot": "footer foot bottom copyright legal colophon sitefoot contentinfo",
    "side": "sidebar aside side rail widget widgets complementary secondary related recommended recirc trending popular more read also",
    "ad": "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted outbrain taboola dfp banner",
    "notice": "cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay paywall toast privacy warning",
    "form": "form search login signup signin subscribe subscription newsletter register contact feedback input field poll survey",
    "comment": "comment comments commentlist reply replies respond disqus discussion responses reader readers thread",
    "share": "share sharing social follow like tweet facebook twitter buttons toolbox author byline meta tags tag",
    "main": "article content main post entry story text body page maincontent copy prose articlebody hentry primary detail",
    "hidden": "hidden invisible offscreen none sr screenreader visuallyhidden",
}
_GROUP = {t: k for k, ts in enumerate(TOKENS.values()) for t in ts.split()}
_TAGS = ["nav menu", "header hgroup", "footer address", "aside", "form fieldset button label input option search dialog details", "article", "main", "section", "div center", "p pre blockquote figure figcaption", "h1 h2 h3 h4 h5 h6", "ul ol dl dir", "li dt dd", "table tbody thead tfoot tr td th caption", "html body"]
_TAG = {t: k for k, ts in enumerate(_TAGS) for t in ts.split()}
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*?)(?:>|\Z)|<!\[CDATA\[", re.DOTALL)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop|rel|name)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
N_FEATURES = len(_TAGS) + 2 * len(TOKENS) + 16


class Block:
    __slots__ = ("chars", "children", "groups", "kids", "link", "parent", "stops", "tag", "texts")

    def __init__(self, tag: str, parent: Block | None, groups: frozenset):
        self.tag, self.parent, self.groups = tag, parent, groups
        #: Runs of text and blocks in page order.
        self.children: list = []
        self.chars = self.link = self.stops = self.kids = 0


def _groups(attrs: str) -> frozenset:
    out = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            out.add(_GROUP["hidden"])
        elif name not in ("style", "aria-hidden"):
            out.update(_GROUP[t] for t in map(str.lower, _SPLIT.split(value)) if t in _GROUP)
    return frozenset(out)


_NONE: frozenset = frozenset()


def parse(page: str) -> Block:
    """The page's tree of blocks; inline elements are part of their block's text."""
    root = now = Block("html", None, _NONE)
    stack: list[tuple[str, Block | None]] = [("html", root)]  # open elements; a block's, or None for inline ones
    places: dict[str, list[int]] = {}  # of each tag the places of its open elements in the stack, but the root's
    endless: set[str] = set()  # raw elements that nothing ends from here on
    at, size, link = 0, len(page), 0

    def text(run: str) -> None:
        run = entities.unescape(run)
        now.children.append(run)
        n = len(run) - run.count(" ")
        now.chars += n
        now.link += n if link else 0
        now.stops += run.count(".") + run.count(",")

    def pop_to(k: int) -> None:
        nonlocal now, link
        while len(stack) > k:
            tag, block = stack.pop()
            places[tag].pop()
            link -= tag == "a"
            if block is not None:
                now = block.parent

    def find(tags, stops) -> int:
        """The place of the innermost open element of ``tags``, unless one of ``stops`` is further in; else 0."""
        inmost = lambda some: max((p[-1] for t in some if (p := places.get(t))), default=0)
        k = inmost(tags)
        return k if k >= inmost(stops) else 0

    def push(tag: str, block: Block | None) -> None:
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, block))

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        if not m[0].endswith(">"):
            break  # the page ends inside a tag
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                now.children.append(" ")
            elif tag == "p" and not find(("p",), SCOPE):
                now.children.append(" ")
            elif tag not in ("html", "body") and (k := find((tag,), ("table",) if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") and tag in BLOCK and tag != "div" else ())):
                pop_to(k)
            continue
        if tag in ("svg", "math") and m[3].endswith("/") and not _UNQUOTED.search(m[3]):
            continue
        if tag in RAW and tag != "head":
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if end:
                at = end.end()
            elif tag in RAW_TEXT:
                break
            else:
                endless.add(tag)
            continue
        if tag in ("html", "head", "body") or tag in VOID:
            if tag in ("br", "hr", "img"):
                now.children.append(" " if tag != "img" else "")
            if tag == "body":
                now.groups |= _groups(m[3])
            continue
        if tag in ENDS_P and (k := find(("p",), SCOPE)):
            pop_to(k)
        if tag in IMPLIED and (k := find(*IMPLIED[tag])):
            if tag == "tr":
                k = find(("tr",), ("table",)) or k
            pop_to(k)
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            block = Block(tag, now, _groups(m[3]) if m[3] else _NONE)
            now.children.append(block)
            now = block
            push(tag, block)
        else:
            link += tag == "a"
            push(tag, None)
    return root


def walk(root: Block) -> list[Block]:
    """All blocks, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        b = todo.pop()
        out.append(b)
        todo.extend(x for x in reversed(b.children) if type(x) is Block)
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block of a page, in the order of :func:`walk`."""
    n = len(blocks)
    number = {id(b): k for k, b in enumerate(blocks)}
    out = np.zeros((n, N_FEATURES), np.float32)
    parent = np.array([number[id(b.parent)] if b.parent is not None else -1 for b in blocks])
    own = np.array([(b.chars, b.link, b.stops) for b in blocks], float)
    total = np.column_stack([own, np.ones(n), [b.tag in ("p", "pre", "blockquote") for b in blocks], own[:, 0]])
    depth, place, siblings = np.zeros(n), np.zeros(n), np.zeros(n)
    before = np.concatenate([[0], np.cumsum(own[:, 0])[:-1]])
    for k in range(n - 1, 0, -1):
        total[parent[k], :5] += total[k, :5]
        total[parent[k], 5] = max(total[parent[k], 5], total[k, 5])
        siblings[parent[k]] += 1
    seen = np.zeros(n)
    t, g = len(_TAGS), len(TOKENS)
    for k, b in enumerate(blocks):
        out[k, _TAG.get(b.tag, 8)] = 1
        for x in b.groups:
            out[k, t + x] = 1
        p = parent[k]
        if p >= 0:
            depth[k] = depth[p] + 1
            place[k] = seen[p]
            seen[p] += 1
            out[k, t + g : t + 2 * g] = np.maximum(out[p, t + g : t + 2 * g], out[p, t : t + g])
            out[k, -1] = max(out[p, -1], out[p, 5], out[p, 6])  # below an article or main
            out[k, -2] = max(out[p, -2], out[p, :5].max())  # below a nav, header, footer, aside or form
    chars, page = total[:, 0], max(total[0, 0], 1)
    up = np.maximum(parent, 0)
    rest = [
        np.log1p(chars),
        np.log1p(own[:, 0]),
        total[:, 1] / np.maximum(chars, 1),
        chars / total[:, 3],
        np.log1p(total[:, 4]),
        total[:, 2] / np.maximum(chars, 1),
        chars / page,
        before / page,
        depth,
        place,
        siblings[up],
        (place + 1) / np.maximum(siblings[up], 1),
        chars / np.maximum(chars[up], 1),
        total[:, 5] / page,
    ]
    out[:, t + 2 * g : t + 2 * g + len(rest)] = np.column_stack(rest)
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth for the logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            nodes = 2 ** (DEPTH + 1) - 1
            feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for d in range(DEPTH):
                first, width = 2**d - 1, 2**d
                local = at - first
                best = np.full(width, 1e-6)
                chosen = np.zeros((width, 2), np.int64) - 1
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    size = len(c) + 1
                    g = np.bincount(local * size + binned[:, f], grad, width * size).reshape(width, size).cumsum(1)
                    h = np.bincount(local * size + binned[:, f], hess, width * size).reshape(width, size).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = (g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1))[:, :-1]
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better] = top[better]
                    chosen[better] = np.column_stack([np.full(width, f), k])[better]
                for w in np.flatnonzero(chosen[:, 0] >= 0):
                    feature[first + w], cut[first + w] = chosen[w, 0], cuts[chosen[w, 0]][chosen[w, 1]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = 2**DEPTH - 1
            g = np.bincount(at - leaf, grad, 2**DEPTH)
            h = np.bincount(at - leaf, hess, 2**DEPTH)
            value[leaf:] = RATE * g / (h + 1)
            score += value[at]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at]
        return out


def decode(blocks: list[Block], odds: np.ndarray) -> str:
    """The text of the best labelling in which a block ruled out rules out its subtree."""
    number = {id(b): k for k, b in enumerate(blocks)}
    worth = odds.copy()  # of a kept block with the best choice below it, against the subtree ruled out
    for k in range(len(blocks) - 1, 0, -1):
        if worth[k] > 0:
            worth[number[id(blocks[k].parent)]] += worth[k]
    if worth[0] <= 0:
        return ""
    out: list[str] = []
    todo: list = [blocks[0]]
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(x)
        else:
            out.append(" ")
            todo.append(" ")
            todo.extend(c for c in reversed(x.children) if type(c) is str or worth[number[id(c)]] > 0)
    return " ".join("".join(out).split())


class Extractor:
    def __init__(self, model: Boosted):
        self.model = model

    def __call__(self, pages: list[str | None]) -> list[str]:
        trees = [walk(parse(p)) if p else [] for p in pages]
        rows = [features(b) for b in trees if b]
        if not rows:
            return [""] * len(pages)
        odds, at, out = self.model.predict(np.concatenate(rows)), 0, []
        for b in trees:
            out.append(decode(b, odds[at : at + len(b)]) if b else "")
            at += len(b)
        return out


#: Marks the main text of composed pages.
KEPT = "\ue000"


def compose(rng: random.Random, mark: str = "") -> tuple[str, str]:
    """A page of made-up words and its main text, for fitting and for tests; with
    ``mark``, that stands before the text of each of its blocks."""
    word = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", ", " + words(2, 6) + "."])
    prose = lambda a=1, b=7: " ".join(sentence() for _ in range(rng.randint(a, b)))
    kept: list[str] = []
    attr = lambda *names: "" if rng.random() < 0.12 else f' {rng.choice(["class", "class", "class", "id", "role"])}="{rng.choice(["", "", "site-", "page-", "c-", "the "])}{rng.choice(names)}{rng.choice(["", "", "-box", "-wrap", " cf", "_1"])}"'

    def inline(s: str) -> str:
        parts = s.split(" ")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(parts))
            t = rng.choice(["b", "i", "em", "strong", "a", "span", "code"])
            parts[k] = f'<{t}{" href=/x" if t == "a" else ""}>{parts[k]}</{t}>'
        return " ".join(parts)

    def block(s: str, tag: str = "p") -> str:
        kept.append(s)
        return f"<{tag}>{mark}{inline(s)}" + ("" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>")

    def body() -> str:
        if rng.random() < 0.15:  # next to nothing, below which a long footer may stand
            return (block(words(1, 4), rng.choice(["h1", "h2"])) if rng.random() < 0.75 else "") + "".join(block(rng.choice([words(1, 5), sentence(2, 4)])) for _ in range(rng.choice([1, 1, 1, 2])))
        out = [block(words(3, 12), rng.choice(["h1", "h1", "h2"]))] if rng.random() < 0.8 else []
        for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 30])):
            r = rng.random()
            if r < 0.74:
                out.append(block(prose()))
            elif r < 0.80:
                out.append(block(words(2, 7), rng.choice(["h2", "h3"])))
            elif r < 0.86:
                t = rng.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(block(sentence(2, 10), "li") for _ in range(rng.randint(2, 6))) + f"</{t}>")
            elif r < 0.90:
                out.append(block(prose(1, 3), "blockquote"))
            elif r < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(block(words(1, 4), "td") for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif r < 0.95:
                out.append(f"<figure><img src=x>{block(words(3, 9), 'figcaption')}</figure>")
            elif r < 0.97:
                out.append(block(sentence(1, 3)))
            else:
                out.append(rng.choice(extras)())
        return "".join(out)

    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randint(a, b)))
    wrap = lambda tags, names, inner: (lambda t: f"<{t}{attr(*names)}>{inner}</{t}>")(rng.choice(tags))
    some = lambda: rng.choice([f"<p>{prose(1, 3)}</p>", prose(1, 2), f"<span>{words(2, 8)}</span>", f"<p>{sentence()}</p>"])
    menu = lambda: rng.choice([lambda: f"<nav{rng.choice(['', attr('main-nav', 'navbar')])}><ul>{links(3, 9)}</ul></nav>", lambda: f"<div{' class=' + rng.choice(['menu', 'navbar', 'navigation', 'breadcrumbs'])}>{rng.choice(['<ul>' + links(3, 9) + '</ul>', ''.join(f'<a href=/{word()}>{word()}</a> ' for _ in range(6))])}</div>"])()
    header = lambda: f"<header{rng.choice(['', attr('site-header', 'masthead', 'top')])}>{rng.choice([f'<h1>{words(1, 4)}</h1>', f'<a href=/>{words(1, 3)}</a>', f'<div class=logo>{words(1, 3)}</div><p>{sentence()}</p>', f'<p>{prose(1, 3)}</p>'])}{rng.choice(['', menu()])}</header>"
    footer = lambda: rng.choice([lambda: f"<footer{rng.choice(['', attr('footer', 'site-footer')])}>&copy; {words(1, 4)} &middot; {some()}{rng.choice(['', '<ul>' + links(2, 6) + '</ul>'])}</footer>", lambda: f"<div class={rng.choice(['footer', 'site-footer', 'copyright', 'legal'])}>{some()}</div>"])()
    side = lambda: rng.choice([lambda: f"<aside{rng.choice(['', attr('sidebar', 'related', 'widget')])}><h3>{words(1, 3)}</h3>{rng.choice(['<ul>' + links(2, 7) + '</ul>', some(), f'<p>{prose(2, 5)}</p>'])}</aside>", lambda: f"<div class={rng.choice(['sidebar', 'related', 'widget', 'side-rail', 'recommended'])}>{rng.choice([some(), '<ul>' + links(2, 6) + '</ul>'])}</div>"])()
    advert = lambda: f"<{(t := rng.choice(['div', 'div', 'div', 'p', 'section', 'aside']))} class=\"{rng.choice(['ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-banner', 'advertisement', 'adsbox'])}\">{some()}</{t}>"
    notice = lambda: f"<{(t := rng.choice(['div', 'div', 'section', 'p']))} {rng.choice(['class', 'id'])}=\"{rng.choice(['cookie', 'cookie-notice', 'consent', 'gdpr', 'notice', 'popup', 'modal', 'alert', 'cookie-banner', 'privacy-notice'])}\">{some()}{rng.choice(['', '<button>' + word() + '</button>'])}</{t}>"
    form = lambda: f"<form{rng.choice(['', attr('search', 'login', 'newsletter')])}><label>{words(1, 4)}</label><input name=q>{rng.choice(['', some()])}<button>{word()}</button></form>" if rng.random() < 0.75 else f"<div class={rng.choice(['newsletter', 'subscribe', 'signup', 'search'])}>{some()}</div>"
    share = lambda: f"<div class={rng.choice(['share', 'social', 'tags', 'byline'])}>{rng.choice(['<ul>' + links(2, 5) + '</ul>', words(1, 5)])}</div>"
    hidden = lambda: f"<div {rng.choice(['hidden', 'style=display:none', 'aria-hidden=true'])}>{some()}</div>"

    def comments() -> str:
        t = rng.choice(["div", "li", "article", "p"])
        each = "".join(f'<{t}{rng.choice(["", " class=comment", " class=reply"])}>{rng.choice(["", f"<b>{word()}</b> ", f"<span>{word()}</span>"])}{prose(1, 4) if t == "p" else f"<p>{prose(1, 4)}</p>"}</{t}>' for _ in range(rng.randint(1, 6)))
        w = rng.choice(["div", "section", "ul", "ol", "div"])
        return f'<{w} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "reader-comments", "discussion", "replies", "comments-area", "responses"])}">{rng.choice(["", f"<h3>{words(1, 3)}</h3>"])}{each}</{w}>'

    extras = [advert, share, side, form, notice, hidden, advert]
    if rng.random() < 0.06:  # a text without any structure
        text = prose(1, 4) if rng.random() < 0.6 else words(2, 12)
        return rng.choice([f"{mark}{inline(text)}", f"<p>{mark}{inline(text)}", f"<html><body>{mark}{inline(text)}</body></html>", f"<div>{mark}{inline(text)}</div>"]), text
    shell = rng.choice(["article", "article", "article", "main", "div", "div", "section", "none", "both"])
    inner = body()
    if rng.random() < 0.25:
        inner += rng.choice([comments, share, side, advert, form])()
    box = rng.choice(["content", "main", "post", "entry", "article-body", "story", "text", "post-content"])
    inner = {"none": inner, "both": f"<main><article>{inner}</article></main>", "div": f'<div {rng.choice(["class", "id"])}="{box}">{inner}</div>'}.get(shell, f"<{shell}{attr(box, box)}>{inner}</{shell}>")
    top = [f() for f in (header, menu, notice, advert, form, side, hidden) if rng.random() < 0.45]
    end = [f() for f in (comments, side, advert, form, footer, footer, notice, share, menu) if rng.random() < 0.4]
    if rng.random() < 0.1:
        top, end = [], []
    rng.shuffle(top)
    if rng.random() < 0.2:
        rng.shuffle(end)
    page = "".join(top) + inner + "".join(end)
    for t in ("div", "div"):
        if rng.random() < 0.3:
            page = f"<{t}{rng.choice(['', ' class=wrapper', ' id=page', ' class=container', ' class=layout'])}>{page}</{t}>"
    head = f"<head><meta charset=utf-8><title>{words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='<p>';</script></head>"
    return f"<!DOCTYPE html><html>{head}<body>{page}</body></html>", " ".join(kept)


def _labels(blocks: list[Block]) -> np.ndarray:
    """Blocks whose own text is marked as main text, and all that contain one; the marks go."""
    number = {id(b): k for k, b in enumerate(blocks)}
    good = np.zeros(len(blocks), bool)
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        for i, x in enumerate(b.children):
            if type(x) is str and KEPT in x:
                good[k] = True
                b.children[i] = x.replace(KEPT, "")
                b.chars -= x.count(KEPT)
        if good[k] and k:
            good[number[id(b.parent)]] = True
    return good


@lru_cache(maxsize=4)
def fit(pages: int = FIT_PAGES, seed: int = 11) -> Boosted:
    """The model, fitted once in a process."""
    rng, rows, labels = random.Random(seed), [], []
    for _ in range(pages):
        blocks = walk(parse(compose(rng, KEPT)[0]))
        labels.append(_labels(blocks))
        rows.append(features(blocks))
    return Boosted().fit(np.concatenate(rows), np.concatenate(labels).astype(float))


def extract(df: DataFrame, model: Boosted | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, url, text and n_chars of every page."""
    from tidemark.llm.common import over_rows, small_batches

    model = model or fit()
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def make():
        extractor = Extractor(model)

        def work(ids, urls, pages):
            texts = extractor(pages)
            return [ids, urls, texts, [*map(len, texts)]]

        return work

    rows = small_batches(df).select(F.col(key).cast("bigint").alias("page_id"), "url", F.col(html).alias("html"))
    return rows.mapInArrow(over_rows(["page_id", "url", "html"], schema, make), "page_id bigint, url string, text string, n_chars bigint")
