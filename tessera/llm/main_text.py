"""HTML main-text extraction: boosted trees over DOM-node features, decoded along the tree.

Each page becomes a tree of its block-level nodes. A node has features of its tag, its attribute tokens, its depth, the
text and link density of its subtree and its place among its siblings. Gradient-boosted regression trees give each
node's chance of belonging to the article. Decoding picks the likeliest labels of all nodes together under one rule:
below a node that is left out everything is left out, so an ancestor and a descendant never contradict each other.

The trees are fitted to `TRAIN_PAGES` generated pages whose parts are known (a bounded sample by that parameter), with
menus, headers, footers, sidebars, notices, adverts, forms and comments under many names.

Defined cases: a null or empty page, and one without text, gives an empty text; tags that are never closed end with
their parent, and scripts, styles and text areas with the page; a `<` that starts no tag is text; a tag whose quotes do not
pair ends at the next `>`; text outside of all elements belongs to an implied body; equal rows give equal results; an empty
table gives an empty result; other columns are ignored. A page is read once from front to back, in time in proportion to its
length.
"""

from __future__ import annotations

import collections
import html
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import map_text, table

# Fixed values of HTML: void elements, raw-text elements, block-level elements, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg".split())
ENDLESS = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody "
    "tfoot tr td th caption figure figcaption blockquote pre address details summary dialog menu hgroup search select option button label legend center".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}}
INSIDE_P = frozenset("label button option select summary legend".split())
LISTS = ("ul", "ol", "dl", "table", "select")
TAG_GROUPS = [{"article", "main"}, {"section"}, {"div", "center"}, {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"}, {"li", "dt", "dd"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "select", "button", "label", "search"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"body", "html"}, {"dialog"}]
# Attribute tokens that speak for and against the article.
GOOD = frozenset("article content post entry story text body main prose page blog news detail".split())
BAD_GROUPS = [
    frozenset("nav navbar navigation menu breadcrumb breadcrumbs crumbs pagination pager tabs toc links".split()),
    frozenset("header masthead topbar top banner logo brand hero".split()),
    frozenset("footer foot bottom copyright legal colophon".split()),
    frozenset("sidebar side aside widget widgets rail related recommended recommend trending popular more teaser".split()),
    frozenset("cookie cookies consent gdpr notice alert popup modal overlay toast message warning disclaimer".split()),
    frozenset("ad ads adv advert advertisement adbox sponsor sponsored promo promotion banner dfp outbrain taboola".split()),
    frozenset("form search login signup subscribe newsletter register contact".split()),
    frozenset("comment comments disqus reply replies respond discussion feedback reviews thread".split()),
    frozenset("share social follow tags tag meta byline author hidden print".split()),
]
OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
QUOTE = re.compile("[\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
WORD = re.compile(r"[a-z]+")
TRAIN_PAGES, TREES, DEPTH, SHRINK, BINS = 300, 40, 4, 0.25, 32


def _tag_end(source: str, at: int, last: int) -> int:
    """The place of the `>` that ends a tag: the first outside of quotes, or the first one where quotes do not pair.

    `last` is the place of the page's last `>`, and at least one stands at or after `at`.
    """
    end = first = source.find(">", at)
    quote = QUOTE.search(source, at, end)
    while quote:
        shut = source.find(quote[0], quote.end())
        if shut < 0 or shut > last:
            return first
        end = source.find(">", shut)
        quote = QUOTE.search(source, shut + 1, end)
    return end


class Page:
    """The block-level tree of a page: per node its tag, parent, depth and attribute tokens; and the blocks of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.tokens = ["html"], [-1], [0], [frozenset()]
        self.blocks: list[tuple[int, str, int, int]] = []  # node, text, characters in links, inline tags
        self._read(source)

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block-level node
        where: dict[str, list[int]] = collections.defaultdict(list)  # places of open elements in the stack, by tag
        text, in_link, link_chars, inline, implied = [], 0, 0, 0, 0
        at, n, last, unclosed = 0, len(source), source.rfind(">"), set()

        def flush() -> None:
            nonlocal text, link_chars, inline, implied
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                if joined:
                    if not (node := stack[-1][1]):
                        node = implied = implied or self._add("body", 0, "")
                    self.blocks.append((node, joined, link_chars, inline))
            text, link_chars, inline = [], 0, 0

        def close(upto: int) -> None:
            nonlocal in_link
            if any(t in BLOCK for t, _ in stack[upto:]):
                flush()
            for t, _ in stack[upto:]:
                in_link -= t == "a"
                where[t].pop()
            del stack[upto:]

        while at < n:
            m = OPEN.search(source, at)
            start = m.start() if m and m.start() < last else n
            if start > at:
                part = source[at:start]
                text.append(part)
                if in_link:
                    link_chars += len(part)
            if start == n:
                break
            if m[1]:
                end = source.find("-->", m.end())
                at = end + 3 if end >= 0 else n
                continue
            end = _tag_end(source, m.end(), last)
            attributes, at = source[m.end() : end], end + 1
            if not m[3]:
                continue
            tag = m[3].lower()
            if m[2]:
                if where[tag]:
                    close(where[tag][-1])
                continue
            if tag in VOID:
                text.append(" ")
                continue
            if tag in RAW:
                if not attributes.endswith("/") and tag not in unclosed:
                    over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    end = source.find(">", over.end()) if over else -1
                    if end >= 0:
                        at = end + 1
                    elif tag in ENDLESS:
                        at = n
                    else:
                        unclosed.add(tag)
                continue
            if tag in BLOCK and tag not in INSIDE_P and where["p"]:  # an open paragraph ends here
                close(where["p"][-1])
            for shut in CLOSES.get(tag, ()):
                if where[shut] and where[shut][-1] > max((where[t][-1] for t in LISTS if where[t]), default=0):
                    close(where[shut][-1])
            if tag in BLOCK:
                flush()
                if tag == "html":
                    continue
                node = self._add(tag, stack[-1][1], attributes)
            else:
                inline += 1
                in_link += tag == "a"
                node = stack[-1][1]
            where[tag].append(len(stack))
            stack.append((tag, node))
        flush()
        self.plain = len(self.tag) == 1 + bool(implied)  # no element at all

    def _add(self, tag: str, above: int, attributes: str) -> int:
        self.tag.append(tag)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        self.tokens.append(self._tokens(attributes) if attributes else frozenset())
        return len(self.tag) - 1

    @staticmethod
    def _tokens(attributes: str) -> frozenset:
        found = set()
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                found.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                found.add("hidden")
        if re.search(r"(?:^|\s)hidden(?:\s|$)", attributes):
            found.add("hidden")
        return frozenset(found)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, links, words, stops, count, inline, subtree = ([0.0] * n for _ in range(7))
        for node, text, link, tags in self.blocks:
            chars[node] += len(text)
            links[node] += min(link, len(text))
            words[node] += text.count(" ") + 1
            stops[node] += text.count(".") + text.count(",")
            count[node] += 1
            inline[node] += tags
        own, children, place = list(chars), [0] * n, [0] * n
        for i in range(1, n):
            place[i] = children[self.parent[i]]
            children[self.parent[i]] += 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for a in (chars, links, words, stops, count, inline):
                a[p] += a[i]
            subtree[p] += subtree[i] + 1
        total = chars[0] or 1.0
        bad = [[bool(t & g) for g in BAD_GROUPS] for t in self.tokens]
        good = [bool(t & GOOD) for t in self.tokens]
        plain = [next((k for k, g in enumerate(TAG_GROUPS) if t in g), -1) for t in self.tag]
        above_bad, above_good, above_tag = [0] * n, [0] * n, [0] * n
        out = np.zeros((n, N_FEATURES), np.float32)
        for i in range(n):
            p = self.parent[i]
            if p >= 0:
                above_bad[i] = above_bad[p] or any(bad[p]) or plain[p] in (7, 8, 9, 10, 11, 15)
                above_good[i] = above_good[p] or good[p] or plain[p] == 0
                above_tag[i] = plain[p]
            of = max(p, 0)
            row = out[i]
            if plain[i] >= 0:
                row[plain[i]] = 1
            k = len(TAG_GROUPS)
            row[k : k + len(BAD_GROUPS)] = bad[i]
            k += len(BAD_GROUPS)
            row[k:] = (
                good[i], above_bad[i], above_good[i], above_tag[i], self.depth[i], math.log1p(chars[i]), chars[i] / total, links[i] / (chars[i] or 1),
                words[i] / (count[i] or 1), stops[i] / (words[i] or 1), chars[i] / (subtree[i] + inline[i] + 1), own[i] / (chars[i] or 1), children[of],
                place[i] / (children[of] or 1), chars[i] / (chars[of] or 1), children[i], links[of] / (chars[of] or 1),
            )
        return out


N_FEATURES = len(TAG_GROUPS) + len(BAD_GROUPS) + 17


class BoostedTrees:
    """Gradient-boosted trees of a fixed depth on the logistic loss, over binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f, self.feature, self.cut, self.leaf = np.full(len(y), self.base), [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            feature, cut, leaf, at = self._tree(binned, y - p, p * (1 - p), depth)
            f += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def _tree(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        at = np.zeros(len(g), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            choice: list[tuple[int, int] | None] = [None] * width
            tg, th = np.bincount(at, g, width), np.bincount(at, h, width)
            for j, c in enumerate(self.cuts):
                if not len(c):
                    continue
                key = at * (BINS + 1) + binned[:, j]
                lg = np.cumsum(np.bincount(key, g, width * (BINS + 1)).reshape(width, -1), 1)[:, : len(c)]
                lh = np.cumsum(np.bincount(key, h, width * (BINS + 1)).reshape(width, -1), 1)[:, : len(c)]
                gain = lg**2 / (lh + 1) + (tg[:, None] - lg) ** 2 / (th[:, None] - lh + 1) - (tg**2 / (th + 1))[:, None]
                b = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), b] > best).tolist():
                    best[k], choice[k] = gain[k, b[k]], (j, int(b[k]))
            for k, found in enumerate(choice):
                if found:
                    feature[first + k], cut[first + k] = found[0], self.cuts[found[0]][found[1]]
            right = np.zeros(len(g), np.int64)
            for k, found in enumerate(choice):
                if found:
                    mine = at == k
                    right[mine] = binned[mine, found[0]] > found[1]
            at = 2 * at + right
        leaf = SHRINK * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + 1)
        return feature, cut, leaf, at

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, every = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            f += leaf[node - (len(leaf) - 1)]
        return f


def decoded(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The likeliest labels in which no node below one that is left out is kept."""
    n = len(parent)
    keep, drop = [0.0] * n, [0.0] * n
    for i, m in enumerate(margin.tolist()):
        keep[i], drop[i] = -math.log1p(math.exp(min(50.0, -m))), -math.log1p(math.exp(min(50.0, m)))
    for i in range(n - 1, 0, -1):  # a child stands after its parent
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = [True] * n  # the page itself is no choice
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] >= drop[i]
    return out


def _prose(rng: np.random.Generator, n: int) -> str:
    words = ["".join(rng.choice(list("abcdefghiklmnoprstuvw"), size=k)) for k in rng.integers(1, 11, n)]
    return " ".join(w + ("." if rng.random() < 0.08 else "," if rng.random() < 0.05 else "") for w in words).capitalize() + "."


def generated(seed: int) -> str:
    """A page whose parts carry y="1" (article) or y="0"."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    prose = lambda a, b: _prose(rng, int(rng.integers(a, b)))
    links = lambda n: "".join(f'<li y="0"><a href="/{i}">{_prose(rng, int(rng.integers(1, 4)))}</a></li>' for i in range(n))

    def named(group: int) -> str:
        return pick(sorted(BAD_GROUPS[group])) + pick(["", "", "-box", "-wrap", " block", "-1"])

    def part(tag: str, group: int, inner: str) -> str:
        if rng.random() < 0.45 and tag != "div":
            return f'<{tag} y="0">{inner}</{tag}>'
        name = pick(["class", "id"])
        return f'<{pick(["div", tag, "section"])} {name}="{named(group)}" y="0">{inner}</div>' if tag == "div" else f'<{tag} {name}="{named(group)}" y="0">{inner}</{tag}>'

    menu = lambda: part("nav", 0, f'<ul y="0">{links(int(rng.integers(3, 9)))}</ul>')
    advert = lambda: f'<div {pick(["class", "id"])}="{named(5)}" y="0">{pick([prose(4, 30), f"<p y=0>{prose(4, 30)}</p>"])}</div>'
    notice = lambda: f'<div class="{named(4)}" y="0"><p y="0">{prose(5, 30)}</p><button y="0">{prose(1, 2)}</button></div>'
    form = lambda: f'<form y="0"><label y="0">{prose(1, 4)}</label><input><button y="0">{prose(1, 2)}</button></form>'
    side = lambda: part("aside", 3, f'<h3 y="0">{prose(1, 4)}</h3>' + pick([f'<ul y="0">{links(5)}</ul>', f'<p y="0">{prose(5, 40)}</p>']))
    share = lambda: f'<div class="{named(8)}" y="0">{prose(1, 6)}</div>'

    def paragraph() -> str:
        inner = prose(*pick([(1, 4), (5, 30), (20, 140), (20, 140), (60, 300)]))
        if rng.random() < 0.25:
            inner = f"<b>{inner}" + pick(["</b>", "<br>", ""])
        if rng.random() < 0.2:
            inner += f' <a href="/x">{prose(1, 4)}</a> {prose(3, 20)}'
        return f'<p y="1">{inner}' + pick(["</p>", "</p>", ""])

    def article() -> str:
        body = f'<h1 y="1">{prose(2, 12)}</h1>' if rng.random() < 0.8 else ""
        for _ in range(int(pick([0, 1, 2, 3, 5, 8, 15]))):
            k = rng.random()
            if k < 0.06:
                body += f'<h2 y="1">{prose(2, 8)}</h2>'
            elif k < 0.12:
                body += '<ul y="1">' + "".join(f'<li y="1">{prose(2, 25)}</li>' for _ in range(int(rng.integers(2, 6)))) + "</ul>"
            elif k < 0.16:
                body += f'<blockquote y="1">{prose(8, 60)}</blockquote>'
            elif k < 0.19:
                body += f'<table y="1"><tr y="1"><td y="1">{prose(1, 5)}</td><td y="1">{prose(1, 5)}</td></tr></table>'
            elif k < 0.27:
                body += pick([advert, side, share, form, notice])()
            else:
                body += paragraph()
        if "<p" not in body and "<h1" not in body:
            body += paragraph()
        return pick([f'<article y="1">{body}</article>', f'<article y="1">{body}</article>', f'<div class="{pick(sorted(GOOD))}" y="1">{body}</div>', f'<main y="1">{body}</main>', f'<main y="1"><article y="1">{body}</article></main>', f'<div y="1">{body}</div>'])

    def comments() -> str:
        inner = "".join(f'<div class="{named(7)}" y="0"><p y="0">{prose(3, 60)}</p></div>' for _ in range(int(rng.integers(1, 5))))
        return part(pick(["section", "div"]), 7, f'<h3 y="0">{prose(1, 3)}</h3>{inner}')

    maybe = lambda f, p: f() if rng.random() < p else ""
    top = maybe(lambda: part("header", 1, f'<div y="0">{prose(1, 5)}</div>' + maybe(menu, 0.5) + maybe(form, 0.2)), 0.5) + maybe(menu, 0.6) + maybe(notice, 0.25) + maybe(advert, 0.4)
    foot = maybe(lambda: part("footer", 2, pick([f"&copy; {prose(2, 20)}", f'<p y="0">{prose(3, 25)}</p>'])), 0.8)
    middle = maybe(side, 0.3) + article() + maybe(side, 0.3) + maybe(advert, 0.2) + maybe(comments, 0.4)
    if rng.random() < 0.4:
        middle = f'<div {pick(["", "class=container", "id=wrap", "class=row"])} y="1">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>x</title><script>var a=1;</script></head><body y=1>{top}{middle}{foot}</body></html>"


def trained(pages: int = TRAIN_PAGES) -> BoostedTrees:
    """Trees fitted to generated pages."""
    x, y = [], []
    label = re.compile(r'\sy="?([01])"?')
    for seed in range(pages):
        source = generated(seed)
        marks = label.sub(lambda m: f' class2="{m[1]}"', source)
        wanted: list[int] = []

        class Marked(Page):
            def _tokens(self, attributes: str) -> frozenset:  # noqa: N805, B023
                return Page._tokens(attributes) | ({"mark1"} if 'class2="1"' in attributes else {"mark0"} if 'class2="0"' in attributes else set())

        page = Marked(marks)
        wanted = [0 if "mark0" in t else 1 for t in page.tokens]
        x.append(page.features()[1:])
        y += wanted[1:]
    return BoostedTrees(np.concatenate(x).astype(np.float64), np.array(y, np.float64))


def extractor(model: BoostedTrees):
    def texts(sources: list[bytes]) -> list[list]:
        pages = [Page(s.decode("utf-8", "replace")) for s in sources]
        margins = model.margin(np.concatenate([p.features() for p in pages]))
        out, at = [], 0
        for p in pages:
            n = len(p.tag)
            keep = decoded(p.parent, margins[at : at + n])
            at += n
            text = "\n".join(t for node, t, _, _ in p.blocks if keep[node] or p.plain)
            out.append((text, len(text)))
        return [list(c) for c in zip(*out, strict=True)]

    return texts


def main_texts(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return map_text(pages, "html", [("text", "string"), ("n_chars", "bigint")], extractor(model or trained()), ["page_id", "url"])


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


QUERIES = {"op3_main_text": op3_main_text}
