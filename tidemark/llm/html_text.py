"""HTML extraction by composite text density.

A page becomes a tree by a forgiving tokeniser (implied end tags, unclosed elements, raw text, comments). Subtrees that
are never article text are cut: raw elements, navigation, footers, hidden ones. Others are cut
weakly, by forms or by words in their class or id. Asides, some roles and words of comment sections cut strongly: only an element that holds
the page's text (most of it, its densest part, and its headline or article) is spared. For every node left, with C characters, T tags, LC characters and LT
tags inside links, and the body's own C_b and LC_b, the composite density is

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_b / C_b * C + e)

with zeros in denominators read as one. A node's density sum is the sum over its children (its own text counts as one).
The node of the greatest sum is the core of the page; a core that is a single paragraph stands for its container.

Weak cuts yield to density: one around the core found without any of them is lifted if it holds an <article> or
<main> around that core, or several blocks of text; and all are lifted where no text would be left. An <article> around the core
is a prior: it is taken as a container (and one with an h1 in it wins over a core outside of articles). The least density on the core's path up to the article, or else to the body, is
the threshold. Without an article every other node that reaches it adds the node of greatest sum below it, and the page's h1
before the core is kept; beside an article, its sibling articles that reach it are added.

Memory: one page at a time, time linear in the page. Defined cases: a null, empty or text-less page gives an empty text;
rows that repeat a page_id are rows of their own; nesting may be of any depth; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag closes these open ones, up to a fence.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
FENCES = set("table td th caption button object article section div main body html".split())
CUT_TAGS = set("script style textarea title noscript iframe xmp noembed noframes head nav aside footer button select option input dialog template svg canvas audio video object math datalist menu".split())
CUT_ROLES = {"navigation", "contentinfo", "complementary", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
WEAK_ROLES = {"banner", "search", "form", "alert"}
COMMENT_WORDS = set("comment comments commentlist disqus replies respond".split())
CUT_WORDS = set(
    "ad ads adv adbox adslot adunit advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login signin register share sharing sharebar social related recommended recommendations recommend "
    "trending popular sidebar sidebars rail widget widgets menu menus nav navbar navigation subnav breadcrumb breadcrumbs footer foot masthead topbar comment comments commentlist disqus replies reply "
    "respond discussion pagination pager toolbar skip copyright legal disclaimer paywall outbrain taboola feedback rating ratings donate aside offcanvas dropdown search".split()
)
KEEP_WORDS = set("article post entry content story main body text title headline".split())
#: Cut even where a word of KEEP_WORDS stands beside it.
CUT_ANYWAY = set("ad ads advert advertisement sponsored promo cookie consent newsletter subscribe share social related recommended sidebar comment comments commentlist replies respond navigation nav menu footer widget".split())
#: How much more text a container may add to the core to be taken with it.
WIDEN = 0.15
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Elements that are one piece of text: a core of this kind stands for its container.
SINGLE = INLINE | set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption td th tr".split())
#: Text blocks that make a weakly cut element look like an article.
BLOCKS = 3
#: How much less text than a strongly cut element holds may lie outside, for it to be the page's text.
OUTSIDE = 0.1
NO, WEAK, STRONG, FIRM = 0, 1, 2, 3


def cut_kind(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element can't hold article text: NO, WEAK (unless density says so), STRONG (unless it holds the page's text) or FIRM."""
    if tag in CUT_TAGS:
        return STRONG if tag == "aside" else FIRM
    weak = tag == "form" or (tag == "header" and not in_article)
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return WEAK if weak else NO
    words, strong = set(), False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return FIRM
        if name == "role":
            strong = strong or value.lower() in CUT_ROLES
            weak = weak or value.lower() in WEAK_ROLES
        if name in ("class", "id"):
            words.update(w.lower() for w in WORDS.findall(value))
    found = words & CUT_WORDS
    if strong or found & COMMENT_WORDS:
        return STRONG
    weak = weak or ("header" in words and not in_article and not words & KEEP_WORDS)
    weak = weak or (bool(found) and (not words & KEEP_WORDS or bool(found & CUT_ANYWAY)))
    return WEAK if weak else NO


class Page:
    """Nodes in document order (a parent comes before its children) and the page's texts with the node they are in."""

    def __init__(self, source: str):
        self.tags, self.parents, self.kinds = ["#root"], [0], [NO]
        self.texts: list[tuple[int, str]] = []  # "" marks the edge of a block
        self.talk: set[int] = set()  # articles that are comments by their name
        stack, in_article = [0], 0
        at, size = 0, len(source)
        tags, texts = self.tags, self.texts
        places: dict[str, list[int]] = {}  # of the open elements of a tag in the stack

        def last(names) -> int:
            return max((places[t][-1] for t in names if places.get(t)), default=0)

        def close(down_to: int) -> None:
            nonlocal in_article
            while len(stack) > down_to:
                node = stack.pop()
                places[tags[node]].pop()
                if tags[node] not in INLINE:
                    texts.append((node, ""))
                in_article -= tags[node] in ("article", "main")

        def close_open(names: set, fences: set) -> None:
            if (k := last(names)) and k > last(fences):
                close(k)

        while found := TOKEN.search(source, at):
            if found.start() > at:
                texts.append((stack[-1], source[at : found.start()]))
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                if found[0].startswith("<![CDATA["):
                    texts.append((stack[-1], html.escape(found[0][9:].removesuffix("]]>"))))
                continue
            attributes = found[3] or found[6] or ""
            if found[1] or found[4]:
                k = last((tag,))
                barred = tag in INLINE and last(FENCES) > k
                barred = barred or (tag not in ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "html", "body") and last(("td", "th")) > k)
                if k and not barred:
                    close(k)
                continue
            if tag in ("html", "body") and places.get(tag):
                continue
            if tag == "body":
                close_open({"head"}, set())
            if tag in CLOSES_P:
                close_open({"p"}, FENCES)
            if tag in IMPLIED:
                # the outermost of these above the fence
                names, fences = IMPLIED[tag]
                close_open(names, fences)
            node = len(tags)
            tags.append(tag)
            self.parents.append(stack[-1])
            self.kinds.append(cut_kind(tag, attributes, in_article > 0))
            if tag == "article" and not COMMENT_WORDS.isdisjoint(w.lower() for w in WORDS.findall(attributes)):
                self.talk.add(node)
            if tag not in INLINE:
                texts.append((node, ""))
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else size
            elif tag not in VOID and not attributes.endswith("/") or tag in ("div", "p", "span", "a", "b", "i"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
                in_article += tag in ("article", "main")
        if at < size:
            texts.append((stack[-1], source[at:]))

    def _settle(self) -> None:
        """Strongly cut elements that hold the page's text are no cuts, the others are firm ones.

        One holds it if it has more text than lies outside of all of them, the densest part too, and besides the page's h1, or an <article> or
        <main> of most of its text, or hardly any text and no h1 is outside. That tells a wrapper ("no-comments") from a comment section of any length.
        """
        strong = [k for k, kind in enumerate(self.kinds) if kind == STRONG]
        if not strong:
            return
        tags, parents, n = self.tags, self.parents, len(self.tags)
        cut, linked, inside, chars, heads, widest, rest = [False] * n, [False] * n, [False] * n, [0] * n, [0] * n, [0] * n, 0
        for k in range(1, n):
            cut[k] = cut[parents[k]] or self.kinds[k] == FIRM
            linked[k] = linked[parents[k]] or tags[k] == "a"
            inside[k] = inside[parents[k]] or self.kinds[k] == STRONG
        for node, t in self.texts:
            if t and not cut[node] and not linked[node]:
                size = len("".join(t.split()))
                chars[node] += size
                rest += 0 if inside[node] else size
        for k in range(n - 1, 0, -1):
            if cut[k]:
                continue
            if tags[k] == "h1" and chars[k]:
                heads[k] += 1
            elif tags[k] == "main" or (tags[k] == "article" and k not in self.talk):
                widest[k] = max(widest[k], chars[k])
            up = parents[k]
            chars[up], heads[up], widest[up] = chars[up] + chars[k], heads[up] + heads[k], max(widest[up], widest[k])
        large = [k for k in strong if not cut[k] and chars[k] > rest]
        held = {k for k in large if heads[k] or 2 * widest[k] > chars[k] or (not heads[0] and chars[0] - chars[k] <= OUTSIDE * chars[k])}
        if held:
            for k in strong:
                self.kinds[k] = NO if k in held else FIRM
            up, around = self.densities(self._cut(None)).core(), set()
            while up:
                around.add(up)
                up = parents[up]
            held &= around
        for k in strong:
            self.kinds[k] = NO if k in held else FIRM

    def text(self) -> str:
        self._settle()
        wanted = self._wanted()
        parts = [(html.unescape(t) if "&" in t else t) if t else " " for node, t in self.texts if wanted[node]]
        return " ".join("".join(parts).split())

    def _cut(self, lifted: set[int] | None = None) -> list[bool]:
        """Which nodes are cut; lifted: nodes whose weak cut doesn't count, None for all."""
        out = [False] * len(self.tags)
        for k in range(1, len(out)):
            kind = self.kinds[k]
            out[k] = out[self.parents[k]] or kind == FIRM or (kind == WEAK and lifted is not None and k not in lifted)
        return out

    def densities(self, cut: list[bool]) -> Densities:
        return Densities(self, cut)

    def _wanted(self) -> list[bool]:
        weak = {k for k in range(1, len(self.tags)) if self.kinds[k] == WEAK}
        found = self.densities(self._cut(set()))
        if weak and (lifted := self._lifted(weak)):
            found = self.densities(self._cut(lifted))
        if weak and found.chars[0] == found.links[0]:  # no text is left outside links
            found = self.densities(self._cut(None))
        return found.wanted()

    def _lifted(self, weak: set[int]) -> set[int]:
        """The weak cuts that density lifts."""
        tags, parents = self.tags, self.parents
        blocks, holds = [0] * len(tags), [False] * len(tags)
        for node, t in self.texts:
            if tags[node] in SINGLE and tags[node] not in INLINE and not t.isspace() and t:
                blocks[node] = 1
        for k in range(len(tags) - 1, 0, -1):
            blocks[parents[k]] += blocks[k]
            holds[parents[k]] |= holds[k] or tags[k] in ("article", "main")
        if not any(blocks[k] >= BLOCKS or holds[k] for k in weak):
            return set()
        free = self.densities(self._cut(None))
        up, inside, out = free.core(), False, set()
        while up:
            if up in weak and (inside or blocks[up] >= BLOCKS):
                out.add(up)
            inside = inside or tags[up] in ("article", "main")
            up = parents[up]
        return out


class Densities:
    """Characters, tags and their shares in links of every node's subtree, its density and its density sum."""

    def __init__(self, page: Page, cut: list[bool]):
        self.page, self.cut = page, cut
        tags, parents = page.tags, page.parents
        n = len(tags)
        self.own, self.chars, self.links, self.tag_count, self.link_tags = ([0] * n for _ in range(5))
        own, chars, links, tag_count, link_tags = self.own, self.chars, self.links, self.tag_count, self.link_tags
        self.in_link = in_link = [False] * n
        self.article: list[int] = [0] * n  # the outermost one around a node
        for k in range(1, n):
            in_link[k] = tags[k] == "a" or in_link[parents[k]]
            self.article[k] = self.article[parents[k]] or (k if tags[k] == "article" else 0)
        for node, t in page.texts:
            if t and not cut[node]:
                own[node] += len("".join(t.split()))
        for k in range(n - 1, -1, -1):
            if cut[k]:
                continue
            chars[k] += own[k]
            links[k] += own[k] if in_link[k] else 0
            if k:
                p = parents[k]
                chars[p] += chars[k]
                links[p] += links[k]
                tag_count[p] += tag_count[k] + 1
                link_tags[p] += link_tags[k] + (tags[k] == "a")
        body = next((k for k in range(n) if tags[k] == "body"), 0)
        self.body = body if chars[body] == chars[0] else 0  # text outside the body counts, too
        share = links[self.body] / max(chars[self.body], 1)
        self.dense = [0.0 if cut[k] else density(chars[k], links[k], tag_count[k], link_tags[k], share) for k in range(n)]
        self.sums = sums = [0.0] * n
        for k in range(n):
            if not cut[k]:
                sums[k] += density(own[k], own[k] if in_link[k] else 0, 1, 1, share) if own[k] else 0.0
                if k:
                    sums[parents[k]] += self.dense[k]

    def core(self) -> int:
        """The node of the greatest density sum; the container of a single piece of text, but for the body."""
        page, sums = self.page, self.sums
        core = max(range(self.body, len(sums)), key=lambda k: (sums[k], -k) if not self.cut[k] else (-1.0, 0))
        up = core
        while page.tags[up] in SINGLE:
            up = page.parents[up]
        return core if up in (0, self.body) or page.tags[up] in ("html", "body") else up

    def threshold(self, core: int, top: int) -> float:
        """The least density on the path from the core up to top."""
        least, up = self.dense[core], core
        while up != top and up:
            up = self.page.parents[up]
            least = min(least, self.dense[up])
        return least

    def wanted(self) -> list[bool]:
        tags, parents, cut, chars, links, dense, sums = self.page.tags, self.page.parents, self.cut, self.chars, self.links, self.dense, self.sums
        n = len(tags)
        marked = [False] * n
        if not chars[0]:
            return marked
        core = self.core()
        top = self.article[core]
        if not top:  # an article with the page's headline, however short, before denser text elsewhere
            headed = {self.article[k] for k in range(1, n) if tags[k] == "h1" and not cut[k]} - {0}
            if headed:
                core = top = max(headed, key=lambda k: (sums[k], -k))
        if top:
            least = self.threshold(core, top)
            marked[top] = True
            for k in range(1, n):
                if tags[k] == "article" and parents[k] == parents[top] and not cut[k] and dense[k] >= least:
                    marked[k] = True
        else:
            # a container that adds little but a title or a caption belongs to the core
            while (up := parents[core]) != core and up != self.body and tags[up] not in ("html", "#root"):
                more, more_links = chars[up] - chars[core], links[up] - links[core]
                if more > WIDEN * chars[core] or more_links * 2 > more:
                    break
                core = up
            least = self.threshold(core, self.body)
            # the node of greatest sum in each subtree, from below
            best = list(range(n))
            for k in range(n - 1, 0, -1):
                if not cut[k] and sums[best[k]] >= sums[best[parents[k]]]:
                    best[parents[k]] = best[k]
            marked[core] = True
            for k in range(n):
                if not cut[k] and k != self.body and k and chars[k] and dense[k] >= least:
                    marked[best[k]] = True
                elif k < core and tags[k] == "h1" and not cut[k] and not self.in_link[k]:
                    marked[k] = True
        for k in range(1, n):
            marked[k] = (marked[k] or marked[parents[k]]) and not cut[k]
        return marked


def density(c: int, lc: int, t: int, lt: int, share: float) -> float:
    """The composite density of c characters and t tags, lc and lt of them in links; share: of links in the body's text."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)), 0.0) / max(math.log(base), 0.05)


def main_text(source: str | None) -> str:
    """The article of a page as one line."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, url_col, text, n_chars per page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return rows.mapInArrow(task, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
