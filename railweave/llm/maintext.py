"""Operator 13, main text of web pages from flat text blocks.

A page is read as a flat run of text blocks. Each block has its word count and
link density and those of the blocks before and after it, what marked container
it stands in, and a few signs of running text. A decision tree, trained on the
blocks of ``LABELLED``, tells main text from the rest. The pages are independent
of one another: nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that part blocks; all other tags stand inside a line, br is white space.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose content is no text of the page, and tags without content.
SILENT = frozenset("script style template noscript noframes svg iframe object canvas audio video title select datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open p, li, .. that a new one of the same kind ends, up to the nearest list or table.
ENDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MAIN_TAGS, REST_TAGS = frozenset(["article", "main"]), frozenset(["nav", "footer", "aside", "form", "dialog", "menu", "search"])
#: Words of class, id and role attributes.
TALK = re.compile(r"comment|disqus|repl(y|ies)|discussion|respond|guestbook")
REST = re.compile(
    r"^(ads?|nav|side|top|share|tags|toc|skip|legal|meta|hidden|gdpr|dfp|rail|toolbar|search|form|pager|login|signup|feedback|author|byline|sticky|toast)$|^ad(box|slot|unit|banner|space|wrap|block|s?container)|^advert|nav(igation|bar|list|link|menu)|(site|main|sub|top)nav|menu|breadcrumb|masthead|banner|footer|sidebar|widget|sponsor|promo|cookie|consent|notice|alert|popup|modal|overlay|newsletter|subscri|social|sharing|sharebar|related|recommend|trending|popular|pagination|copyright|complementary|contentinfo|disclaimer|toolbar|paywall|outbrain|taboola|teaser"
)
MAIN = re.compile(r"^(article|main|content|post|entry|story|body|text|maincontent|articlebody|postbody|storybody|prose)$")
HEADER = re.compile(r"^(header|head|heading|hd|topbar)$")
#: Words of standing texts around articles.
STOCK = frozenset("cookie cookies copyright © privacy terms subscribe newsletter advertisement advert sponsored login signup share tweet facebook twitter rights reserved accept consent imprint sitemap".split())
WORD = re.compile(r"\S+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "container", "heading", "item", "sentence", "stock")


class Blocks(HTMLParser):
    """Text blocks of a page: (text, words, words in links, container, heading, item, mark).

    container is 1 in a main container, -1 in one of the rest, 0 in neither; the
    innermost counts, but nothing in reader comments is main text.
    """

    def __init__(self, marked: bool = False):
        super().__init__(convert_charrefs=True)
        self.marked, self.out, self.words, self.linked = marked, [], [], 0
        self.open: list[tuple[str, int, bool]] = []  # tag, container, mark
        self.silent: list[str] = []
        self.link = -1
        self.known: dict[tuple, tuple[int, bool]] = {}

    def read(self, html: str) -> list[tuple]:
        cut = html.rfind("<!--")
        if cut >= 0 and "-->" not in html[cut:] and "</script" not in html[cut:].lower():
            html = html[:cut]  # an unclosed comment runs to the end
        self.feed(html)
        self.close()
        self.flush()
        return self.out

    def kind(self, tag: str, attrs: list, around: int) -> tuple[int, bool]:
        """Container of an element, and whether it is hidden."""
        named = tuple((k, v or "") for k, v in attrs if k in ("class", "id", "role", "hidden", "style"))
        key = (tag, around, named)
        have = self.known.get(key)
        if have is None:
            have = self.known[key] = self._kind(tag, named, around)
        return have

    @staticmethod
    def _kind(tag: str, named: tuple, around: int) -> tuple[int, bool]:
        hidden = any(k == "hidden" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I) for k, v in named)
        parts = [] if tag in ("html", "body") else [p.lower() for k, v in named if k in ("class", "id", "role") for p in PART.findall(v)]
        whole = [] if tag in ("html", "body") else [w.lower() for k, v in named if k in ("class", "id", "role") for w in v.split()]
        if around == -2 or any(TALK.search(p) for p in parts):
            return -2, hidden
        main = tag in MAIN_TAGS or any(MAIN.search(p) for p in (*parts, *whole))
        if tag in REST_TAGS or any(REST.search(p) for p in (*parts, *whole)):
            return -1, hidden
        if (tag == "header" or any(HEADER.search(p) for p in parts)) and not main and around != 1:
            return -1, hidden
        return (1 if main else around), hidden

    def flush(self):
        text = " ".join("".join(self.words).split())
        if text:
            container = self.open[-1][1] if self.open else 0
            tags = [t for t, _, _ in self.open]
            near = tags[-1] if tags else ""
            self.out.append((text, len(WORD.findall(text)), self.linked, max(-1, container), near[:1] == "h" and near[1:].isdigit(), "li" in tags[-2:], bool(self.open and self.open[-1][2])))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent.append(tag)
            return
        if self.silent:
            return
        if tag == "br":
            self.words.append("\n")
        elif tag == "a":
            self.link = len(self.open) if any(k == "href" for k, _ in attrs) else -1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in BLOCK:
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self.drop(len(self.open) - 1)
            stop = ENDS.get(tag)
            if stop:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in stop:
                        break
                    if self.open[i][0] == tag:
                        self.drop(i)
                        break
        elif not attrs:
            return
        around = self.open[-1][1] if self.open else 0
        container, hidden = self.kind(tag, attrs, around)
        if hidden and tag not in ("html", "body"):
            container = -2
        if tag in BLOCK:
            mark = self.marked and any(k == "data-main" for k, _ in attrs) or bool(self.open and self.open[-1][2])
            self.open.append((tag, container, mark))

    def handle_endtag(self, tag):
        if tag in SILENT:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
            return
        if self.silent:
            return
        if tag == "a":
            self.link = -1
        elif tag in BLOCK:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    self.drop(i)
                    break

    def drop(self, i: int):
        del self.open[i:]
        if self.link > len(self.open):
            self.link = -1

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)
            if self.link >= 0:
                self.linked += len(WORD.findall(data))


def block_features(blocks: list[tuple]) -> np.ndarray:
    """One row of ``FEATURES`` for each block; before the first and after the last there is nothing."""
    own = np.array([(words, min(1.0, linked / words)) for _, words, linked, *_ in blocks], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    signs = [(container, heading, item, text[-1] in ".!?…。\"”»", sum(w.strip(".,:;!?()|").lower() in STOCK for w in text.split()[:60]) / min(60, words)) for text, words, _, container, heading, item, _ in blocks]
    return np.hstack([own, np.vstack([none, own])[:-1], np.vstack([own, none])[1:], np.array(signs, float).reshape(-1, 5)])


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int):
    """A tree of (feature, threshold, left, right), leaves are shares of main text; splits by the Gini index."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = hits[:-1], hits[-1] - hits[:-1]
        cost = left * (1 - left / n) + right * (1 - right / (len(y) - n))
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        at = int(cost.argmin())
        if cost[at] < best[0]:
            best = (float(cost[at]), f, float(v[at] + v[at + 1]) / 2)
    if best[1] < 0:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = walk(tree[2], x[low]), walk(tree[3], x[~low])
    return out


#: The labelled table: pages in which the elements of main text have the attribute
#: data-main; [n] stands for n words, [n.] for n words and a full stop.
LABELLED = [
    '<nav><ul><li><a href=x>[1]</a></li><li><a href=x>[2]</a></li><li><a href=x>[1]</a></li></ul></nav><div class="ad">[9.]</div><article data-main><h1>[7]</h1><p>[60.]</p><p>[1.]</p><p>[35.]</p><p>[2.]</p></article><footer>© [12.]</footer>',
    '<header><h1>[2]</h1><p>[5]</p></header><nav><a href=x>[1]</a><a href=x>[1]</a></nav><main data-main><h2>[5]</h2><p>[4.]</p><p>[3.]</p><ul><li>[6]</li><li>[3]</li></ul><p>[20.]</p></main><aside><h3>[2]</h3><p>[40.]</p><ul><li><a href=x>[6]</a></li></ul></aside><footer><p>[30.]</p></footer>',
    '<div><a href=x>[1]</a> | <a href=x>[1]</a> | <a href=x>[2]</a></div><div data-main><h1>[6]</h1><p>[45.]</p><p>[2.]</p><p>[80.]</p><p>[12.]</p><h2>[3]</h2><p>[50.]</p></div><div><a href=x>[3]</a> <a href=x>[3]</a></div><div>copyright [4] rights reserved</div>',
    '<table><tr><td><a href=x>[1]</a></td><td><a href=x>[2]</a></td></tr><tr><td data-main><p>[25.]</p><p>[33.]</p><p>[5.]</p><p>[28.]</p></td></tr><tr><td>copyright [3]</td></tr></table>',
    '<div class="cookie-notice"><p>[25.] cookies [6.]</p><button>[1]</button></div><div class="content" data-main><h1>[9]</h1><p>[30.]</p><blockquote>[14.]</blockquote><p>[9] <a href=x>[4]</a> [11.]</p></div><div class="comments"><h3>[2]</h3><div class="comment"><p>[25.]</p></div><div class="comment"><p>[4.]</p></div></div>',
    '<div id="header"><div>[3]</div><div>[4]</div></div><div id="menu"><ul><li><a href=x>[1]</a></li><li><a href=x>[1]</a></li></ul></div><div class="post" data-main><h2>[4]</h2><p>[7.]</p><p>[55.]</p></div><div class="sidebar"><p>[30.]</p></div><form><p>[6]</p><p>[15.]</p></form><div id="footer">[6]</div>',
    '<p>[2] cookies [12.] privacy [3]</p><p><a href=x>[1]</a> <a href=x>[1]</a></p><h1 data-main>[5]</h1><p data-main>[70.]</p><p data-main>[31.]</p><p data-main>[6.]</p><p data-main>[44.]</p><p>share [1] <a href=x>[2]</a></p><p>© [3]</p>',
    '<ul><li><a href=x>[2]</a></li><li><a href=x>[2]</a></li><li><a href=x>[2]</a></li></ul><h1 data-main>[4]</h1><p data-main>[16.]</p><ul data-main><li>[5]</li><li>[9]</li><li>[7]</li></ul><p data-main>[22.]</p><h3>[2]</h3><ul><li><a href=x>[5]</a></li><li><a href=x>[7]</a></li></ul><p>subscribe [3] newsletter</p>',
    '<main><div class="breadcrumbs"><a href=x>[1]</a> / <a href=x>[1]</a></div><article data-main><header><h1>[8]</h1></header><p>[3.]</p><p><a href=x>[6]</a> [20.]</p><p><a href=x>[5]</a></p><p>[40.]</p></article><section class="related"><h2>[2]</h2><p><a href=x>[8]</a></p><p>[18.]</p></section></main>',
    '<div>[2]</div><div>[1]</div><div data-main><p>[90.]</p><p>[41.]</p><p>[64.]</p></div><div>[3]</div><div><a href=x>[1]</a></div><div>[2]</div>',
    '<div>[3]</div><div data-main>[120.]</div><div>[5]</div>',
    '<div><a href=x>[2]</a></div><pre data-main>[40]</pre><div>© [2] terms</div>',
    '<div class="promo"><p>[22.]</p></div><section class="story" data-main><p>[2]</p><p>[5]</p><p>[1.]</p></section><section class="newsletter"><p>[20.]</p></section>',
    '<dl data-main><dt>[2]</dt><dd>[18.]</dd><dt>[2]</dt><dd>[21.]</dd></dl><div><a href=x>[2]</a> <a href=x>[2]</a> [1]</div>',
    '<nav><a href=x>[2]</a></nav><article data-main><p>[3.]</p></article><footer>[4]</footer>',
    '<div class="ad">[60.]</div><article data-main><h1>[2]</h1><p>[1.]</p></article><aside>[90.]</aside><footer>[80.]</footer>',
    '<article data-main><p>[300.]</p><p>[2.]</p><p>[1]</p><p>[250.]</p><ul><li>[2]</li><li><a href=x>[3]</a> [5]</li></ul></article><footer>[25]</footer>',
    '<article data-main><p>[4] <a href=x>[3]</a></p><p>[200]</p><p>[12]</p></article><div class="related"><p>[14.]</p><p><a href=x>[5]</a></p></div>',
    '<p data-main>[9.]</p>', '<div data-main>[30]</div>', '<p data-main>[15.]</p><p data-main>[2.]</p><p data-main>[18.]</p>', '<pre data-main>[6]</pre>',
    '<div data-main>[12]</div>', '<div data-main>[50]</div>', '<p data-main>[7]</p>', '<section data-main>[20]</section>',
    '<nav><a href=x>[1]</a></nav><article data-main><p>[4] copyright [3]</p><p>cookies [6.]</p><p>© [2] rights reserved</p><p>[20.]</p><p>privacy [1]</p></article><footer>copyright [5]</footer>',
    '<main data-main><h1>subscribe [2]</h1><p>share [3.]</p><p>[9.] terms</p><p>newsletter</p></main><div>share [1] tweet</div>',
    '<nav><a href=x>[1]</a></nav><div class="ad">[9.]</div><div data-main><h1>[9]</h1><p>[40.]</p><p>[2.]</p><p>[25.]</p></div><footer>© [6.]</footer>',
    '<header>[3]</header><div data-main><h1>[7]</h1><p>[25.]</p><h2>[3]</h2><p>[50.]</p><h2>[5]</h2><p>[18.]</p></div><div>[2]</div><footer>[9]</footer>',
    '<div class="banner">[5.]</div><div data-main><h1>[4]</h1><h2>[11]</h2><p>[35.]</p><h3>[2]</h3><p>[60.]</p><p>[22.]</p></div><div>[3]</div>',
    '<article data-main><p>[8]</p><p><a href=x>[3]</a></p><h2>[3]</h2><p><a href=x>[5]</a></p><p>[4]</p></article><ul><li><a href=x>[4]</a></li><li><a href=x>[2]</a></li></ul>',
    '<div class="entry" data-main><h1>[5]</h1><p>[30]</p><p>[6]</p></div><p><a href=x>[3]</a></p><div class="content" data-main><p>[10.]</p><p>[12]</p></div><p><a href=x>[3]</a></p>',
    '<article data-main><p>[8.]</p><p>[3]</p></article>', '<main data-main><p>[20]</p><p>[9]</p></main>', '<footer>[4]</footer><article data-main><p>[30.]</p><ul><li>[4]</li><li>[2]</li></ul></article>',
    '<nav><a href=x>[2]</a></nav><div class="content" data-main><h1>[3]</h1><p>[14]</p></div>', '<div class="ad">[9]</div><section class="post" data-main><p>[2]</p><p>[1]</p></section>',
    '<article data-main><p>[5]</p><p>[4] copyright [2]</p></article>', '<main data-main><p><a href=x>[4]</a></p><p>[3]</p></main>', '<article data-main><p>© [3]</p></article>',
    '<nav><a href=x>[2]</a></nav><main data-main><p>[12.]</p><p>[7] terms</p></main>', '<article data-main><p>[9.]</p><p><a href=x>[2]</a></p><p>cookies [8]</p></article>',
    '<article data-main><p>© [5.]</p><h2>cookies</h2><p>login [30.]</p></article><div class="cookie">[12.] cookies accept</div>',
    '<div>[1]</div><div>[2]</div><div data-main><p>[18.]</p><p>[1.]</p><p>[16.]</p><p>[3.]</p><p>[25.]</p></div><div><p><a href=x>[2]</a></p><p><a href=x>[2]</a></p></div><div>[2]</div>',
    '<div><a href=x>[2]</a> <a href=x>[2]</a></div><h1 data-main>[8]</h1><p data-main>[12.]</p><h2 data-main>[2]</h2><p data-main>[14.]</p><p data-main>[8.]</p><p data-main>[11.]</p><div><a href=x>[1]</a> <a href=x>[1]</a></div><div>© [5]</div>',
    '<div>[14] <a href=x>[9]</a> [3] <a href=x>[9]</a></div><div data-main><p>[28.]</p><p>[30.] <a href=x>[4]</a></p><p>[3.]</p><p>[33.]</p></div><div>advertisement [10]</div><div>[8] cookies privacy accept</div>',
]


def labelled_blocks(pages: list[str], scales: tuple[float, ...] = (1.0, 0.5, 3.0)) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages, with runs of words shorter and longer too."""
    fill = lambda scale: lambda m: " ".join(["word"] * max(1, round(int(m[1]) * scale))) + m[2]
    read = [Blocks(marked=True).read(re.sub(r"\[(\d+)(\.?)\]", fill(scale), page)) for scale in scales for page in pages]
    return np.vstack([block_features(b) for b in read]), np.array([b[-1] for page in read for b in page], float)


def train(pages: list[str] = LABELLED, depth: int = 8, least: int = 2):
    return grow(*labelled_blocks(pages), depth, least)


def main_text(html: str | None, tree) -> str:
    blocks = Blocks().read(html or "")
    if not blocks:
        return ""
    return "\n".join(b[0] for b, p in zip(blocks, walk(tree, block_features(blocks)), strict=True) if p >= 0.5)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] = LABELLED) -> DataFrame:
    """Main text of every page: (id_col, url_col, text, n_chars), one row per input row.

    Null and empty pages, and pages without main text, have the empty text. Pages
    of any length are read whole, unclosed tags and comments end with the page.
    Repeated rows get equal results; ids and urls are passed on, nulls included.
    Other columns are ignored, so their names can't clash. An empty table gives an
    empty result. The tree is trained on ``labelled``, a few dozen pages at most.
    """
    tree = train(labelled)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{url_col}` string, text string, n_chars long")
