"""Operators 11 to 13 against brute force, edge cases and pages of other make."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import pytest
from railweave.llm import maintext, merkle, search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def paths_up(nodes):
    """Root of a list of digests, and for each the (left, right) siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, k in enumerate(at):
            low = k // 3 * 3
            paths[j].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 3])))
            at[j] = k // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(told, (r[0], r[3], r[2], r[4], text))))
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    lists = [sorted(sources[s], key=lambda x: x[:3]) for s in names]
    trees = [paths_up([x[2] for x in v]) for v in lists]
    root, upper = paths_up([t[0] for t in trees])
    for v, (subroot, lower), above in zip(lists, trees, upper, strict=True):
        for (_, _, own, r), below in zip(v, lower, strict=True):
            text, path = r[1], below + above
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for a, b in path:
                folded = sha(a + folded + b)
            yield r[0], own, subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    source = lambda i: "one" if i == 7 else [None, "", "a", "é", "big", "big", "big", "big"][i % 8]
    out = [(i if i % 50 else None, None if i % 17 == 0 else "".join(rng.choice("aé\n") for _ in range(rng.randrange(9))), "en" if i % 3 else None, source(i), i) for i in range(900)]
    return [*out, *out[5:9], (5000, "x\n" * 200000, "en", "a", 1)]


@pytest.mark.parametrize("take", [0, 1, 4, 905])
def test_manifest(spark, rows, take):
    docs = spark.createDataFrame(rows[:take], DOCS).selectExpr("*", "1 AS g", "2 AS node", "3 AS path", "4 AS leaf")
    assert ordered(merkle.manifest(docs).collect()) == ordered(plain_manifest(rows[:take]))


def plain_search(docs, items, k=10):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")
    counts = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    n_docs, n_terms, df = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(low(t)))
    for i, terms in asked.items():
        found = []
        for doc, c in counts:
            if c:
                m = 10 + 90 * c.total() * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
                found.append((-score, doc is not None, doc or 0, doc))
        yield from ((i, n + 1, x[3], -x[0]) for n, x in enumerate(sorted(x for x in found if x[0] < 0)[:k]))


@pytest.mark.parametrize(("block", "shard", "queries"), [(4096, 1 << 14, 1 << 12), (50, 100, 10)])
def test_search(spark, monkeypatch, block, shard, queries):
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "QUERY_BLOCK", queries)
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abBé9") for _ in range(rng.randrange(1, 5))) for _ in range(90)]
    some = lambda n: [vocab[min(89, int(rng.paretovariate(0.5)))] for _ in range(n)]
    docs = [(i if i % 40 else None, None if i % 31 == 0 else rng.choice([" ", "-", "\n"]).join(some(rng.randrange(40)))) for i in range(700)]
    docs += [docs[7]] * 15 + [(9000, "ab " * 50000), (9001, "")]
    items = [(i, " ".join(some(12))) for i in range(30)] + [(3, "ab é"), (77, None), (78, ""), (79, "unseen"), (None, "ab ba"), (4, "AB")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS block").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item")
    assert ordered(search.ranked_search(d, q).collect()) == ordered(plain_search(docs, items))


@pytest.mark.parametrize("none", ["docs", "items"])
def test_search_of_nothing(spark, none):
    docs = spark.createDataFrame([] if none == "docs" else [(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([] if none == "items" else [(1, "a")], "item_id long, text string")
    assert search.ranked_search(docs, items).count() == 0


def test_search_stops_opening_accumulators():
    """Documents that hold only a common term are never opened once the rare one has filled the result."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int32()))])
    n = 1000
    rows = pa.table([[0, 0, 0], [None, "rare", "common"], [list(range(n)), list(range(20)), list(range(n))], [[5] * n, [4] * 20, [1] * n]], schema=schema)
    shard = search.Shard(rows, n, 5 * n)
    found = shard.best([(20, "rare", 3000), (n, "common", 1)], 10)
    assert [p for p, _ in found] == list(range(10)) and len({s for _, s in found}) == 1
    assert not shard.acc.any()


PAGES = {
    "layout of divs": (
        '<html><body class="article menu"><header><a href=/>Home</a><form><input><button>Go</button></form></header><div id="cookieBanner">We use cookies to make this site better for everyone.</div>'
        '<div class="layout"><div class="leftNav"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class="article-body"><h1>A title here</h1><p>First &amp; long paragraph &nbsp; of it.<p>Short.<ul><li>point one<li>point two</ul>'
        '<p>Last<br>line.</div></div><section id="comments"><article class="comment"><p>This is such a great article, thank you for it.</p></article></section><footer><p>All rights reserved by the company.</p></footer>',
        "A title here\nFirst & long paragraph of it.\nShort.\npoint one\npoint two\nLast line.",
    ),
    "no marks at all": (
        "<div><div><p>Some text with a number of words which run on for long enough to count as text.</p><p>Yes.</p><p>And another paragraph that again has many words.</p></div><div><p><a href=x>Link one</a></p><p><a href=x>Link two</a></p></div></div>",
        "Some text with a number of words which run on for long enough to count as text.\nYes.\nAnd another paragraph that again has many words.",
    ),
    "aside in an article": ('<article><h1>Head</h1><p>Body text.</p><aside><p>Aside text, long or not, is no main text.</p></aside><p style="display: none">Hidden.</p><p>End.</p></article>', "Head\nBody text.\nEnd."),
    "unclosed comment": ("<main><p>Here.</p><!-- never closed <p>Not here.</p></main>", "Here."),
    "unclosed script": ('<main><p>Here.</p><script>var a = "<p>No.</p>"', "Here."),
    "references": ("<article><p>&lt;b&gt; &#65;&#x42; &copy &bogus; a &amp;amp; b</p></article>", "<b> AB © &bogus; a &amp; b"),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_of_other_make(name):
    page, want = PAGES[name]
    assert maintext.main_text(page, maintext.train()) == want


def test_main_text_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in maintext.extract_main_text(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(p for p in parts if p)
        assert got[row.page_id] == (want, len(want))


def test_main_text_edges(spark):
    long = "<article>" + "<p>word</p>" * 40000 + "</article>"
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, "v", long)]
    got = maintext.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert ordered((r.page_id, r.url, r.n_chars) for r in got) == ordered([(1, "u", 0), (1, "u", 0), (None, None, 0), (2, "v", 40000 * 5 - 1)])
    assert maintext.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_against_all_splits():
    """The first split has the least Gini cost of all features and thresholds."""
    rng = random.Random(2)
    import numpy as np

    x = np.array([[rng.randrange(6), rng.randrange(4), rng.random()] for _ in range(60)], float)
    y = (x[:, 0] + x[:, 1] > 4).astype(float)
    gini = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    costs = [gini(y[x[:, f] <= t]) + gini(y[x[:, f] > t]) for f in range(3) for t in np.unique(x[:, f]) if min((x[:, f] <= t).sum(), (x[:, f] > t).sum()) >= 2]
    f, t, _, _ = maintext.grow(x, y, 1, 2)
    assert gini(y[x[:, f] <= t]) + gini(y[x[:, f] > t]) == pytest.approx(min(costs))
