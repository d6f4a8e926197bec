"""Nulls, repeated rows, long texts, empty tables and clashing column names, for every operator."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.llm import bytespans, chat, jaccard, lines, media, mixing, neighbors, packing, queries, repeats, rolling, spans, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
CLASH = ["_th", "_sh", "_copy", "_d", "_bad", "_all", "_kept", "_h", "_m", "kid", "th", "node", "key", "body", "items", "root", "id", "h", "a", "n", "k", "e", "v", "size", "copies", "first", "width", "taken", "source_size", "html", "digest"]


def text(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = text(1), text(2)
    rows = [(1, a), (1, a), (2, f"{a} end"), (3, b), (None, b), (None, b), (4, None), (5, ""), (5, "other"), (6, " \n "), (7, text(3) + " " + " ".join(["again"] * 400)), (8, text(4, 30_000)), (9, f"start {b}")]
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2] if k % 5 else None, 0) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")


def wide(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def bag(df, *skip):
    return Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.drop(*skip).collect())


def on_documents(labels):
    return {
        "packing": lambda d: packing.pack_documents(d),
        "spans": lambda d: spans.remove_repeated_spans(d),
        "bytespans": lambda d: bytespans.remove_repeated_bytes(d),
        "mixing": lambda d: mixing.mix_sources(d),
        "toxicity": lambda d: toxicity.score_toxicity(d, labels),
        "jaccard": lambda d: jaccard.jaccard_components(d),
    }


@pytest.mark.parametrize("name", ["packing", "spans", "bytespans", "mixing", "toxicity", "jaccard"])
def test_clashing_names_change_nothing(spark, docs, labels, name):
    made = on_documents(labels)[name]
    plain = bag(made(docs))
    assert bag(made(wide(docs))) == plain
    per_row = 1 if name != "packing" else None
    if per_row:
        assert Counter(r[0] for r in plain.elements()) == Counter(r.doc_id for r in docs.collect())


def test_operators_that_keep_columns_keep_them_all(spark, docs, labels):
    many = wide(docs)
    for made in (mixing.mixed_rows(many), jaccard.keep_first_of_each(many), toxicity.drop_toxic(many, labels), lines.drop_site_lines(many, "doc_id", "text", "source").drop("n_lines", "n_dropped")):
        assert made.columns == many.columns
        assert {r._d for r in made.select("_d").collect()} <= {"clash"}
    assert bag(lines.drop_site_lines(many, "doc_id", "text", "source").select("doc_id", "text", "n_lines", "n_dropped")) == bag(lines.drop_site_lines(docs, "doc_id", "text", "source").select("doc_id", "text", "n_lines", "n_dropped"))


def test_rows_that_repeat_are_one_occurrence_or_each_their_own(spark, docs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # Operator 3: rows that repeat id and text are one occurrence, null ids come first.
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        w = word.findall(t or "")
        out = [False] * len(w)
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen:
                out[k : k + 20] = [True] * 20
            seen.add(window)
        want[i, t] = (i, len(w), sum(out), " ".join(x for x, o in zip(w, out, strict=True) if not o))
    assert bag(spans.remove_repeated_spans(docs)) == Counter(want[r] for r in rows)
    # Operator 5: every row is an occurrence.
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update({b[k : k + 200] for k in range(len(b) - 199)} if len(b) > 10**5 else [b[k : k + 200] for k in range(len(b) - 199)])
    got = bag(bytespans.remove_repeated_bytes(docs))
    for i, t in rows:
        b = (t or "").encode()
        out = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                out[k : k + 200] = True
        spans_out = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
        assert (i, len(b), int(out.sum()), spans_out, bytes(c for c, o in zip(b, out, strict=True) if not o)) in got
    assert sum(got.values()) == len(rows)


@pytest.mark.parametrize("most", [1 << 17, 0])
def test_suffix_order_and_hot_contexts_agree(spark, monkeypatch, most):
    # With 0 every context counts as hot, so windows are named by hash; buckets are of one window then.
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "BUCKET", 1 << 16 if most else 1)
    rng = random.Random(3)
    base = "".join(rng.choice("abcd ") for _ in range(700))
    rows = [(0, base)] + [(i, base[: 40 * i] + chr(200 + i) + base[40 * i :]) for i in range(1, 16)] + [(20, "\0" * 250), (21, "\0" * 230 + "x")]
    count = Counter()
    for _, t in rows:
        b = t.encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = {}
    for i, t in rows:
        b = t.encode()
        out = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                out[k : k + 200] = True
        want[i] = bytes(c for c, o in zip(b, out, strict=True) if not o)
    found = bytespans.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: bytes(r.kept) for r in found.collect()} == want


def test_mixing_tells_sources_apart(spark):
    rows = [(1, "a b c", "en", "x", 0), (1, "a b c", "en", "x", 0), (1, "a b c", "en", "y", 0), (2, "d", "en", "y", 0), (None, "e f", "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    copies = Counter()
    for r in mixing.mix_sources(df).join(df.select("source").distinct().withColumn("sh", F.xxhash64(F.col("source").isNull(), "source")), "sh").collect():
        copies[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixing.mixed_rows(df).collect()) == +copies


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = []
    for width in range(1, 81):
        v = rng.normal(size=width)
        rows += [(2 * width, v.tolist(), 0), (2 * width + 1, (2 * v).tolist(), 0)]
    near = rng.normal(size=90)
    rows += [(500, near.tolist(), 0), (500, (near + 0.01).tolist(), 0), (None, near.tolist(), 0), (501, near.tolist(), 0), (501, near.tolist(), 0)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in neighbors.link_vectors(wide(spark.createDataFrame(rows, VECTORS))).collect()]
    want = [(i, 1, i - i % 2) for i in range(2, 162)] + [(500, 3, 500)] * 2 + [(501, 3, 500)] * 2 + [(None, 0, None)]
    assert Counter(got) == Counter(want)


def test_vector_index_recall(spark):
    # 20,000 vectors in 40 clusters; a tenth have a partner at cosine 0.90 to 0.92.
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(40, 32))
    v = centre[rng.integers(0, 40, 18_000)] + 1.2 * rng.normal(size=(18_000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    x = v[:2000]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.92, (2000, 1))
    v = np.concatenate([v, cosine * x + np.sqrt(1 - cosine**2) * noise]).astype(np.float32)
    unit = v.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = np.zeros(len(v), np.int64)
    for at in range(0, len(v), 1000):
        links[at : at + 1000] = (unit[at : at + 1000] @ unit.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], VECTORS)
    found = np.zeros(len(v), np.int64)
    for r in neighbors.link_vectors(df).collect():
        found[r.vec_id] = r.n_links
    assert (found <= links).all() and links.sum() > 3000
    assert found.sum() >= 0.95 * links.sum()


def test_chat_and_media_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "x" * 100_000), (None, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert bag(chat.render_chats(wide(turns))) == bag(chat.render_chats(turns))
    assert {r.conv_id: r.n_turns for r in chat.render_chats(turns).collect()} == {1: 2, 2: 1}
    bodies = spark.createDataFrame([(bytearray(b"x" * 300_000),), (bytearray(b""),), (bytearray(b""),)], "body binary")
    read = media.read_media(media.store_media(wide(bodies))).collect()
    assert {r.n_bytes for r in read} == {0, 300_000}
    assert {r.digest for r in read} == {hashlib.sha256(x).hexdigest() for x in (b"", b"x" * 300_000)}


def test_empty_tables_of_the_others(spark, labels, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score_toxicity(empty, labels).count() == 0 == toxicity.drop_toxic(empty, labels.limit(0)).count()
    assert mixing.mixed_rows(empty).count() == 0 == jaccard.keep_first_of_each(empty).count()
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    import corpus_pipeline

    for made in (queries.op8_media_columns, queries.op10_line_dedup, corpus_pipeline.run):
        assert made(spark, str(tmp_path)).count() == 0


def test_sketches_get_finer_until_the_pigeonhole_holds(spark):
    # With too few blocks the bound would fail; the result must not depend on where the loop starts.
    rng = random.Random(12)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 400))]
        for c in range(5):
            w = list(words)
            for _ in range(c * len(w) // 60):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((g * 10 + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split(" ")) for i, t in rows)}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((up[a], up[b]))
                up = {k: ra if v == rb else v for k, v in up.items()}
    for spread in (0.05, 1.5):
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, spread=spread).collect()}
        assert got == up


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def test_thue_morse_texts_are_told_apart(spark):
    """A text of 2,048 symbols and its mirror: as one word for operators 3 and 9, as words for 3, as bytes for 5."""
    words = ["".join(thue_morse(2048, a, b)) for a, b in ("ab", "ba")]
    assert len(set(rolling.word_hashes(" ".join(words).encode()).tolist())) == 2
    rest = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join([*rest[:10], w, *rest[10:]])) for i, w in enumerate(words)], "doc_id long, text string")
    cut = {r.doc_id: r.n_removed for r in spans.remove_repeated_spans(docs).collect()}
    assert cut == {0: 0, 1: 20}
    alone = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(alone).collect()} == {0: 0, 1: 1}

    def brute(texts, width):
        seen, out = {}, []
        for d, t in enumerate(texts):
            for i in range(len(t) - width + 1):
                seen.setdefault(tuple(t[i : i + width]), []).append((d, i))
        for d, t in enumerate(texts):
            gone = [False] * len(t)
            for places in seen.values():
                for e, i in places[1:] if width == 20 else places * (len(places) > 1):
                    if e == d:
                        gone[i : i + width] = [True] * width
            out.append(sum(gone))
        return out

    for width, glue in ((20, " "), (200, "")):
        texts = [thue_morse(2048, a, b) for a, b in ("ab", "ba")]
        table = spark.createDataFrame([(i, glue.join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
        found = spans.remove_repeated_spans(table) if width == 20 else bytespans.remove_repeated_bytes(table)
        assert [r.n_removed for r in found.orderBy("doc_id").collect()] == brute(texts, width)
