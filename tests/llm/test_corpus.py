"""Corpus operators against brute force, exact round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railweave.llm import bytespans, chat, jaccard, lines, media, mixing, neighbors, packing, spans, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(90))
    rows = []
    for i in range(60):
        words = " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 200)))
        rows.append((i, words if i % 4 else f"{words[:100]} {passage}\n{words[100:]}"))
    rows += [(100 + i, rows[5][1]) for i in range(12)]
    near = rows[7][1].split(" ")
    for i in range(14):
        w = list(near)
        w[i * 3 % max(1, len(w))] = f"zz{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "  \n\t"), (303, "a" * 900), (304, "ab " * 300), (305, "x"), (306, "One two"), (307, "ONE two")]
    return rows


def test_span_removal(spark, texts):
    want, seen = {}, set()
    for i, t in sorted(texts):
        w = WORD.findall(t or "")
        out = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                out[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(out), " ".join(a for a, o in zip(w, out, strict=True) if not o))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in spans.remove_repeated_spans(table(spark, texts)).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 0


def test_byte_removal(spark, texts):
    count = Counter()
    for _, t in texts:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = {}
    for i, t in texts:
        b = (t or "").encode()
        out = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                out[k : k + 200] = True
        runs = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
        want[i] = (len(b), int(out.sum()), runs, bytes(c for c, o in zip(b, out, strict=True) if not o))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in bytespans.remove_repeated_bytes(table(spark, texts)).collect()}
    assert got == want


def test_byte_parse_by_pieces(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    rows = [(0, long), (1, "q" * 37 + long)]
    whole = table(spark, rows)
    texts = bytespans.R.keyed(whole, "doc_id", "text")
    found = bytespans.parse(texts, 200, piece=700)
    runs = bytespans.R.covered(found, texts, bytespans.raw_bytes, lambda raw: bytespans.BYTE_SYMBOL[raw], 200, False, bytespans.Scratch())
    assert sorted(int(bytespans.R.gone([], 0, 200).sum()) for _ in (0, 1)) == [0, 0]
    got = {r.kid: sum(len(range(x.a, x.a + x.n)) for x in r["items"]) for r in runs.collect()}
    assert got == {0: 4801, 1: 4801}


def components(links, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_jaccard(spark, texts):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in components(links, sets).items()}
    for small, few in ((4, 8), (2, 0)):  # with 0, all open blocks go to the narrow size bands
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table(spark, texts), small=small, few=few).collect()}
        assert got == want
    kept = jaccard.keep_first_of_each(table(spark, texts + [(5, texts[5][1])]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_jaccard_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, lone = (text() for _ in range(5))
    # A group of copies and near copies with a null id among them; id 9 has the texts c and d.
    rows = [(i, a) for i in range(20, 26)] + [(None, a), (30, f"{a} z"), (31, f"y {a}"), (None, b), (None, f"{b} z"), (9, c), (9, d), (12, f"{c} z"), (13, f"{d} z"), (4, f"y {c}"), (14, lone), (9, " ")]
    for small, few in ((4, 8), (2, 0)):
        found = jaccard.jaccard_components(table(spark, rows), small=small, few=few).collect()
        got = Counter((r.doc_id, r.component_id) for r in found)
        want = Counter({(i, 20): 1 for i in (*range(20, 26), 30, 31, None)})
        want += Counter({(None, None): 2, (9, 4): 1, (12, 4): 1, (4, 4): 1, (9, 9): 2, (13, 9): 1, (14, 14): 1})
        assert got == want
    kept = jaccard.keep_first_of_each(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(20, a), (None, a), (None, b), (None, f"{b} z"), (4, f"y {c}"), (9, d), (14, lone), (9, " ")])


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    near = np.concatenate([base[:10] + rng.normal(size=(10, 16)).astype(np.float32) * 0.05 for _ in range(3)])
    every = np.concatenate([base, near, base[:3]])
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(every)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, [], 0)]
    unit = every.astype(np.float64) / np.linalg.norm(every.astype(np.float64), axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    got = {r.vec_id: r for r in neighbors.link_vectors(table(spark, rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(len(every)))
    assert 0.9 * hit.sum() <= found <= hit.sum()
    assert all(got[i].n_links <= hit[i].sum() for i in range(len(every)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905))


def test_forest_has_the_components_of_its_links():
    rng = np.random.default_rng(0)
    hit = rng.random((12, 15)) < 0.12
    nx, ny = np.arange(12), np.arange(100, 115)
    pairs = [(int(nx[i]), int(ny[j])) for i, j in zip(*np.nonzero(hit), strict=True)]
    nodes = [*nx.tolist(), *ny.tolist()]
    assert components(neighbors.forest(nx, ny, hit).tolist(), nodes) == components(pairs, nodes)


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*texts, (400, "word " * 5000), (401, "say <|endoftext|> now")]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4") for i, t in rows}
    got = packing.pack_documents(table(spark, rows)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i]))
            at += r.length
        assert at == len(ids[i])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_differencing_levels_sums():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 300) for _ in range(400)]
    windows = packing.difference(sizes, 20)
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(400))
    assert max(sums) - min(sums) <= 60
    assert all(sum(sizes[i] for i in w) <= 2048 for w in packing.fill(sizes, 2048))


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a", "b", "b", "c", "d", None]), 0) for i in range(600)]
    rows += [(900, None, "en", "e", 0), (3, rows[3][1], "en", rows[3][3], 0)]
    got = mixing.mix_sources(table(spark, rows, DOCS)).join(table(spark, rows, DOCS).select("doc_id", "source").distinct(), "doc_id").collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * size[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 62 for s in names)
    again = mixing.mix_sources(table(spark, rows[::-1], DOCS))
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mixing.mixed_rows(table(spark, rows, DOCS)).count() == sum(r.copies for r in got)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    bad, good = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc > 0.85
    odd = toxicity.score_toxicity(table(spark, [(1, None), (2, ""), (None, "x")]), labels.limit(0)).collect()
    assert len(odd) == 3
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert 0 < kept.count() < docs.count()


def test_isotonic_never_falls():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    knots, values = toxicity.isotonic(x, np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    # A thousand clean rows and a toxic one of one raw score, in any order, and a toxic one above.
    for order in (slice(None), slice(None, None, -1)):
        x, y = np.array([0.1] * 1001 + [0.9]), np.array([0.0] * 1000 + [1, 1])
        knots, values = toxicity.isotonic(x[order], y[order])
        assert np.interp(0.1, knots, values) == pytest.approx(1 / 1001) and np.interp(0.9, knots, values) == 1


def test_media_round_trip(spark, texts):
    for data in (b"", b"x", bytes(range(256)) * 3, b"\0" * 64):
        payload = media.pad(data)
        assert len(payload) % 64 == 0 and payload
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    items = media.parse_sequence('<p>a &amp; b<script>x</script></p><figure><img src="d1"><figcaption>cap <b>one</b></figcaption></figure>tail<img src="d2" alt="two">')
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "a & b", None, None), (1, "media", None, "d1", "cap one"), (2, "text", "tail", None, None), (3, "media", None, "d2", "two")]
    rows = table(spark, texts).select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    read = {r.digest: r for r in media.read_media(media.store_media(rows)).collect()}
    for _, t in texts:
        data = (t or "").encode()
        r = read[hashlib.sha256(data).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(media.pad(data)), hashlib.sha256(media.pad(data)).hexdigest())
        assert r.tail_crc32 == zlib.crc32(media.pad(data)[-64:])


def test_media_query_covers_every_document(spark):
    from railweave.llm import queries

    got = queries.op8_media_columns(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count() == got.where("payload_sha256 IS NOT NULL AND caption = concat('document ', doc_id)").count()


def test_lines(spark):
    rows = [(i, f"own {i}\n menu \n\nown {i}", "h" if i < 8 else "g") for i in range(10)] + [(10, None, None), (11, "", "h")]
    got = {r.id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_site_lines(table(spark, rows, "id long, text string, host string"), "id", "text", "host", 0.5).collect()}
    assert got[0] == ("own 0\n\nown 0", 4, 1)
    assert got[8] == ("own 8\n menu \n\nown 8", 4, 0)
    assert got[10] == (None, 0, 0)
    assert got[11] == ("", 1, 0)


def test_lines_of_repeated_rows(spark):
    # Page 0 stands in four rows; its own lines are on one of twelve pages. Page 20 is on two hosts.
    rows = [(0, "own 0\nalso 0", "h")] * 4 + [(i, f"own {i}", "h") for i in range(1, 11)]
    rows += [(20, "menu\nown 20", "h"), (20, "menu\nown 20", "g")] + [(30 + i, f"menu\nown {30 + i}", "g") for i in range(5)]
    got = lines.drop_site_lines(table(spark, rows, "id long, text string, host string"), "id", "text", "host", 0.1).collect()
    assert Counter((r.id, r.host, r.text) for r in got if r.id in (0, 20)) == Counter({(0, "h", "own 0\nalso 0"): 4, (20, "h", "menu\nown 20"): 1, (20, "g", "own 20"): 1})


def test_chat(spark):
    say = lambda c, *turns: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows = say(1, "a", "b") + say(2, "a", "b", "c") + say(3, "a", "x") + say(4, "a", "b", "c") + say(5, "a") + [(None, 0, "user", "z"), (6, None, "user", "z"), (7, 0, None, None)]
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render_chats(table(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 3, 7}
    assert got[3] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n")


def test_empty_tables(spark):
    docs = table(spark, [], DOCS)
    for made in (spans.remove_repeated_spans(docs), bytespans.remove_repeated_bytes(docs), jaccard.jaccard_components(docs), packing.pack_documents(docs), mixing.mix_sources(docs), lines.drop_site_lines(docs, "doc_id", "text", "source")):
        assert made.count() == 0
    assert neighbors.link_vectors(table(spark, [], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.render_chats(table(spark, [], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    clean = P.keep(P.toxic_out(spark, docs, SF), "clean")
    assert {r.doc_id for r in clean.collect()} == {i for i in rows if not scores[i]}
    cut = P.keep(P.site_lines_out(spark, clean, SF), "cut")
    first = P.keep(P.near_copies_out(spark, cut, SF), "first")
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(cut).collect()}
    assert {r.doc_id for r in first.collect()} == {i for i, c in found.items() if i == c}
    mix = P.keep(P.mixed(spark, first, SF), "mix")
    want = Counter({r.doc_id: r.copies for r in mixing.mix_sources(first).collect() if r.copies})
    assert Counter(r.doc_id for r in mix.collect()) == want
    pieces = P.packed(spark, mix, SF)
    assert pieces.select("doc_id").distinct().count() == len(want)
    assert all(x.columns == docs.columns for x in (clean, cut, first, mix))


def test_pipeline_keeps_one_of_hot_copies(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = [r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()]
    own = docs.where(F.col("doc_id").isin(clean)).orderBy(F.desc(F.size(F.split("text", "\n"))), "doc_id").first()
    copies = spark.range(10**6, 10**6 + 40).select(F.col("id").alias("doc_id"), *[F.lit(own[c]).alias(c) for c in docs.columns[1:]])
    docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    every = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = P.site_lines_out(spark, every, str(tmp_path))
    assert {r.text for r in cut.where(F.col("doc_id") >= 10**6).collect()} == {own.text}
    hot = [own.doc_id, *range(10**6, 10**6 + 40)]
    out = P.run(spark, str(tmp_path)).where(F.col("doc_id").isin(hot)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert [r.doc_id for r in out] == [own.doc_id] and out[0].n > 10
