"""run() of the pipeline, from the documents to the packed pieces, against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from railweave.llm import toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def without_site_lines(rows, ratio=0.1, least=4):
    """{id: text} without lines on more than a tenth of a source's distinct texts."""
    texts, on = defaultdict(set), Counter()
    for _, t, s in rows:
        texts[s].add(t or "")
    for s, every in texts.items():
        for t in every:
            on.update({(s, x.strip(" ")) for x in t.split("\n")})
    bad = lambda s, x: x.strip(" ") != "" and on[s, x.strip(" ")] >= least and on[s, x.strip(" ")] > ratio * len(texts[s])
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if not bad(s, x)) for i, t, s in rows}


def one_of_each(texts):
    """Ids that are the smallest of their near-duplicate component."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").encode().translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((up[a], up[b]))
                up = {k: ra if v == rb else v for k, v in up.items()}
    return {i for i in ids if up[i] == i}


def test_run_equals_plain_python(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = [(r.doc_id, r.text, r.source) for r in docs.collect() if not scores[r.doc_id]]
    source = {i: s for i, _, s in clean}
    cut = without_site_lines(clean)
    first = one_of_each(cut)
    size = {i: len(WORD.findall((cut[i] or "").encode())) for i in first}

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.append(np.array(tok.encode(cut[i] or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4") for i in first}
    tokens, places = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.doc_id in first
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()))
        tokens[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048

    copies = {i: tokens[i] / len(ids[i]) for i in first}
    assert all(c in (0, 1, 2) for c in copies.values())
    # Targets by plain water filling; what each source takes comes near its target.
    total, names = Counter(), sorted({source[i] for i in first if source[i] is not None}) + ([None] if None in {source[i] for i in first} else [])
    for i in first:
        total[source[i]] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= full
    for s in names:
        taken = sum(copies[i] * size[i] for i in first if source[i] == s)
        assert abs(taken - target[s]) <= 2 * max(size[i] for i in first if source[i] == s)
