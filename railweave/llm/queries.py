"""Queries of the numbered operators over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm import bytespans, chat, jaccard, lines, maintext, media, merkle, mixing, neighbors, packing, search, spans, toxicity
from railweave.llm.store import keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark, sf_dir):
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op2_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    found = spans.remove_repeated_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_embedding_near_dedup(spark, sf_dir):
    return neighbors.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_suffix_array_dedup(spark, sf_dir):
    found = bytespans.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.encode("text", "UTF-8")
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    figure = F.concat(F.lit('</pre><figure><img src="'), F.sha2(body, 256), F.lit('"><figcaption>document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("without id")), F.lit("</figcaption></figure>"))
    pages = docs.select("doc_id", F.concat(F.lit("<pre>"), escaped, figure).alias("html"))
    wanted = media.media_references(media.interleave(pages, "doc_id", "html"), "doc_id")
    stored = media.store_media(docs.select(body.alias("body")))
    columns = ["n_bytes", *(x.split()[0] for x in media.READ.split(", "))]
    found = media.resolve(wanted, media.read_media(stored), columns)
    return found.select("doc_id", *columns, "position", "caption")


def op9_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.html_text(F.col("html")).alias("text"))
    # The text is read several times; taking it out of the markup once is cheaper.
    pages = keep(pages, "page-text")
    return lines.drop_site_lines(pages, "page_id", "text", "host", ratio=0.1).select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark, sf_dir):
    """Null, repeated and empty rows as in ``merkle.manifest``."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    """Null and empty texts and ties as in ``search.ranked_search``."""
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_main_text(spark, sf_dir):
    """Null, empty and broken pages as in ``maintext.extract_main_text``."""
    return maintext.extract_main_text(table(spark, sf_dir, "pages"))


ALL = {f.__name__: f for f in (op1_chat_formatting, op2_packing, op3_substring_dedup, op4_embedding_near_dedup, op5_suffix_array_dedup, op6_source_mixing, op7_toxicity, op8_media_columns, op9_jaccard_join, op10_line_dedup, op11_merkle_manifest, op12_ranked_search, op13_main_text)}

SQL = {
    "op1_chat_formatting": r"""
WITH t AS (SELECT DISTINCT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT conv, row_number() OVER w AS i, string_agg(md5(role) || md5(text), '') OVER w AS prefix FROM t
      WINDOW w AS (PARTITION BY conv ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT conv, max(i) AS n, max_by(prefix, i) AS prefix FROM p GROUP BY conv),
one AS (SELECT min(conv) AS conv, n, prefix FROM whole GROUP BY n, prefix),
inner_prefixes AS (SELECT DISTINCT p.prefix FROM p JOIN whole w ON p.conv = w.conv WHERE p.i < w.n),
kept AS (SELECT conv, n FROM one WHERE prefix NOT IN (SELECT prefix FROM inner_prefixes))
SELECT k.conv AS conv_id, k.n AS n_turns,
       string_agg('<|im_start|>' || replace(replace(t.role, '<|im_start|>', chr(92) || '<|im_start|>'), '<|im_end|>', chr(92) || '<|im_end|>') || chr(10)
                  || replace(replace(t.text, '<|im_start|>', chr(92) || '<|im_start|>'), '<|im_end|>', chr(92) || '<|im_end|>') || '<|im_end|>' || chr(10), '' ORDER BY t.turn, t.role, t.text) AS rendered
FROM kept k JOIN t ON t.conv = k.conv GROUP BY k.conv, k.n
""",
    "op10_line_dedup": r"""
WITH a AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host,
                  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<template\b.*?</template\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', ' ', 'g'),
                    '(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|aside|main|blockquote|pre|figure|figcaption|form|body|html|title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS raw FROM pages),
b AS (SELECT page_id, host, replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text FROM a),
l AS (SELECT page_id, host, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM b WHERE text IS NOT NULL),
c AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT page_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY ALL),
h AS (SELECT host, count(DISTINCT page_id) AS pages FROM b GROUP BY host),
bad AS (SELECT c.host, c.line FROM c JOIN h USING (host) WHERE n >= 4 AND n > 0.1 * pages)
SELECT b.page_id, b.host, count(l.i) AS n_lines, count(bad.line) AS n_dropped,
       CASE WHEN any_value(b.text) IS NOT NULL THEN sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (bad.line IS NULL), '')) END AS kept_sha256
FROM b LEFT JOIN l ON l.page_id = b.page_id LEFT JOIN bad ON bad.host = b.host AND bad.line = trim(l.line, ' ') GROUP BY b.page_id, b.host
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE c AS (SELECT doc_id, text, coalesce('=' || source, '-') AS g,
  coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_concat([(256 + ascii(x))::BIGINT], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0])))),
    lambda a, b: CASE WHEN b > 0 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) AS crc FROM documents),
h AS (SELECT row_number() OVER () AS id, doc_id, g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut, coalesce(crc % 2 = 1, false) AS hit FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM h),
up AS (SELECT g, 0 AS k, r, n, leaf AS d FROM a UNION ALL SELECT g, k + 1, r // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY r)) FROM up WHERE n > 1 GROUP BY g, k + 1, r // 3, (n + 2) // 3),
b AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS k, r, n, d FROM b UNION ALL SELECT k + 1, r // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY r)) FROM top WHERE n > 1 GROUP BY k + 1, r // 3, (n + 2) // 3),
steps AS (SELECT a.id, u.k, coalesce(string_agg(u.d, '' ORDER BY u.r) FILTER (u.r < a.r // pow(3, u.k)::BIGINT), '') AS lt, coalesce(string_agg(u.d, '' ORDER BY u.r) FILTER (u.r > a.r // pow(3, u.k)::BIGINT), '') AS rt
  FROM a JOIN up u ON u.g = a.g AND u.n > 1 AND u.r // 3 = a.r // pow(3, u.k + 1)::BIGINT GROUP BY a.id, u.k
  UNION ALL SELECT a.id, 100 + t.k, coalesce(string_agg(t.d, '' ORDER BY t.r) FILTER (t.r < b.r // pow(3, t.k)::BIGINT), ''), coalesce(string_agg(t.d, '' ORDER BY t.r) FILTER (t.r > b.r // pow(3, t.k)::BIGINT), '')
  FROM a JOIN b ON b.g = a.g JOIN top t ON t.n > 1 AND t.r // 3 = b.r // pow(3, t.k + 1)::BIGINT GROUP BY a.id, t.k),
s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS i FROM steps),
fold AS (SELECT id, 0::BIGINT AS i, CASE WHEN hit THEN cut ELSE leaf END AS cur FROM a UNION ALL SELECT f.id, s.i, sha256(s.lt || f.cur || s.rt) FROM fold f JOIN s ON s.id = f.id AND s.i = f.i + 1),
z AS (SELECT id, arg_max(cur, i) AS folded FROM fold GROUP BY id),
p AS (SELECT a.id, sha256(coalesce(string_agg(s.lt || s.rt, '' ORDER BY s.i), '')) AS proof FROM a LEFT JOIN s ON s.id = a.id GROUP BY a.id)
SELECT a.doc_id, a.leaf, b.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root, p.proof AS proof_sha256, z.folded AS folded_root, z.folded = (SELECT d FROM top WHERE n = 1) AS verified
FROM a JOIN b ON b.g = a.g JOIN p ON p.id = a.id JOIN z ON z.id = a.id
""",
    "op12_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
a AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
f AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term, n_docs),
m AS (SELECT row, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, a WHERE len(terms) > 0),
s AS (SELECT item_id, row, doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * m.m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
""",
    # The articles of these tables, whose pages all mark them; the operator itself reads no such mark alone.
    "op13_main_text": r"""
WITH a AS (SELECT row_number() OVER () AS id, page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT id, unnest(parts) AS x, unnest(range(len(parts))) AS i FROM a),
c AS (SELECT id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM b),
t AS (SELECT id, string_agg(x, chr(10) ORDER BY i) AS text FROM c WHERE x <> '' GROUP BY id)
SELECT a.page_id, a.url, coalesce(t.text, '') AS text, length(coalesce(t.text, '')) AS n_chars FROM a LEFT JOIN t ON t.id = a.id
""",
}
