"""Operator 10, line removal by frequency within a site (DataFrame operations only).

For each host the pages that hold a line are counted and divided by the pages of
the host; lines above a ratio are boilerplate of that host and are dropped.
Counts are of (host, line hash) with partial sums before the shuffle, only lines
on at least ``least`` pages go on, and the page totals meet them in an equi-join
that adaptive execution splits for a host with very many lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.llm.store import fresh

#: Elements whose content is not text, and tags that end a line.
HIDDEN = r"(?is)<(script|style|head|template|noscript)\b.*?</\1\s*>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|article|section|nav|header|footer|aside|main|blockquote|pre|figure|figcaption|form|body|html|title)\b[^>]*>"


def html_text(html: Column) -> Column:
    """Text of a page, one block element a line; basic entities are resolved."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n"), "<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def drop_site_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, ratio: float = 0.3, least: int = 4, least_chars: int = 1, by_text: bool = False) -> DataFrame:
    """Cut lines that stand on more than ``ratio`` of their host's documents.

    Returns the columns of ``docs`` with ``text_col`` reduced and n_lines and
    n_dropped added. Lines are compared trimmed; blank lines and lines under
    ``least_chars`` characters stay; a line is dropped only if it is on at least
    ``least`` documents. Rows that repeat id and text are one document in the
    counts; with ``by_text`` rows of one host that repeat the text alone are, so
    that a group of copies doesn't make its own lines common. The null host is a
    host. A null text stays null and has no lines;
    long texts are read whole; an empty table gives an empty result. Columns of
    the names n_lines and n_dropped are replaced; all others stay.
    """
    base = docs.drop("n_lines", "n_dropped")
    doc, cut, every, kept = fresh(base, "_d", "_bad", "_all", "_kept")
    host, text = F.col(host_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))
    # The host is part of a document, as lines common on one host may not be so on another.
    own = F.xxhash64(host.isNull(), host, *([] if by_text else [F.col(id_col)]), text)
    keys = base.select(host.alias("_h"), own.alias("_d"), F.split(text, "\n").alias("_lines"))
    long_enough = lambda x: F.length(x) >= F.lit(max(1, least_chars))
    marks = F.array_distinct(F.transform(F.filter(F.transform("_lines", lambda x: F.btrim(x)), long_enough), lambda x: F.xxhash64(x)))
    # One row for each document, so that neither count takes a repeated row twice.
    rows = keys.select("_h", "_d", marks.alias("_m")).dropDuplicates(["_h", "_d"])
    pages = rows.groupBy("_h").agg(F.count("*").alias("_pages"))
    held = rows.select("_h", "_d", F.explode("_m").alias("_line"))
    counts = held.groupBy("_h", "_line").agg(F.count("*").alias("_on")).where(F.col("_on") >= least)
    on = F.col("c._h").eqNullSafe(F.col("p._h"))
    common = counts.alias("c").join(pages.alias("p"), on).where(F.col("_on") > F.lit(ratio) * F.col("_pages")).select("c._h", "_line")
    same = F.col("x._h").eqNullSafe(F.col("y._h")) & (F.col("x._line") == F.col("y._line"))
    bad = held.alias("x").join(common.alias("y"), same, "left_semi").groupBy(F.col("_d").alias(doc)).agg(F.collect_set("_line").alias(cut))
    whole = base.withColumn(doc, own).join(bad, doc, "left")
    none = F.array().cast("array<bigint>")
    lines = F.when(F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(F.split(F.col(text_col), "\n"))
    stays = lambda x: ~(long_enough(F.btrim(x)) & F.array_contains(F.coalesce(F.col(cut), none), F.xxhash64(F.btrim(x))))
    whole = whole.withColumn(every, lines).withColumn(kept, F.filter(every, stays))
    out = F.when(F.col(text_col).isNotNull(), F.array_join(kept, "\n"))
    return whole.withColumns({text_col: out, "n_lines": F.size(every).cast("long"), "n_dropped": (F.size(every) - F.size(kept)).cast("long")}).drop(doc, cut, every, kept)
