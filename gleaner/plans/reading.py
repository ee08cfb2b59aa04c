"""Queries for what is read of pages: the main text of web pages, and pages of long documents for questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import html as H
from gleaner.functions import text as T
from gleaner.operators import pages, windows
from gleaner.plans.registry import query, table

_SILENT = "html"
for _tag in H.SILENT:
    _SILENT = rf"regexp_replace({_SILENT}, '(?is)<{_tag}\b.*?</{_tag}\s*>', ' ', 'g')"
_FOLDED = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'))"""
_COUNTED = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, ' ')) END"


@query(r"""WITH a AS (SELECT page_id, html, regexp_replace(""" + _SILENT + r""", '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(t, '(?i)<h[1-6]\b[^>]*>', chr(1) || chr(2), 'g'), '(?i)</?(?:""" + H.BLOCKS + r""")\b[^>]*>', chr(1), 'g'), chr(1)) AS t FROM a),
c AS (SELECT page_id, unnest(t) AS raw, generate_subscripts(t, 1) AS place FROM b),
d AS (SELECT page_id, place, starts_with(raw, chr(2)) AS heading, """ + _FOLDED.format("replace(raw, chr(2), ' ')") + " AS text, " + _FOLDED.format(r"array_to_string(regexp_extract_all(raw, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), ' ')") + """ AS link FROM c),
e AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS i, heading, text, """ + _COUNTED.format("text") + " AS words, " + _COUNTED.format("link") + """ AS links FROM d WHERE text <> ''),
f AS (SELECT *, sum(CASE WHEN links * 3 > words THEN -words WHEN heading THEN words ELSE greatest(words - 10, -3) END) OVER (PARTITION BY page_id ORDER BY i) AS upto FROM e),
g AS (SELECT *, coalesce(lag(upto) OVER (PARTITION BY page_id ORDER BY i), 0) AS before FROM f),
r AS (SELECT b.page_id, b.i AS b, e.i AS e, e.upto - b.before AS total FROM g b JOIN g e ON b.page_id = e.page_id AND b.i <= e.i QUALIFY row_number() OVER (PARTITION BY b.page_id ORDER BY total DESC, e.i, b.i DESC) = 1),
m AS (SELECT g.page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM g JOIN r ON r.page_id = g.page_id AND g.i BETWEEN r.b AND r.e WHERE total > 0 AND links * 3 <= words GROUP BY g.page_id),
o AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM g WHERE links * 3 <= words GROUP BY page_id),
w AS (SELECT a.page_id, nullif(coalesce(m.text, o.text, trim(html), ''), '') AS text FROM a LEFT JOIN m USING (page_id) LEFT JOIN o USING (page_id))
SELECT page_id, text, CASE WHEN text IS NULL THEN 'html extracted empty text' END AS error FROM w""")
def main_text(spark, sf_dir):
    """The main text of web pages: the run of blocks that speaks most, without links and what stands around it."""
    return H.main_text(table(spark, sf_dir, "pages")).select("page_id", "text", "error")


@query(r"""WITH p AS (SELECT source AS doc, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc, page, text, lower(text) AS low, list_filter(list_transform(list_concat(l[1:3], list_reverse(l[greatest(1, len(l) - 2):len(l)])), lambda x: regexp_extract(x, '^[ \t\r\f]*([0-9]{1,4}|[IVXLCDM]+|[ivxlcdm]+)[ \t\r\f]*$', 1)), lambda x: x <> '')[1] AS label,
 len(regexp_extract_all(text, '(?im)^[ \t]*(?:CHAPTER\s+|APPENDIX\s+|\d+(?:\.\d+)?)\s+[A-Za-z][^\n]{2,80}?\s+\d+[ \t]*$')) >= 5 AS toc FROM p),
z AS (SELECT *, '## PDF page ' || page || CASE WHEN label IS NULL THEN '' ELSE ' (book p. ' || label || ')' END || chr(10) || text AS block FROM s),
k AS (SELECT DISTINCT item_id, lower(unnest(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_$/.-]+'), lambda x: length(x) >= 2 AND lower(x) NOT IN ('""" + "','".join(T.STOP_WORDS) + r"""')))) AS kw FROM benchmark),
d AS (SELECT DISTINCT kw FROM k),
c AS (SELECT doc, page, kw, (length(low) - length(replace(low, kw, ''))) // length(kw) AS n FROM z, d WHERE NOT toc AND contains(low, kw)),
h AS (SELECT item_id, doc, page, CAST(sum(n) AS BIGINT) AS hits FROM c JOIN k USING (kw) GROUP BY item_id, doc, page),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc ORDER BY hits DESC, page) AS n FROM h),
w AS (SELECT DISTINCT item_id, doc, unnest([page - 1, page, page + 1]) AS page FROM b WHERE n <= 10),
r AS (SELECT item_id, z.doc, z.page, block, coalesce(sum(length(block)) OVER (PARTITION BY item_id, z.doc ORDER BY z.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z JOIN w ON w.doc = z.doc AND w.page = z.page)
SELECT r.item_id, r.doc AS source, CAST(r.page AS BIGINT) AS page, coalesce(hits, 0) AS hits, md5(block) AS block_md5 FROM r LEFT JOIN h ON h.item_id = r.item_id AND h.doc = r.doc AND h.page = r.page WHERE before < 25000""")
def pages_for_questions(spark, sf_dir):
    """Folders as books, documents as their pages, every benchmark item as a question asked of each book: the pages to read."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    book = windows.numbered(docs.select("source", "doc_id"), "source", "doc_id", "page").withColumn("page", F.col("page").cast("bigint"))
    found = docs.select("doc_id", "text").join(book, "doc_id").select(F.col("source").alias("doc"), "page", "text")
    words = items.select(F.col("item_id").alias("question_id"), F.array_distinct(F.transform(T.telling_tokens(F.col("text")), lambda x: F.lower(x))).alias("keywords"))
    books = docs.select(F.col("source").alias("doc")).distinct()
    asks = books.crossJoin(F.broadcast(words))  # a stated set of questions, asked of each book
    return pages.chosen(found, asks).select(F.col("question_id").alias("item_id"), F.col("doc").alias("source"), "page", "hits", F.md5("block").alias("block_md5"))
