"""Queries on cutting texts into chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import chunking as ck
from gridloom.plans.registry import query


@query("markdown_sections", """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS INTEGER) AS section, trail, body FROM md_sections""")
def markdown_sections(t):
    return t.md_docs.select("doc_id", F.posexplode_outer(ck.markdown_sections(F.col("text"))).alias("section", "s")).where("section IS NOT NULL").select(
        "doc_id", "section", "s.trail", "s.body")


@query("merge_small_sections", """
SELECT doc_id, CAST(sec AS INTEGER) AS section, s.trail AS trail, s.body AS body, s.whole AS whole
FROM (SELECT doc_id, unnest(range(0, len(secs))) AS sec, unnest(secs) AS s FROM md_merged)""")
def merge_small_sections(t):
    merged = ck.merge_small_sections(ck.markdown_sections(F.col("text")))
    return t.md_docs.select("doc_id", F.posexplode_outer(merged).alias("section", "s")).where("section IS NOT NULL").select(
        "doc_id", "section", "s.trail", "s.body", "s.whole")


@query("pack_paragraphs", r"""
SELECT doc_id, CAST(unnest(range(0, len(ps))) AS INTEGER) AS part, unnest(ps) AS piece FROM (
  SELECT doc_id, acc.out || CASE WHEN acc.cur <> '' THEN [acc.cur] ELSE [] END AS ps FROM (
    SELECT doc_id, list_reduce(
      list_filter(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p, chr(10) || ' ' || chr(9)) <> ''),
      lambda a, p: CASE WHEN a.cur = '' THEN {'cur': p, 'out': a.out}
               WHEN length(a.cur) + 2 + length(p) <= 1400 THEN {'cur': a.cur || chr(10) || chr(10) || p, 'out': a.out}
               ELSE {'cur': right(a.cur, 160) || chr(10) || chr(10) || p, 'out': list_append(a.out, a.cur)} END,
      {'cur': '', 'out': CAST([] AS VARCHAR[])}) AS acc FROM documents))""")
def pack_paragraphs(t):
    body = F.regexp_replace("text", "\n", "\n\n")
    return t.documents.select("doc_id", F.posexplode_outer(ck.pack_paragraphs(body)).alias("part", "piece")).where("part IS NOT NULL")


@query("chunk_markdown", "SELECT doc_id, CAST(position AS INTEGER) AS position, trail, piece FROM md_chunks")
def chunk_markdown(t):
    return t.md_docs.select("doc_id", F.posexplode_outer(ck.chunk_markdown(F.col("text"))).alias("position", "c")).where("position IS NOT NULL").select(
        "doc_id", "position", "c.trail", "c.piece")


@query("document_chunks", r"""
SELECT 'doc:docs-' || doc_id || '-md:' || position AS id, 'doc' AS kind,
       CASE WHEN trail <> '' THEN lang || ' - ' || trail ELSE lang END AS title,
       file || ' - ' || CASE WHEN trail <> '' THEN trail ELSE '(document root)' END AS locator,
       'PROJECT DOCUMENTATION, ' || file || ' (' || CASE WHEN trail <> '' THEN trail ELSE '(document root)' END || '):' || chr(10)
       || coalesce(standing || chr(10), '') || chr(10) || piece AS text,
       file AS meta_file
FROM md_chunks JOIN md_docs USING (doc_id)""")
def document_chunks(t):
    made = ck.document_chunks(t.md_docs, "lang", "PROJECT DOCUMENTATION")
    return made.select("id", "kind", "title", "locator", "text", F.col("metadata")["file"].alias("meta_file"))
