"""Queries on the project's own index: records, tariff and documents united, renewed by content, searched beside own runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import money
from gridloom.operators import chunking as ck
from gridloom.operators import records as rc
from gridloom.operators import retrieval as rt
from gridloom.plans import chunks as _documents  # noqa: F401  its twin is part of the one below
from gridloom.plans import payloads
from gridloom.plans import retrieval as asked_sql
from gridloom.plans.registry import ORACLES, query
from gridloom.session import scratch_path
from gridloom.sources import index

_SAME = ("corpus_id", "id", "kind", "title", "locator", "text")
_NONE = "not recorded in the dataset"
_number = payloads._number
_CORPUS = "SELECT * FROM corpus UNION ALL SELECT * FROM run_chunks"
_TARIFF = rc.tariff_text().replace("'", "''").replace("\n", "' || chr(10) || '")

OWN = f"""
own AS (
  SELECT 'index' AS corpus_id, 'line:' || lower(a) || '--' || lower(b) || ':' || a || '-' || b AS id, 'dataset' AS kind,
         'Transmission line: ' || a || ' -> ' || b AS title, 'grid row ' || a || '-' || b AS locator,
         concat_ws(chr(10), 'TRANSMISSION LINE (dataset record): ' || a || ' -> ' || b, 'CSV row ' || a || '-' || b || ' of grid.',
           'Source station: ' || a, 'Destination station: ' || b, 'Type (facility type of the source station): customer',
           'Distance_km: ' || {_number('distance_km', ' km')}, 'Voltage_kV: {_NONE}', 'Capacity_MW: {_NONE}', 'Loss_Percent: {_NONE}',
           'Energy_Loss_MW: ' || {_number('energy_loss_mw', ' MW')},
           'Loss_Cost_Per_Hour_INR: ' || {_number('energy_loss_mw * 6600', ' INR per hour', 2)},
           'Loss_Cost_Per_Year_INR: ' || {_number('energy_loss_mw * 6600 * 8760', ' INR per year', 2)}) AS text
  FROM grid
  UNION ALL
  SELECT 'index', 'station:' || lower(s.name), 'dataset', 'Station: ' || s.name, 'grid (station record)',
         concat_ws(chr(10), 'STATION (dataset record): ' || s.name,
           'Type: ' || CASE WHEN left(s.name, 1) = 'C' THEN 'customer' ELSE 'supplier' END, 'Latitude: {_NONE}', 'Longitude: {_NONE}',
           'Transmission lines meeting here: ' || coalesce(n.degree, 0),
           'Directly connected stations and the line distance to each:',
           coalesce(n.listed, '  - none; this station is isolated in the dataset'))
  FROM grid_stations s LEFT JOIN (
    SELECT src, count(*) AS degree, string_agg('  - ' || src || ' <-> ' || dst || ': ' || {_number('km', ' km')}, chr(10) ORDER BY dst) AS listed
    FROM grid_adj GROUP BY src) n ON n.src = s.name
  UNION ALL SELECT 'index', id, 'dataset', 'Network summary', 'grid (whole-file summary)', text FROM ({ORACLES['network_record']})
  UNION ALL SELECT 'index', 'tariff:basis', 'dataset', 'Tariff and monetary-loss basis',
                   '{money.DEFAULT_TARIFF.source_location.replace("'", "''")}', '{_TARIFF}'
  UNION ALL SELECT 'index', id, kind, title, locator, text FROM ({ORACLES['document_chunks']}))"""

# What the tests of a search ask: two phrases a context has to hold for each line, and for each region a question off the topic.
LABELLED = """
labelled AS (
  SELECT 'line:' || a || '-' || b AS qid, 'What is the energy loss between ' || a || ' and ' || b || '?' AS question,
         ['(dataset record): ' || lower(a) || ' -> ' || lower(b), 'destination station: ' || lower(b)] AS expected FROM grid
  UNION ALL
  SELECT 'off:' || r_regionkey, 'pasta sauce recipes as ' || reverse(r_name) || ' grandmothers cooked', CAST([] AS VARCHAR[]) FROM region)"""


def searched(own: str, asked: str) -> str:
    """The twin of a search over another corpus and other questions."""
    start = asked_sql.PIECES.index("asked AS (")
    end = asked_sql.PIECES.index("q_lists AS (")
    sql = asked_sql.PIECES[:start] + f"asked AS ({asked}),\n" + asked_sql.PIECES[end:]
    return sql.replace(_CORPUS, own)


def own_chunks(t):
    """Every family of the project's own texts as one corpus."""
    lines = t.grid_cut.select(
        F.concat_ws("-", "a", "b").alias("row_number"), F.col("a").alias("source"), F.col("b").alias("destination"),
        F.lit("customer").alias("line_type"), "distance_km", "energy_loss_mw",
        *[F.lit(None).cast("decimal(18,3)").alias(c) for c in ("voltage_kv", "capacity_mw", "loss_percent")])
    nowhere = F.lit(None).cast("decimal(9,4)")
    stations = t.grid_stations.select(
        "name", F.array(F.when(F.col("name").startswith("C"), "customer").otherwise("supplier")).alias("types"),
        nowhere.alias("latitude"), nowhere.alias("longitude"))
    network = payloads.network_record(t).select(
        "id", F.lit("dataset").alias("kind"), F.lit("Network summary").alias("title"),
        F.lit("grid (whole-file summary)").alias("locator"), "text")
    return index.chunk_union(
        rc.line_records(lines, "grid"), rc.station_records(stations, t.grid_cut, "grid"), network, rc.tariff_record(t.spark),
        ck.document_chunks(t.md_docs, "lang", "PROJECT DOCUMENTATION").drop("metadata")).select(
        F.lit("index").alias("corpus_id"), *_SAME[1:])


def labelled(t):
    none = F.expr("CAST(array() AS array<string>)")
    ends = F.lower("a"), F.lower("b")
    return t.grid_cut.select(
        F.concat(F.lit("line:"), "a", F.lit("-"), "b").alias("qid"),
        F.concat(F.lit("What is the energy loss between "), "a", F.lit(" and "), "b", F.lit("?")).alias("question"),
        F.array(F.concat(F.lit("(dataset record): "), ends[0], F.lit(" -> "), ends[1]),
                F.concat(F.lit("destination station: "), ends[1])).alias("expected")).union(
        t.region.select(F.concat(F.lit("off:"), "r_regionkey"), F.concat(
            F.lit("pasta sauce recipes as "), F.reverse("r_name"), F.lit(" grandmothers cooked")), none))


def built(t):
    """The index of all families as stored; returns its path."""
    path = scratch_path(t.spark, "own-index")
    absent = t.md_docs.where("trim(text) = ''").select("file")
    index.refresh_index(own_chunks(t), path, missing=absent)
    return path


def renewed(t):
    """An earlier state of the index, then the present one built upon it; returns its path and the status of every chunk.

    The earlier state had no German documents, another wording for absent values, and web pages that are gone now.
    """
    before, now = scratch_path(t.spark, "own-index"), scratch_path(t.spark, "own-index")
    chunks = own_chunks(t)
    gone = t.pages.select(
        F.lit("index").alias("corpus_id"), F.concat(F.lit("page:"), "page_id").alias("id"), F.lit("doc").alias("kind"),
        F.lit("web page").alias("title"), F.col("url").alias("locator"), F.col("html").alias("text"))
    earlier = chunks.where("NOT (kind = 'doc' AND title LIKE 'de%')").withColumn("text", F.replace("text", F.lit(_NONE), F.lit("unknown")))
    index.refresh_index(earlier.unionByName(gone), before)
    return now, index.refresh_index(chunks, now, before)


@query("own_index", f"WITH {OWN} SELECT id, kind, title, locator, md5(text) AS digest FROM own")
def own_index(t):
    """Line, station, network, tariff and document chunks, stored as one index and read back."""
    return index.load_index(t.spark, built(t)).select("id", "kind", "title", "locator", F.md5("text").alias("digest"))


@query("index_manifest", f"""WITH {OWN}
SELECT kind, count(*) AS chunks, (SELECT count(*) FROM own) AS all_chunks, (SELECT count(*) FROM own) AS posted,
       (SELECT count(*) FROM md_docs WHERE trim(text) = '') AS missing FROM own GROUP BY 1""")
def index_manifest(t):
    """What the manifest of that index says: chunks per kind and in all, chunks posted, files missing."""
    return index.load_manifest(t.spark, built(t)).select(
        F.inline("kinds"), F.col("chunks").alias("all_chunks"), "posted", "missing")


@query("index_refresh", f"""WITH {OWN}
SELECT id, CASE WHEN kind = 'doc' AND title LIKE 'de%' THEN 'added' WHEN contains(text, '{_NONE}') THEN 'changed' ELSE 'unchanged' END AS status
FROM own UNION ALL SELECT 'page:' || page_id, 'removed' FROM pages""")
def index_refresh(t):
    """Every chunk of the earlier and the present index, and what became of it."""
    return renewed(t)[1].select("id", "status")


@query("index_refresh_postings", f"WITH {OWN}, {asked_sql.CHUNKS.replace(_CORPUS, 'SELECT * FROM own')} SELECT term, id, doc_len, tf FROM postings")
def index_refresh_postings(t):
    """Postings of the renewed index, most of them taken over: they equal those of a build from nothing."""
    return index.load_postings(t.spark, renewed(t)[0]).select("term", "id", "doc_len", "tf")


@query("own_retrieval_eval", f"""WITH {OWN}, {LABELLED},
{searched("SELECT * FROM own", "SELECT qid, 'index' AS corpus_id, question FROM labelled")},
contexts AS (SELECT qid, lower(string_agg(piece, chr(10) ORDER BY position)) AS context FROM pieces GROUP BY 1)
SELECT l.qid, c.context IS NOT NULL AS answered,
       CASE WHEN len(expected) = 0 THEN c.context IS NULL
            ELSE len(list_filter(expected, lambda w: NOT contains(coalesce(c.context, ''), w))) = 0 END AS passed
FROM labelled l LEFT JOIN contexts c ON c.qid = l.qid""")
def own_retrieval_eval(t):
    """Questions on every line against the project's own index: is the right record in the context; off the topic, is there none."""
    path = built(t)
    stored, posted = index.load_index(t.spark, path).select(*_SAME), index.load_postings(t.spark, path)
    questions = labelled(t)
    hits = rt.composite_search(questions.withColumn("corpus_id", F.lit("index")), stored, posted=posted)
    return rt.retrieval_eval(questions, rt.context_block(rt.budget_cut(hits, stored)))


@query("own_run_search")
def own_run_search(t):
    """Each run's owner asks about it: the stored index and the run's own chunks, merged with reserved places. No SQL, as for `run_chunks`."""
    path = built(t)
    runs = payloads.run_chunks(t).select(F.concat(F.lit("run:"), "start").alias("corpus_id"), "start", *_SAME[1:])
    question = F.concat(F.lit("How much energy loss has the hybrid route of this run from "), "start", F.lit("?"))
    owners = runs.select("corpus_id", F.col("start").alias("qid"), question.alias("question")).distinct()
    asked = owners.unionByName(owners.withColumn("corpus_id", F.lit("index")))
    return rt.search_index(asked, index.load_index(t.spark, path), index.load_postings(t.spark, path), runs.drop("start"))
