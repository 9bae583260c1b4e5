"""Ranked lexical search with exact integer scores, by sequential reads of impact-sorted postings (NRA).

A first pass reads every text once and keeps, for each document, how often it has
each term that some item asks for. Corpus counts follow from that table. A second
pass takes its documents in shards. Within a shard each term has a list of
(impact, document), highest first. For an item, the lists of its terms are read
from the top in blocks that double. What has been read of a document is the lower
bound of its score; the upper bound adds, for every list it was not seen in, the
impact that list was last read at. Reading ends when every document whose upper
bound reaches the k-th best lower bound is read out, so membership, ties and
scores are final. The k-th best score of earlier shards of a task is the bound to
start from. A task gives up at most k rows an item, which are merged in two steps.

Items are taken in blocks of about `BLOCK_TERMS` terms, one pass each: what is sent
to the tasks (terms and weights of one block) does not grow with the items or the corpus.

Defined results
    null or empty text      a document without terms is never found; an item without terms finds nothing
    ties                    equal scores by ascending id, a null id last
    null ids                documents and items without an id take part like any other
    repeated rows           each row of either table is ranked on its own
    very long text          counted whole, `WINDOW` bytes at a time
    empty table             an empty result with the same schema
    other columns           of documents not read; of items they stay in `row`
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stored, whole_row

#: A term is a longest run of ASCII digits and letters and of whatever is not ASCII; capitals are lowered first.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of one text that are cut into terms at once.
WINDOW = 1 << 20
#: Documents whose lists are held together in a task.
SHARD = 16_384
#: Postings that a list is read by at first; every further read is twice as long.
FIRST_READ = 64
#: Terms of all items of a block.
BLOCK_TERMS = 200_000
#: Parts that an item's candidates are merged in before they meet.
PARTS = 64

POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = "q long, doc_id long, score long"


def windows(text: bytes) -> Iterator[bytes]:
    """`text` in lower case, cut outside its terms."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + WINDOW) if len(text) - at > WINDOW else None
        upto = end.start() if end else len(text)
        yield text[at:upto].lower()
        at = upto


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, as an array."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))


def postings(df: DataFrame, known: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts): all terms of a document counted, those in `known` listed by number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for whole in batch.column(1):
                found: Counter = Counter()
                for part in windows(whole.as_py() or b""):
                    found.update(map(known.get, TERM.findall(part)))
                sizes.append(found.total())
                found.pop(None, None)
                terms.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
                     for values, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return source.mapInArrow(counted, POSTINGS)


class Lists:
    """Impact-sorted lists of one shard: `of(term)` is (documents, impacts), highest impact first."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, documents: int, words: int):
        self.size = len(n)
        m = 100 - 50 + (50 * n * documents) // max(words, 1)
        impact = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m[owner]))
        order = np.lexsort((-impact, terms))
        self.owner, self.impact = owner[order], impact[order]
        self.ends = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[term], self.ends[term + 1])
        return self.owner[at], self.impact[at]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, bound: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all of `size` documents that score at least the k-th best, and at least `bound`.

    More than k come back where scores tie. `bound` is a score below which nothing is wanted.
    """
    lists = [x for x in lists if len(x[0])]
    lower, last = np.zeros(size, np.int64), np.zeros(len(lists), np.int64)
    seen_owner, seen_list, done, depth = [], [], 0, FIRST_READ
    while True:
        for at, (owner, impact) in enumerate(lists):
            if done < len(owner):
                read = owner[done:depth]  # a document is once in a list
                lower[read] += impact[done:depth]
                last[at] = impact[min(depth, len(owner)) - 1] if depth < len(owner) else 0
                seen_owner.append(read)
                seen_list.append(np.full(len(read), at, np.int16 if len(lists) < 1 << 15 else np.int64))
        best = np.partition(lower, size - k)[size - k] if size >= k else 0
        least = max(int(best), bound)
        open_ = int(last.sum())
        if not open_:
            break
        read_out = np.bincount(np.concatenate(seen_owner), last[np.concatenate(seen_list)], minlength=size)
        upper = lower + open_ - np.rint(read_out).astype(np.int64)
        if not ((upper >= least) & (upper > lower)).any():
            break
        done, depth = depth, depth * 2
    found = np.flatnonzero(lower >= least)
    return found, lower[found]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of up to `SHARD` rows as (ids, n, owner of each posting, term, count)."""
    held, rows = [], 0

    def made():
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "counts")]
        lengths = np.diff(columns[2].offsets.to_numpy())
        return (columns[0].to_pylist(), columns[1].to_numpy(), np.repeat(np.arange(len(lengths)), lengths),
                columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy())

    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            part = batch.slice(at, SHARD)
            if rows + part.num_rows > SHARD:
                yield made()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield made()


def _order(hit: tuple[int, int | None]) -> tuple:
    score, key = hit
    return -score, key is None, key or 0


def best_of_tasks(index: DataFrame, asked: list[tuple[int, list[int]]], weights: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """(q, doc_id, score): the `k` best documents of each task for every item."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, list[tuple[int, int | None]]] = {q: [] for q, _ in asked}
        for ids, n, owner, terms, counts in _shards(batches):
            lists = Lists(n, owner, terms, counts, weights, documents, words)
            for q, wanted in asked:
                bound = top[q][-1][0] if len(top[q]) == k else 1
                found, scores = nra([lists.of(t) for t in wanted], lists.size, k, bound)
                if len(found):
                    top[q] = sorted(top[q] + [(s, ids[d]) for d, s in zip(found.tolist(), scores.tolist())], key=_order)[:k]
        rows = [(q, key, score) for q, hits in top.items() for score, key in hits]
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["q", "doc_id", "score"])

    return index.mapInArrow(searched, FOUND)


def _block(docs: DataFrame, items: list, k: int, doc_id: str, text: str) -> DataFrame:
    """(q, doc_id, score) candidates for the items of one block."""
    known = {t: at for at, t in enumerate(sorted({t for r in items for t in r["terms"]}))}
    index = stored(postings(docs, {t.encode(): at for t, at in known.items()}, doc_id, text), "postings")
    total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
    held = np.zeros(len(known), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # at most the block's terms
        held[r["t"]] = r["n"]
    documents = total["documents"]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in held], np.int64)
    asked = [(r["q"], [known[t] for t in r["terms"]]) for r in items]
    return best_of_tasks(index.where("n > 0"), asked, weights, documents, total["words"] or 0, k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """(row, rank, doc_id, score): the `k` best documents with a score above 0 for every row of `items`."""
    asked = stored(items.select(
        F.monotonically_increasing_id().alias("q"), whole_row(items).alias("row"), terms_of(F.col(f"`{item_text}`")).alias("terms")), "items")
    asked_for = asked.where(F.size("terms") > 0)
    size = asked_for.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_TERMS))
    hits = None
    for at in range(blocks):
        mine = asked_for.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == at).select("q", "terms").collect()  # about BLOCK_TERMS terms
        found = _block(docs, mine, k, doc_id, text)
        hits = found if hits is None else hits.unionByName(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS))
    fewer = hits.withColumn("part", part).withColumn("at", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).where(F.col("at") <= k)
    best = fewer.drop("at").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("q", "row"), "q").select("row", "rank", "doc_id", "score")
