"""Importance resampling towards a target distribution, on hashed runs of one to three words.

Texts of a batch are joined with a separator into one buffer of bytes. One regex
pass over the buffer finds all words, `SLICE` at a time; `searchsorted` on the
offsets of the documents tells whose each word is, and masks the runs of words that
would reach from one document into the next. Each run's bucket is the CRC of its
bytes, carried on from word to word, and `bincount` adds the buckets up. The first
pass over the corpus yields one count per bucket and task, the second each
document's sum of gains. The driver holds the `buckets` counts and nothing else.

The draw is Gumbel top-k: a document's score is its weight plus noise from a hash of
its id, so it is the same in every run. Places come from range partitions, so the
drawn share may be as large as it likes.

Defined results
    null or empty text      no words: no features, weight 0, never drawn
    ties                    the smaller id is drawn first; equal ids in any order, both drawn if there is room
    null doc_id             hashed like an empty id, drawn behind equal scores
    repeated rows           scored, counted and drawn one by one
    very long text          whole; at most `SLICE` words and two of the slice before are held at once
    empty table             an empty result; an empty target gives every bucket the gain of no sightings
    other columns           not read, so their nulls and names do not matter
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import fresh, stored

#: Words are ASCII digits and small letters and whatever is not ASCII; capitals are lowered first.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A byte that no word holds. Texts may hold it too: offsets alone tell documents apart.
SEPARATOR = b"\x00"
#: Bytes of texts that are joined into one buffer; a longer text has a buffer of its own.
BUFFER = 1 << 20
#: Words that are looked at together.
SLICE = 1 << 16


@dataclass(frozen=True)
class Settings:
    """Runs of up to three words in `buckets` buckets; `percent` of the documents with `least_words` words are drawn."""

    buckets: int = 10_000
    percent: int = 5
    least_words: int = 20
    seed: str = "42"


def buffers(texts: pa.Array) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, buffer, offsets): documents `first` to `last` joined in lower case, and where each begins."""
    first, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append((text.as_py() or b"").lower())  # of bytes, A-Z alone are lowered
        size += len(held[-1]) + 1
        if size >= BUFFER or at == len(texts) - 1:
            yield first, at + 1, SEPARATOR.join(held), np.cumsum([0, *[len(h) + 1 for h in held[:-1]]])
            first, held, size = at + 1, [], 0


def features(buffer: bytes, begins: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner of each word, owner of each run, bucket of each run), a slice of words at a time.

    `two` and `three` are the sums of the runs that end at a word, each carried on
    from the run that ends at the word before it. A run belongs to a document if its
    first and last word do.
    """
    words, before, last_one, last_two = WORD.finditer(buffer), np.array([-2, -1]), 0, 0
    while found := list(islice(words, SLICE)):
        owner = np.searchsorted(begins, np.fromiter((m.start() for m in found), np.int64, len(found)), side="right") - 1
        plain = [m.group() for m in found]
        spaced = [b" " + w for w in plain]
        one = list(map(crc32, plain))
        two = list(map(crc32, spaced, [last_one, *one]))
        three = list(map(crc32, spaced, [last_two, *two]))
        known = np.concatenate([before, owner])
        whole_two, whole_three = owner == known[1:-1], owner == known[:-2]
        bucket = np.concatenate([np.array(one), np.array(two)[whole_two], np.array(three)[whole_three]]) % buckets
        yield owner, np.concatenate([owner, owner[whole_two], owner[whole_three]]), bucket
        before, last_one, last_two = known[-2:], one[-1], two[-1]


def bucket_counts(df: DataFrame, text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """Features of all texts in each bucket; tasks add up their own first, so at most `buckets` rows leave each."""
    buckets = settings.buckets

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, buffer, begins in buffers(batch.column(0)):
                for _, _, bucket in features(buffer, begins, buckets):
                    sums += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(seen), pa.array(sums[seen])], ["bucket", "n"])

    parts = df.select(F.col(f"`{text}`").cast("string").cast("binary")).mapInArrow(counted, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight: the log-ratio of its smoothed shares, in thousandths, floored."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets) / (float(s + 1) * float(all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, buffer, begins in buffers(batch.column(1)):
                for word_owner, owner, bucket in features(buffer, begins, buckets):
                    words[first:last] += np.bincount(word_owner, minlength=last - first)
                    runs[first:last] += np.bincount(owner, minlength=last - first)
                    weight[first:last] += np.rint(np.bincount(owner, gain[bucket], minlength=last - first)).astype(np.int64)
            yield pa.record_batch(
                [batch.column(0), pa.array(words), pa.array(runs), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").cast("binary").alias("t"))
    return source.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`scores` with `rank`: places 1, 2, 3... of the drawn documents, null for all others."""
    able = F.col("n_words") >= settings.least_words
    drawn = scores.where(able).count() * settings.percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")]
    ranged = stored(scores.withColumn("able", able).repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("inside")), "ranges")
    first = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ranged.groupBy("range").agg(F.count("*").alias("n")).select(  # one row per range
        "range", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("ahead"))
    place = F.col("inside") + F.col("ahead") + 1
    return ranged.join(F.broadcast(ahead), "range").select(
        *scores.columns, F.when(F.col("able") & (place <= drawn), place).alias("rank"))


def resampled(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document of `df`, drawn towards the texts of `target`."""
    gain = gains(bucket_counts(df, text, settings), bucket_counts(target, text, settings))
    scores = weighted(df, gain, doc_id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings.seed))
    return ranked(stored(scores, "scores"), settings)


def drawn(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of `df` whose document is drawn; ids have to be unique and not null."""
    key = fresh("id", df.columns)
    ids = resampled(df, target, doc_id, text, settings).where("rank IS NOT NULL").select(F.col("doc_id").alias(key))
    return df.join(ids, F.col(f"`{doc_id}`").cast("long") == F.col(key), "left_semi")
