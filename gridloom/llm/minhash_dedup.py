"""MinHash near-duplicates: SuperMinHash signatures, bands, exact verification, union-find groups.

1. Each text becomes its set of word shingles, as 64-bit hashes. Texts with equal
   sets are one class, named by a 128-bit digest of the set, however many copies there are.
2. A SuperMinHash signature: every shingle has a pseudo-random permutation of the
   slots, spelled out step by step; step j offers rank j plus a fraction to one
   slot, and a text stops at the first step at which all its slots are filled.
3. Slots are joined to bands, as many as the threshold needs for a link at the
   threshold to be missed once in a million. Classes that share a band share a bucket.
4. In each bucket all classes are compared with the smallest one, on full sets. Classes
   linked so far form groups. What is left are the pairs of one bucket whose ends
   are in different groups; those are compared too. Pairs inside a group cannot change
   it and are never formed, so a bucket with a third of all classes costs a
   comparison per member.
5. The links' groups, by union-find rounds.

Defined results
    null, empty or blank text  no shingle, linked with nothing, its own component
    fewer words than a shingle the whole sequence is the one shingle
    repeated rows              equal rows share a component; `keep_one` leaves one of them
    null doc_id                takes part; a component's id is its smallest id that is not null
    very long text             its whole set
    ties                       the smallest id stays; of one id with several texts, the row with the smallest key
    empty table                an empty result with the same schema
    clashing column names      `keep_one` returns the input columns alone
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.clusters import groups
from gridloom.llm.shared import fresh, stored

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
REMEMBERED = 400_000
#: 64-bit words of a set's bitmap.
MARKS = 32
#: Shingles whose permutations are spelled out at a time.
CHUNK = 100_000


@dataclass(frozen=True)
class Settings:
    """Words per shingle, the least similarity in per cent, slots per band, the chance to miss a link at the threshold."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of shingles; only A to Z change their case, only the space and U+0009 to U+000D part words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    at = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    joined = np.full(len(at) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        joined = mixed(joined * _GOLDEN + at[k:len(at) - size + 1 + k])
    return np.unique(joined)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash: per set and slot the smallest rank-and-fraction any of its elements offers."""
    best = np.full(len(sets) * slots, _EMPTY, dtype=np.uint64)
    sizes = [len(s) for s in sets]
    element, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    order: np.ndarray | None = None
    for step in range(slots):
        draw = mixed(element + np.uint64((step + 1) * int(_GOLDEN) % (1 << 64)))
        to = step + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        slot = to
        if order is not None:  # the step swaps place `step` with place `to` of the element's permutation
            rows = np.arange(len(element))
            slot = order[rows, to].astype(np.int64)
            order[rows, to] = order[:, step]
        np.minimum.at(best, owner * slots + slot, np.uint64(step) << np.uint64(32) | draw >> np.uint64(32))
        open_ = (best.reshape(-1, slots) == _EMPTY).any(axis=1)[owner]
        if not open_.any():
            break
        if order is None:  # most texts are done after the first step and never need permutations
            element, owner, to = element[open_], owner[open_], to[open_]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
            order[np.arange(len(element)), to] = 0
        elif open_.mean() < 0.7:
            element, owner, order = element[open_], owner[open_], order[open_]
    return best.reshape(len(sets), slots)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    bands = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key * _GOLDEN + bands[:, :, k])
    return key.view(np.int64)


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("-")), text)


def _source(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")) \
        .select("doc_id", row_key(F.col("doc_id"), F.col("t")).alias("row_key"), "t")


def _parts(batch: pa.RecordBatch, settings: Settings, hashes: WordHashes, column: int):
    """Slices of a batch with their sets, of about CHUNK shingles each."""
    start, sets, total = 0, [], 0
    for at, value in enumerate(batch.column(column)):
        sets.append(shingles(value.as_py(), settings.words, hashes))
        total += len(sets[-1])
        if total >= CHUNK:
            yield batch.slice(start, len(sets)), sets
            start, sets, total = at + 1, [], 0
    if sets:
        yield batch.slice(start, len(sets)), sets


def described(source: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, row_key, n_shingles, class, bands) of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, sets in _parts(batch, settings, hashes, 2):
                keys = band_keys(signatures(sets, settings.bands * settings.rows), settings.rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64()))],
                    names=["doc_id", "row_key", "n_shingles", "class", "bands"])

    return source.mapInArrow(describe, "doc_id long, row_key long, n_shingles long, class binary, bands array<long>")


def marks(items: np.ndarray) -> np.ndarray:
    """A bit per residue of the items, as `MARKS` 64-bit words: two sets differ in at least as many items as their marks in bits."""
    bits = np.zeros(64 * MARKS, dtype=np.uint8)
    bits[(items >> np.uint64(7)) % np.uint64(64 * MARKS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def full_sets(texts: DataFrame, settings: Settings) -> DataFrame:
    """(class, items, marks): the set of every text."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for _, sets in _parts(batch, settings, hashes, 0):
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([marks(s) for s in sets], pa.list_(pa.int64()))], names=["class", "items", "marks"])

    return texts.mapInArrow(unfold, "class binary, items array<long>, marks array<long>")


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The distinct pairs (a, b) of classes that reach the threshold on their full sets."""
    both = (
        pairs.distinct().join(sets.select(F.col("class").alias("a"), F.col("items").alias("x")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("items").alias("y")), "b"))
    meet = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("n"), (F.size("x") + F.size("y")).cast("long").alias("m"))
    return stored(meet.where(100 * F.col("n") >= settings.percent * (F.col("m") - F.col("n"))).select("a", "b").distinct(), "links")


def _bucketed(classes: DataFrame) -> DataFrame:
    """(key, spot, class, first, n): the classes of every band key that several share, with its band, the smallest class and their number."""
    keys = classes.select(F.posexplode("bands").alias("spot", "key"), "class")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("first")).where("n > 1")
    return keys.join(shared, "key").select("key", "spot", "class", "first", "n")


def _left_over(buckets: DataFrame, roots: DataFrame, sets: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of one bucket, not with its smallest class, whose ends are in different groups so far and may still be linked.

    Every such pair has an end outside the group of the bucket's smallest class,
    so only those classes are held against the bucket. A pair's sets may differ in
    so many items at most; where sizes or marks differ in more, no row is made.
    A pair of several buckets is formed in that of the first band alone.
    """
    of = roots.select(F.col("node").alias("class"), "root")
    at_first = of.select(F.col("class").alias("first"), F.col("root").alias("first_root"))
    named = (
        buckets.where("n > 2 AND class <> first").join(of, "class", "left").join(at_first, "first", "left")
        .select("key", "spot", "class", F.coalesce("root", "class").alias("root"), F.coalesce("first_root", "first").alias("first_root")))
    torn = named.where("root <> first_root").select("key").distinct()
    about = sets.select("class", F.size("items").cast("long").alias("size"), "marks")
    others = stored(named.join(torn, "key", "left_semi").join(about, "class").join(classes.select("class", "bands"), "class"), "others")
    told = ("class", "root", "size", "marks", "bands")
    apart = others.where("root <> first_root").select("key", "spot", *[F.col(c).alias(f"{c}_a") for c in told])
    mates = others.select("key", *[F.col(c).alias(f"{c}_b") for c in told], (F.col("root") != F.col("first_root")).alias("b_apart"))
    differ = sum((F.bit_count(F.get("marks_a", F.lit(k)).bitwiseXOR(F.get("marks_b", F.lit(k)))) for k in range(1, MARKS)),
                 F.bit_count(F.get("marks_a", F.lit(0)).bitwiseXOR(F.get("marks_b", F.lit(0)))))
    may = (
        (F.col("root_a") != F.col("root_b")) & (~F.col("b_apart") | (F.col("class_a") < F.col("class_b")))
        & (100 * F.least("size_a", "size_b") >= settings.percent * F.greatest("size_a", "size_b"))
        & ((100 + settings.percent) * differ <= (100 - settings.percent) * (F.col("size_a") + F.col("size_b"))))
    for k in range(settings.bands):
        may = may & ((F.col("spot") <= k) | (F.get("bands_a", F.lit(k)) != F.get("bands_b", F.lit(k))))
    pairs = apart.join(mates.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & may)
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def resolved(df: DataFrame, doc_id: str, text: str, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as `described` without bands; classes with root, their group's smallest id and its row key."""
    source = _source(df, doc_id, text)
    rows = stored(described(source, settings), "rows")
    classes = stored(
        rows.where("class IS NOT NULL").groupBy("class").agg(
            F.count("*").alias("copies"), F.min("row_key").alias("row_key"), F.any_value("bands").alias("bands"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")), "classes")
    buckets = stored(_bucketed(classes), "buckets")
    # The sets of all classes that share a bucket, made anew from one text each: that moves less than carrying every set along.
    asked = buckets.select("class").distinct().join(classes.select("class", "row_key"), "class").select("row_key").distinct()
    texts = source.join(asked, "row_key").dropDuplicates(["row_key"]).select("t")
    sets = stored(full_sets(texts, settings).join(buckets.select("class").distinct(), "class", "left_semi"), "sets")
    links = verified(buckets.where("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b")), sets, settings)
    roots = groups(links)
    more = verified(_left_over(buckets, roots, sets, classes, settings), sets, settings)
    if not more.isEmpty():
        roots = groups(links.union(more))
    members = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "copies", "least", F.coalesce("root", "class").alias("root"))
    best = members.groupBy("root").agg(F.min("least").alias("least"))
    return rows.drop("bands"), members.drop("least").join(best, "root").select(
        "class", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("winner"), "copies", "root")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; kept marks the row whose id is the component's."""
    rows, classes = resolved(df, doc_id, text, settings)
    named = rows.join(classes.select("class", "component_id"), "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """`df` with one row of every component; rows without words all stay."""
    rows, classes = resolved(df, doc_id, text, settings)
    winners = rows.where("class IS NULL").select("row_key", F.lit(True).alias("every")).union(
        classes.select(F.col("winner").alias("row_key"), F.lit(False))).distinct()
    repeated = rows.groupBy("row_key").agg((F.count("*") > 1).alias("repeated"))
    key = fresh("row_key", df.columns)
    wanted = winners.join(repeated, "row_key").select(
        F.col("row_key").alias(key), (F.col("repeated") & ~F.col("every")).alias(f"{key}_again"))
    found = df.withColumn(key, row_key(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))).join(wanted, key)
    once = found.where(f"NOT {key}_again")
    again = found.where(f"{key}_again").dropDuplicates([key])
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in df.columns])
