"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines.

Vectors are scaled to length one, so that a cosine of c is a distance of
sqrt(2 - 2c). A table hashes a vector by `depth` random projections, each cut into
cells of one width; vectors of a link fall into one cell in all of them with a known
chance, and the number of tables follows from how rarely a link may be missed.

Equal vectors are one class with a number of copies. Classes of one bucket are
compared by blocks of bounded size: a bucket beyond the size of a block is dealt
into several, and each pair of blocks meets in one group. A group multiplies its
vectors as matrices and passes on a number of links per class and the links of a
spanning forest, never its pairs. A pair that meets in several tables counts in
the first of them, which both ends' hashes tell.

Defined results
    null, empty or zero vector, null or non-finite component   linked with nothing
    vectors of another length   only vectors of one length can be linked
    null vec_id                 takes part; a component's id is its smallest id that is not null
    repeated rows               each counts as a vector of its own, linked with its equals
    ties                        the smallest id is kept
    empty table                 an empty result with the same schema
    other columns               not read, so their nulls and names do not matter
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.clusters import groups
from gridloom.llm.shared import stored

#: Classes of a bucket that meet in one block.
BLOCK = 1000


@dataclass(frozen=True)
class Settings:
    """Least cosine, projections per table, cell width in distances of a link, the chance to miss a link at the threshold."""

    cosine: float = 0.9
    depth: int = 8
    cells: float = 4.0
    miss: float = 1e-4
    seed: int = 11

    @property
    def width(self) -> float:
        return self.cells * math.sqrt(2 - 2 * self.cosine)

    @property
    def tables(self) -> int:
        r = self.cells  # width over distance
        stays = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
        return math.ceil(math.log(self.miss) / math.log(1 - stays ** self.depth))


def scaled(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(usable, rows of length one in double precision) of vectors of one length."""
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # first by the largest component, so that no square overflows
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.isfinite(x).all(axis=1), x


def hashes(x: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit bucket key per row and table.

    The sums run component by component, so a row's hashes do not depend on the
    rows beside it.
    """
    rng = np.random.default_rng([settings.seed, x.shape[1]])
    lines = rng.normal(size=(x.shape[1], settings.tables * settings.depth))
    at = np.broadcast_to(rng.uniform(0, settings.width, lines.shape[1]), (len(x), lines.shape[1])).copy()
    for k in range(x.shape[1]):
        at += x[:, k:k + 1] * lines[k]
    cells = np.floor(at / settings.width).astype(np.int64).astype(np.uint64).reshape(len(x), settings.tables, settings.depth)
    key = np.broadcast_to(np.arange(settings.tables, dtype=np.uint64) + np.uint64(x.shape[1]) * np.uint64(1 << 20), cells.shape[:2]).copy()
    for k in range(settings.depth):
        key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _classed(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, class, raw): class is a digest of the vector, null where it can link with nothing."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for value in batch.column(1):
                items = value.as_py()
                row = np.array(items, dtype="<f8") if items and None not in items else np.zeros(0)
                raw.append(row.tobytes() if len(row) and scaled([row])[0][0] else None)
            names = ["vec_id", "class", "raw"]
            digests = [xxhash.xxh3_128_digest(r) if r else None for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=names)

    source = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return source.mapInArrow(classify, "vec_id long, class binary, raw binary")


def _keyed(classes: DataFrame, settings: Settings) -> DataFrame:
    """(class, copies, v, spot, keys): vectors of length one, and their bucket of every table."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [np.frombuffer(r.as_py(), "<f8") for r in part.column(2)]
                keys = [hashes(scaled([r])[1], settings)[0] for r in rows] if len({len(r) for r in rows}) > 1 else hashes(scaled(rows)[1], settings)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(keys), pa.list_(pa.int64()))], names=["class", "copies", "raw", "keys"])

    return classes.select("class", "copies", "raw").mapInArrow(key, "class binary, copies long, raw binary, keys array<long>")


def _met(blocks: DataFrame, settings: Settings) -> DataFrame:
    """(class, n, other): links counted per class, and links (class, other) of a spanning forest, from sorted groups."""
    names = ["class", "n", "other"]

    def compare(rows: list[tuple]) -> Iterator[tuple]:
        table, i, j = rows[0][1:4]
        x = scaled([np.frombuffer(r[7], "<f8") for r in rows])[1]
        side = np.array([r[4] for r in rows])
        left, right = (np.flatnonzero(side == i), np.flatnonzero(side == j))
        near = x[left] @ x[right].T >= settings.cosine
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        if not len(a):
            return
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keys = hashes(x[used], settings)
        ka, kb = at[:len(a)], at[len(a):]
        first = np.ones(len(a), dtype=bool)
        for t in range(table):
            first &= keys[ka, t] != keys[kb, t]
        a, b, ka, kb = a[first], b[first], ka[first], kb[first]
        copies = np.array([rows[u][6] for u in used])
        n = np.bincount(ka, copies[kb], len(used)) + np.bincount(kb, copies[ka], len(used))
        yield from ((rows[u][5], int(k), None) for u, k in zip(used, n) if k)
        up = np.arange(len(used))
        for p, q in zip(ka.tolist(), kb.tolist()):
            while up[p] != p:
                up[p] = p = up[up[p]]
            while up[q] != q:
                up[q] = q = up[up[q]]
            if p != q:
                up[max(p, q)] = min(p, q)
                yield rows[used[max(p, q)]][5], 0, rows[used[min(p, q)]][5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:4] != row[:4]:
                    found += compare(group)
                    group = []
                group.append(row)
            yield _as_batch(found, names)
        yield _as_batch(list(compare(group)) if group else [], names)

    return blocks.mapInArrow(run, "class binary, n long, other binary")


def _as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], names=names)


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    rows = stored(_classed(df, vec_id, vector), "vectors")
    classes = stored(rows.where("class IS NOT NULL").groupBy("class").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("raw").alias("raw")), "classes")
    keyed = stored(_keyed(classes, settings), "keyed")
    keys = keyed.select(F.posexplode("keys").alias("spot", "key"))
    sizes = keys.groupBy("key", "spot").agg(F.count("*").alias("size")).where("size > 1").select(
        "key", "spot", F.expr(f"CAST((size + {BLOCK - 1}) DIV {BLOCK} AS INT)").alias("parts"))
    # Which bucket and block a class goes to is settled on keys alone; its vector follows afterwards.
    dealt = keyed.select("class", "copies", "raw", F.posexplode("keys").alias("spot", "key")).join(sizes, ["key", "spot"])
    own = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    met = dealt.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", "spot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "class", "copies", "raw")
    blocks = met.repartition("key", "i", "j").sortWithinPartitions("key", "spot", "i", "j")
    found = stored(_met(blocks, settings), "met")
    counted = found.where("other IS NULL").groupBy("class").agg(F.sum("n").alias("n"))
    roots = groups(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    members = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select(
        "class", "copies", "least", F.coalesce("root", "class").alias("root"))
    best = members.groupBy("root").agg(F.min("least").alias("component_id"))
    about = members.join(best, "root").join(counted, "class", "left").select(
        "class", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "class").join(about, "class", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
