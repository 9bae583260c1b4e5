"""Best-fit packing by minimum bin slack.

Encoded documents become pieces of at most `capacity` ids. All that packing needs
is how many pieces there are of each length, at most `capacity` numbers. On those
the driver fills bin after bin: the longest piece left opens a bin, a subset-sum
table over the lengths left, kept as one bitset per length, finds the fullest
completion, and the combination is taken out as often as its lengths last. The
result is a short table of runs: the pieces of one length, counted through,
from which place on belong to which sequences. Spark numbers the pieces of each
length and every piece looks its run up, so no piece passes the driver.

Defined results
    null or empty text      one piece that holds only the closing id
    text over the capacity  cut into pieces of `capacity`; the first is the shorter one
    repeated rows           packed once each
    null doc_id             packed like any other, with a null doc_id in the result
    empty table             an empty result with the same schema
    other columns           not read, so their nulls and names do not matter
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import stored
from gridloom.llm.tokens import default_path, library_encoder, ids_of

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces of one length that are counted through together; longer lists are split by hash.
SLICE = 500
#: Slack that a bin may keep for the sake of longer pieces: none, then these parts of the capacity.
SLACKS = (0, 128, 64, 32, 16, 8, 4, 2, 1)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_into_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document, its closing id included."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for key, whole in zip(batch.column(0), batch.column(1)):
                ids = np.append(ids_of(encode, whole.as_py()), np.array([CLOSING_ID], "<u4"))
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(key.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            columns = list(zip(*rows)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return source.mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], space: int, most: int, slack: int = 0) -> dict[int, int]:
    """The combination of lengths of at most `most` with the largest sum within `space`; few long pieces first.

    The longest lengths are tried alone as long as they leave more than `slack` of the space.
    """
    lengths = [n for n in sorted(counts, reverse=True) if n <= min(space, most) and counts[n]]
    mask, reach, steps, enough = (1 << (space + 1)) - 1, 1, [], max(space - slack, 1)
    for n in lengths:
        steps.append(reach)
        left, chunk = min(counts[n], space // n), 1
        while left:  # binary splitting: 1, 2, 4, ... copies
            use = min(chunk, left)
            reach |= (reach << (n * use)) & mask
            left, chunk = left - use, chunk * 2
        if reach >> enough:
            break
    target, taken = reach.bit_length() - 1, {}
    for n, before in zip(reversed(lengths[:len(steps)]), reversed(steps)):
        while not before >> target & 1:
            target, taken[n] = target - n, taken.get(n, 0) + 1
    return taken


def _filled(counts: dict[int, int], capacity: int, slack: int) -> dict[int, int]:
    """One bin: the longest piece, then the fullest combinations of what is left, until no piece fits."""
    longest = max(counts)
    bin_, left, space = {longest: 1}, counts | {longest: counts[longest] - 1}, capacity - longest
    while more := fullest(left, space, longest, slack):
        for n, k in more.items():
            bin_[n], left[n], space = bin_.get(n, 0) + k, left[n] - k, space - n * k
    return bin_


def _plan(counts: dict[int, int], capacity: int, slack: int) -> tuple[int, list[tuple[int, int, int, int, int, int]]]:
    counts = {n: c for n, c in counts.items() if c}
    used, runs, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        bin_ = _filled(counts, capacity, slack)
        times, offset = min(counts[n] // k for n, k in bin_.items()), 0
        for n, k in sorted(bin_.items(), reverse=True):
            runs.append((n, used[n], used[n] + times * k, sequence, k, offset))
            used[n], offset = used[n] + times * k, offset + n * k
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        sequence += times
    return sequence, runs


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer: by the total, and by pieces of which no two share a sequence with what must go beside them."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for small in {n for n in lengths if 2 * n <= capacity} | {1}:
        alone = sum(counts[n] for n in lengths if n > capacity - small)
        halves = [(n, counts[n]) for n in lengths if capacity - small >= n and 2 * n > capacity]
        rest = sum(n * counts[n] for n in lengths if small <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in halves)
        best = max(best, alone + sum(c for _, c in halves) + max(0, -(-(rest - room) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, last, sequence, per_bin, offset) that place every counted piece.

    Pieces `first` to `last` of a length go `per_bin` to a sequence, one behind
    the other from `offset` on. At most as many combinations are formed as there are
    ways for a length to run out, so the plan does not grow with the corpus.

    The fullest bin at every step can use up the short pieces and leave long ones
    that pair badly. So unless it reaches the bound below which no packing gets, bins
    are also filled with some slack allowed while long pieces alone come that
    close, for a few shares of the capacity, and the plan with the fewest sequences stays.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    bound, best = least_sequences(counts, capacity), None
    for share in SLACKS:
        found = _plan(counts, capacity, capacity // share if share else 0)
        best = found if best is None or found[0] < best[0] else best
        if best[0] == bound:
            break
    return best[1]


def numbered(pieces: DataFrame, hist: DataFrame) -> DataFrame:
    """`pieces` with `place`, their number among the pieces of their length, from 0."""
    cells = hist.select("length", F.expr(f"(n + {SLICE - 1}) DIV {SLICE}").alias("cells"))
    dealt = pieces.join(F.broadcast(cells), "length").withColumn(  # at most `capacity` rows
        "cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("cells"))).drop("cells")
    per_cell = dealt.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    skips = per_cell.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32", "start")
    return (
        dealt.withColumn("at", F.row_number().over(inside) - 1).join(skips, ["length", "cell"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("skip")).alias("place")))


def placed(pieces: DataFrame, runs: list[tuple]) -> DataFrame:
    """Every numbered piece with its sequence and offset, looked up in the table of runs."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, place = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = table[np.searchsorted(order, length << 44 | place, side="right") - 1]
            since, per_bin = place - run[:, 1], np.maximum(run[:, 4], 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(run[:, 3] + since // per_bin), pa.array(run[:, 5] + since % per_bin * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(look_up, PLACED)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there, gapless from 0."""
    pieces = stored(cut_into_pieces(df, doc_id, text, path, capacity), "pieces")
    hist = pieces.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in hist.collect()}  # at most `capacity` rows
    return placed(numbered(pieces, hist), plan(counts, capacity))
