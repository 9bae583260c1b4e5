"""Sums of parts of scores within a shard of chunks: the numeric step of `retrieval.bm25` and `retrieval.best_chunks`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What a row of a shard is; rows come in this order. Their key is shard * KINDS + kind.
NAME, PART, QUESTION = 0, 1, 2
KINDS = 4

#: Scores this close may be equal once they are rounded to nine places.
CLOSE = 2e-9
#: Rows handed on at a time.
ROWS = 50_000
#: A search for the best begins with at most so many parts, where its question has at least `FEW` times as many.
BEGIN = 500
FEW = 16
#: Sets of long lists and their best that a shard remembers.
ASKED = 2_000


class Shard:
    """The parts of some chunks by list, and, where results carry names, the ids of the chunks."""

    def __init__(self, number: int):
        self.number = number
        self._rows: dict[int, list[pa.RecordBatch]] = {NAME: [], PART: []}
        self.lists: np.ndarray | None = None
        self.asked: dict[bytes | tuple, tuple[np.ndarray, np.ndarray] | None] = {}

    def take(self, kind: int, rows: pa.RecordBatch) -> None:
        self._rows[kind].append(rows)

    def _column(self, kind: int, name: str, dtype: str) -> np.ndarray:
        parts = [rows.column(name).to_numpy(zero_copy_only=False) for rows in self._rows[kind]]
        return np.concatenate(parts) if parts else np.empty(0, dtype)

    def ready(self) -> None:
        """Parts ordered by list, each chunk a place from 0 on; places go by the number of the chunk."""
        if self.lists is not None:
            return
        owner, at = self._column(PART, "a", "int64"), self._column(PART, "b", "int64")
        self.chunks, place = np.unique(owner, return_inverse=True)
        order = np.lexsort((place, at))
        self.lists, first = np.unique(at[order], return_index=True)
        self.bounds = np.append(first, len(at))
        self.place, self.part = place[order], self._column(PART, "x", "float64")[order]
        self.most = np.maximum.reduceat(self.part, first) if len(first) else self.part
        if self._rows[NAME]:
            numbers = self._column(NAME, "a", "int64")
            ids = pa.chunked_array([rows.column("s") for rows in self._rows[NAME]])
            self.ids = ids.take(pa.array(np.argsort(numbers)[np.searchsorted(np.sort(numbers), self.chunks)])).combine_chunks()
        self._rows = {NAME: [], PART: []}

    def scores(self, lists: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores, matched) of the chunks on at least `needed` of the lists at these positions."""
        spans = [slice(self.bounds[p], self.bounds[p + 1]) for p in lists]
        place = np.concatenate([self.place[s] for s in spans])
        matched = np.bincount(place, minlength=len(self.chunks))
        passed = np.flatnonzero(matched >= needed)
        score = np.bincount(place, np.concatenate([self.part[s] for s in spans]), len(self.chunks))[passed]
        some = score > 0
        return passed[some], score[some], matched[passed[some]]

    def _reached(self, lists: np.ndarray, others: np.ndarray, needed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, scores) of the chunks on any of `lists` that are on at least `needed` of these and `others`, which are searched
        for them, and the places of all chunks on any of `lists`."""
        spans = [slice(self.bounds[p], self.bounds[p + 1]) for p in lists]
        place, at = np.unique(np.concatenate([self.place[s] for s in spans]), return_inverse=True)
        matched = np.bincount(at, minlength=len(place))
        score = np.bincount(at, np.concatenate([self.part[s] for s in spans]), len(place))
        for low, high in zip(self.bounds[others], self.bounds[others + 1], strict=True):
            found = low + np.minimum(np.searchsorted(self.place[low:high], place), high - low - 1)
            here = self.place[found] == place
            matched += here
            score[here] += self.part[found[here]]
        passed = (matched >= needed) & (score > 0)
        return place[passed], score[passed], place

    def _common(self, lists: np.ndarray, needed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all that may be among the `k` best of `lists` alone, remembered."""
        key = (needed, k, *lists.tolist())
        if key not in self.asked:
            place, score, _ = self.scores(lists, needed)
            best = np.sort(_best(score, k))
            self.asked[key] = place[best], score[best]
        return self.asked[key]

    def best(self, lists: np.ndarray, needed: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of chunks, all that may be among the `k` best with them.

        Where long lists make up nearly all parts and were asked for before, chunks on
        the short ones are scored first. Any other chunk scores what the long lists give
        to it, so none is looked for if that is too little for all, and else the best of
        the long lists alone serve every question that has the same ones.
        """
        size = self.bounds[lists + 1] - self.bounds[lists]
        order = np.lexsort((lists, size))
        lists, taken = lists[order], np.cumsum(size[order])
        if taken[-1] < BEGIN * FEW:
            return self.scores(lists, needed)[:2]
        few = int(np.searchsorted(taken, BEGIN, "right"))
        key = lists[few:].tobytes()
        if key not in self.asked:
            if len(self.asked) >= ASKED:
                self.asked.clear()
            self.asked[key] = None
            return self.scores(lists, needed)[:2]
        none = np.empty(0, "int64")
        place, score, seen = self._reached(lists[:few], lists[few:], needed) if few else (none, np.empty(0), none)
        if len(lists) - few < needed or len(score) >= k and self.most[lists[few:]].sum() < np.partition(score, -k)[-k] - 2 * CLOSE:
            return place, score
        more = self._common(lists[few:], needed, k + (1 << len(seen).bit_length()) * bool(few))
        other = ~np.isin(more[0], seen, assume_unique=True)
        place, score = np.concatenate([place, more[0][other]]), np.concatenate([score, more[1][other]])
        order = np.argsort(place)
        return place[order], score[order]


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of all that may be among the `k` best once scores are rounded and ties go by place; of equal scores the first `k`."""
    if len(score) <= k:
        return np.arange(len(score))
    near = np.flatnonzero(score >= np.partition(score, -k)[-k] - CLOSE)
    order = near[np.argsort(-score[near], kind="stable")]
    _, first, group = np.unique(-score[order], return_index=True, return_inverse=True)
    return order[np.arange(len(order)) - first[group] < k]


def _pieces(rows: pa.RecordBatch, terms: int) -> Iterator[pa.RecordBatch]:
    """`rows` of questions, cut so that a piece has about `terms` terms."""
    ends = np.cumsum(rows.column("lists").value_lengths().to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // max(terms, 1))) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(ends)], strict=True):
        yield rows.slice(lo, hi - lo)


def _answers(shard: Shard, rows: pa.RecordBatch, k: int | None) -> Iterator[dict]:
    """What a shard has for each question, as columns."""
    shard.ready()
    if not len(shard.lists):
        return
    asked, needed = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    wanted = rows.column("lists")
    terms, ends = wanted.flatten().to_numpy(zero_copy_only=False), np.cumsum(wanted.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(shard.lists, terms), len(shard.lists) - 1)
    here = shard.lists[at] == terms
    for i in np.flatnonzero(np.diff(np.append(0, np.append(0, np.cumsum(here))[ends])) >= needed):
        own = slice(ends[i - 1] if i else 0, ends[i])
        if k is not None:
            place, score = shard.best(at[own][here[own]], needed[i], k)
            best = _best(score, k)
            yield {"asked": np.full(len(best), asked[i]), "chunk": shard.chunks[place[best]], "score": score[best]}
            continue
        place, score, matched = shard.scores(at[own][here[own]], needed[i])
        if len(place):
            yield {"row": np.full(len(place), i), "place": place, "score": score, "matched": matched}


def _batch(shard: Shard, rows: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
    columns = {c: pa.array(np.concatenate([f[c] for f in found])) for c in found[0]}
    if "asked" in columns:
        return pa.RecordBatch.from_pydict(columns)
    row = columns["row"]
    return pa.RecordBatch.from_pydict({
        "qid": rows.column("s").take(row), "corpus_id": rows.column("t").take(row), "id": shard.ids.take(columns["place"]),
        "needed": rows.column("b").take(row).cast("int32"), "score": columns["score"], "matched": columns["matched"]})


def summed(batches: Iterator[pa.RecordBatch], k: int | None, terms: int) -> Iterator[pa.RecordBatch]:
    """Scores of every question in every shard of a task, the `k` best of each by numbers or all by names.

    Rows come by shard and within it names, parts, questions. A shard is held, its
    questions pass by, `terms` of their terms at a time.
    """
    shard = None
    for batch in batches:
        number, kind = np.divmod(batch.column("key").to_numpy(zero_copy_only=False), KINDS)
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(number)], strict=True):
            if lo == hi:
                continue
            if shard is None or shard.number != number[lo]:
                shard = Shard(number[lo])
            rows = batch.slice(lo, hi - lo)
            if kind[lo] != QUESTION:
                shard.take(kind[lo], rows)
                continue
            for piece in _pieces(rows, terms):
                found, size = [], 0
                for answer in _answers(shard, piece, k):
                    found.append(answer)
                    size += len(answer["score"])
                    if size >= ROWS:
                        yield _batch(shard, piece, found)
                        found, size = [], 0
                if found:
                    yield _batch(shard, piece, found)
