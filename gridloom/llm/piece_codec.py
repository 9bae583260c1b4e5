"""SentencePiece ids and texts: exact merge-type encoding by backtracking.

A piece vocabulary of the merge type encodes a text as the result of merging
neighbours in the order of the pieces' scores. Without merging the whole text,
the same ids follow from longest matches: an Aho-Corasick automaton gives the
longest piece at a place; two neighbouring pieces are compatible when merging their
joined text anew gives the two again, which the merges along their common border
decide; where they are not, the shorter piece is tried, and a bitfield holds the
places from which no continuation worked. A segmentation all of whose neighbours
are compatible is the merged one.

No piece spans the mark of a space behind another character, so words are encoded on
their own, and a task remembers the words it has met.

Defined results
    null or empty text      begin and end id, decoded as an empty text
    very long text          encoded whole, word by word
    unknown characters      their bytes, as the vocabulary says, or else its unknown piece
    runs of spaces          merged as such, with the last one as the start of its word
    repeated rows           each row gets its own result
    empty table             an empty result with the same schema
    clashing column names   input columns live in one struct beside the results
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import whole_row

SPACE = "▁"
#: Words, and neighbour checks, that a task remembers in each of two generations.
REMEMBERED = 250_000


def default_path() -> str:
    """The 32k piece vocabulary of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes with one vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(size)]
        self.ids = {self.library.id_to_piece(i): i for i in range(size) if not special[i]}
        self.score = {piece: self.library.get_score(i) for piece, i in self.ids.items()}
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece spans a space behind another character: words cannot be encoded on their own")
        self.singles = {piece for piece in self.ids if len(piece) == 1}
        breaks = "" if "\n" in self.ids else "\n"  # what is no piece ends a word
        self.word_pattern = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+|\n")
        self.words, self.older_words = {}, {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece, self.parts) == [piece]:  # a piece that merging never makes is never used
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.longest = max(map(len, self.automaton), default=1)
        #: The longest piece that begins a piece and is not all of it.
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.automaton), None) for p in self.automaton}
        #: Whether every piece is merged after its parts, as training makes them; else neighbours are merged anew in full.
        self.ordered = all(self._made(piece) > max(map(self._made, parts)) for piece, parts in self.parts.items() if piece.strip(SPACE))

    def _made(self, piece: str) -> float:
        """The moment in the order of merges at which a piece comes about."""
        return -self.score[piece] if len(piece) > 1 else -np.inf

    def _border(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """The symbols that lie at one end of a piece while it is merged: (symbol, made, gone)."""
        found, gone = [], np.inf
        while True:
            found.append((piece, self._made(piece), gone))
            if len(piece) == 1:
                return found
            gone = self._made(piece)
            piece = self.parts[piece][side]

    def merged(self, text: str, last: dict | None = None) -> list[str]:
        """The pieces of a text by merging: best score first, leftmost among equals; `last` gets the parts of a single piece."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(part) and (joined := part[left] + part[right]) in self.score:
                heapq.heappush(queue, (-self.score[joined], left, joined))

        for at in range(len(part)):
            offer(at)
        while queue:
            _, left, joined = heapq.heappop(queue)
            right = after[left]
            if not part[left] or right >= len(part) or part[left] + part[right] != joined:
                continue
            if last is not None and len(joined) == len(text):
                last[joined] = (part[left], part[right])
            part[left], part[right], after[left] = joined, "", after[right]
            if after[left] < len(part):
                before[after[left]] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in part if p]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' joined text gives the two again."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs = {}
            found = self.pairs[key] = self._stays(left, right) if self.ordered else self.merged(left + right) == [left, right]
        return found

    def _stays(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border while both sides are merged anew.

        A crossing merge happens if both its symbols lie at the border at its
        moment. Among equals the leftmost goes first: a merge within the left side
        comes before it, one within the right side after it.
        """
        if SPACE * 2 in left + right:  # runs of spaces all merge at one moment
            return self.merged(left + right) == [left, right]
        after = self._border(right, 0)
        for a, _, gone_a in self._border(left, 1):
            for b, _, gone_b in after:
                at = self.score.get(a + b)
                if at is not None and gone_a > -at and gone_b >= -at:
                    return False
        return True

    def segmented(self, text: str) -> list[str]:
        """The merged pieces of a text of known characters, by longest matches and backtracking.

        No match is longer than `longest`, so the automaton reads no further from any place, and time grows with the text.
        """
        compatible, match, most, size = self.compatible, self.automaton.iter_long, self.longest, len(text)
        path: list[str] = []
        failed, place, piece = bytearray((size >> 3) + 1), 0, next(match(text[:most]))[1]  # one bit a position
        while place < size:
            while piece and (failed[place + len(piece) >> 3] >> (place + len(piece) & 7) & 1 or path and not compatible(path[-1], piece)):
                piece = self.shorter[piece]
            if piece:
                path.append(piece)
                place += len(piece)
                piece = next(match(text[place:place + most]))[1] if place < size else None
            else:
                failed[place >> 3] |= 1 << (place & 7)
                piece = path.pop()
                place -= len(piece)
                piece = self.shorter[piece]
        return path

    def _known(self, text: str) -> list[int]:
        """Ids of a text without leading spaces beyond one; unknown characters become bytes."""
        if self.singles.issuperset(text):
            return [self.ids[p] for p in self.segmented(text)]
        ids: list[int] = []
        start = 0
        for at, char in enumerate(text):
            if char not in self.singles:
                ids += [self.ids[p] for p in self.segmented(text[start:at])] if at > start else []
                ids += [self.bytes[b] for b in char.encode()] if self.bytes else [self.library.unk_id()]
                start = at + 1
        return ids + ([self.ids[p] for p in self.segmented(text[start:])] if start < len(text) else [])

    def word(self, word: str) -> bytes:
        """Ids of one word, with the spaces before it, as little-endian unsigned 32-bit numbers.

        Pieces of several spaces merge last, so the last space goes with the word
        if the word's first piece takes it, and the spaces before it merge by themselves.
        """
        body = word.lstrip(SPACE)
        spaces = len(word) - len(body)
        ids = self._known(SPACE + body if spaces else body) if body else []
        if body and spaces and ids and ids[0] == self.ids.get(SPACE):
            ids = ids[1:]
        elif body and spaces:
            spaces -= 1
        lead = [self.ids[p] for p in self.merged(SPACE * spaces)] if spaces else []
        return struct.pack(f"<{len(lead) + len(ids)}I", *lead, *ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text, begin and end id included, as little-endian unsigned 32-bit numbers."""
        found = [np.array([self.library.bos_id()], "<u4").tobytes()]
        if text:
            known = self.words
            for word in self.word_pattern.findall(SPACE + text.replace(" ", SPACE)):
                ids = known.get(word)
                if ids is None:
                    if len(known) >= REMEMBERED:
                        self.older_words, self.words = known, {}
                        known = self.words
                    ids = known[word] = self.older_words.get(word) or self.word(word)
                found.append(ids)
        found.append(np.array([self.library.eos_id()], "<u4").tobytes())
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process, with what it remembers."""
    return Codec(path)


def coded(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = False, keep=None) -> DataFrame:
    """The rows of `df`, their columns (or those in `keep`) in the struct `row`, with n_tokens and the digests of ids and decoded text.

    `with_ids` adds the ids themselves (binary, little-endian unsigned 32-bit) and
    the decoded text.
    """
    path = path or default_path()
    source = df.select(whole_row(df, keep).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.slice(at, 500), []
                for value in part.column(1):
                    ids = used.encode(value.as_py() or "")
                    text_back = used.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text_back.encode()).hexdigest(), ids, text_back))
                n, ids_sha, text_sha, ids, texts = map(list, zip(*rows))
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary()), pa.array(texts)] * with_ids, names=names)

    kind = source.schema["row"].dataType.simpleString()
    extra = ", ids binary, decoded string" * with_ids
    return source.mapInArrow(code, f"row {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
