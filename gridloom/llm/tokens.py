"""Byte-level BPE ids inside tasks, from a vocabulary file that is a parameter."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: How byte-level BPE cuts a text before merging (a fixed value of the public vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space of that pattern, which is not quite Python's.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut out before encoding: the engine behind the pattern gives up within one of a million.
LONG_RUN = 500_000
_RUNS = re.compile(f"[{SPACE}]+")


def default_path() -> str:
    """The 50k byte-level vocabulary of the public tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character; this is the way back."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


@lru_cache(maxsize=2)
def encoder(path: str):
    """``encode(text) -> numpy ids`` for a byte-level vocabulary of the `tokenizers` library.

    Where ids are in the order of the merges, which is checked here, ids double as
    merge ranks and the faster rank-based encoder gives the same ids. Otherwise
    the `tokenizers` library itself encodes. Strings of special tokens in a text
    are ordinary text; `library_encoder` gives them their ids.
    """
    encode = _rank_encoder(_spec(path))
    if encode is not None:
        return encode
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def library_encoder(path: str):
    """``encode(text) -> ids`` exactly as the `tokenizers` library encodes by default, without ids of its own around the text.

    The library cuts a text at the added tokens of the file, the leftmost and
    longest first, and encodes what lies between on its own. Added tokens that also
    take in white space, ask for whole words or are looked up in two passes are
    left to the library.
    """
    spec = _spec(path)
    encode, added = _rank_encoder(spec), spec.get("added_tokens", [])
    simple = not any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") or not t["content"] for t in added)
    if encode is None or not simple or len({t.get("normalized") for t in added}) > 1:
        import tokenizers

        library = tokenizers.Tokenizer.from_file(path)
        return lambda text: library.encode(text, add_special_tokens=False).ids
    if not added:
        return encode
    ids = {t["content"]: t["id"] for t in added}
    cuts = re.compile("(" + "|".join(re.escape(c) for c in sorted(ids, key=len, reverse=True)) + ")")

    def whole(text: str) -> list[int]:
        parts = cuts.split(text)
        if len(parts) == 1:
            return encode(text)
        out: list[int] = []
        for at, part in enumerate(parts):
            if at % 2:
                out.append(ids[part])
            elif part:
                out.extend(encode(part))
        return out

    return whole


def _rank_encoder(spec: dict):
    """The rank-based encoder of a vocabulary whose ids are in merge order, or None; it knows no added tokens."""
    back, model = _byte_of(), spec["model"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in piece): at for piece, at in model["vocab"].items() if piece not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    plain = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" \
        and not spec["pre_tokenizer"].get("add_prefix_space")
    if not plain or made != sorted(set(made)) or len(ranks) != 256 + len(made):
        return None
    import tiktoken

    encode = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    merge = tiktoken.Encoding("one-piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _with_long_runs(encode, merge)


def _with_long_runs(encode, merge):
    """`encode` for texts with white space of any length; `merge` encodes one piece that the pattern would not cut.

    The pattern takes a run of white space whole at the end of a text, and else
    without its last character, which belongs to what follows.
    """

    def whole(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return encode(text)
        out, done = [], 0
        for run in _RUNS.finditer(text):
            first, last = run.span()
            if last - first >= LONG_RUN:
                last -= last < len(text)
                out += encode(text[done:first])
                out += merge(text[first:last])
                done = last
        out += encode(text[done:])
        return out

    return whole


def ids_of(encode, text: str | None) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit numbers; a null text has none."""
    return np.array(encode(text) if text else [], dtype="<u4")
