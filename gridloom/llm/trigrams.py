"""Boolean trigram queries derived from regular expressions.

A query is a set of alternatives; each alternative is a set of trigrams that all
occur, in lower case, in every text the expression matches. An empty alternative
means that nothing is mandatory, and the rule has to scan every text.
"""

from __future__ import annotations

import re._constants as ops
from itertools import product
from re import _parser as parser

#: Alternatives kept while strings are spelled out; beyond it a part counts as unknown.
MOST = 64

Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])


def trigram_query(pattern: str) -> Query:
    """The query of a pattern, over lower-case text."""
    return _tidy(_of_sequence(list(parser.parse(pattern))))


def mandatory(pattern: str) -> bool:
    """Whether every match of the pattern needs some trigram."""
    return frozenset() not in trigram_query(pattern)


def _of_string(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= MOST else a


def _tidy(query: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _spelled(item) -> set[str] | None:
    """All strings that one parsed item can be, if they are few."""
    op, arg = item
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is ops.LITERAL:
                found.add(chr(value).lower())
            elif kind is ops.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is ops.SUBPATTERN:
        return _spelled_sequence(arg[3])
    if op is ops.BRANCH:
        parts = [_spelled_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] <= 4 and (inner := _spelled_sequence(arg[2])) is not None:
        return {"".join(p) for n in range(arg[0], int(arg[1]) + 1) for p in product(inner, repeat=n)}
    if op is ops.AT:
        return {""}
    return None


def _spelled_sequence(items) -> set[str] | None:
    strings = {""}
    for item in items:
        if (next_ := _spelled(item)) is None or len(strings) * len(next_) > MOST:
            return None
        strings = {a + b for a, b in product(strings, next_)}
    return strings


def _of_item(item) -> Query:
    """What an item that cannot be spelled out still demands."""
    op, arg = item
    if op is ops.SUBPATTERN:
        return _of_sequence(list(arg[3]))
    if op is ops.BRANCH:
        found = frozenset().union(*(_of_sequence(list(p)) for p in arg[1]))
        return found if len(found) <= MOST else ANYTHING
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] >= 1:
        return _of_sequence(list(arg[2]))
    return ANYTHING


def _of_sequence(items) -> Query:
    query, strings = ANYTHING, {""}
    for item in items:
        spelled = _spelled(item)
        if spelled is not None and len(strings) * len(spelled) <= MOST:
            strings = {a + b for a, b in product(strings, spelled)}
            continue
        query, strings = _both(query, frozenset(map(_of_string, strings))), {""}
        query = _both(query, frozenset(map(_of_string, spelled)) if spelled else _of_item(item))
    return _both(query, frozenset(map(_of_string, strings)))
