"""Boolean trigram queries that every match of a regular expression implies.

A pattern is walked with the standard library's parser.  Runs whose strings are
finitely many (literals, small classes, options, alternatives) are kept exactly;
where a run ends, all its strings' trigrams become a condition: one of the strings,
hence all trigrams of one of them, must occur.  The query is a disjunction of
trigram sets; ``None`` means that no trigram is mandatory and a rule must scan.
"""

from __future__ import annotations

import re._parser as parser
from itertools import product


#: More strings, or more alternatives, than these and a part counts as unknown.
STRINGS, ALTERNATIVES = 64, 256


def _exact(op: object, arg: object) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                found.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < STRINGS:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _exact_all(arg[3])
    if name == "BRANCH":
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1 and arg[0] in (0, 1):
        inner = _exact_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return {""} if name == "AT" else None


def _exact_all(nodes: object) -> set[str] | None:
    strings = {""}
    for op, arg in nodes:
        more = _exact(op, arg)
        if more is None or len(strings) * len(more) > STRINGS:
            return None
        strings = {a + b for a, b in product(strings, more)}
    return strings


Query = frozenset[frozenset[str]]


def _of_run(strings: set[str]) -> Query | None:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets else _least(sets)


def _least(sets: set[frozenset[str]]) -> Query:
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    return a if len(a) * len(b) > ALTERNATIVES else _least({x | y for x, y in product(a, b)})


def _walk(nodes: object) -> Query | None:
    query, run = None, {""}
    for op, arg in nodes:
        name, exact = str(op), _exact(op, arg)
        if exact is not None and len(run) * len(exact) <= STRINGS:
            run = {a + b for a, b in product(run, exact)}
            continue
        query, run = _both(query, _of_run(run)), {""}
        if exact is not None:
            run = exact
        elif name == "SUBPATTERN":
            query = _both(query, _walk(arg[3]))
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(p is not None for p in parts):
                query = _both(query, _least(set().union(*parts)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            query = _both(query, _walk(arg[2]))
    return _both(query, _of_run(run))


def trigram_query(pattern: str) -> Query | None:
    """The alternatives, each a set of lower-case trigrams, of which one must be wholly in any text that matches.

    >>> sorted(map(sorted, trigram_query("ab[cd]e+")))
    [['abc'], ['abd']]
    >>> trigram_query("[0-9a-f]{24,}") is None
    True
    """
    return _walk(parser.parse(pattern))
