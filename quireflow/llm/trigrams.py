"""Boolean trigram queries that every match of a regular expression satisfies."""

from __future__ import annotations

from re import _constants as C
from re import _parser as P

#: A run of literal alternatives is followed while it has at most this many strings.
WIDEST = 64

#: A query is a list of clauses, all needed; a clause is a set of conjunctions, one needed.
Query = list[frozenset[frozenset[str]]]


def query(pattern: str) -> Query:
    """The clauses of ``pattern``, lower-cased; an empty list means that nothing is mandatory."""
    clauses: Query = []
    last = _walk(list(P.parse(pattern)), {""}, clauses)
    _close(last, clauses)
    return list(dict.fromkeys(clauses))


def grams(strings: frozenset[frozenset[str]]) -> set[str]:
    return {g for conjunction in strings for g in conjunction}


def _close(strings: set[str], clauses: Query) -> None:
    """Turns a finished run of alternatives into a clause, if each holds a trigram."""
    if min(map(len, strings), default=0) < 3:
        return
    each = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    clauses.append(frozenset(c for c in each if not any(d < c for d in each)))  # a conjunction implied by a weaker one adds nothing


def _walk(nodes: list, strings: set[str], clauses: Query) -> set[str]:
    """Extends ``strings``, the exact alternatives just before ``nodes``, closing the run where it can't go on."""
    for op, arg in nodes:
        options = _exact(op, arg)
        if options is not None and len(strings) * len(options) <= WIDEST:
            strings = {a + b for a in strings for b in options}
            continue
        _close(strings, clauses)
        strings = {""}
        if op is C.SUBPATTERN:
            inner: Query = []
            _close(_walk(list(arg[3]), {""}, inner), inner)
            clauses += inner
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = []
            _close(_walk(list(arg[2]), {""}, inner), inner)
            clauses += inner
        elif options is not None:
            strings = options
    return strings


def _exact(op, arg) -> set[str] | None:
    """Every lower-cased string the node can match, or None if there are too many to list."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.AT:
        return {""}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None
    if op is C.SUBPATTERN:
        return _all(list(arg[3]))
    if op is C.BRANCH:
        parts = [_all(list(b)) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 1:
        inner = _all(list(arg[2]))
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _all(nodes: list) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        options = _exact(op, arg)
        if options is None or len(out) * len(options) > WIDEST:
            return None
        out = {a + b for a in out for b in options}
    return out
