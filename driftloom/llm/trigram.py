"""Boolean trigram queries of regular expressions.

A text that matches a regex must hold certain trigrams; ``query(pattern)``
derives that condition from the parsed regex.  Trigrams are in lower case, to be
looked up in lower-cased texts, so they hold for either case.

A query is ``True`` (nothing is mandatory), a trigram, or ``("and" | "or",
frozenset of queries)``.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass
from itertools import product

#: Literal sets above this size, and classes above the second, count as "anything".
MOST_STRINGS, MOST_CLASS = 64, 4


def both(*qs):
    return _flat("and", qs)


def either(*qs):
    return True if any(q is True for q in qs) else _flat("or", qs)


def _flat(op, qs):
    out = set()
    for q in qs:
        if isinstance(q, tuple) and q[0] == op:
            out |= q[1]
        elif q is not True:
            out.add(q)
    if not out:
        return True
    return next(iter(out)) if len(out) == 1 else (op, frozenset(out))


def of_string(s: str):
    """All trigrams of one literal; True below three characters."""
    return both(*(s[i : i + 3] for i in range(len(s) - 2)))


def of_strings(strings):
    return either(*(of_string(s) for s in strings)) if strings else True


@dataclass
class Info:
    """What one regex node matches: all its strings, or their ends and a query."""

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    need: object = True

    def open(self) -> Info:
        if self.exact is None:
            return self
        return Info(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), both(self.need, of_strings(self.exact)))


_ANY = Info(None, frozenset([""]), frozenset([""]))


def _exactly(strings) -> Info:
    s = frozenset(strings)
    return Info(s, s, s)


def _concat(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return _exactly(a + b for a, b in product(x.exact, y.exact))
    left, right = x.exact if x.exact is not None else x.suffix, y.exact if y.exact is not None else y.prefix
    need = both(x.open().need, y.open().need, of_strings([a + b for a, b in product(left, right)]) if len(left) * len(right) <= MOST_STRINGS else True)
    prefix = frozenset((a + b)[:2] for a, b in product(x.exact, y.open().prefix)) if x.exact is not None else x.prefix
    suffix = frozenset((a + b)[-2:] for a, b in product(x.open().suffix, y.exact)) if y.exact is not None else y.suffix
    return Info(None, prefix, suffix, need)


def _union(x: Info, y: Info) -> Info:
    if x.exact is not None and y.exact is not None and len(x.exact | y.exact) <= MOST_STRINGS:
        return _exactly(x.exact | y.exact)
    x, y = x.open(), y.open()
    return Info(None, x.prefix | y.prefix, x.suffix | y.suffix, either(x.need, y.need))


def _class(items) -> Info:
    chars = set()
    for op, arg in items:
        if op is K.LITERAL:
            chars.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < MOST_CLASS:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return _ANY
    return _exactly(chars) if len(chars) <= MOST_CLASS else _ANY


def _walk(nodes) -> Info:
    out = _exactly([""])
    for op, arg in nodes:
        if op is K.LITERAL:
            x = _exactly([chr(arg).lower()])
        elif op is K.IN:
            x = _class(arg)
        elif op is K.SUBPATTERN:
            x = _walk(arg[3])
        elif op is K.BRANCH:
            x = None
            for way in arg[1]:
                x = _walk(way) if x is None else _union(x, _walk(way))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, body = arg
            one = _walk(body)
            if least == 0:
                x = _union(_exactly([""]), one) if most == 1 and one.exact is not None else _ANY
            elif least == most == 1:
                x = one
            else:
                x = one.open()
        elif op is K.AT:
            x = _exactly([""])
        else:
            x = _ANY
        out = _concat(out, x)
    return out


def query(pattern: str):
    """The trigram condition of a regex; True where none is mandatory."""
    return _walk(parser.parse(pattern)).open().need


def trigrams(q) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))
