"""Literals that every match of a pattern must hold.

`required_literals` reads a pattern's syntax tree and gives a small set of
lower-case printable ASCII strings: a match holds one of them, case aside.  It
gives None rather than a wrong set: for constructs that another dialect reads
otherwise, for alternatives without a literal, for literals under three
characters.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as K
from re import _parser

LEAST, LONGEST, MOST = 3, 32, 16  # characters of a literal; literals of a pattern
_RARE_FIRST = "zqxjkvbpgywmfculdrhsnioate"


def _same_everywhere(pattern: str) -> bool:
    """No construct whose extent differs between Java, JavaScript and Python:
    numbered escapes, quoted runs, classes that hold '[' or begin with ']'."""
    if re.search(r"\\[0-9QEpPkxNgGhHRX]|\(\?[A-Za-z-]*x|&&|\[\^?\]", pattern):
        return False
    inside, i = False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            if inside:
                return False
            inside = True
        elif c == "]":
            inside = False
        i += 1
    return True


def _best(options: list[frozenset[str]]) -> frozenset[str] | None:
    good = [o for o in options if len(o) <= MOST and min(map(len, o)) >= LEAST]
    return max(good, key=lambda o: (min(min(map(len, o)), 8), -len(o), min(map(len, o)), sorted(o)), default=None)


def _options(nodes) -> list[frozenset[str]]:
    """Sets of which every match of the sequence holds a member."""
    out, run = [], ""

    def flush() -> None:
        nonlocal run
        if run:
            out.append(frozenset([run]))
        run = ""

    for op, arg in nodes:
        if op is K.LITERAL and 0x20 <= arg < 0x7F:
            run += chr(arg).lower()
            continue
        if op is K.AT:  # takes no characters
            continue
        flush()
        if op is K.SUBPATTERN:
            out += _options(arg[-1])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _options(arg[2])
        elif op is K.ATOMIC_GROUP:
            out += _options(arg)
        elif op is K.BRANCH:
            each = [_best(_options(b)) for b in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
    flush()
    return out


def required_literals(patterns: list[str]) -> frozenset[str] | None:
    """A set of which every match of any of the patterns holds a member."""
    found: set[str] = set()
    for p in patterns:
        if not _same_everywhere(p):
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                best = _best(_options(_parser.parse(p, re.IGNORECASE)))
        except (re.error, OverflowError, RecursionError):
            return None
        if best is None:
            return None
        found |= {s[:LONGEST] for s in best}
    return frozenset(found) if 0 < len(found) <= MOST else None


def key_gram(literal: str) -> str:
    """The three characters of a literal that are likely the rarest in text."""
    rank = lambda c: 30 - _RARE_FIRST.index(c) if c in _RARE_FIRST else 0 if c == " " else 24
    return max((literal[i:i + 3] for i in range(len(literal) - 2)), key=lambda g: (sum(map(rank, g)), g))
