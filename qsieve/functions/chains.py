"""Patterns that are chains of literals, matched for many rules in one pass.

A chain is a finite set of strings (its heads), or heads and a finite set of
tails with something between them: runs of characters of a class of which none
can give way to what follows, or `.*`.  A single head may repeat.  `chain_of`
reads a pattern's syntax tree and gives None for anything else, and for
constructs that Java reads otherwise.

`Chains` finds all their literals by one walk of a trie over the text, and
tells a chain's match from its literals' places.  No rule's pattern is run, and
a line meets only rules of which it holds a literal.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache
from re import _constants as K
from re import _parser

from .literals import _same_everywhere

LEAST, LONGEST, MOST, MOST_PAIRS = 3, 48, 16, 64  # characters of a literal; heads or tails of a chain, pairs of both
SMALL_CLASS = 10  # most characters of a class that is read as so many strings
_OTHERS = 1 << 128  # in a class: all characters beyond ASCII


def _mask(test) -> int:
    return sum(1 << c for c in range(128) if test(chr(c)))


_ALL = (1 << 129) - 1
_KINDS = {"DIGIT": _mask(lambda c: c in "0123456789"), "SPACE": _mask(lambda c: c in " \t\n\x0b\f\r"), "WORD": _mask(lambda c: c.isalnum() or c == "_")}
_KINDS = {f"CATEGORY_{k}": v for k, v in _KINDS.items()} | {f"CATEGORY_NOT_{k}": _ALL ^ v for k, v in _KINDS.items()}


def _printable(c: int) -> bool:
    return 0x20 <= c < 0x7F


def _class(op, arg) -> int | None:
    """The characters (case aside) that one class or literal takes, as bits."""
    parts, negated = (arg, False) if op is K.IN else ([(K.LITERAL, arg)], op is K.NOT_LITERAL) if op in (K.LITERAL, K.NOT_LITERAL) else (None, False)
    if parts is None:
        return None
    bits = 0
    for kind, v in parts:
        if kind is K.NEGATE:
            negated = True
        elif kind is K.CATEGORY and v.name in _KINDS:
            bits |= _KINDS[v.name]
        elif kind is K.LITERAL and (_printable(v) or v in (9, 10, 13)):
            bits |= 1 << v
        elif kind is K.RANGE and _printable(v[0]) and _printable(v[1]):
            bits |= (1 << v[1] + 1) - (1 << v[0])
        else:
            return None
    bits |= sum(1 << ord(chr(c).swapcase()) for c in range(128) if bits >> c & 1 and chr(c).isalpha())
    return _ALL ^ bits if negated else bits


def _strings(items) -> frozenset[str] | None:
    """The strings of a sequence that is finite, else None."""
    if items is None or len(items) > 1 or items and items[0][0] != "strings":
        return None
    return items[0][1] if items else frozenset([""])


def _items(nodes) -> list[tuple] | None:
    """A sequence as ("strings", set), ("run", class, least), ("gap", least) and ("repeated", string)."""
    out: list[tuple] = []

    def strings(s: frozenset[str] | None) -> bool:
        if s is not None and out and out[-1][0] == "strings":
            s = frozenset(a + b for a in out.pop()[1] for b in s) if len(out[-1][1]) * len(s) <= 4 * MOST else None
        if s is None or len(s) > MOST or max(map(len, s)) > LONGEST:
            return False
        out.append(("strings", s))
        return True

    for op, arg in nodes:
        if op is K.LITERAL and _printable(arg):
            if not strings(frozenset([chr(arg).lower()])):
                return None
        elif op in (K.IN, K.NOT_LITERAL):
            bits = _class(op, arg)
            held = [] if bits is None or bits & _OTHERS else [c for c in range(128) if bits >> c & 1]
            if not held or not all(map(_printable, held)) or len(few := {chr(c).lower() for c in held}) > SMALL_CLASS or not strings(frozenset(few)):
                return None
        elif op is K.SUBPATTERN:
            _, added, dropped, inner = arg
            inner = None if added or dropped else _items(inner)
            if inner is None:
                return None
            for x in inner:
                if x[0] == "strings":
                    if not strings(x[1]):
                        return None
                else:
                    out.append(x)
        elif op is K.BRANCH:
            each = [_strings(_items(b)) for b in arg[1]]
            if any(x is None for x in each) or not strings(frozenset().union(*each)):
                return None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                once = _strings(_items(inner))
                if once is None or not strings(once | {""}):
                    return None
            elif most is not K.MAXREPEAT or least not in (0, 1):
                return None
            elif len(inner) == 1 and inner[0][0] is K.ANY:
                out.append(("gap", least))
            elif len(inner) == 1 and (bits := _class(*inner[0])) is not None:
                out.append(("run", bits, least))
            else:
                once = _strings(_items(inner))
                if least != 1 or once is None or len(once) != 1 or len(min(once)) < LEAST:
                    return None
                out.append(("repeated", min(once)))
        else:
            return None
    return out


def _sure(runs: list[tuple], tails: frozenset[str]) -> bool:
    """Whether a run always takes all it can: none of its characters can begin what follows."""
    first = sum({1 << ord(c) for t in tails for c in (t[0], t[0].upper())})
    for i, (_, bits, _) in enumerate(runs):
        for _, more, least in runs[i + 1:]:
            if bits & more:
                return False
            if least:
                break
        else:
            if bits & first:
                return False
    return True


def chain_of(pattern: str) -> tuple[str, str | None, list[str], list[str]] | None:
    """(joint, repeated, heads, tails) of a pattern that is a chain, in lower case.
    A joint is '' (no tails), 'g' with the least length of `.*` or `.+`, or 'r'
    with the runs' least lengths and classes.  `repeated` is a string that heads
    begin with and that may stand before them any number of times more."""
    if "{" in pattern or re.search(r"\(\?[^:]|(?<!\\)(?:\\\\)*\\v", pattern) or not _same_everywhere(pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            items = _items(_parser.parse(pattern, re.IGNORECASE))
    except (re.error, OverflowError, RecursionError):
        return None
    while items and items[-1][0] in ("run", "gap") and not items[-1][-1]:
        items.pop()  # may be empty at the end: tells nothing
    if not items:
        return None
    repeated, after = None, frozenset([""])
    if items[0][0] == "repeated":
        repeated, items = items[0][1], items[1:]
        if items and items[0][0] == "strings":
            after, items = items[0][1], items[1:]
        items = [("strings", frozenset(repeated + x for x in after)), *items]
    if items[0][0] != "strings":
        return None
    heads, between, tails = items[0][1], items[1:-1], frozenset()
    joint = ""
    if len(items) > 1:
        if items[-1][0] != "strings" or not between:
            return None
        tails = items[-1][1]
        if not all(tails):
            return None
        if all(x[0] == "run" for x in between) and _sure(between, tails):
            joint = "r" + ";".join(f"{least}{bits:x}" for _, bits, least in between)
        elif len(between) == 1 and between[0][0] == "gap":
            joint = f"g{between[0][1]}"
        else:
            return None
    if repeated is not None and not joint.startswith("r"):
        if not joint and after == {""}:
            repeated = None  # the first of the repeated strings is the match's begin
        elif not all(after) or any(x[0] in repeated for x in after):
            return None
    if len(heads) * max(1, len(tails)) > MOST_PAIRS or any(not LEAST <= len(x) <= LONGEST for x in heads | tails):
        return None
    return joint, repeated, sorted(heads), sorted(tails)


def _spans(counts):
    """For rows that are repeated `counts` times: each copy's row and its number among the copies."""
    import numpy as np

    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _sorted_by(*columns):
    """The order by several columns of whole numbers, none negative, first column first."""
    import numpy as np

    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:]):
        key = key << b | c
    return np.argsort(key, kind="stable")


class _Listed:
    """Rows by key: `key` → the rows that hold it."""

    def __init__(self, key, n: int):
        import numpy as np

        self.rows = np.argsort(key, kind="stable")
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))]).astype(np.int64)

    def of(self, keys):
        """(place in `keys`, row) for all rows of all keys."""
        counts = self.begin[keys + 1] - self.begin[keys]
        at, k = _spans(counts)
        return at, self.rows[self.begin[keys[at]] + k]


class Chains:
    """The chains of a table of patterns: rn (a rule's number; rules of one id
    follow each other in the order in which the first to match counts), rule_id,
    languages, place (the pattern's among its rule's), joint, repeated, heads, tails."""

    CELLS = 1 << 21  # of a table of lines by literals

    def __init__(self, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks().sort_by([("rn", "ascending"), ("place", "ascending")])
        column = lambda c: pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], table[c].type)
        self.n = n = table.num_rows
        self.rn = column("rn").to_numpy(zero_copy_only=False).astype(np.int64)
        self.id = column("rule_id").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tongues = [frozenset(x) - {None} if x else None for x in column("languages").to_pylist()]  # None: any
        self.languages = sorted({x for t in tongues for x in t or ()})
        kinds = {t: i for i, t in enumerate({None: 0} | dict.fromkeys(tongues))}
        self.tongue = np.array([kinds[t] for t in tongues], np.int64)
        #: By language (its place; one more for others, one more for none known) and kind.
        self.speaks = np.array([[t is None or x is None or x in t for t in kinds] for x in [*self.languages, object(), None]], bool)
        parts = [column(c) for c in ("heads", "tails")]
        both = pa.concat_arrays([*(p.flatten() for p in parts), column("repeated").drop_null()]).dictionary_encode()
        code, self.texts = both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary.to_pylist()
        counts = [pc.list_value_length(p).to_numpy(zero_copy_only=False).astype(np.int64) for p in parts]
        (h, t), end = counts, int(counts[0].sum())
        head_from, tail_from = np.cumsum(h) - h, end + np.cumsum(t) - t
        self.repeated = np.full(n, -1, np.int64)
        self.repeated[np.flatnonzero(column("repeated").is_valid().to_numpy(zero_copy_only=False))] = code[end + int(t.sum()):]
        # a row for each head and tail of a pattern
        e, k = _spans(h * np.maximum(t, 1))
        per = np.maximum(t, 1)[e]
        head = code[head_from[e] + k // per]
        tail = np.where(t[e] > 0, code[np.minimum(tail_from[e] + k % per, len(code) - 1)], 0)
        joints = column("joint").dictionary_encode()
        joint, names = joints.indices.to_numpy(zero_copy_only=False)[e], joints.dictionary.to_pylist()
        # Of patterns that the same literals tell, in one id and for the same
        # languages, the first matches wherever the others do.
        order = _sorted_by(joint, head, tail, self.id[e], self.tongue[e], e)
        same = np.zeros(len(order), bool)
        if len(order):
            same[1:] = np.all([np.diff(x[order]) == 0 for x in (joint, head, tail, self.id[e], self.tongue[e])], axis=0)
        keep = np.sort(order[~same])
        e, head, tail, joint = e[keep], head[keep], tail[keep], joint[keep]
        self._trie()
        lits = len(self.texts)
        self.alone, self.gaps, self.runs = None, None, []
        gap = {i: int(x[1:]) for i, x in enumerate(names) if x.startswith("g")}
        for i, x in enumerate(names):
            at = np.flatnonzero(joint == i)
            if not x:
                self.alone = (_Listed(head[at], lits), e[at])
            elif x.startswith("r"):
                order = _sorted_by(head[at], tail[at])
                at = at[order]
                key, begin, count = np.unique(head[at] * lits + tail[at], return_index=True, return_counts=True)
                begins, ends = np.zeros(lits, bool), np.zeros(lits, bool)
                begins[head[at]] = ends[tail[at]] = True
                self.runs.append(([(int(r[0]), int(r[1:], 16)) for r in x[1:].split(";")], begins, ends, key, begin, count, e[at]))
        at = np.flatnonzero(np.isin(joint, list(gap)))
        if len(at):
            heads, tails = np.unique(head[at]), np.unique(tail[at])
            self.gaps = {"e": e[at], "head": head[at], "tail": tail[at], "least": np.array([gap[x] for x in joint[at]], np.int64),
                         "h": np.searchsorted(heads, head[at]), "t": np.searchsorted(tails, tail[at]), "n": (len(heads), len(tails)),
                         "of_head": self._codes(heads), "of_tail": self._codes(tails)}
            g, self.pieces = self.gaps, max(1, self.CELLS // (len(heads) + len(tails)))
            g["first"], g["last"] = np.full(self.pieces * len(heads), 1 << 40, np.int64), np.full(self.pieces * len(tails), -1, np.int64)
        self.repeats = np.zeros(lits, bool)
        self.repeats[self.repeated[self.repeated >= 0]] = True
        self.seen, self.blocks = np.zeros(lits, np.int64), 0

    def _codes(self, some):
        import numpy as np

        out = np.full(len(self.texts), -1, np.int64)
        out[some] = np.arange(len(some))
        return out

    def _trie(self) -> None:
        """States of the literals' beginnings: `step[state * width + code of a
        byte]`, 0 where none goes on, and `third` for the first three bytes."""
        import numpy as np

        n = len(self.texts)
        self.length = np.array([len(x) for x in self.texts], np.int64)
        most = int(self.length.max()) if n else LEAST
        byte = np.frombuffer("".join(x.ljust(most, "\0") for x in self.texts).encode("ascii"), np.uint8).reshape(n, most)
        used = np.setdiff1d(np.unique(byte), [0])
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        upper = np.arange(ord("A"), ord("Z") + 1)
        self.code[upper] = self.code[upper + 32]
        self.width = w = len(used) + 1
        state, path, moves, states = np.zeros(n, np.int64), np.zeros(1, np.int64), [], 1
        self.third = np.zeros(w ** 3, np.int64)
        for d in range(most):
            alive = np.flatnonzero(self.length > d)
            key, new = np.unique(state[alive] * w + self.code[byte[alive, d]], return_inverse=True)
            state[alive] = states + new
            if d < 3:
                path = path[key // w - (states - len(path))] * w + key % w if d else key % w
            if d == 2:
                self.third[path] = states + np.arange(len(key))
            if d >= 3:
                moves.append((key, states + np.arange(len(key))))
            states += len(key)
        self.step = np.zeros(states * w, np.int32)
        for key, to in moves:
            self.step[key] = to
        self.ends = np.full(states, -1, np.int32)
        self.ends[state] = np.arange(n)
        self.deepest = most

    def _literals(self, data):
        """(place, literal) of all literals in the text."""
        import numpy as np

        n, w = len(data), self.width
        code = np.zeros(n + self.deepest + 2, np.int64)
        code[:n] = self.code[data]
        state = self.third[(code[:n] * w + code[1:n + 1]) * w + code[2:n + 2]]
        at = np.flatnonzero(state)
        state, places, found = state[at], [], []
        for depth in range(3, self.deepest + 1):
            lit = self.ends[state]
            held = np.flatnonzero(lit >= 0)
            places.append(at[held])
            found.append(lit[held])
            state = self.step[state.astype(np.int64) * w + code[at + depth]]
            on = np.flatnonzero(state)
            at, state = at[on], state[on]
            if not len(at):
                break
        return np.concatenate(places), np.concatenate(found).astype(np.int64)

    def blocks_of(self, text: bytes, most_bytes: int = 1 << 18):
        """Cuts of the text at line breaks, so that a block's tables are bounded: (begin, end)."""
        import numpy as np

        data = np.frombuffer(text, np.uint8)
        breaks = np.flatnonzero(data == 10) + 1
        ends = np.concatenate([breaks, [len(data) + 1]])
        most_lines = self.pieces if self.gaps else self.CELLS
        at, i = 0, 0
        while i < len(ends):
            j = max(i + 1, min(i + most_lines, int(np.searchsorted(ends, at + most_bytes, "right"))))
            yield at, int(ends[j - 1]) - 1  # the last line's break is left out
            at, i = int(ends[j - 1]), j

    def _sides(self, lits: int) -> None:
        """Pairs with `.*` between are looked up by the literal that fewer lines hold."""
        import numpy as np

        g = self.gaps
        by_head = self.seen[g["head"]] <= self.seen[g["tail"]]
        one, other = np.flatnonzero(by_head), np.flatnonzero(~by_head)
        g["by_head"], g["by_tail"] = (_Listed(g["head"][one], lits), one), (_Listed(g["tail"][other], lits), other)

    def matches(self, text: bytes, languages):
        """(line, rn, column) of the text's matches, a row per line and rule id: the
        first of the id's rules that matches the line, by its first pattern that
        does, in the order of lines and rules.  `languages`: of each line, its
        place in `self.languages`, one beyond for others, two beyond for none known."""
        import numpy as np

        data = np.frombuffer(text + b"\n", np.uint8)
        n, lits = len(data), len(self.texts)
        at, lit = self._literals(data)
        line_break = data == 10
        line_of = np.cumsum(line_break) - line_break
        stops = line_break | (data == 13)  # what `.` does not take
        wide = np.flatnonzero(data >= 0x80)
        if len(wide):
            b, c = data[np.minimum(wide + 1, n - 1)], data[np.minimum(wide + 2, n - 1)]
            stops[wide] |= (data[wide] == 0xC2) & (b == 0x85) | (data[wide] == 0xE2) & (b == 0x80) & ((c == 0xA8) | (c == 0xA9))
        piece_of = np.cumsum(stops) - stops
        order = _sorted_by(piece_of[at], lit, at)
        at, lit = at[order], lit[order]
        piece = piece_of[at]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(lit) != 0)])) if len(at) else np.zeros(0, np.int64)
        first, last = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else at
        gpiece, glit = piece[new], lit[new]
        found = []
        if self.alone:
            listed, e = self.alone
            g, row = listed.of(glit)
            found.append((e[row], first[g]))
        if self.gaps and len(at):
            found += self._gaps(gpiece, glit, first, last, lits)
        run_end = lru_cache(None)(lambda bits: self._run_end(data, bits))
        for runs, begins, ends, key, begin, count, e in self.runs:
            if not len(at):
                break
            one, other = np.flatnonzero(begins[lit]), np.flatnonzero(ends[lit])
            stand = at[one] + self.length[lit[one]]
            ok = np.ones(len(one), bool)
            for least, bits in runs:
                to = run_end(bits)[stand]
                ok &= to - stand >= least
                stand = to
            one, stand = one[ok], stand[ok]
            a, row = _Listed(at[other], n + 1).of(stand)
            a, b = one[a], other[row]
            k = lit[a] * lits + lit[b]
            where = np.minimum(np.searchsorted(key, k), len(key) - 1)
            hit = np.flatnonzero(key[where] == k)
            which, c = _spans(count[where[hit]])
            found.append((e[begin[where[hit]][which] + c], at[a[hit]][which]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        e, at0 = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        at0 = self._begin(e, at0, at, lit, n)
        line = line_of[at0]
        if len(self.speaks[0]) > 1:
            fits = self.speaks[languages[line], self.tongue[e]]
            e, at0, line = e[fits], at0[fits], line[fits]
        line, e, at0 = self._best(line, e, at0)
        own = data != 10
        if len(wide):
            own = (data & 0xC0 != 0x80).astype(np.int64) + (data >= 0xF0)  # UTF-16 units
            units = np.cumsum(own) - own
            begin = np.concatenate([[0], np.flatnonzero(line_break) + 1])
            column = units[at0] - units[begin[line]] + 1
        else:
            begin = np.concatenate([[0], np.flatnonzero(line_break) + 1])
            column = at0 - begin[line] + 1
        return line, self.rn[e], column

    def _best(self, line, e, at):
        """The first row of each line and rule id, in order of (pattern, place)."""
        import numpy as np

        if not len(line):
            return line, e, at
        eb, ab = max(1, self.n.bit_length()), max(1, int(at.max()).bit_length())
        if int(line.max()).bit_length() + eb + ab <= 63:
            key = np.sort((line << eb | e) << ab | at)
            at, e, line = key & (1 << ab) - 1, key >> ab & (1 << eb) - 1, key >> ab + eb
        else:
            order = np.lexsort((at, e, line))
            line, e, at = line[order], e[order], at[order]
        own = self.id[e]
        keep = np.flatnonzero(np.concatenate([[True], (np.diff(line) != 0) | (np.diff(own) != 0)]))
        return line[keep], e[keep], at[keep]

    def _run_end(self, data, bits: int):
        """Of each place, where the run of the class's characters that stands there ends."""
        import numpy as np

        takes = np.array([bits >> (c if c < 128 else 128) & 1 for c in range(256)], bool)
        takes[10] = False
        end = np.where(takes[data], len(data), np.arange(len(data)))
        return np.append(np.minimum.accumulate(end[::-1])[::-1], len(data))

    def _gaps(self, piece, lit, first, last, lits: int):
        """Pairs of literals of one piece of a line, the tail after the head."""
        import numpy as np

        g = self.gaps
        self.blocks += 1
        self.seen += np.bincount(lit, minlength=lits)
        if self.blocks & self.blocks - 1 == 0:  # so far, at each power of two
            self._sides(lits)
        for p in range(0, int(piece[-1]) + 1, self.pieces):
            a, b = np.searchsorted(piece, [p, p + self.pieces])
            if b > a:
                yield from self._pairs(g, piece[a:b] - p, lit[a:b], first[a:b], last[a:b])

    def _pairs(self, g, piece, lit, first, last):
        import numpy as np

        nh, nt = g["n"]
        hs, ts = np.flatnonzero(g["of_head"][lit] >= 0), np.flatnonzero(g["of_tail"][lit] >= 0)
        hcell, tcell = piece[hs] * nh + g["of_head"][lit[hs]], piece[ts] * nt + g["of_tail"][lit[ts]]
        g["first"][hcell], g["last"][tcell] = first[hs], last[ts]
        listed, rows = g["by_head"]
        x, row = listed.of(lit[hs])
        x, row = hs[x], rows[row]
        ok = np.flatnonzero(g["last"][piece[x] * nt + g["t"][row]] >= first[x] + self.length[lit[x]] + g["least"][row])
        yield g["e"][row[ok]], first[x[ok]]
        listed, rows = g["by_tail"]
        x, row = listed.of(lit[ts])
        x, row = ts[x], rows[row]
        begin = g["first"][piece[x] * nh + g["h"][row]]
        ok = np.flatnonzero(begin + self.length[g["head"][row]] + g["least"][row] <= last[x])
        yield g["e"][row[ok]], begin[ok]
        g["first"][hcell], g["last"][tcell] = 1 << 40, -1

    def _begin(self, e, at, places, lits, n: int):
        """The matches' begins where a head's string stands repeated before it."""
        import numpy as np

        own = np.flatnonzero(self.repeats[lits])
        if not len(own):
            return at
        key = lits[own] * n + places[own]
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        before = np.searchsorted(key, key - self.length[lits[own]])
        back = np.flatnonzero((places[own] >= self.length[lits[own]]) & (key[np.minimum(before, len(key) - 1)] == key - self.length[lits[own]]))
        if not len(back):
            return at
        link = np.arange(len(key))
        link[back] = before[back]
        while not np.array_equal(further := link[link], link):
            link = further
        moved = np.zeros(n, bool)
        moved[places[own[back]]] = True
        some = np.flatnonzero(moved[at] & (self.repeated[e] >= 0))
        want = self.repeated[e[some]] * n + at[some]
        where = np.minimum(np.searchsorted(key, want), len(key) - 1)
        at = at.copy()
        at[some] = np.where(key[where] == want, places[own[link[where]]], at[some])
        return at


def chain_rows():
    """A mapInArrow function: (rule_no, patterns) → a row per pattern with its
    chain; `joint` is null where it is none."""
    read = chain_of

    def run(batches):
        import pyarrow as pa

        kinds = (("rule_no", pa.int64()), ("place", pa.int32()), ("joint", pa.string()), ("repeated", pa.string()), ("heads", pa.list_(pa.string())), ("tails", pa.list_(pa.string())))
        for batch in batches:
            rows = [(no, i, *(p is not None and read(p) or (None,) * 4)) for no, patterns in zip(batch["rule_no"].to_pylist(), batch["patterns"].to_pylist()) for i, p in enumerate(patterns)]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds)], [k for k, _ in kinds])

    return run


def chain_hits(folder: str, most_bytes: int = 1 << 20):
    """A mapInArrow function: (repo, path, language, content) → the lines that
    rules of the table in `folder` match, with `hits`: a number per rule id,
    the rule's number * 2**32 + the match's column."""
    chains = Chains

    def table():
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs as pfs

        files, base = pfs.FileSystem.from_uri(folder)
        found = sorted(f.path for f in files.get_file_info(pfs.FileSelector(base)) if f.is_file and f.path.endswith(".parquet"))
        wanted = ["rn", "rule_id", "languages", "place", "joint", "repeated", "heads", "tails"]
        return pa.concat_tables([pq.read_table(p, filesystem=files, columns=wanted, partitioning=None) for p in found])

    def lines_of(text, files, languages, finder):
        """The matches of one portion's text, block by block."""
        import numpy as np
        import pyarrow as pa

        line0 = 0
        for begin, end in finder.blocks_of(text):
            block = text[begin:end]
            breaks = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
            line, rn, column = finder.matches(block, languages[line0:line0 + len(breaks) + 1])
            if len(line):
                own, counts = np.unique(line, return_counts=True)
                starts, ends = np.concatenate([[0], breaks + 1]), np.append(breaks, len(block))
                lines = [block[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]
                hits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(rn << 32 | column))
                yield files[line0 + own], line0 + own, lines, hits
            line0 += len(breaks) + 1

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        finder = chains(table())
        place = {x: i for i, x in enumerate(finder.languages)} | {None: len(finder.languages) + 1}
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["content"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            cuts = [0, *(np.flatnonzero(np.diff(ends // most_bytes)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b <= a:
                    continue
                part = batch.slice(a, b - a)
                texts = [x or b"" for x in part["content"].cast(pa.binary()).to_pylist()]
                counts = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
                file_of = np.repeat(np.arange(len(texts)), counts)
                begins = np.cumsum(counts) - counts
                tongue = np.array([place.get(x, len(finder.languages)) for x in part["language"].to_pylist()], np.int64)
                for file, line, lines, hits in lines_of(b"\n".join(texts), file_of, tongue[file_of], finder):
                    held = [part[c].take(pa.array(file)) for c in ("repo", "path", "language")]
                    text = pa.array(lines, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [*held, pa.array((line - begins[file] + 1).astype(np.int32)), pa.StringArray.from_buffers(len(text), text.buffers()[1], text.buffers()[2]), hits],
                        ["repo", "path", "language", "line_no", "line", "hits"])

    return run
