"""Brute-force versions of the operators, in plain Python."""

import base64
import hashlib
import heapq
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(t):
    return t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def substring_dedup(docs, k=13):
    first, out = {}, []
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - k + 1 if d is not None else 0):
            g = tuple(w[i:i + k])
            first[g] = min(first.get(g, d), d)
    for d, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - k + 1 if d is not None else 0):
            if first[tuple(w[i:i + k])] < d:
                gone[i:i + k] = [True] * k
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def fingerprint(t, n=3):
    w = lower(t or "").split()
    grams = [b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def simhash(docs, n=3, radius=3):
    fps = [fingerprint(t, n) for _, t in docs]
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(names, np.uint64)
    for i, f in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius):
            x, y = find(f), find(names[i + 1 + j])
            root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for (d, _), f in zip(docs, fps):
        if d is not None:
            ids[find(f)].append(d)
    return [(d, f"{f:016x}", min(ids[find(f)], default=None)) for (d, _), f in zip(docs, fps)]


def contamination(docs, items, k=13):
    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", lower(t or ""))

    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(k, len(w))
        for p in range(len(w) - n + 1 if n and i is not None else 0):
            win[tuple(w[p:p + n])].add(str(i))
    sizes, out = sorted({len(x) for x in win}), []
    for d, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p:p + n])) in win:
                    hit[p:p + n] = [True] * n
                    found |= win[g]
        n = sum(hit)
        out.append((d, len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return out


def nearest(rows, k=20, step=20):
    ok = {(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in sorted(ok)]
    m = np.array([v for _, v in sorted(ok)])
    out = {}
    for i, v in sorted(ok):
        if i % step == 0:
            s = m @ np.array(v)
            out[i] = sorted(((-x, j) for x, j in zip(s, ids) if j != i))[:k]
    return out


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base_pii(t):
    t, out = t or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, rule, ok in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
                           ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
                           ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
                           ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(rule, t) if ok(m.group())]
    return out


def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def shingle_set(t):
    w = [x.removesuffix(b".") for x in re.findall(rb"[0-9a-z.\x80-\xff-]+", lower(t or ""))]
    w = [x for x in w if x]
    return ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())


def suffix_dedup(rows, length, keep):
    """(doc_id, spans, kept bytes) of (doc_id, text) rows; equal rows count as one place."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    where, times = {}, {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            key = (-(1 << 63) if d is None else d, hashlib.sha256(t).digest(), i)
            where.setdefault(t[i:i + length], set()).add(key)
            times[t[i:i + length]] = times.get(t[i:i + length], 0) + 1
    signed = lambda b: tuple(int.from_bytes(b[k:k + 8], "big", signed=True) for k in (0, 8))
    place = lambda k: (k[0], signed(k[1]), k[2])
    least = {w: min(map(place, s)) for w, s in where.items()}
    out = []
    for d, t in texts:
        gone, me = bytearray(len(t)), (-(1 << 63) if d is None else d, signed(hashlib.sha256(t).digest()))
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            if (times[w] > 1 if keep == "none" else least[w] < (*me, i)):
                gone[i:i + length] = b"\x01" * length
        spans = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((d, spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def filter_audit(rows, labels):
    """(part, order, step, ...) of (doc_id, text, source) and (doc_id, quality, toxic) rows."""
    first, good, toxic = {}, {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    docs = []
    for d, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        docs.append((source or "", {k for k, v in fails.items() if v}, d is not None and d in good, d is not None and d in toxic))
    out, share = {}, {}
    for part in {p for p, *_ in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                r = [0] * 6
                for p, fails, g, x in docs:
                    if p == part:
                        gone, here = bool(fails & set(order[:step - 1])), f in fails
                        r = [a + b for a, b in zip(r, [not gone and not here, here and not gone, here and gone, fails == {f}, here and not gone and g, here and not gone and x], strict=True)]
                out[part, order, step] = r
                share[part, f] = share.get((part, f), 0) + r[1]
    return [(p, o, s, *r, share[p, o[s - 1]]) for (p, o, s), r in out.items()]


def repair(rows):
    """(conv_id, ...) of conversations rows, by a search over all edits in order of cost, then letters."""
    told, say = {}, lambda x: " " if x is None else str(x)
    for c, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20, say(role), say(text)
        mine = told.setdefault(c, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, mine in told.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            body = text.rstrip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, *_ in mine if t is not None}
        initials = [r[:1] for _, r, _ in mine]
        heap, done, n = [(0, "", 0, "", ())], set(), len(mine)
        while True:
            cost, audit, i, state, kept = heapq.heappop(heap)
            if i == n and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            new = "a" if state == "u" else "u"
            name = "assistant" if state == "u" else "user"
            heapq.heappush(heap, (cost + 5, audit + "I", i, new, (*kept, f"{name}:")))
            if i < n:
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    if initials[i] and initials[i] in allowed:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i], (*kept, f"{mine[i][1]}:{mine[i][2]}")))
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new, (*kept, f"{name}:{mine[i][2]}")))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out
