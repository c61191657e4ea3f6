"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def runs(flags: list[bool]) -> int:
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def op1(docs, length=200):
    texts = {d: (t or "").encode() for d, t in docs}
    seen = Counter(t[i : i + length] for t in texts.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in texts.items():
        gone, until = [], 0
        for i in range(len(t)):
            if i + length <= len(t) and seen[t[i : i + length]] > 1:
                until = i + length
            gone.append(i < until)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), runs(gone), sha(kept))
    return out


def op9(docs, window=20):
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = WORD.findall((t or "").encode())
        gone, until = [], 0
        for i in range(len(w)):
            if i + window <= len(w):
                key = tuple(w[i : i + window])
                if key in seen:
                    until = i + window
                seen.add(key)
            gone.append(i < until)
        out[d] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def op10(docs, size=5, percent=75):
    sets = {}
    for d, t in docs:
        w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    has = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            has[x].append(d)
    shared = Counter((a, b) for ds in has.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def op4_base(text):
    t = (text or "").encode()
    w = WORD.findall(t)
    lines, seen, dup = t.split(b"\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    n, rep = len(w), sum(hit)
    chars = sum(len(x.decode()) for x in w)
    return n, chars, sum(c in "#*$%&|<>" for c in (text or "")), dup, rep, n < 20 or 100 * rep > 30 * n


def op5_targets(sizes: dict, most=3):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    left = total
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= most * sizes[s]
        open_ -= over
    return out


def op7(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t, r or "", x or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in ts)
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), sha(told.encode()), len(loss), sha(loss.encode()))
    return out


def op2(rows, k=10):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out
