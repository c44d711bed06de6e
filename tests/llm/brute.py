"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")
SOLID = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text, pattern):
    return pattern.findall((text or "").encode().lower())


def contamination(docs, items, window=10):
    where = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            where[tuple(w[j:j + k])].add(item)
    lengths = {len(x) for x in where}
    out = []
    for doc, text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if items_here := where.get(tuple(w[j:j + k])):
                    hit.update(range(j, j + k))
                    found |= items_here
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


def shingle_set(text):
    w = words(text, SOLID)
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near(docs, percent=85):
    """{doc_id: (shingles, smallest linked id, kept)} by comparing all sets that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(list)
    for d, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for o in seen[x]:
                common[o] += 1
            seen[x].append(d)
        for o, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
    ("github", re.compile(r"gh[opsu]_[A-Za-z0-9]+"), 0, 40),
]


def secrets(text, rules=len(RULES)):
    found = []
    for k, (kind, pattern, group, least) in enumerate(RULES[:rules]):
        found += [(m.start(), k, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def token_rows(docs, tokenizer, end=2):
    """(doc_id, start, n_tokens, crc) of docs in ascending order."""
    at, out = 0, []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} for {source: size}; None is last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / free if free else 0.0
        over = {s for s in order if s not in full and level * weight[s] >= most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else level * weight[s] for s in order}
        full |= over
