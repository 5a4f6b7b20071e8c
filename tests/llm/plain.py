"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def jaccard(docs, n=5, percent=80):
    """{doc: (number of shingles, component)}"""
    sets = {}
    for doc, text in docs:
        w = words((text or "").translate(LOWER))
        sets[doc] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    where, links = defaultdict(list), []
    for doc, shingles in sets.items():
        common = Counter(o for s in shingles for o in where[s])
        links += [(doc, o) for o, k in common.items() if 100 * k >= percent * (len(shingles) + len(sets[o]) - k)]
        for s in shingles:
            where[s].append(doc)
    found = classes(sets, links)
    return {doc: (len(s), found[doc]) for doc, s in sets.items()}


def dedup(docs, length=50):
    """{doc: (words, removed, SHA-256 of what is kept)}"""
    first, split = {}, {doc: words(text) for doc, text in sorted(docs)}
    for doc, w in split.items():
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k:k + length]), doc)
    out = {}
    for doc, w in split.items():
        covered = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < doc:
                covered.update(range(k, k + length))
        kept = " ".join(x for k, x in enumerate(w) if k not in covered)
        out[doc] = len(w), len(covered), hashlib.sha256(kept.encode()).hexdigest()
    return out
