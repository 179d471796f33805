"""Plain versions of the operators, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs, width=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), sha(kept)))
    return sorted(out)


def suffix(docs, length=200):
    data = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def near(docs, width=4, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    postings = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for x in sets[i] for j in postings[x])
        for j, both in shared.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for x in sets[i]:
            postings[x].append(i)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secret_base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in sorted(found))


def secret_parts(text, patterns):
    """(start, kind, end) of base spans and of the matches of weak ``patterns`` (kind -> pattern)."""
    number = {"assign": 0, "access": 1, "hex": 2}
    base = [(int(a), number[k], int(z)) for k, a, z in (x.split(":") for x in secret_base(text).split(",") if x)]
    return base, [(m.start(), kind, m.end()) for kind, p in patterns.items() for m in re.finditer(p, text, re.ASCII)]


def secret_spans(text, patterns, reach=200):
    """All spans: weak parts stay when complements lie within twice ``reach``, by trying every pair."""
    base, weak = secret_parts(text, patterns)
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    parts = base + weak

    def near(x, kinds):
        return any(y is not x and y[1] in kinds and max(x[0], y[0]) - min(x[2], y[2]) <= 2 * reach for y in parts)

    needs = {3: [(0, 2, 4)], 4: [(1, 3)], 5: [(0, 2, 4), (1, 3)]}
    return sorted(base + [w for w in weak if all(near(w, kinds) for kinds in needs[w[1]])])


def quality(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)
