"""Plain versions of the corpus operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(doc_id):
    return (doc_id is None, doc_id or 0)


def byte_repeats(rows, length):
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in sorted(raw, key=lambda x: key(x[0])):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], key(d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(d):
                gone[p : p + length] = b"\1" * length
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def word_repeats(rows, length):
    first = {}
    raw = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in sorted(raw, key=lambda x: key(x[0])):
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p : p + length]), (key(d), p))
    out = []
    for d, w in raw:
        gone = bytearray(len(w))
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] != (key(d), p):
                gone[p : p + length] = b"\1" * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def leaks(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for p in range(len(w) - window + 1) if len(w) >= window else [0] if w else []:
            windows[tuple(w[p : p + window])].add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, met = ALNUM.findall(lower(t)), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    met |= {str(i) for i in windows[tuple(w[p : p + n])] if i is not None}
        out.append((d, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return out


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_groups(rows, k, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall(lower(t))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    links, seen = [], defaultdict(list)
    for i, (d, s) in enumerate(sets):
        met = Counter()
        for x in s:
            met.update(seen[x])
            seen[x].append(i)
        links += [(d, sets[j][0]) for j, c in met.items() if 100 * c >= percent * (len(s) + len(sets[j][1]) - c)]
    root = roots([d for d, _ in sets], links)
    return [(d, len(s), root[d]) for d, s in sets]
