"""Plain-Python versions that the operators are held against."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def shingles(text, run=5):
    w = tokens(text, True)
    return {tuple(w[i:i + run]) for i in range(len(w) - run + 1)} if len(w) >= run else {tuple(w)} if w else set()


def near_components(docs, percent):
    """{id: (set size, smallest reachable id)} over all pairs."""
    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


def without_repeats(docs, window=50):
    """{id: (words, removed, kept words joined)}."""
    seen, words = {}, {k: tokens(t) for k, t in docs.items()}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            seen.setdefault(tuple(words[k][i:i + window]), k)
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] < k:
                gone[i:i + window] = [True] * window
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out
