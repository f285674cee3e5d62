"""Plain versions that the tests hold the operators against."""

import re
from itertools import combinations

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def near_classes(rows):
    """doc_id -> least doc_id reachable by Jaccard links of 0.75 on 5-word shingles."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sets, 2):
        if (n := len(sets[a] & sets[b])) and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: top(d) for d in sets}


def passages(rows, window):
    """doc_id -> words that are left; documents that lose all their words are not in it."""
    first, out = {}, {}
    split = {d: WORDS.findall(t or "") for d, t in rows}
    for d, w in split.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        if len(gone) < len(w) or not w:
            out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out
