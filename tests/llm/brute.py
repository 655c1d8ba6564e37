"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def smallest_of_components(ids, links):
    """Per row the smallest id of its component; links are pairs of row numbers."""
    parent = list(range(len(ids)))
    for a, b in links:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    low = {}
    for k, x in enumerate(ids):
        r = find(parent, k)
        if x is not None:
            low[r] = min(low.get(r, x), x)
    return [low.get(find(parent, k)) for k in range(len(ids))]


def near_copies(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a + 1, len(rows))
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    low = smallest_of_components([i for i, _ in rows], links)
    return sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, low)), key=str)


def near_vectors(rows, cosine=0.93):
    def good(label, e):
        return label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            (_, la, x), (_, lb, y) = rows[a], rows[b]
            if good(la, x) and good(lb, y) and la == lb and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                    links.append((a, b))
    n = [sum(k in pair for pair in links) for k in range(len(rows))]
    low = smallest_of_components([i for i, _, _ in rows], links)
    return sorted(((i, k, c, i is not None and i == c) for (i, _, _), k, c in zip(rows, n, low)), key=str)
