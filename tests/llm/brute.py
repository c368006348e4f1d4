"""Plain versions of operators, for comparison."""

import re
from collections import defaultdict

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def jaccard_components(rows, n, percent):
    """Smallest id of each row's component; rows: (id, text)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(parent, i)] = find(parent, j)
    least = defaultdict(list)
    for i, (name, _) in enumerate(sets):
        least[find(parent, i)].append(name)
    return [(name, len(s), min((x for x in least[find(parent, i)] if x is not None), default=None)) for i, (name, s) in enumerate(sets)]
