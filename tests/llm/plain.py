"""Plain versions of the operators for small inputs."""

import collections
import re

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def last(i):
    return (1 << 63) - 1 if i is None else i


def without_repeats(rows, k=50):
    """{row number: (kept text, words, removed)}"""
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, last(i)), last(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < last(i) for q in range(p, p + k)}
        out.append((i, " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone)))
    return out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(rows, n, num, den):
    """{id: (size of the set, least id reached)} for distinct ids."""
    sets = {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=last)
    for a in ids:
        for b in ids:
            if last(a) < last(b) and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)), key=last)
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def copies(rows):
    """[(id, keep id, group size)] with null ids last."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    return [(i, min(groups[SPACE.sub(" ", t or "")], key=last), len(groups[SPACE.sub(" ", t or "")])) for i, t in rows]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Deals the budget by weight, again and again, until no source is above its limit. ``sizes``: {source: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = budget - sum(most * sizes[s] for s in capped)
        dealt = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if dealt[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else dealt[s] for s in order}
        capped |= over
