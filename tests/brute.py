"""Textbook versions of both scorers, from their definitions."""

import math
from collections import Counter


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def token_sort(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    total = len(a) + len(b)
    return lcs(a, b), total


def fuzzy(left, right, cutoff, k):
    """left, right: lists of keys; right None means the later keys of left."""
    out = {}
    for i, a in enumerate(left):
        found = []
        for j, b in enumerate(left if right is None else right):
            if right is None and j <= i:
                continue
            common, total = token_sort(a, b)
            if 200 * common >= cutoff * total:
                found.append((j, 100.0 if not total else 200 * common / total))
        found.sort(key=lambda p: (-p[1], p[0]))
        if found:
            out[i] = [(j, round(s, 7)) for j, s in found[:k]]
    return out


def grams(key):
    out = []
    for word in key.split():
        padded = f" {word} "
        for n in (2, 3, 4):
            out += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return Counter(out)


def tfidf_vectors(corpus):
    counts = [grams(k) for k in corpus]
    df = Counter(g for c in counts for g in c)
    out = []
    for c in counts:
        w = {g: n * (math.log((1 + len(corpus)) / (1 + df[g])) + 1) for g, n in c.items()}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1.0
        out.append({g: v / norm for g, v in w.items()})
    return out


def tfidf(left, right, cutoff, k):
    vec = tfidf_vectors(left + (right or []))
    mine, theirs = vec[: len(left)], vec if right is None else vec[len(left) :]
    out = {}
    for i, a in enumerate(mine):
        found = []
        for j, b in enumerate(theirs):
            if right is None and j <= i:
                continue
            s = round(sum(v * b.get(g, 0.0) for g, v in a.items()), 9)
            if s >= cutoff / 100:
                found.append((j, s))
        found.sort(key=lambda p: (-p[1], -p[0]))
        if found:
            out[i] = [(j, round(s * 100, 7)) for j, s in found[:k]]
    return out
