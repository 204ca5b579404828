"""Plain versions of the operators, for small tables."""

import hashlib
import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_reachable(ids, links):
    near = {i: {i} for i in ids}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = min(seen)
    return out


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(docs, k):
    sets = {i: shingles(t, k) for i, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = smallest_reachable(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def repeats(docs, length=50):
    first = {}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    for i in sorted(raw):
        for p in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][p : p + length], i)
    out = {}
    for i, b in raw.items():
        hit = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                hit[p : p + length] = True
        hit = hit[: len(b)]
        n_spans = int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(hit.sum()), n_spans, hashlib.sha256(bytes(c for c, h in zip(b, hit) if not h)).hexdigest())
    return out


def words6(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, m=13):
    out = {}
    for i, t in docs.items():
        w, hit, found = words6(t), set(), set()
        for item, text in items.items():
            v = words6(text)
            size = min(m, len(v))
            for j in range(len(v) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[j : j + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(item))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
