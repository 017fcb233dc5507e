"""Plain versions of the operators, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= n:
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def components(docs, n, percent):
    """docs: (doc_id, text). The smallest doc_id reachable, and the number of links, by doc_id."""
    sets = [(i, shingles(t, n)) for i, t in docs]
    label, links = {i: i for i, _ in docs}, {i: 0 for i, _ in docs}
    edges = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label, links


def without_repeats(docs, length):
    """docs: (doc_id, text) with distinct ids. Kept words by doc_id."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def item_words(text):
    """The word rule of decontamination, for characters below U+0250."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x80-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF]+", (text or "").lower()) if w]


def contained(docs, items, n=5, threshold=0.8):
    def sets(text):
        w = item_words(text)
        if len(w) >= n:
            return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return {tuple(w)} if w else set()

    out = {}
    own = [(i, sets(t)) for i, t in items]
    for d, t in docs:
        s = sets(t)
        for i, q in own:
            if q and len(q & s) / len(q) >= threshold:
                out[d, i] = (len(q), len(q & s))
    return out


def best_fit(lengths, size):
    """Number of bins of one-by-one best-fit decreasing."""
    import bisect

    left, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(left, n)
        if k < len(left):
            room = left.pop(k)
        else:
            room, bins = size, bins + 1
        bisect.insort(left, room - n)
    return bins


def nearest(vectors, query, k):
    """vectors: {id: list}. The k nearest other ids by cosine, ties to the smaller id."""
    import numpy as np

    a = np.array(vectors[query], float)
    found = []
    for i, v in vectors.items():
        if i != query:
            b = np.array(v, float)
            found.append((-(a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)), i))
    return [(i, -s) for s, i in sorted(found)[:k]]
