"""Plain versions of what the operators compute, for small inputs."""
from __future__ import annotations

import re
from collections import defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, size=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def jaccard_groups(docs):
    """{row number: (doc_id, set size, component)} of [(doc_id, text)]."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in lists[g]:
                shared[j] += 1
            lists[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def repeated_bytes(docs, window=200):
    """[(doc_id, n_bytes, n_removed, n_spans, kept bytes)] of [(doc_id, text)]."""
    raws = [(t or "").encode() for _, t in docs]
    seen = defaultdict(int)
    for raw in raws:
        for i in range(len(raw) - window + 1):
            seen[hash(raw[i:i + window])] += 1
    out = []
    for (d, _), raw in zip(docs, raws):
        mark = bytearray(len(raw) + 1)
        reach = 0
        for i in range(len(raw) - window + 1):
            if seen[hash(raw[i:i + window])] > 1:
                for j in range(max(i, reach), i + window):
                    mark[j] = 1
                reach = i + window
        out.append((d, len(raw), sum(mark), sum(mark[i] and not mark[i - 1] for i in range(len(raw))), bytes(b for b, m in zip(raw, mark) if not m)))
    return out
