"""Brute-force answers that several tests use."""

import numpy as np
import xxhash


def brute_fingerprint(text, width, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = ([b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
                or [b" ".join(words)])
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_groups(rows, width, seeds, differing):
    """Groups of row numbers of texts linked by so many differing bits or fewer."""
    fps = np.array([[brute_fingerprint(t, width, s) for s in seeds] for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        apart = np.bitwise_count(fps ^ fps[i]).sum(axis=1, dtype=int)
        for j in np.flatnonzero(apart <= differing):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())
