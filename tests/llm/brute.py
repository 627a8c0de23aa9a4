"""Plain restatements of the operators' contracts, for small tables."""

import hashlib
import re

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def _before(a, b):
    """Whether an id comes before another: null first, and none before an equal one."""
    return a != b and (a is None or (b is not None and a < b))


def _least(ids):
    return None if None in ids else min(ids)


def repeated_words(docs, size):
    """doc_id -> (n_words, n_removed, sha256); docs are (doc_id, text) with different ids."""
    return {d: tuple(x) for (d, _), x in zip(docs, repeated_words_rows(docs, size))}


def repeated_words_rows(docs, size):
    """(n_words, n_removed, sha256) of each (doc_id, text), whatever their ids."""
    where, parsed = {}, [words(t) for _, t in docs]
    for (d, _), w in zip(docs, parsed):
        for i in range(len(w) - size + 1):
            where.setdefault(tuple(w[i:i + size]), set()).add(d)
    out = []
    for (d, _), w in zip(docs, parsed):
        gone = set()
        for i in range(len(w) - size + 1):
            if _before(_least(where[tuple(w[i:i + size])]), d):
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def repeated_bytes(docs, size):
    """doc_id -> (n_bytes, n_removed, n_spans, sha256); docs have different ids."""
    return {d: tuple(x) for (d, _), x in zip(docs, repeated_bytes_rows(docs, size))}


def repeated_bytes_rows(docs, size):
    """(n_bytes, n_removed, n_spans, sha256) of each (doc_id, text), whatever their ids."""
    where = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            where.setdefault(b[i:i + size], set()).add(d)
    out = []
    for d, t in docs:
        b, gone, seen = (t or "").encode(), set(), set()
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if w in seen or _before(_least(where[w]), d):
                gone.update(range(i, i + size))
            seen.add(w)
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        out.append((len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def simhash(text, size=4):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints, radius=4):
    """doc_id -> smallest id reachable; prints are (doc_id, fingerprint)."""
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[i + 1:]:
            if bin(f ^ g).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in prints}
