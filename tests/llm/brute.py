"""Brute-force versions of what the operators compute, over ``(doc_id, text)`` pairs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile("[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def quality_counts(text):
    words = SPACED.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            len(words) < 20 or 100 * len(hit) > 30 * len(words))


def benchmark_hits(docs, items, size=13):
    windows, lengths = defaultdict(set), set()
    for item, text in items:
        words = PLAIN.findall((text or "").translate(LOWER))
        n = min(size, len(words))
        if n:
            lengths.add(n)
            for i in range(len(words) - n + 1):
                windows[tuple(words[i:i + n])].add("" if item is None else str(item))
    for doc, text in docs:
        words = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                some = windows.get(tuple(words[i:i + n]))
                if some:
                    hit.update(range(i, i + n))
                    found |= some
        yield doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def covered(docs, size):
    """Per document its sequence and a mask of what windows that start in a smaller document cover."""
    first = {}
    for doc, seq in docs:
        for i in range(len(seq) - size + 1):
            key = bytes(seq[i:i + size]) if isinstance(seq, bytes) else tuple(seq[i:i + size])
            first[key] = min(first.get(key, doc), doc)
    for doc, seq in docs:
        mask = bytearray(len(seq))
        for i in range(len(seq) - size + 1):
            if first[bytes(seq[i:i + size]) if isinstance(seq, bytes) else tuple(seq[i:i + size])] < doc:
                mask[i:i + size] = b"\1" * size
        yield doc, seq, bytes(mask)


def byte_cuts(docs, size=50):
    for doc, seq, mask in covered([(d, (t or "").encode()) for d, t in docs], size):
        yield doc, len(seq), sum(mask), len(re.findall(b"\1+", mask)), sha(bytes(c for c, m in zip(seq, mask) if not m))


def word_cuts(docs, size=13):
    for doc, seq, mask in covered([(d, SPACED.findall(t or "")) for d, t in docs], size):
        yield doc, len(seq), sum(mask), sha(" ".join(w for w, m in zip(seq, mask) if not m))


def jaccard_components(docs, size=4, percent=85):
    sets = {}
    for doc, text in docs:
        words = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(words)} if 0 < len(words) < size else {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        for e, common in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * common >= percent * (len(s) + len(sets[e]) - common):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return [(d, len(s), root(d)) for d, s in sets.items()]
