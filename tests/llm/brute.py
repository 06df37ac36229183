"""Plain versions of the operators, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def last(doc_id):
    return (doc_id is None, doc_id or 0)


def passages(docs, size=13):
    first = {}
    cut = [(i, words(t)) for i, t in docs]
    for i, w in sorted(cut, key=lambda d: last(d[0])):
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), last(i))
    out = []
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < last(i):
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return Counter(out)


def byte_repeats(docs, size=400):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, b in raw:
        seen.update(b[k : k + size] for k in range(len(b) - size + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return Counter(out)


def common_lines(docs, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


def fingerprint(text, size=3):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    """Smallest index that each item reaches."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a + 1, len(items)):
            if linked(items[a], items[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(items))]


def simhash(docs):
    docs = sorted(docs, key=lambda d: last(d[0]))
    prints = [fingerprint(t) for _, t in docs]
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    return Counter((i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots))


def quality(docs):
    out = []
    for i, t in docs:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        places = defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        again = {x for v in places.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        out.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed))
    return Counter(out)


def contained(docs, items, share=0.8, size=5):
    token = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda text: token.findall((text or "").translate(LOWER))
    out = []
    for i, t in docs:
        w = cut(t)
        for item, text in items:
            x = cut(text)
            n = min(size, len(x))
            wanted = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            held = wanted & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if wanted and len(held) >= math.ceil(share * len(wanted) - 1e-9):
                out.append((i, item, len(wanted), len(held)))
    return Counter(out)


def base_scores(docs):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [(i, words((t or "").translate(LOWER)) + [None]) for i, t in docs]
    counts = Counter(x for i, w in tokens if not held(i) for x in w)
    total, kinds = sum(counts.values()), len(counts)
    score = lambda w: sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
    return Counter((i, held(i), len(w), sum(counts[x] > 0 for x in w), total, round(score(w), 6)) for i, w in tokens)


def trained_tree(docs, depth, least, divergence, z, heavy=5):
    """Counts of n-grams, followers of contexts, contexts that are retained."""
    counts, follow = Counter(), defaultdict(Counter)
    for i, t in docs:
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        w = (*words((t or "").translate(LOWER)), None)
        for k in range(len(w)):
            counts[()] += 1
            for n in range(min(depth, k) + 1):
                counts[w[k - n : k + 1]] += 1
                follow[w[k - n : k]][w[k]] += 1
    kept = set()
    for context, followers in follow.items():
        total = sum(followers.values())
        if not context or total < least:
            continue
        shorter = context[1:]
        gain = seen = expected = alone = 0
        for x, c in followers.items():
            e = total * counts[(*shorter, x)] / (sum(follow[shorter].values()) if shorter else counts[()])
            if e >= 1 or c >= heavy:
                gain, seen, expected, alone = gain + c * math.log(c / e), seen + c, expected + e, alone + 1
        others = total - seen
        gain += others * math.log(max(others, 1) / max(total - expected, 1))
        free = max(alone, 1)
        limit = free * (1 - 2 / (9 * free) + z * math.sqrt(2 / (9 * free))) ** 3
        if 2 * gain > limit and gain - free / 2 >= divergence * total:
            kept.add(context)
    return counts, follow, kept


def tree_scores(docs, depth, least, divergence, z):
    counts, follow, kept = trained_tree(docs, depth, least, divergence, z)
    types = len(follow[()])

    def chance(context, x):
        if not context:
            return (counts[(x,)] + 0.5) / (counts[()] + 0.5 * (types + 1))
        under = chance(context[1:], x)
        if context not in kept:
            return under
        kinds = len(follow[context])
        return (counts[(*context, x)] + kinds * under) / (sum(follow[context].values()) + kinds)

    out = []
    for i, t in docs:
        w = (*words((t or "").translate(LOWER)), None)
        out.append((i, round(sum(math.log10(chance(w[max(0, k - depth) : k], w[k])) for k in range(len(w))), 4)))
    return Counter(out)


def jaccard(a, b, size=5):
    cut = lambda t: {tuple(w[k : k + size]) for w in [words((t or "").translate(LOWER))] for k in range(max(1, len(w) - size + 1)) if w}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1.0
