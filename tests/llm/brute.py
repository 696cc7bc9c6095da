"""Plain Python versions of what the operators give, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text, n=5):
    w = white_words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(links, ids):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def near_duplicates(docs):
    """docs: [(id, text)] with unique ids -> {id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for who in holders.values():
        for k, a in enumerate(who):
            for b in who[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    found = components(links, sets)
    return {i: (len(s), found[i]) for i, s in sets.items()}


def contamination(docs, items, span=13):
    """-> [(id, n_words, n_hit, n_items, sha, contaminated)]"""
    windows = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(span, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, got = plain_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    got |= own
        sha = hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(got), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def mixture(docs, weights=(1, 2, 3), most=3, seed=17):
    """docs: [(id, text, source)] -> [(id, size, source_size, target, copies)]"""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    of = defaultdict(int)
    for (_, _, s), n in zip(docs, sizes):
        of[s] += n
    order = sorted((s for s in of if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in of)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped, level = sum(of.values()), set(), 0.0
    while len(capped) < len(order):
        level = (total - sum(most * of[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * level > most * of[s]}
        if not above:
            break
        capped |= above
    target = {s: float(most * of[s]) if s in capped else weight[s] * level for s in order}
    out = []
    for (i, _, s), n in zip(docs, sizes):
        rate = target[s] / of[s] if of[s] else 1.0
        coin = int(hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest()[:12], 16) / 2**48
        out.append((i, n, of[s], target[s], int(rate) + (coin < rate - int(rate))))
    return out


def token_rows(docs, tokenizer, end=2):
    """docs: [(id, text)] -> [(id, start, n_tokens, crc)] in order of id, then text."""
    out, at = [], 0
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out
