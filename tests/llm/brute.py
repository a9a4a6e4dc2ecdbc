"""Plain Python versions of the corpus operators, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def tokens(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def bench_words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=13):
    """docs and items: (id, text). doc id -> (n_words, n_hit, items)."""
    windows: dict = {}
    for item, text in items:
        w = bench_words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).update([] if item is None else [str(item)])
    out = {}
    sizes = {len(x) for x in windows}
    for doc, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (ids := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= ids
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def near_groups(docs, size=5, similar=85):
    """doc id -> (n_shingles, component)."""
    sets = {}
    for doc, text in docs:
        w = tokens(text)
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similar * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def base_scores(docs):
    """doc id -> (n_tokens, n_known, base), with N."""
    counts: Counter = Counter()
    for doc, text in docs:
        if crc(doc) % 5 != 1:
            counts.update([*tokens(text), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for doc, text in docs:
        t = [*tokens(text), None]
        out[doc] = (len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    return out, n


def tree_scores(train, texts, depth, least, gain):
    """Log10 probabilities of texts under a suffix tree over the bytes of train, with dictionaries."""

    def form(text):
        return b"\n" * depth + b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"

    seen: dict = {}
    for text in train:
        f = form(text)
        for i in range(depth, len(f)):
            for d in range(depth + 1):
                seen.setdefault(f[i - d : i], Counter())[f[i]] += 1
    kept = {b""}
    for context, after in seen.items():
        if context and (total := sum(after.values())) >= least:
            above = seen[context[1:]]
            whole = sum(above.values())
            if sum(n * math.log(n * whole / (total * above[s])) for s, n in after.items()) >= gain:
                kept |= {context[k:] for k in range(len(context))}

    def probability(before, symbol):
        p = 1 / 256
        for d in range(depth + 1):
            context = before[len(before) - d :]
            if context in kept and context in seen:
                total, kinds = sum(seen[context].values()), len(seen[context])
                p = kinds / (total + kinds) * p + seen[context][symbol] / (total + kinds)
        return p

    return [sum(math.log10(probability(f[i - depth : i], f[i])) for i in range(depth, len(f))) for f in map(form, texts)]


def edited(rows):
    """rows: (id, text) in order of id. id -> edited text."""
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, follow = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        out[doc] = text[: len(text) - q] + follow[:q]
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
