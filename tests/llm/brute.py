"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    """{row index: (n_words, n_hit, n_items, sha)}"""
    index = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        size = min(window, len(w))
        if item is not None:
            for s in range(len(w) - size + 1 if w else 0):
                index[tuple(w[s : s + size])].add(str(item))
    sizes = {len(k) for k in index}
    out = []
    for id_, text in docs:
        w = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for size in sizes:
            for s in range(len(w) - size + 1):
                if names := index.get(tuple(w[s : s + size])):
                    hit.update(range(s, s + size))
                    found |= names
        out.append((id_, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def proximity(docs, items, span, window=10, rarest=2):
    """(id, item, n_places, first, last) for each text and item with enough of the item's rarest places near each other."""
    cut = {(i, t): ITEM_WORD.findall((t or "").translate(ASCII_LOWER)) for i, t in docs}
    n = Counter(w for _, t in docs for w in ITEM_WORD.findall((t or "").translate(ASCII_LOWER)))
    out = []
    for item, text in items:
        words = ITEM_WORD.findall((text or "").translate(ASCII_LOWER))
        if item is None or not words:
            continue
        places = set()
        for s in range(max(1, len(words) - window + 1)):
            ranked = sorted((n[words[q]], q) for q in range(s, min(s + window, len(words))))
            if ranked[0][0]:
                places.update(q for _, q in ranked[:rarest])
        need = min(len(words), rarest)
        for (id_, _), doc in cut.items():
            best = None
            hits = sorted((p, q) for q in places for p, w in enumerate(doc) if w == words[q])
            for p, _ in hits:
                inside = [(b, q) for b, q in hits if p <= b < p + span]
                found = len({q for _, q in inside}), -p, max(b for b, _ in inside)
                if found[0] >= need and (best is None or found > best):
                    best = found
            if best:
                out.append((id_, str(item), best[0], -best[1], best[2]))
    return out


def substring_dedup(docs, window=20):
    place = lambda i: (i is None, i or 0)
    first = {}
    cut = [(id_, SPACE_WORD.findall(text or "")) for id_, text in docs]
    for id_, w in cut:
        for s in range(len(w) - window + 1):
            k, p = tuple(w[s : s + window]), (place(id_), s)
            first[k] = min(p, first.get(k, p))
    out = []
    for id_, w in cut:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (place(id_), s):
                gone.update(range(s, s + window))
        out.append((id_, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def line_dedup(docs, least=2):
    place = lambda i: (i is None, i or 0)
    first = {}
    cut = []
    for id_, text in docs:
        lines = [] if text is None else text.split("\n")
        cut.append((id_, text, lines, [i for i, x in enumerate(lines) if SPACE_WORD.search(x)]))
    for id_, _, lines, full in cut:
        for s in range(len(full) - least + 1):
            k, p = tuple(lines[i] for i in full[s : s + least]), (place(id_), full[s])
            first[k] = min(p, first.get(k, p))
    out = []
    for id_, text, lines, full in cut:
        gone = set()
        for s in range(len(full) - least + 1):
            if first[tuple(lines[i] for i in full[s : s + least])] < (place(id_), full[s]):
                gone.update(range(full[s], full[s + least - 1] + 1))
        kept = [x for i, x in enumerate(lines) if i not in gone]
        out.append((id_, None if text is None else "\n".join(kept), len(lines), len(gone)))
    return out


def text_stats(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def shingles(text, size=5):
    w = SPACE_WORD.findall((text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def jaccard_components(docs):
    """[(id, n_shingles, component)]"""
    sets = [(id_, shingles(text)) for id_, text in docs]
    where = defaultdict(list)
    for i, (id_, s) in enumerate(sets):
        if id_ is not None:
            for x in s:
                where[x].append(i)
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, (id_, s) in enumerate(sets):
        if id_ is None:
            continue
        for j, both in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((root(id_), root(sets[j][0])))
                up[b] = a
    return [(id_, len(s), None if id_ is None else root(id_)) for id_, s in sets]
