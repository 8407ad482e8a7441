"""Brute-force versions of the operators, written from the contracts."""

from __future__ import annotations

import hashlib
import re


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s))


def alnum_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def contamination(docs, items):
    """{index: (n_words, n_hit, n_items, sha, contaminated)} for docs [(id, text)] and items [(id, text)]."""
    out = []
    for _, text in docs:
        w = alnum_words(text)
        hit, ids = set(), set()
        for item, t in items:
            v = alnum_words(t)
            if item is None or not v:
                continue
            n = min(13, len(v))
            for i in range(len(v) - n + 1):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit.update(range(j, j + n))
                        ids.add(item)
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(map(str, ids)))),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingle_set(text):
    w = space_words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """{doc_id: smallest linked id} by all pairs."""
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def dedup_lines(docs):
    """Texts after removal of later occurrences of three-line windows; docs [(id, text)] in id order."""
    seen, out = {}, []
    for i, text in docs:
        if text is None:
            continue
        counted = [p for p, line in enumerate(text.split("\n")) if re.search(r"\S", line)]
        lines = text.split("\n")
        for a, b, c in zip(counted, counted[1:], counted[2:]):
            seen.setdefault((lines[a], lines[b], lines[c]), (i, a))
    for i, text in docs:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        counted = [p for p, line in enumerate(lines) if re.search(r"\S", line)]
        gone = set()
        for a, b, c in zip(counted, counted[1:], counted[2:]):
            if seen[lines[a], lines[b], lines[c]] != (i, a):
                gone |= {a, b, c}
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone)))
    return out
