"""Brute-force versions of the operators' contracts, in plain Python."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def near(rows: list[tuple[int, str | None]], width: int = 4, percent: int = 80) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component_id, kept), all pairs compared."""
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def repeated_bytes(rows: list[tuple[int, str | None]], width: int) -> dict[int, tuple[int, int, int, str]]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen: dict[bytes, int] = {}
    data = {i: (t or "").encode() for i, t in rows}
    for d in data.values():
        for p in range(len(d) - width + 1):
            seen[d[p:p + width]] = seen.get(d[p:p + width], 0) + 1
    out = {}
    for i, d in data.items():
        cut = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if seen[d[p:p + width]] > 1:
                cut[p:p + width] = b"\1" * width
        kept = bytes(b for b, c in zip(d, cut) if not c)
        spans = len(re.findall(rb"\x01+", bytes(cut)))
        out[i] = (len(d), sum(cut), spans, sha(kept))
    return out


def repeated_words(rows: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first: dict[tuple, tuple[int, int]] = {}
    out = {}
    for i in sorted(words):
        w = words[i]
        cut = [False] * len(w)
        for p in range(len(w) - width + 1):
            key = tuple(w[p:p + width])
            if key in first:
                cut[p:p + width] = [True] * width
            else:
                first[key] = (i, p)
        out[i] = (len(w), sum(cut), sha(" ".join(x for x, c in zip(w, cut) if not c)))
    return out


def spans(text: str | None, patterns: list[tuple[str, str, object]]) -> list[tuple[str, int, int]]:
    found = []
    for kind, pattern, test in patterns:
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if test(m)]
    return found
