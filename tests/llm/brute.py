"""Slow, plain versions of the operators' results, written from their contracts."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def fingerprint(text, width=4):
    w = WORDS.findall(ascii_lower(text or ""))
    shingles = [" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(fps: list[int], bits=4) -> list[int]:
    """A group number for each fingerprint."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if group[i] != group[j] and bin(fps[i] ^ fps[j]).count("1") <= bits:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def near_duplicates(rows, bits=4):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    group = components(fps, bits)
    least = {g: min((d for (d, _), x in zip(rows, group) if x == g and d is not None), default=None) for g in set(group)}
    return [(d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fps, group)]


def substring_dedup(rows, least=50):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    docs = [(d, WORDS.findall(t or "")) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - least + 1):
                k = tuple(w[i:i + least])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - least + 1 if d is not None else 0):
            if first[tuple(w[i:i + least])] < d:
                gone[i:i + least] = [True] * least
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, width, n=None):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    n = min(len(w), width) if n is None else n
    return n, ({" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set())


def contained(docs, items, threshold=0.8, width=5):
    """{(doc_id, item_id): containment}."""
    found = {}
    for item_id, text in items:
        n, want = shingles(text, width)
        for d, t in docs if n else []:
            share = len(want & shingles(t, width, n)[1]) / len(want)
            if share >= threshold - 1e-9:
                found[d, item_id] = max(share, found.get((d, item_id), 0.0))
    return found


def topk(rows, every, k):
    """(query_id, rank, vec_id, score) of (vec_id, vector) rows."""
    import math
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        best: dict[int, int] = {}
        for i, v in ok:
            for j, w in ok:
                if i == q and j != q and len(v) == len(w):
                    score = sum(int(a) * int(b) for a, b in zip(v, w))  # a 64-bit column: clipped, then ranked
                    best[j] = max(best.get(j, -(1 << 70)), max(-(1 << 63), min((1 << 63) - 1, score)))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r, j, s) for r, (j, s) in enumerate(ranked, 1)]
    return out


def base_spans(text):
    """[(kind, start, end)] by start, then kind as listed."""
    t = text or ""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(found)]


def merge_words(ranks: dict[tuple[bytes, bytes], int], word: bytes) -> list[bytes]:
    """Byte-pair merging, one leftmost lowest-rank pair at a time."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return parts
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
