"""Plain implementations of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]")


def shingles(text: str | None, k: int) -> set:
    words = [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def near(docs: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i in sorted(sets):
        both = Counter(j for s in sets[i] for j in index[s])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            index[s].add(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def suffix(docs: list[tuple[int | None, str | None]], depth: int) -> Counter:
    owner: dict[bytes, float] = {}
    key = lambda i: float("-inf") if i is None else i
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            if key(i) < owner.get(w, float("inf")):
                owner[w] = key(i)
    out = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if owner[b[p : p + depth]] < key(i):
                gone[p : p + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def tokens(docs: list[tuple[int, str | None]], path: str) -> list[tuple]:
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    out, start = [], 0
    for i, t in sorted(docs):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
