"""Plain, slow versions of the text operators, for comparison on small inputs."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ppm_bits(train: bytes, text: bytes, order: int) -> float:
    """Code length of ``text`` by PPM, method C with exclusion, under the frozen counts of ``train``."""
    counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    data = bytes(order) + train
    for i in range(order, len(data)):
        for k in range(order + 1):
            counts[data[i - k:i]][data[i]] += 1
    bits, data = 0.0, bytes(order) + text
    for i in range(order, len(data)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            here = counts.get(data[i - k:i])
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in out}
            total = sum(left.values()) + len(left)
            if data[i] in left:
                bits += math.log2(total / left[data[i]])
                break
            if left:
                bits += math.log2(total / len(left))
            out |= set(here)
        else:
            bits += math.log2(256 - len(out))
    return bits


def substring(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept)."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k:k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {p for k in range(len(w) - size + 1) if i is not None and first[tuple(w[k:k + size])] < i for p in range(k, k + size)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def simhash(text: str | None, k: int = 3) -> int:
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes: list, linked) -> dict:
    """Node to the smallest node of its component; ``linked(a, b)``."""
    own = {n: n for n in nodes}

    def root(n):
        while own[n] != n:
            n = own[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    return {n: root(n) for n in nodes}


def normalised(line: str) -> str:
    return "".join(c if c.isalnum() else " " for c in line.lower()).split() and " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()) or ""


def edits(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_simhash(line: str, hashes: dict[str, int]) -> int:
    words = line.split(" ")
    return sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in words) > len(words))


def dedup_lines(rows: list[tuple], hashes: dict[str, int]) -> list[str | None]:
    """Texts without repeated lines; ``hashes`` has each word's hash; ids are distinct."""
    first: dict[str, tuple] = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if n := normalised(line):
                first[n] = min(first.get(n, (i, k)), (i, k))

    prints = {n: line_simhash(n, hashes) for n in first}

    def alike(a: str, b: str) -> bool:
        x, y = a.split(" "), b.split(" ")
        return (prints[a] ^ prints[b]).bit_count() <= 3 and edits(x, y) <= math.floor(max(len(x), len(y)) * 0.2 + 1e-9)

    part = components(sorted(first), alike)
    keep: dict[str, tuple] = {}
    for n, at in first.items():
        keep[part[n]] = min(keep.get(part[n], at), at)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if not (n := normalised(x)) or keep[part[n]] == (i, k)]
        out.append(None if t is None else "\n".join(left))
    return out


def common(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def nearest(ids: list[int], rows: np.ndarray, every: int, k: int) -> dict[int, list[int]]:
    out = {}
    for q, v in zip(ids, rows):
        if q % every == 0:
            score = [(-sum(float(x) * float(y) for x, y in zip(v, r)), i) for i, r in zip(ids, rows) if i != q]
            out[q] = [i for _, i in sorted(score)[:k]]
    return out
