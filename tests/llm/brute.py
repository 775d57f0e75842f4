"""Plain versions of the operators, for small inputs."""

import math
import re
import struct
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower_az(text))


def simhash(text, k=3):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum((2 * c > len(shingles)) << b for b, c in enumerate(counts))


def groups(n, linked):
    """The smallest index of each index's component."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def secret_spans(text):
    kinds = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    )
    found = [(m.start(), i, m.end(), k) for i, (k, r, ok) in enumerate(kinds) for m in r.finditer(text or "") if ok(m)]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def encode(library, text, end):
    return library.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def katz(texts, ids, lowest=2):
    """Rows as of the operator, by the definitions of the model."""
    tokens = [[*words(t), "\n"] for t in texts]
    learn = [t for t, i in zip(tokens, ids, strict=True) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c, pairs = Counter(), Counter()
    for t in learn:
        c.update(t)
        pairs.update(zip([" ", *t], t, strict=False))
    total, types = sum(c.values()), len(c)

    def ratios(n, low):
        tail = 6 * n.get(6, 0) / n[1] if n.get(1) else 0
        out = [1.0]
        for r in range(1, 6):
            d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - tail) / (1 - tail) if n.get(r) and n.get(r + 1) and tail < 1 else 0
            out.append(1.0 if r < low else d if 0 < d < 1 else (r - 0.5) / r)
        return lambda x: x * (out[x] if x <= 5 else 1)

    one, two = ratios(Counter(c.values()), 1), ratios(Counter(pairs.values()), lowest)
    kept = sum(map(one, c.values()))
    scale = min(1.0, total / (total + 1) * total / kept) if kept else 1.0
    unknown = 1 - kept * scale / total if total else 1.0
    p = {w: one(x) * scale / total for w, x in c.items()}
    contexts = c | {" ": len(learn)}
    seen, back = {}, {}
    for (v, w), x in pairs.items():
        if x >= lowest:
            seen.setdefault(v, {})[w] = two(x) / contexts[v]
    for v, q in seen.items():
        rest = max(1 - sum(q.values()), 1 / (contexts[v] + 1))
        factor = (1 - rest) / sum(q.values())
        seen[v] = {w: x * factor for w, x in q.items()}
        back[v] = rest / (1 - sum(p[w] for w in q))
        whole = sum(seen[v].values()) + back[v] * (unknown + sum(x for w, x in p.items() if w not in q))
        assert abs(whole - 1) < 1e-9

    def score(t):
        return sum(math.log10(seen[v][w]) if w in seen.get(v, ()) else math.log10(back.get(v, 1.0) * p.get(w, unknown)) for v, w in zip([" ", *t], t, strict=False))

    base = lambda t: sum(math.log10((c[w] + 1) / (total + types + 1)) for w in t)
    return [(len(t), sum(w in c for w in t), total, base(t), score(t)) for t in tokens]


def packed(rows, capacity):
    """Checks places; the number of sequences."""
    by = {}
    for sequence, offset, length in rows:
        by.setdefault(sequence, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)
