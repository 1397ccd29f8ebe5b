"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def bpe(rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d, t in rows:
        ids = own.encode_ordinary(t or "")
        yield d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((t or "").encode())


def repeats(rows, length=50):
    rows = [(d, (t or "").encode()) for d, t in rows]
    big = float("inf")
    least = {}
    for d, t in rows:
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            least[w] = min(least.get(w, big), big if d is None else d)
    for d, t in rows:
        gone = bytearray(len(t))
        for a in range(len(t) - length + 1):
            if least[t[a : a + length]] < (big if d is None else d):
                gone[a : a + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        yield d, len(t), sum(gone), runs, sha(bytes(c for c, g in zip(t, gone) if not g))


def quality(rows):
    for d, t in rows:
        t = t or ""
        words = re.findall(SPACE, t)
        windows = [tuple(words[a : a + 8]) for a in range(len(words) - 7)]
        n, hit = Counter(windows), set()
        for a, w in enumerate(windows):
            if n[w] > 1:
                hit.update(range(a, a + 8))
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        yield d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def decontaminate(rows, items, size=13):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[a : a + size])].add(i)
    sizes = sorted({len(w) for w in windows})
    for d, t in rows:
        w, hit, found = pattern.findall(lower(t)), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own is not None:
                    hit.update(range(a, a + n))
                    found |= own
        names = sorted({str(i) for i in found if i is not None})
        yield d, len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit) and 20 * len(hit) >= len(w)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


def private(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def unigram(rows):
    split = [(d, re.findall(SPACE, lower(t)) + [None]) for d, t in rows]
    held = {k: d is not None and crc32(str(d).encode()) % 7 == 2 for k, (d, _) in enumerate(split)}
    count = Counter(w for k, (_, ws) in enumerate(split) if not held[k] for w in ws)
    n, v = sum(count.values()), len(count)
    for k, (d, ws) in enumerate(split):
        yield d, held[k], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)


def jaccard(rows, part=100, whole=90, size=3):
    sets = []
    for _, t in rows:
        w = re.findall(SPACE, lower(t))
        sets.append({tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    pairs = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in pairs.items():
        if part * n >= whole * (len(sets[a]) + len(sets[b]) - n):
            parent[top(a)] = top(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[top(k)] = min(least.get(top(k), d), d)
    for k, (d, _) in enumerate(rows):
        yield d, len(sets[k]), least.get(top(k))
