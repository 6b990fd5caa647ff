"""Plain forms of the operators, over lists in memory."""

import hashlib
import zlib
from collections import Counter, defaultdict


def runs(covered):
    out, n = [], 0
    for i, c in enumerate(covered):
        if c and (i == 0 or not covered[i - 1]):
            n += 1
    return n


def repeated(docs, length):
    """Which units of each document (a list of bytes or words) lie in a window that occurs elsewhere."""
    seen = Counter()
    names = []
    for d in docs:
        own = [hashlib.blake2b(repr(d[i : i + length]).encode(), digest_size=12).digest() for i in range(len(d) - length + 1)]
        names.append(own)
        seen.update(own)
    out = []
    for d, own in zip(docs, names):
        covered = [False] * len(d)
        end = 0
        for i, name in enumerate(own):
            if seen[name] > 1:
                for k in range(max(i, end), i + length):
                    covered[k] = True
                end = i + length
        out.append(covered)
    return out


def op1(rows, length=400):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), t, c in zip(rows, texts, repeated(texts, length)):
        kept = bytes(x for x, gone in zip(t, c) if not gone)
        out.append((i, len(t), sum(c), runs(c), hashlib.sha256(kept).hexdigest()))
    return out


def op2(rows, length=35):
    texts = [(t or "").encode().split() for _, t in rows]
    out = []
    for (i, _), t, c in zip(rows, texts, repeated(texts, length)):
        kept = b" ".join(x for x, gone in zip(t, c) if not gone)
        out.append((i, len(t), sum(c), hashlib.sha256(kept).hexdigest()))
    return out


def op3(rows):
    import re

    out = []
    for i, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen, dup = set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        tri = Counter(zip(words, words[1:], words[2:]))
        marked = set()
        for k, g in enumerate(zip(words, words[1:], words[2:])):
            if tri[g] > 1:
                marked |= {k, k + 1, k + 2}
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked), failed))
    return out


def sets(texts, n):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    return out


def groups(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def similar(all_sets, percent=80):
    index = defaultdict(list)
    for i, s in enumerate(all_sets):
        both = Counter(j for x in s for j in index[x])
        for j, m in both.items():
            if 100 * m >= percent * (len(s) + len(all_sets[j]) - m):
                yield i, j
        for x in s:
            index[x].append(i)


def op6(rows, n=4, percent=80):
    all_sets = sets([t for _, t in rows], n)
    root = groups(len(rows), similar(all_sets, percent))
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    return [(i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(rows, all_sets, root)]


def encode(rows, path, end):
    import struct

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, end] for _, t in rows], lambda ids: zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def op10(rows, path, end=2):
    rows = sorted(rows)
    ids, crc = encode(rows, path, end)
    out, start = [], 0
    for (i, _), x in zip(rows, ids):
        out.append((i, start, len(x), crc(x)))
        start += len(x)
    return out
