"""Small tables for the tests, with awkward rows and columns of clashing names, and plain versions of the operators."""

from collections import Counter, defaultdict
import hashlib
import math
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, key string, score double, ids string, kept string, _row int"
REST = (3, "x", "y", 0.5, "z", "k", 9)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "do", "ki", "lu", "me", "ño", "ste", "the"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def documents():
    long = prose(1, 30_000)
    base, passage = prose(2, 120), prose(3, 60)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "short words here"), (4, "short words here"), (None, prose(4, 40)), (5, long), (6, "a" * 5000),
             (7, "déjà vu 日本 😀 " * 30), (8, "déjà vu 日本 😀 " * 30), (9, base), (10, base + " tail"), (11, prose(5, 30) + " " + passage + " " + prose(6, 30)),
             (12, prose(7, 30) + " " + passage + " " + prose(8, 30)), (13, long[:9000]), (14, "12345 !!! ..."), (15, "x"), (16, "X"),
             (17, "Sich " * 80 + prose(9, 30)), (18, "Sich " * 55), (19, "a\r\nb c\x00d"), (20, "\n".join([prose(10, 12)] * 40))]
    return [(i, t, "en" if k % 3 else None, "s", None if t is None else len(t), *REST) for k, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_groups(rows, size, percent=80):
    """Per place in rows: shingles and the places it links with."""
    sets = [shingles(t, size) for _, t in rows]
    where = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            where[x].append(k)
    edges = []
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j > k)
        edges += [(k, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
    return [len(s) for s in sets], union_find(range(len(rows)), edges)


def repeats(texts, length=200):
    """Per text: bytes, removed bytes, runs, digest of what is left."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def backoff(texts, order=2, weight=0.4):
    """Per text: words, words scored by the total, sum of log scores, counts of the text itself left out."""
    words = [(t or "").encode().lower().split() for t in texts]

    def grams(w):
        padded = ["<s>"] * (order - 1) + w
        found = Counter(tuple(padded[k - n + 1 : k + 1]) for k in range(order - 1, len(padded)) for n in range(1, order + 1))
        for n in range(1, order if w else 1):
            found[("<s>",) * n] += 1
        return found

    own = [grams(w) for w in words]
    every = sum(own, Counter())
    total = sum(map(len, words))
    out = []
    for w, mine in zip(words, own):
        padded, score, plain = ["<s>"] * (order - 1) + w, 0.0, 0
        for k in range(order - 1, len(padded)):
            for n in range(order, 0, -1):
                gram = tuple(padded[k - n + 1 : k + 1])
                count = every[gram] - mine[gram]
                if n == 1:
                    score += math.log(max(count, weight) / total)
                    plain += 1
                elif count > 0:
                    score += math.log(count / max(1, every[gram[:-1]] - mine[gram[:-1]]))
                    break
                else:
                    score += math.log(weight)
        out.append((len(w), plain, score))
    return out
