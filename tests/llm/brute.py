"""Plain-Python versions of the contracts, for small tables only."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op2(docs, window=50):
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    order = lambda d: float("inf") if d is None else d
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < order(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op3(docs):
    pats = [("assign", re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]
    out = []
    for d, t in docs:
        got = []
        for rank, (kind, p, g, least) in enumerate(pats):
            got += [(m.start(), rank, m.end(), kind) for m in p.finditer(t or "") if len(m.group(g)) >= least]
        n = Counter(x[3] for x in got)
        out.append((d, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(got)))))
    return out


def op5(docs, items, window=13):
    wins = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = NORMAL.findall((t or "").translate(UPPER))
        if w:
            n = min(window, len(w))
            sizes.add(n)
            for k in range(len(w) - n + 1):
                wins[tuple(w[k:k + n])] |= {str(i)} if i is not None else {None}
    out = []
    for d, t in docs:
        w = NORMAL.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = wins.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got - {None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def op6(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        bad = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                    len(cover), bad))
    return out


def op8(docs, k=3, per_cent=85):
    sets = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        sets[d] = {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    both = Counter()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                both[a, b] += 1
    comp = {d: d for d in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= per_cent * (len(sets[a]) + len(sets[b]) - n):
            a, b = top(a), top(b)
            comp[max(a, b)] = min(a, b)
    return [(d, len(s), top(d), top(d) == d) for d, s in sets.items()]


def op9_targets(docs):
    """docs: (id, text, source); target per source by repeated resharing."""
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= 2 * size[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
        left -= sum(2 * size[s] for s in over)
        free -= over
    return {s: (size[s], target[s]) for s in names}


def op10(docs, window=200):
    texts = [(d, (t or "").encode()) for d, t in docs]
    c = Counter(hash(b[i:i + window]) for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        flags = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if c[hash(b[i:i + window])] > 1:
                flags[i:i + window] = b"\x01" * window
        kept = bytes(x for x, f in zip(b, flags) if not f)
        spans = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
        out.append((d, len(b), sum(flags), spans, sha(kept)))
    return out
