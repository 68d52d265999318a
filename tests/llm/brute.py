"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def cover(size, starts, width):
    hit = bytearray(size)
    for p in starts:
        hit[p : p + width] = b"\1" * width
    return hit


def secrets(rows):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = []
    for i, t in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort()
        names = ("assign", "access", "hex")
        out.append((i, *(sum(k == n for _, k, _ in found) for n in range(3)), sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found))))
    return out


def winnowing(rows, benchmark, width=10):
    windows = defaultdict(set)
    for i, t in benchmark:
        w = ALNUM.findall((t or "").translate(LOWER))
        for p in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[p : p + width])].add(str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, items = bytearray(len(w)), set()
        for m in {len(k) for k in windows}:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in windows:
                    hit[p : p + m] = b"\1" * m
                    items |= windows[k]
        out.append((i, len(w), sum(hit), len(items), sha(",".join(sorted(items))), sum(hit) > 0))
    return out


def phrases(rows, width=50):
    last = float("inf")
    words = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for key, _, w in sorted(words, key=lambda r: r[0]):
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), key)
    out = []
    for key, i, w in words:
        hit = cover(len(w), [p for p in range(len(w) - width + 1) if first[tuple(w[p : p + width])] < key], width)
        out.append((i, len(w), sum(hit), sha(" ".join(x for x, h in zip(w, hit, strict=True) if not h))))
    return out


def suffixes(rows, width=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + width] for _, b in raw for p in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        hit = cover(len(b), [p for p in range(len(b) - width + 1) if count[b[p : p + width]] > 1], width)
        runs = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        out.append((i, len(b), sum(hit), runs, sha(bytes(x for x, h in zip(b, hit, strict=True) if not h))))
    return out


def quality(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        count = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        repeat = sum(cover(len(w), [p for p in range(len(w) - 7) if count[tuple(w[p : p + 8])] > 1], 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 20 or 100 * repeat > 30 * len(w)))
    return out


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def overlaps(sets):
    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverse[g].append(i)
    count = Counter()
    for group in inverse.values():
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                count[group[a], group[b]] += 1
    return count


def ngram_join(rows, n=5, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set())
    links = [(rows[a][0], rows[b][0]) for (a, b), o in overlaps(sets).items() if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o) and None not in (rows[a][0], rows[b][0])]
    comp = union_find({i for i, _ in rows if i is not None}, links)
    return [(i, len(s), comp.get(i)) for (i, _), s in zip(rows, sets, strict=True)]


def near_pairs(sets, percent):
    """All pairs over the threshold: two such sets share one of their rarest n - ceil(t * n) + 1 elements."""
    often = Counter(g for s in sets for g in s)
    found, at = set(), defaultdict(list)
    for i, s in enumerate(sets):
        for g in sorted(s, key=lambda g: (often[g], g))[: len(s) + (-percent * len(s) // 100) + 1]:
            found.update((j, i) for j in at[g])
            at[g].append(i)
    return [(j, i) for j, i in found if 100 * (o := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - o)]


def line_sets(distinct, n=5):
    raw = [x.translate(LOWER).encode() for x in distinct]
    return [frozenset(b[p : p + n] for p in range(len(b) - n + 1)) if len(b) >= n else frozenset([b]) for b in raw]


def lines(rows, percent=80, n=5):
    last = float("inf")
    every = sorted((last if i is None else i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n")) if WORD.search(x))
    distinct = list(dict.fromkeys(x for _, _, x in every))
    comp = union_find(range(len(distinct)), near_pairs(line_sets(distinct, n), percent))
    at = {x: comp[i] for i, x in enumerate(distinct)}
    head = {}
    for i, k, x in every:
        head.setdefault(at[x], (i, k))
    gone = defaultdict(set)
    for i, k, x in every:
        if head[at[x]] != (i, k):
            gone[i].add(k)
    return [(i, len(t.split("\n")) if t is not None else 0, len(gone[last if i is None else i]), sha("\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[last if i is None else i]) if t is not None else "")) for i, t in rows]


def targets(rows, weights=(3, 1, 2)):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, fixed, level = 1.5 * sum(size.values()), {}, 0.0
    while free := [s for s in names if s not in fixed]:
        level = (budget - sum(fixed.values())) / sum(w[s] for s in free)
        above = [s for s in free if level * w[s] > 2 * size[s]]
        if not above:
            break
        fixed |= {s: 2.0 * size[s] for s in above}
    return size, {s: fixed.get(s, level * w[s]) for s in names}
