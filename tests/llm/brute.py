"""Plain-Python versions of the contracts, which the queries are held against."""

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digest(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def only_digits(m):
    return re.sub("[^0-9]", "", m)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only_digits(m)) <= 15),
}
SECRETS = {
    "assign": (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)", lambda m: len(m) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m) >= 16),
}


def spans(text, kinds):
    out = []
    for rank, (kind, (pattern, keep)) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            if keep(m.groupdict().get("v", m[0])):
                out.append((m.start(), rank, kind, m.end()))
    counts = Counter(k for _, _, k, _ in out)
    return tuple(counts[k] for k in kinds) + (sha(digest(out)), digest(out))


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near(rows, percent=85):
    """{row: (n_shingles, component)} of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    w = PLAIN.findall((text or "").translate(UPPER))
    at = [(i, k) for i in range(len(w)) for p, k in PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))


def mixing(rows):
    """{source: (size, target)} of (id, text, source) rows."""
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(size.values()))
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * size[s]} if free else set()
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            rest -= target[s]
        free -= over
    for s in free:
        target[s] = rest * weight[s] / sum(weight[x] for x in free)
    return {s: (size[s], target[s]) for s in order}


WHITE = " \t\n\x0b\x0c\r"


def lines(rows, chars=40, docs=5):
    key = lambda x: x.strip(WHITE).translate(UPPER)
    holds = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holds[k].append(d)
    stays = {k: max(v) for k, v in holds.items() if len(v) >= docs}
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if stays.get(key(x), d) == d]
        out.append((d, len(own), len(own) - len(left), sha("\n".join(left))))
    return out


def leaks(rows, items, width=10):
    found = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[k : k + width])].add(str(i))
    lengths = sorted({len(k) for k in found})
    out = []
    for d, t in rows:
        w = PLAIN.findall((t or "").translate(UPPER))
        hit, got = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    got |= found[x]
        out.append((d, len(w), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return out
