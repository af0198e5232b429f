"""Plain-Python statements of what the operators compute."""

import bisect
import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(w, size):
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size, percent):
    """[(id, size of set, least id reachable)] for (id, text) rows; rows are their own nodes."""
    sets = [shingles(words(lower(t)), size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[root(i)].append(k)
    pick = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return [(k, len(sets[i]), pick[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)]


def removed(rows, size):
    """{(id, text): mask of removed words}; equal (id, text) rows count once, NULL ids come last."""
    order = sorted({(k is None, k, t) for k, t in rows}, key=lambda x: (x[0], x[1] or 0))
    seen, out = set(), {}
    for _, k, t in order:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            if g in seen:
                gone[i : i + size] = [True] * size
            seen.add(g)
        out[k, t] = gone
    return out


def measures(text):
    w, n = words(text), len(words(text))
    at = collections.defaultdict(list)
    for i in range(n - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def best_fit_bins(lengths, capacity):
    rooms, bins = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        room = capacity if i == len(rooms) else rooms.pop(i)
        bins += room == capacity
        if room > x:
            bisect.insort(rooms, room - x)
    return bins


def contained(docs, items, percent):
    def norm(t):
        return shingles(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", lower(t)), 5)

    sets = [(k, norm(t)) for k, t in items]
    out = []
    for k, t in docs:
        own = norm(t)
        out += [(k, i, len(s & own), len(s)) for i, s in sets if s and 100 * len(s & own) >= percent * len(s)]
    return sorted(out, key=str)


def collocations(rows, least, top):
    """[(lang, rank, phrase, a, l, r, n, score)] for (lang, text) rows."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {
            q[i : i + k] for q, a in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
            if a >= counts[q[i : i + k]]}
        found = []
        for p, a in often.items():
            if p not in inside:
                n = total[lang]
                s, _, x, y = min((1000 * a * n // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), x, y, n))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y, n) in enumerate(sorted(found)[:top])]
    return sorted(out)
