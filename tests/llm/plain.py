"""Plain Python versions of the operators' contracts, for comparison on small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(covered), failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def personal_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m[0])]


def secret_spans(text):
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    rules = (("assign", assign, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24))
    found = [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return sorted(found, key=lambda s: (s[1], [r[0] for r in rules].index(s[0])))


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_components(rows, percent):
    """{id: (set size, smallest id reachable)} by comparing every pair of distinct sets."""
    sets = {i: shingles(t) for i, t in rows}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    parent = {i: i for i in first.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    distinct = list(first.items())
    for k, (a, i) in enumerate(distinct):
        for b, j in distinct[:k]:
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: (len(s), root(first[s]) if s else i) for i, s in sets.items()}
