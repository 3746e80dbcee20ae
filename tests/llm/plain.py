"""Plain Python versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text, n):
    words = WORDS.findall((text or "").encode().translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def group_rows(rows, n, percent):
    """rows: (id, text). For each row: (set size, index of its group's first row by (id, position))."""
    sets = [shingle_set(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by_token = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            by_token[t].append(i)
    seen = set()
    for members in by_token.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        up[root(b)] = root(a)
    return [len(s) for s in sets], [root(i) for i in range(len(rows))]


def line_words(line):
    return frozenset(w for w in re.split(r"[ \t\x0B\f\r]+", line.lower()) if w)


def dedup_lines(rows, percent=80):
    """rows: (id, text) with ids in order. The texts without near-duplicate lines."""
    seen, out = [], []
    for _, text in rows:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            words = line_words(line)
            if words:
                gone = any(100 * len(words & s) >= percent * len(words | s) for s in seen
                           if 100 * min(len(s), len(words)) >= percent * max(len(s), len(words)))
                seen.append(words)
                if gone:
                    continue
            kept.append(line)
        out.append("\n".join(kept))
    return out
