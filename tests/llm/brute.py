"""Plain Python versions of what the operators compute, for small tables."""

import collections
import hashlib
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = words(w)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """rows of (doc_id, text) -> {(doc_id, text): (n_shingles, component_id)}"""
    sets = [(d, t, shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, _, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][2]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return {(d, t): (len(s), least.get(find(i)) if s else d) for i, (d, t, s) in enumerate(sets)}


def repeated(rows, length=35):
    """[(doc_id, n_words, n_removed, sha256 of what stays)]"""
    seen = collections.Counter(tuple(w[i:i + length]) for w in (words(t) for _, t in rows) for i in range(len(w) - length + 1))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def figures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    w = words(text)
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def certain_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def held_items(text, items):
    """Ids of the items (id, text) that a window of the text resembles."""
    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    mine, found = grams(words((text or "").lower())), set()
    for i, t in items:
        theirs = grams(words((t or "").lower()))
        n, want = len(theirs), collections.Counter(theirs)
        if n and any(
                100 * (both := sum((collections.Counter(mine[a:a + n]) & want).values())) >= 75 * (len(mine[a:a + n]) + n - both)
                for a in range(max(1, len(mine) - n + 1))) and mine:
            found.add(i)
    return found
