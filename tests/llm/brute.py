"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def shingles(tokens, k=5):
    if not tokens:
        return frozenset()
    return frozenset(tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1)))


def similar(a, b):
    shared = len(a & b)
    return bool(a and b) and 100 * shared >= 75 * (len(a) + len(b) - shared)


def groups(sets):
    """Root (smallest position) of each set under links at 0.75."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j in sorted({j for x in s for j in holders[x]}):
            if similar(s, sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return [find(i) for i in range(len(sets))]


def near(docs):
    """docs: list of (doc_id, text), ids distinct and not null. -> {doc_id: (n, component, kept)}."""
    docs = sorted(docs)
    sets = [shingles(words(t)) for _, t in docs]
    return {d: (len(s), docs[r][0], docs[r][0] == d) for (d, _), s, r in zip(docs, sets, groups(sets))}


def contamination(text, items):
    """(n_words, n_hit, sorted item ids) by comparing every window."""
    own, hit, ids = alnum(text), set(), set()
    for item, content in items:
        other = alnum(content)
        k = min(10, len(other))
        for q in range(len(other) - k + 1 if other else 0):
            for p in range(len(own) - k + 1):
                if own[p : p + k] == other[q : q + k]:
                    hit.update(range(p, p + k))
                    ids.add(str(item))
    return len(own), len(hit), sorted(ids)


def clean_lines(docs, size=3):
    """docs in order: texts. -> cleaned texts."""
    seen, out = set(), []
    for text in docs:
        lines, gone = (text or "").split("\n"), set()
        for i in range(len(lines) - size + 1):
            key = tuple(low(x) for x in lines[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def passages(docs, least=40):
    """docs: (doc_id, text) in order. -> {(doc_id, line): (first doc_id, first line)} of lines in repeated runs."""
    lines = [(d, i, words(x)) for d, t in docs for i, x in enumerate((t or "").split("\n")) if words(x)]
    roots = groups([shingles(w) for _, _, w in lines])
    size = Counter(roots)
    out, run = {}, []

    def close():
        if sum(len(lines[k][2]) for k in run) >= least:
            for k in run:
                out[lines[k][0], lines[k][1]] = lines[roots[k]][:2]

    for k, (d, _, _) in enumerate(lines):
        if size[roots[k]] < 2 or (run and lines[run[-1]][0] != d):
            close()
            run = []
        if size[roots[k]] > 1:
            run.append(k)
    close()
    return out


def verbatim(docs, n=50):
    """docs: (doc_id, text) in order. -> ({(doc_id, word)} in repeated windows, those of windows that occur before)."""
    split = [(d, words(t)) for d, t in docs]
    places = defaultdict(list)
    for d, w in split:
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((d, i))
    every, later = set(), set()
    for found in places.values():
        for k, (d, i) in enumerate(found if len(found) > 1 else []):
            every.update((d, j) for j in range(i, i + n))
            if k:
                later.update((d, j) for j in range(i, i + n))
    return every, later


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def base_scores(docs):
    """docs: (doc_id, text). -> ({doc_id: (n_tokens, n_known, base)}, N)."""
    tokens = {d: [*words(t), None] for d, t in docs}
    counts = Counter(x for d, ts in tokens.items() if fold(d, 10) for x in ts)
    n, v = sum(counts.values()), len(counts)
    norm = math.log10(n + 0.1 * (v + 1))
    return {
        d: (len(ts), sum(counts[x] > 0 for x in ts), sum(math.log10(counts[x] + 0.1) - norm for x in ts))
        for d, ts in tokens.items()
    }, n
