"""Plain, quadratic or row-by-row versions that the operators are held against."""

import math
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import zstandard

from postbag.llm import license_scan


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def component_map(ids, linked):
    """Smallest id reachable from each id; ``linked`` gives pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(texts, width, percent=80):
    """``{id: (n_shingles, component)}`` over ``{id: text}``, comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in texts.items()}
    ids = sorted(sets)
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small and 100 * small >= percent * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    pairs.append((a, b))
    roots = component_map(ids, pairs)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def pieces(word, n=6):
    whole = word + b" "
    return [whole[:n], *[b" " + whole[k : k + n] for k in range(n, len(whole), n)]]


def word_ratios(labelled, asked, cuts=(2, 4), discount=0.75, unseen=1e-3):
    """``{word: ratio}`` of the two models of ``(text, toxic)`` over beginnings of pieces, from plain dictionaries."""

    def begins(piece):
        return [piece[:c] for c in cuts if c < len(piece)] + [piece]

    counts, kinds, seen = {True: Counter(), False: Counter()}, Counter(), set()
    for text, toxic in labelled:
        for piece in {p for word in text.lower().encode().split() for p in pieces(word)}:
            counts[toxic].update(begins(piece))
            seen.add(piece)
    for piece in seen:
        kinds.update(begins(piece))
    below = defaultdict(set)
    for b in kinds:
        shorter = [c for c in cuts if c < len(b)]
        if shorter:
            below[b[: shorter[-1]]].add(b)

    def share(table, parent, b, rest):
        n = [table[x] for x in below[parent]]
        if not sum(n):
            return rest
        return max(table[b] - discount, 0) / sum(n) + discount * sum(x > 0 for x in n) / sum(n) * rest

    def ratio(piece):
        out, path = 0.0, begins(piece)
        for parent, b in zip(path, path[1:]):
            if parent not in kinds:
                break
            shared = share(kinds, parent, b, unseen)
            out += math.log(share(counts[True], parent, b, shared) / share(counts[False], parent, b, shared))
            if b not in kinds:
                break
        return out

    return {w: sum(map(ratio, pieces(w.lower().encode()))) for w in asked}


def step_ratios(labelled, contexts, discount=0.75, unseen=1e-3):
    """``{(context, first two bytes): ratio}`` from piece to piece; ``contexts`` are numbered from 1."""
    counts = {True: Counter(), False: Counter()}
    for text, toxic in labelled:
        found = [p for word in text.lower().encode().split() for p in pieces(word)]
        before = [0, *[contexts.get(p, 0) for p in found[:-1]]]
        counts[toxic].update({(b, p[:2]) for b, p in zip(before, found)})
    both = set(counts[True]) | set(counts[False])
    firsts = {b for _, b in both}

    def fill(n, rest):
        total = sum(n.values())
        return {b: (max(n.get(b, 0) - discount, 0) + discount * len(n) * rest[b]) / total if total else rest[b] for b in firsts}

    shared = fill(Counter(b for _, b in both), dict.fromkeys(firsts, unseen))
    p = {}
    for c, table in counts.items():
        sums = Counter()
        for (_, b), n in table.items():
            sums[b] += n
        whole = fill(sums, shared)
        for k in [0, *contexts.values()]:
            p[c, k] = fill({b: n for (x, b), n in table.items() if x == k}, whole)
    return {(k, b): math.log(p[True, k][b] / p[False, k][b]) for k in [0, *contexts.values()] for b in firsts}


def licenses(scanner, text: str) -> list[str]:
    """Licences in order of place: every window of words against every template, ranked by fresh compressors."""

    def size(words, dictionary=None):
        data = zstandard.ZstdCompressionDict(" ".join(dictionary).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        c = zstandard.ZstdCompressor(level=9, dict_data=data, write_content_size=False, write_dict_id=False)
        return len(c.compress(" ".join(words).encode()))

    words = license_scan.words_of(text)
    found = []
    for name, template in scanner.wanted.items():
        n = len(template)
        told = [w for w in template if scanner.telling(w)]
        best = []
        for a in range(len(words)):
            row = [0] * (n + 1)
            for b in range(a, min(len(words), a + n + n // 2 + 3)):
                row = list(accumulate(range(1, n + 1), lambda left, k: max(left, row[k], row[k - 1] + (template[k - 1] == words[b])), initial=0))
                own = words[a : b + 1]
                if row[n] < scanner.least_cover * n or [w for w in own if scanner.telling(w)] != told:
                    continue
                if not license_scan.NEGATIONS.intersection(words[max(0, a - 2) : b + 1]):
                    best.append((-row[n], b - a, a, b + 1))
        taken = []
        for cover, _, a, b in sorted(best):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                own = words[a:b]
                alone, left = size(own), size(own, template)
                if (alone - left) / (alone - size([])) >= scanner.least_reduction:
                    found.append((left - alone, a, b, name))
    kept = []
    for _, a, b, name in sorted(found):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, name))
    return [name for _, _, name in sorted(kept)]


def logistic(features, toxic, ridge=1e-2):
    """Weights of a logistic regression on the rows of two arrays, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (toxic - p) - ridge * w)
    return w
