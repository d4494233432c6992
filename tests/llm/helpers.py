"""Small tables with the cases every operator must take, and plain versions of what operators find."""

from __future__ import annotations

import re

import numpy as np

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, part int, size string, n_words double, hash string"
ASCII_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, rows):
    """``(doc_id, text)`` rows with the usual columns and some whose names operators use inside."""
    full = [(i, t, "en", "web", None if t is None else len(t), 1, "s", 0.5, "h") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def words(n, seed, kinds=400):
    random = np.random.default_rng(seed)
    return [f"w{x}" for x in random.integers(0, kinds, n)]


def hard_rows():
    """Null, empty, blank, short, long, repeated, copied, nearly copied, cased, accented and signs-only texts."""
    base, span = words(300, 1), words(70, 2)
    near = [*base[:150], "changed", *base[151:]]
    rows = [
        (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, " ".join(base)), (5, " ".join(base)), (6, " ".join(near)),
        (7, " ".join(words(60, 3) + span + words(60, 4))), (8, "\n".join(words(40, 5) + span + words(9, 6))),
        (9, " ".join(span)), (10, " ".join(span[:50])), (11, " ".join(span[:49])), (12, "É" * 120), (13, "É" * 119 + "e"),
        (14, "one"), (15, "ONE"), (16, "!!! ??? ..."), (17, " ".join(words(20_000, 7, 5000))), (18, "same " * 400),
        (19, "same " * 300), (20, "a b c d"), (21, "x" * 5000), (22, " ".join(base).upper()), (23, "\x00 nul \x00"),
    ]
    return [*rows, rows[4], rows[0], rows[7]]  # repeated rows


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def spaced(text):
    return ASCII_SPACE.findall(text or "")


def shingles(text, k=5):
    w = spaced((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return {i: (len(sets[i]), best[i]) for i in sets}


def repeated(units, window):
    """Which units of each document are covered by a window that starts in a document of smaller id."""
    first = {}
    for i in sorted(units):
        for p in range(len(units[i]) - window + 1):
            first.setdefault(tuple(units[i][p : p + window]), i)
    out = {}
    for i, u in units.items():
        gone = np.zeros(len(u), bool)
        for p in range(len(u) - window + 1):
            if first[tuple(u[p : p + window])] < i:
                gone[p : p + window] = True
        out[i] = gone
    return out


def runs(gone):
    return int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0


def contamination(rows, items, window=13):
    grams = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = np.zeros(len(w), bool), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (of := grams.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = True
                    found |= of
        out[i] = (len(w), int(hit.sum()), sorted(map(str, found)))
    return out
