"""Tables for the tests, and brute-force versions of the operators, written without the operators' code."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators might use for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, Size long, m long, LINES string, copies int, h long, score double"
EXTRA = ("k", 1, 2, "l", 3, 4, 0.5)
LONG = "Der lange Text steht hier und endet nicht. " * 6000 + "x" * 200_000 + " Ende"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a tie"), (6, "a tie"), (6, "a tie"), (None, "no id at all"), (None, None), (7, "é\U0001f600\x00\x7f ü"), (8, LONG), (9, LONG)]


def odd(spark):
    return table(spark, ODD)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def changed(rng, text, share):
    """Some of its words replaced."""
    return " ".join(f"n{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def shingles(text):
    words = tuple(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    if not words:
        return frozenset()
    return frozenset([words] if len(words) < 5 else (words[i : i + 5] for i in range(len(words) - 4)))


def near_groups(docs, percent=85):
    """{doc_id: component} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for pair in {p for ds in where.values() for p in itertools.combinations(sorted(ds), 2)}:
        a, b = (sets[d] for d in pair)
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            x, y = sorted(map(top, pair))
            parent[y] = x
    return {d: top(d) for d in sets}


def line_removals(docs, least):
    """{doc_id: lines that go}: every stretch of lines of enough words, against all earlier places of equal stretches."""
    lines, stretches = {}, {}
    for d, text in sorted(docs):
        own = [(p, x, len(WORD.findall(x))) for p, x in enumerate((text or "").split("\n"))]
        lines[d] = own = [x for x in own if x[2]]
        for i in range(len(own)):
            for j in range(i, len(own)):
                if sum(x[2] for x in own[i : j + 1]) >= least:
                    stretches.setdefault(tuple(x[1] for x in own[i : j + 1]), []).append((d, own[i][0], own[j][0]))
    gone = {d: set() for d, _ in docs}
    for places in stretches.values():
        d0, _, e0 = min(places)
        for d, s, e in sorted(places)[1:]:
            gone[d] |= {p for p in range(s, e + 1) if not (d == d0 and p <= e0)}
    return gone


def repeated_words(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered |= set(range(i, i + 5))
    return len(covered)


def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def mix_targets(sizes, most=3):
    """{source: target} by sharing the excess again and again, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, capped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = Fraction(most * sizes[s])
            left -= capped[s]


def mix_copies(docs, seed="mix-1"):
    """[(doc_id, copies)] of (doc_id, text, source)."""
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
    targets = mix_targets(sizes)
    out = []
    for d, _, s in docs:
        rate = targets[s] / sizes[s] if sizes[s] else Fraction(1)
        drawn = int(hashlib.md5(f"{seed}:{d}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        out.append((d, int(rate) + (drawn < float(rate - int(rate)))))
    return out


def seeded(n):
    return random.Random(n)
