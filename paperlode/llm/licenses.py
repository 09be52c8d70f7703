"""Licence scan by ordered signature rules.

A text's words (ASCII letters in lower case) are joined by single spaces. One pass of an Aho-Corasick automaton finds
which keywords occur; only the rules whose keyword occurs run their regex. Overlapping detections are resolved by
priority and containment: one that lies within another of at least its priority goes (of equal intervals and
priorities the rule first in the table stays). Words stand in Latin-1 form of their UTF-8 bytes while matching, so that
any byte is one character.

Defined results: a null or empty text has no words and no labels, and score 0; a very long text is scanned whole, in
one task; ties between rules go by priority, then place, then order in the table of rules; rows are independent, so repeated rows
and ids, and null ids, give a row each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperlode.llm.common import per_text
from paperlode.llm.license_rules import TABLE

#: Bytes that are no part of a word become spaces; ASCII capitals become small letters.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The phrases that must be found at every place, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
WEIGHTS = {3: 1.0, 2: 0.8, 1: 0.5}


@dataclass(frozen=True)
class Rule:
    order: int
    priority: int
    label: str
    keyword: str
    regex: re.Pattern[str]


@functools.cache
def rules() -> tuple[Rule, ...]:
    lines = [line.split(None, 3) for line in TABLE.strip().splitlines()]
    return tuple(Rule(i, int(p), label, keyword, re.compile(f"(?<![^ ])(?:{regex})(?![^ ])")) for i, (p, label, keyword, regex) in enumerate(lines))


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """From each keyword to the rules that it gates."""
    by: dict[str, list[Rule]] = {}
    for r in rules():
        by.setdefault(r.keyword, []).append(r)
    out = ahocorasick.Automaton()
    for keyword, gated in by.items():
        out.add_word(keyword, gated)
    out.make_automaton()
    return out


def phrase(words: str) -> re.Pattern[str]:
    # a look-ahead, so that places may overlap
    return re.compile(f"(?<![^ ])(?={words}(?![^ ]))")


BASE = tuple((phrase(p), label) for p, label in PHRASES.items())


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Without the detections that lie within another of at least their priority, by place."""
    furthest = dict.fromkeys(WEIGHTS, -1)
    out = []
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], -x[2].priority, x[2].order)):
        if all(end > furthest[p] for p in WEIGHTS if p >= rule.priority):
            out.append((start, end, rule))
            furthest[rule.priority] = max(furthest[rule.priority], end)
    return out


def scanned(text: bytes | None) -> tuple:
    words = (text or b"").translate(TO_WORDS).split()
    joined = b" ".join(words).decode("latin-1")
    gated = {id(g): g for _, g in automaton().iter(joined)}
    if not gated:
        return len(words), 0, None, None, "", "", 0.0, ""
    found = [(m.start(), m.end(), r) for g in gated.values() for r in g for m in r.regex.finditer(joined)]
    base = [(m.start(), label) for p, label in BASE for m in p.finditer(joined)]
    kept = resolved(found)
    if not base and not kept:
        return len(words), 0, None, None, "", "", 0.0, ""
    spaces = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    word = lambda at: int(np.searchsorted(spaces, at))
    base_labels = {label for _, label in base}
    labels = base_labels | {r.label for *_, r in kept}
    score = max([WEIGHTS[r.priority] for *_, r in kept] + [WEIGHTS[3]] * bool(base))
    places = ",".join(f"{r.label}:{word(a)}:{word(b) + 1}" for a, b, r in kept)
    ends = (word(min(base)[0]), word(max(base)[0])) if base else (None, None)
    return len(words), len(base), *ends, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, places


FIELDS = [
    *(pa.field(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
    *(pa.field(n, pa.string()) for n in ("base_labels", "labels")),
    pa.field("score", pa.float64()),
    pa.field("places", pa.string()),
]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places): places lists the detections
    that stay as label:word:word, the last exclusive; score is the strongest one's weight."""
    return per_text(df, id_col, text_col, scanned, FIELDS)
