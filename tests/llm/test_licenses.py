import re

import pytest

import cases
from paperlode.llm import entries, licenses
from paperlode.llm.licenses import Rule

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    """(n_words, places, labels) word by word."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(i for i, _ in found), sorted({x for _, x in found})


TEXTS = [
    "Released under the MIT License. Under-the (mit) license!",
    "cc by nc cc by nc by cc-by-nc-4",
    "Apache License, Version 2.0",
    "apache license version 20 is none",
    "éunder the mit license; under the mit licenseé",
    "under the\x00mit\x7flicense",
    "APACHE LICENSE VERSION 2 " * 3,
    "GNU General Public License version 3 or any later version",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base(text):
    n, places, labels = base(text)
    row = licenses.scanned(text.encode())
    assert row[:4] == (n, len(places), places[0] if places else None, places[-1] if places else None)
    assert row[4] == ",".join(labels) and set(labels) <= set(row[5].split(",")) | {""}
    assert 0 <= row[6] <= 1


def test_table_has_hundreds_of_rules_that_their_keywords_gate():
    rules = licenses.rules()
    assert len(rules) >= 200 and len({r.order for r in rules}) == len(rules)
    texts = [" ".join(t.lower().split()) for t in TEXTS]
    for r in rules:
        for t in texts:
            if r.regex.search(t):
                assert r.keyword in t


def test_prefilter_loses_nothing(spark):
    """Every regex over every text, without the keywords."""
    for text in [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS:
        joined = b" ".join((text or "").encode().translate(licenses.TO_WORDS).split()).decode("latin-1")
        found = [(m.start(), m.end(), r) for r in licenses.rules() for m in r.regex.finditer(joined)]
        kept = {r.label for *_, r in licenses.resolved(found)}
        labels = licenses.scanned((text or "").encode())[5]
        assert set(filter(None, labels.split(","))) == kept | set(base(text)[2])


def test_containment():
    rng = cases.seeded(3)
    for _ in range(300):
        found = []
        for i in range(rng.randrange(1, 8)):
            a = rng.randrange(10)
            found.append((a, a + rng.randrange(1, 6), Rule(i, rng.choice([1, 2, 3]), f"l{i}", "", re.compile(""))))

        def beaten(x, by):
            inside = by[0] <= x[0] and x[1] <= by[1]
            if by is x or not inside or by[2].priority < x[2].priority:
                return False
            same = by[:2] == x[:2] and by[2].priority == x[2].priority
            return not same or by[2].order < x[2].order

        expected = [x for x in found if not any(beaten(x, y) for y in found)]
        place = lambda x: (*x[:2], x[2].order)
        assert sorted(map(place, licenses.resolved(found))) == sorted(map(place, expected))


def test_odd_rows(spark):
    out = licenses.scan(cases.odd(spark)).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in out) == sorted((str(d), base(t)[0]) for d, t in cases.ODD)
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in out)
    assert licenses.scan(cases.odd(spark).limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hits = 0
    for r in entries.op2_license_scan(spark, "/root/testdata/sf0.01").collect():
        n, places, labels = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert (r.first_word, r.last_word) == ((places[0], places[-1]) if places else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and (r.score > 0) == bool(r.labels)
        hits += bool(places)
    assert hits
