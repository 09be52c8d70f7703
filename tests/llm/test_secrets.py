import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from paperlode.llm import entries, secrets

A = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    """{kind: spans} by the contract's own patterns."""
    text = text or ""
    return {
        "assign": [m.span() for m in A.finditer(text) if len(m[2]) >= 8],
        "access": [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16],
        "hex": [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32],
    }


def joined(spans):
    kinds = [*spans]
    rows = sorted((a, kinds.index(k), b) for k, s in spans.items() for a, b in s)
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "secret", "token", "apikey", "API_KEY", "=", ":", " ", '"', "'", "abcd1234", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", "x", "=="]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    spans = secrets.scan([text.encode()], secrets.BASE)[0]
    assert ",".join(f"{secrets.BASE[k].kind}:{a}:{b}" for a, k, b in spans) == joined(base(text))


SAMPLES = {
    "private_key": "-----BEGIN RSA PRIVATE KEY-----",
    "github": "x ghp_" + "a1" * 18,
    "gitlab": "glpat-" + "a-1_" * 6,
    "slack": "xoxb-1234567890-abc",
    "stripe": "sk_live_" + "9aB" * 6,
    "google": "AIza" + "a" * 35,
    "npm": "npm_" + "b" * 36,
    "pypi": "pypi-" + "c" * 60,
    "sendgrid": "SG." + "d" * 20 + "." + "e" * 20,
    "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh1",
    "bearer": "Authorization: Bearer abcdef123456",
    "url_login": "https://user:pa55word@example.org",
    "connection": 'AccountKey="abcdefghijklmnop=="',
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_more_rules(kind):
    rules = secrets.BASE + secrets.MORE
    text = f"Grüße {SAMPLES[kind]} end".encode()
    assert kind in {rules[k].kind for _, k, _ in secrets.scan([text], rules)[0]}


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@pytest.mark.parametrize("rule", secrets.BASE + secrets.MORE, ids=lambda r: r.kind)
def test_matches_satisfy_the_query(rule, spark):
    texts = [s.encode() for s in SAMPLES.values()] + [b"my password = abcd1234", b"AKIA" + b"A" * 16, b"0f" * 20]
    texts += [(r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    matched = [t for t in texts if rule.compiled.search(t)]
    assert matched and all(holds(secrets.query(rule), m[0]) for t in matched for m in [rule.compiled.search(t)])


def test_index_answers_as_a_scan():
    """Queries through postings find the texts that hold them, over several steps of the index."""
    rng, rules = cases.seeded(4), secrets.BASE + secrets.MORE
    texts = [(cases.prose(rng, 20) + rng.choice(["", *SAMPLES.values()]) + cases.prose(rng, 20)).encode() for _ in range(60)]
    own = secrets.index(rules)
    postings = own.postings(texts, step=100)
    for r in rules:
        q = secrets.query(r)
        assert own.answer(q, postings, len(texts)).tolist() == [i for i, t in enumerate(texts) if holds(q, t)]


def test_rules_without_trigrams_scan_fully():
    kinds = {r.kind: secrets.query(r) for r in secrets.BASE}
    assert kinds["hex"] is True and kinds["access"] is not True and kinds["assign"] is not True


def test_odd_rows(spark):
    df = cases.table(spark, [*cases.ODD, (20, None), (21, "ü password: hunter2hunter2 \U0001f600 " + "ab" * 20)])
    out = secrets.find(df).collect()
    assert len(out) == len(cases.ODD) + 2
    (hit,) = [r for r in out if r.doc_id == 21]
    assert hit.spans == "assign:2:26,hex:29:69" and (hit.n_assign, hit.n_access, hit.n_hex) == (1, 0, 1)
    assert all(r.spans == "" for r in out if r.doc_id != 21)
    assert secrets.find(df.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    hits = 0
    for r in entries.op7_secret_scan(spark, "/root/testdata/sf0.01").collect():
        spans = base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, spans.values()))
        assert r.base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest()
        assert set(filter(None, joined(spans).split(","))) <= set(r.spans.split(","))
        hits += any(spans.values())
    assert hits
