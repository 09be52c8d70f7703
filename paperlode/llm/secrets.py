"""Secret scans through a trigram inverted index.

For each rule a Boolean query of trigrams is derived from the regex's syntax tree: what every match must contain. For
each slice of documents (a few MB) an index from trigram to documents is built over the whole texts, the queries are
answered by intersecting and uniting postings, and the regex verifies the candidates. A rule whose query is "any
document" (no mandatory trigram, such as a run of hex digits) scans every text fully.

The index holds the trigrams that some query asks for; queries and index are both folded to ASCII lower case, so a
candidate set is never too small. Spans are in code points, end exclusive; matches are leftmost and non-overlapping per
rule; a match that fails its rule's test is dropped and still uses up its characters.

Defined results: a null or empty text has no spans; a very long text is one text of its slice's
index and is searched whole; spans that tie on their start come in the order of the kinds; rows are independent, so repeated rows and ids, and null ids, give
a row each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import mapped, sha256, slices, spark_schema


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    flags: int = 0
    test: Callable[[re.Match], bool] | None = None

    @functools.cached_property
    def compiled(self) -> re.Pattern[bytes]:
        return re.compile(self.regex.encode("ascii"), self.flags)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: m.end() - m.start() >= 16),
    # runs of 32 and more are the runs whose length passes: the greedy match of a run starts at its first digit
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|\bgithub_pat_[A-Za-z0-9_]{60,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abposr]-[A-Za-z0-9-]{10,}|hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9_]+"),
    Rule("stripe", r"\b(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("npm", r"\bnpm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"\bpypi-[A-Za-z0-9_-]{50,}"),
    Rule("sendgrid", r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"authorization:\x20*(?:bearer|basic)\x20+[A-Za-z0-9+/_.=-]{12,}", re.IGNORECASE),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
    Rule("connection", r"\b(?:accountkey|sharedaccesskey|client_secret|aws_secret_access_key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{16,}", re.IGNORECASE),
)

#: A query: True (any document), a trigram, or ("and" | "or", parts).
Query = bool | bytes | tuple
MOST_STRINGS = 64


def both(*parts: Query) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(*parts: Query) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", parts)


def grams(strings: frozenset[bytes]) -> Query:
    """What a text with one of the strings must contain."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


@dataclass(frozen=True)
class Info:
    """Of a part of a regex: all its matches, if few; else what matches begin and end with; what they must contain."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes] = field(default=frozenset((b"",)))
    suffix: frozenset[bytes] = field(default=frozenset((b"",)))
    match: Query = True

    def open(self) -> Info:
        """The same without `exact`."""
        if self.exact is None:
            return self
        return Info(None, short(self.exact, slice(0, 2)), short(self.exact, slice(-2, None)), both(self.match, grams(self.exact)))


def short(strings: frozenset[bytes], part: slice) -> frozenset[bytes]:
    out = frozenset(s[part] for s in strings)
    return out if len(out) <= MOST_STRINGS else frozenset((b"",))


EMPTY, SOME = Info(frozenset((b"",))), Info(None)


def product(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= MOST_STRINGS else None


def concat(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and (exact := product(a.exact, b.exact)) is not None:
        return Info(exact, match=both(a.match, b.match))
    x, y = a.open(), b.open()
    prefix = (a.exact is not None and product(a.exact, y.prefix)) or x.prefix
    suffix = (b.exact is not None and product(x.suffix, b.exact)) or y.suffix
    ends, begins = a.exact or x.suffix, b.exact or y.prefix
    middle = product(short(ends, slice(-2, None)), short(begins, slice(0, 2)))
    return Info(None, prefix, suffix, both(x.match, y.match, grams(middle) if middle else True))


def alternate(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return Info(a.exact | b.exact, match=True)
    x, y = a.open(), b.open()
    return Info(None, short(x.prefix | y.prefix, slice(None)), short(x.suffix | y.suffix, slice(None)), either(x.match, y.match))


def members(items: list) -> set[int] | None:
    out: set[int] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(value)
        elif op is C.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            return None  # a category or a negation
    return out


def analysed(tree: list) -> Info:
    out = EMPTY
    for op, value in tree:
        if op is C.LITERAL:
            part = Info(frozenset((bytes([value]).lower(),)))
        elif op is C.IN and (chars := members(value)) is not None and len(folded := {bytes([c]).lower() for c in chars}) <= 8:
            part = Info(frozenset(folded))
        elif op is C.SUBPATTERN:
            part = analysed(value[-1])
        elif op is C.BRANCH:
            part = functools.reduce(alternate, map(analysed, value[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = value
            once = analysed(body)
            if least == 0:
                part = alternate(once, EMPTY) if most == 1 else SOME
            else:
                part = once
                for _ in range(min(least, 4) - 1):
                    part = concat(part, once)
                if most != least or least > 4:
                    part = part.open()
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = EMPTY
        else:
            part = SOME
        out = concat(out, part)
    return out


@functools.cache
def query(rule: Rule) -> Query:
    """The Boolean trigram query that every text with a match of the rule satisfies."""
    return analysed(list(parser.parse(rule.regex.encode("ascii"), rule.flags))).open().match


def leaves(q: Query) -> Iterator[bytes]:
    if isinstance(q, bytes):
        yield q
    elif isinstance(q, tuple):
        for p in q[1]:
            yield from leaves(p)


class Index:
    """Postings of the trigrams that the rules' queries name, over one slice of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.ids = {t: i + 1 for i, t in enumerate(dict.fromkeys(t for r in rules for t in leaves(query(r))))}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.ids.items():
            self.table[int.from_bytes(t, "big")] = i
        self.fold = np.arange(256, dtype=np.uint32)
        self.fold[65:91] += 32

    def postings(self, texts: list[bytes], step: int = 1 << 20) -> dict[int, np.ndarray]:
        """From a trigram's id to the places of the texts that have it, sorted."""
        ends = np.cumsum([len(t) + 2 for t in texts])
        data = np.frombuffer(b"\0\0".join(texts), np.uint8)
        found: list[np.ndarray] = []
        for start in range(0, max(0, len(data) - 2), step):
            b = self.fold[data[start : start + step + 2]]
            ids = self.table[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(ids)
            docs = np.searchsorted(ends, at + start, side="right")
            found.append(np.unique(ids[at].astype(np.int64) * len(texts) + docs))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        ids, docs = np.divmod(pairs, max(1, len(texts)))
        starts = np.searchsorted(ids, np.arange(len(self.ids) + 2))
        return {i: docs[starts[i] : starts[i + 1]] for i in self.ids.values()}

    def answer(self, q: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if q is True:
            return np.arange(n)
        if isinstance(q, bytes):
            return postings[self.ids[q]]
        parts = (self.answer(p, postings, n) for p in q[1])
        return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if q[0] == "and" else np.union1d(a, b), parts)


@functools.lru_cache(maxsize=4)
def index(rules: tuple[Rule, ...]) -> Index:
    return Index(rules)


def points(text: bytes, offsets: list[int]) -> list[int]:
    """Offsets in bytes as offsets in code points."""
    if text.isascii():
        return offsets
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(starts[i - 1]) if i else 0 for i in offsets]


def scan(texts: list[bytes], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, number of the rule, end), sorted."""
    own, out = index(rules), [[] for _ in texts]
    postings = own.postings(texts)
    for k, rule in enumerate(rules):
        for d in own.answer(query(rule), postings, len(texts)).tolist():
            spans = [(m.start(), m.end()) for m in rule.compiled.finditer(texts[d]) if rule.test is None or rule.test(m)]
            if spans:
                at = points(texts[d], [x for s in spans for x in s])
                out[d].extend((a, k, b) for a, b in zip(at[::2], at[1::2], strict=True))
    return [sorted(s) for s in out]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base kinds, base_sha256, spans): spans as kind:start:end, comma-joined, by start, then kind."""
    rules = BASE + MORE
    fields = [*(pa.field(f"n_{r.kind}", pa.int64()) for r in BASE), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string())]
    names = [id_col, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = scan(texts, rules)
            joined = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
            counts = [pa.array([sum(k == i for _, k, _ in s) for s in found], pa.int64()) for i in range(len(BASE))]
            base = [sha256(joined([x for x in s if x[1] < len(BASE)]).encode()) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())], names=names)

    schema = spark_schema(df, id_col, pa.schema([pa.field("x", pa.int64()), *fields]))
    return mapped(df.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)
