import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import cases
from paperlode.llm import bpe, entries

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(FILE, "rb") as f:
        return bpe.codec(f.read(), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab'sZ19 \n\t.,!-éß中　\U0001f600"), max_size=300))
def test_cut_anywhere_safe(library, codec, text):
    whole = library.encode_ordinary(text)
    for most in (1, 7, 40):
        assert codec.encode(text, most).tolist() == whole
    assert codec.decode(np.array(whole, np.uint32)) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["'", "s", "re", " ", "\u3000", "\n", "中", "é", "1", "٣", "!", "\U0001f600", "l"]), st.sampled_from([1, 1, 2, 300])), max_size=30))
def test_runs_in_windows(library, codec, runs):
    """Long matches, contractions at their ends, white space of several kinds."""
    text = "".join(c * n for c, n in runs)
    whole = library.encode_ordinary(text)
    for most in (20, 130):
        assert codec.encode(text, most).tolist() == whole


def test_characters_that_engines_class_differently(library, codec):
    """Long texts over every code point that another engine classes otherwise, as runs and side by side."""
    other = {bpe.LETTER: r"\p{L}", bpe.NUMBER: r"\p{N}", bpe.SPACE: r"\s"}
    differ = []
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            mine = next((k for k, p in other.items() if regex.match(p, chr(i))), bpe.OTHER)
            if mine != bpe.classes()[i]:
                differ.append(chr(i))
    assert differ
    text = "".join("中" * 50 + c + "ա՘" for c in differ)
    assert codec.encode(text, 1000).tolist() == library.encode_ordinary(text)
    text = "中" * 140_000 + "ա՘" + "中" * 10 + differ[0] * 70_000 + differ[-1] * 70_000
    assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_very_long_matches(codec):
    """The library's engine gives up on such white space; one match is one piece, in windows."""
    text = " " * 2_000_000 + "x" + "中文" * 500_000
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode()
    assert ids.tolist() == [*codec.whole(" " * 1_999_999).tolist(), *codec.library.encode_ordinary(" x" + "中文" * 500_000)]


def test_another_pattern_takes_whole_texts(library):
    with open(FILE, "rb") as f:
        own = bpe.codec(f.read(), r"\w+|\W+")
    text = "ab  cd" * 20_000
    assert own.encode(text, 100).tolist() == own.library.encode_ordinary(text)


def test_decode_keeps_broken_characters(spark, codec):
    ids = codec.encode("é中")
    single = [np.array([i], "<u4").tobytes() for i in ids.tolist()]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(single)], "doc_id long, ids binary")
    out = {r.doc_id: bytes(r.decoded) for r in bpe.decode(df, FILE, public_tokenizers.PATTERN).collect()}
    assert b"".join(out[i] for i in range(len(single))) == "é中".encode()


def test_odd_rows(spark, library):
    out = bpe.encode(cases.odd(spark), FILE, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(out) == len(cases.ODD)
    expected = sorted((str(d), (t or "").encode(), len(library.encode_ordinary(t or ""))) for d, t in cases.ODD)
    assert sorted((str(r.doc_id), bytes(r.decoded), r.n_tokens) for r in out) == expected
    assert bpe.encode(cases.odd(spark).limit(0), FILE, public_tokenizers.PATTERN).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in entries.op1_byte_bpe(spark, folder).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_size_of_rank_file_is_checked(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_RANK_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.sent(cases.odd(spark), FILE)
