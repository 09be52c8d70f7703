"""Byte-level BPE encoding and decoding by a local rank file.

Encoding and decoding run in Arrow batches through the tiktoken library. A long text is cut first, at ends of matches of
the splitting pattern, so that the parts' ids joined are the whole text's ids. The ends follow from each character's class
(letter, number, white space, other), and the classes are asked from the library itself, so that no other version of
Unicode comes in. A single match that is very long is encoded in windows: two encodings joined are the whole's encoding if
no merge crosses their joint, which is checked by encoding some tokens on both sides of it together; else the joint moves.
With another pattern than PATTERN the library gets each text whole.

Defined results: a null or empty text has no ids and decodes to no bytes; a very long text has the ids of the whole text,
in memory of a few bytes for each of its characters (a run of white space, on which the library's engine gives up, is the
one match or two that the pattern makes of it); there are no ties: of equal merges the leftmost comes first, as in the
library; rows are independent, so repeated rows and ids, and null ids, give a row each; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlode.llm.common import mapped, slices, spark_schema

#: A text of more characters is cut before it is encoded; a match of more is encoded in windows of so many.
CHUNK_CHARS = 1 << 15
#: Tokens at a window's end that the next window encodes again, and tokens on either side that check a joint.
AGAIN, AROUND = 64, 24
#: Largest rank file that is sent to the executors.
MOST_RANK_BYTES = 64 << 20
#: Fixed value: the splitting pattern whose matches' ends `boundaries` knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what its first alternatives take after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def classes() -> np.ndarray:
    """Each code point's class, as the library's engine sees it: of a pattern for one class it returns the matches only."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out, single = np.zeros(0x110000, np.uint8), {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where PATTERN's matches of the text begin, and its length; which of these are places to cut the text at.

    A match is a run of one class, with a space (U+0020) before it if there is one. Of white space before something else
    the last character stands alone unless that space is taken: no place to cut at, as what comes after made it so. A
    contraction takes its letters from the run after it.
    """
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    runs = starts[kind[starts] != SPACE]
    after = runs[runs > 0]
    space, blank = points[after - 1] == 0x20, kind[after - 1] == SPACE
    begin = np.concatenate([runs[runs == 0], after[~space], after[blank] - 1])
    # an apostrophe that is a match's first character and stands alone before letters
    letters = after[(kind[after] == LETTER) & (points[after - 1] == 0x27)]
    alone = (letters < 2) | ((kind[np.maximum(letters - 2, 0)] != OTHER) & (points[np.maximum(letters - 2, 0)] != 0x20))
    moved, taken = [], []
    for i in letters[alone].tolist():
        if found := next((c for c in CONTRACTIONS if text.startswith(c, i)), None):
            taken.append(i)
            moved.append(i + len(found))
    begin = np.concatenate([np.setdiff1d(begin, taken), moved, starts[kind[starts] == SPACE], [len(text)]])
    begin = np.unique(begin.astype(np.int64))
    return begin, ~np.isin(begin, after[blank & ~space])


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.known = pattern == PATTERN
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[[*ranks.values()]] = [len(x) for x in ranks]
        self.one = tiktoken.Encoding("one match", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, most: int = CHUNK_CHARS) -> np.ndarray:
        """The ids of a text as uint32, special tokens' strings being ordinary text."""
        if len(text) <= most or not self.known:
            return self.library.encode_to_numpy(text, disallowed_special=())
        at, safe = boundaries(text)
        before, i, out = np.maximum.accumulate(np.where(safe, np.arange(len(at)), 0)), 0, []
        while i < len(at) - 1:
            j = int(before[np.searchsorted(at, at[i] + most, "right") - 1])
            if j > i:
                out.append(self.library.encode_to_numpy(text[at[i] : at[j]], disallowed_special=()))
            else:
                j = i + 1
                out.append(self.match(text[at[i] : at[j]], most))
            i = j
        return np.concatenate(out)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text as one match."""
        return self.one.encode_to_numpy(text, disallowed_special=())

    def match(self, text: str, most: int) -> np.ndarray:
        """whole(text), in windows of `most` characters."""
        out, start, width, ids = [], 0, most, self.whole(text[:most])
        while start + width < len(text):
            ends, at = self.ends(text[start : start + width], ids)
            inner = ends[(ends <= len(ids) - AGAIN) & (ends >= AROUND)]
            for n in inner[: -AGAIN - 1 : -1].tolist():
                left = int(at[n])
                new = self.whole(text[start + left : start + left + most])
                if self.joined(text[start : start + width], ids, ends, at, n, text[start + left : start + left + most], new):
                    out.append(ids[:n])
                    start, width, ids = start + left, most, new
                    break
            else:  # no joint in this window
                width *= 2
                ids = self.whole(text[start : start + width])
        return np.concatenate([*out, ids])

    def ends(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens that end with a whole character, and how many characters each number of tokens reaches."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + sum((points > x).astype(np.int64) for x in (0x7F, 0x7FF, 0xFFFF))
        of_text, of_ids = (np.concatenate([[0], np.cumsum(x)]) for x in (size, self.lengths[ids]))
        at = np.searchsorted(of_text, of_ids)
        return np.flatnonzero(of_text[at] == of_ids), at

    def joined(self, text: str, ids: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int, right: str, new: np.ndarray) -> bool:
        """Whether the first n ids of `text` and those of `right` stay as they are when some of both are encoded together."""
        begin = int(ends[np.searchsorted(ends, n - AROUND, "right") - 1])
        ends_, at_ = self.ends(right, new)
        stop = int(ends_[min(np.searchsorted(ends_, AROUND), len(ends_) - 1)])
        both = self.whole(text[at[begin] : at[n]] + right[: at_[stop]])
        return np.array_equal(both, np.concatenate([ids[begin:n], new[:stop]]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes of ids, which needn't be whole characters."""
        return self.library.decode_bytes(ids.tolist())


@functools.lru_cache(maxsize=4)
def codec(file: bytes, pattern: str) -> Codec:
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}, pattern)


def sent(df: DataFrame, rank_file: str):
    """The rank file's bytes, broadcast: executors needn't have the file."""
    size = Path(rank_file).stat().st_size
    if size > MOST_RANK_BYTES:
        raise ValueError(f"{rank_file} has {size} bytes; at most {MOST_RANK_BYTES} are broadcast")
    return df.sparkSession.sparkContext.broadcast(Path(rank_file).read_bytes())


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, n_tokens, ids): ids is the binary of little-endian unsigned 32-bit integers, which is an Arrow buffer of
    uint32 as it stands. With `decoded`, the bytes that those ids decode to as well."""
    file = sent(df, rank_file)
    extra = [pa.field("decoded", pa.binary())] if decoded else []
    schema = pa.schema([pa.field("x", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.binary()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in slices(batches, 1):
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
            if decoded:
                columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *schema.names[1:]])

    return mapped(df.select(F.col(id_col), F.col(text_col).cast("string")), run, spark_schema(df, id_col, schema))


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the raw bytes of each row's ids as encode() returns them; null ids give no bytes."""
    file = sent(df, rank_file)
    schema = pa.schema([pa.field("x", pa.int64()), pa.field("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file.value, pattern)
        for batch in slices(batches, 1):
            out = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return mapped(df.select(F.col(id_col), F.col(ids_col)), run, spark_schema(df, id_col, schema))
