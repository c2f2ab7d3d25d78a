"""Token counts of huge documents by overlap resynchronisation.

A text above ``chunk`` bytes is encoded as overlapping chunks with
offsets. Two neighbours are spliced at a position of their overlap that is

* a token boundary in both encodings,
* far enough from the chunks' ends that no special string and no look-ahead of
  the pre-tokenizer reaches over them (``Encoder.margin``), and
* a proven pre-token boundary: no alternative of the byte-level pattern can
  match across it, whatever stands before or behind (``_proven``).

Everything left of it in the one encoding and right of it in the other is then
what the whole text gives. Where an overlap has no such position it is doubled,
up to the whole rest of the text, so the count is always exact.

Defined results. A null text counts as empty: 0 bytes, 0 tokens. Special strings
inside texts are handled as the library's default does. Repeated ids give a row
each; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import pieces

#: Bytes: chunk size and first overlap.
CHUNK, OVERLAP = 32_768, 256
#: The pre-tokenizer's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, Encoder] = {}


class Encoder:
    """The byte-level BPE of a ``tokenizers`` JSON file.

    Its vocabulary and special strings are read from the file and run by
    ``tiktoken``'s encoder, which gives the same tokens five times as fast. Only
    files of this one kind are accepted. Runs of white space too long for its pattern
    (some 600,000 characters) are left to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from code point 256
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): k for t, k in spec["model"]["vocab"].items() if t not in special}
        self._path, self._library = path, None
        self.margin = max([3, *map(len, special)]) + 4
        self._encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._length = {k: len(t) for t, k in ranks.items()} | {k: len(t.encode()) for t, k in special.items()}

    def ids(self, text: str) -> list[int]:
        try:
            return self._encoding.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its pattern's stack is full
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self._path)
                self._library.no_truncation()
                self._library.no_padding()
            return self._library.encode(text, add_special_tokens=False).ids

    def text(self, ids: list[int]) -> str:
        return self._encoding.decode(ids, errors="strict")

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte position at which each token starts."""
        return list(accumulate(map(self._length.__getitem__, ids), initial=0))[:-1]


def encoder(path: str) -> Encoder:
    """One encoder to a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _kind(c: int) -> str:
    return _KINDS[c] if c < 128 else "?"


_KINDS = ["s" if chr(c) in " \t\n\r\x0b\x0c" else "l" if chr(c).isalpha() else "d" if chr(c).isdigit() else "?" if c < 32 or c == 127 else "p" for c in range(128)]


def _proven(a: int, b: int) -> bool:
    """Whether no pre-token can hold byte ``a`` followed by byte ``b``.

    Runs are all white space, all letters, all digits or all others, with one
    leading blank at most; only contractions put letters behind a mark.
    """
    x, y = _kind(a), _kind(b)
    return x in "ldp" and y in "lds" and x != y and (x, y) != ("p", "l")


def _cut(data: bytes, at: int) -> int:
    """The start of the character that holds position ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def count_tokens(text: str, enc: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a whole text, encoded in overlapping chunks of so many bytes."""
    data = text.encode()
    n = len(data)
    encode = lambda s, e: (ids := enc.ids(data[s:e].decode()), {s + p: k for k, p in enumerate(enc.offsets(ids))})
    start, stop = 0, _cut(data, chunk)
    left, known = encode(start, stop)
    skip = total = 0  # tokens of ``left`` that the chunk before has; tokens counted
    while stop < n:
        width, spliced = overlap, None
        while spliced is None and stop < n:
            begin = _cut(data, stop - width)
            if begin <= start:  # no proven boundary in all of the chunk: it grows instead
                stop = _cut(data, min(n, 2 * stop - start + 4))
                left, known = encode(start, stop)
                width = overlap
                continue
            end = _cut(data, min(n, begin + chunk + width))
            right, there = encode(begin, end)
            spliced = next(((known[p], k) for p, k in there.items() if begin + enc.margin <= p <= stop - enc.margin and known.get(p, -1) >= skip and _proven(data[p - 1], data[p])), None)
            width *= 2
        if spliced is None:
            break
        total += spliced[0] - skip
        left, known, skip, start, stop = right, there, spliced[1], begin, end
    return total + len(left) - skip


def _batches(path: str, chunk: int, overlap: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in pieces(parts, 1):
            sizes, counts = [], []
            for x in part.column(1):
                text = x.as_py() or ""
                sizes.append(x.as_buffer().size if text else 0)
                counts.append(len(enc.ids(text)) if sizes[-1] <= chunk else count_tokens(text, enc, chunk, overlap))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    counted = rows.mapInArrow(_batches(path, chunk, overlap), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", counted["n_tokens"] > limit)
