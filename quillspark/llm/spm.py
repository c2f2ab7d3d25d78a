"""SentencePiece encoding and decoding by exact backtracking.

A merge-type (BPE) vocabulary gives every text one encoding, the one that merging
the best-scored adjacent pair again and again ends in. It is also the only token
sequence in which each two neighbours are *compatible*: merging their joined text
anew gives these two tokens back. So a text is encoded left to right:

* an Aho-Corasick automaton names the longest token at each position,
* a candidate is taken if it is compatible with the token before it and the
  position behind it is not known to fail,
* otherwise the next shorter token is tried; if none is left, the position's bit
  in a bitfield is cleared, the token before is given back, and its next shorter
  one is tried.

Every position fails at most once, so time is linear in the text. Characters
that no piece holds take no part in merges: they cut the text and become byte
pieces. No piece holds a word mark behind another character, so merges never
cross the start of a word, and words are encoded once and remembered (the
memory is bounded and refilled).

Defined results. A null text counts as empty: only the begin and end ids. Control
and byte pieces written out in a text are ordinary text. Repeated ids give a row
each; other columns are not read by ``encode_table``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import pieces, thrifty

MARK = "▁"
#: Words that one process remembers: half of them are the newest, and of the half before
#: those what is asked for again becomes new. Of pairs, up to twice as many.
REMEMBERED = 200_000

_loaded: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder of one ``.model`` file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError(f"{path} is not a merge-type model with byte fallback that keeps texts as they are")
        self.dummy_prefix = norm.add_dummy_prefix
        kinds = {1: {}, 6: {}}
        for k, p in enumerate(model.pieces):
            kinds.setdefault(p.type, {})[p.piece] = k
        if 4 in kinds or any(MARK in p.lstrip(MARK) for p in kinds[1]):
            raise ValueError(f"{path} has pieces that reach over the start of a word")
        self.ids = kinds[1]
        self.scores = {p: model.pieces[k].score for p, k in self.ids.items()}
        self.bytes = [kinds[6][f"<0x{b:02X}>"] for b in range(256)]
        self._library = SentencePieceProcessor(model_file=path)
        self.bos, self.eos = self._library.bos_id(), self._library.eos_id()
        # Merging never ends in a piece whose own text it cuts up.
        self.tokens = {p: k for p, k in self.ids.items() if self._merged(p) == [p]}
        self._automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self._automaton.add_word(p[::-1], p)
        self._automaton.make_automaton()
        self._shorter: dict[str, str] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._words: dict[str, bytes] = {}
        self._older_pairs, self._older_words = {}, {}
        self._characters = {p for p in self.tokens if len(p) == 1}

    def _merged(self, text: str) -> list[str]:
        """Merging from characters on, best score first and leftmost of equals."""
        parts: list[str | None] = list(text)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < len(parts) and (both := parts[i] + parts[j]) in self.scores:
                heapq.heappush(queue, (-self.scores[both], i, both))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            if parts[i] is None or (j := nxt[i]) >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], nxt[i] = both, None, nxt[j]
            if nxt[i] < len(parts):
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [p for p in parts if p is not None]

    def _compatible(self, a: str, b: str) -> bool:
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) >= REMEMBERED:
                self._older_pairs, self._pairs = self._pairs, {}
            found = self._older_pairs.get((a, b))
            if found is None:
                found = self._merged(a + b) == [a, b]
            self._pairs[a, b] = found
        return found

    def _next_shorter(self, token: str) -> str:
        """The longest token that is a proper prefix, or an empty string."""
        found = self._shorter.get(token)
        if found is None:
            found = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.tokens), "")
            self._shorter[token] = found
        return found

    def backtrack(self, text: str) -> list[str]:
        """Tokens of a text all of whose characters are pieces."""
        n = len(text)
        longest = [""] * n
        last = -1
        for end, p in self._automaton.iter(text[::-1]):  # reversed: matches that end at a place are those that start at its mirror, the longest first
            if end != last:
                longest[n - 1 - end] = p
                last = end
        fine = bytearray(b"\xff") * (n // 8 + 1)  # a bit for each position: not known to fail
        taken: list[str] = []
        at, token, untried = 0, longest[0] if n else "", True
        paired, shorter = self._pairs.get, self._shorter.get
        while at < n:
            before = taken[-1] if taken else None
            while token:
                fits = before is None or paired((before, token))
                if fits is None:
                    fits = self._compatible(before, token)
                if fits and (untried or fine[(end := at + len(token)) >> 3] >> (end & 7) & 1):
                    break
                if (token := shorter(whole := token)) is None:
                    token = self._next_shorter(whole)
            if token:
                taken.append(token)
                at += len(token)
                token = longest[at] if at < n else ""
            else:
                untried = False
                fine[at >> 3] &= ~(1 << (at & 7))
                if not taken:
                    raise AssertionError("every text of known characters has an encoding")
                token = taken.pop()
                at -= len(token)
                token = self._next_shorter(token)
        return taken

    def _word(self, word: str) -> bytes:
        """Packed ids of one word; a character that is no piece becomes its bytes."""
        if (known := self._older_words.get(word)) is not None:
            return self._remember(word, known)
        if self._characters.issuperset(word):
            return self._remember(word, array("I", map(self.tokens.__getitem__, self.backtrack(word))).tobytes())
        out = array("I")
        start = 0
        for k, c in enumerate(word):
            if c not in self._characters:
                out.extend(self.tokens[t] for t in self.backtrack(word[start:k]))
                out.extend(self.bytes[b] for b in c.encode())
                start = k + 1
        out.extend(self.tokens[t] for t in self.backtrack(word[start:]))
        return self._remember(word, out.tobytes())

    def _remember(self, word: str, packed: bytes) -> bytes:
        if len(self._words) >= REMEMBERED // 2:
            self._older_words, self._words = self._words, {}
        if len(word) <= 64:
            self._words[word] = packed
        return packed

    def packed(self, text: str) -> bytes:
        """Ids of a whole text without begin and end, as little-endian 32-bit integers."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.dummy_prefix:
            text = MARK + text
        known = self._words.get
        return b"".join([known(w) or self._word(w) for w in _WORD.findall(text)])

    def encode(self, text: str) -> list[int]:
        return array("I", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self._library.decode(ids)


#: A run of word marks belongs to the word behind it.
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def codec(path: str) -> Codec:
    """One codec to a process."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _batches(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        first, last = array("I", [use.bos]).tobytes(), array("I", [use.eos]).tobytes()
        for part in pieces(parts, 1):
            sizes, shas, back = [], [], []
            for x in part.column(1):
                data = first + use.packed(x.as_py() or "") + last
                sizes.append(len(data) // 4)
                shas.append(hashlib.sha256(data).hexdigest())
                back.append(hashlib.sha256(use.decode(array("I", data).tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(thrifty(_batches(path)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_table(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of each text (begin and end included) and the text
    decoded from them; columns that have these names already are replaced."""
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    rows = docs.select(*(docs[c] for c in kept))
    at = kept.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path)
        first, last = array("I", [use.bos]).tobytes(), array("I", [use.eos]).tobytes()
        for part in pieces(parts, at):
            ids = [np.frombuffer(first + use.packed(x.as_py() or "") + last, dtype=np.int32) for x in part.column(at)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.zeros(0, dtype=np.int32)]))
            back = pa.array((use.decode(x.tolist()) for x in ids), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, listed, back], [*kept, ids_col, decoded_col])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())])
    return rows.mapInArrow(thrifty(run), schema)
