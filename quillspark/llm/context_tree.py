"""Language-model scores by context-tree weighting.

Bytes are predicted bit by bit (binary decomposition: 255 decisions for each
context). A node of the tree is a context of 0 to ``DEPTH`` preceding bytes; each
has a Krichevsky-Trofimov estimate for each decision, and the weighted
probability of a node is half its own estimate plus half the product of its
children's, for all depths at once. Training adds up counts of byte runs over the
whole corpus; the weights follow from the counts alone, so no order of the
documents matters. Every context that training has is a node, at every size of the
input. So the tree has no bound and is never broadcast: each chunk's distinct contexts
with the byte after them are summed over all chunks, whole subtrees are mixed in a
task, and each chunk gets its own contexts' results back. What is broadcast are the
weights of contexts of one byte and none.

Beside it stands a word base: add-0.1 unigram probabilities. Word counts have no
bound, so they are never broadcast: documents are packed into chunks, each chunk's
distinct words (as 64-bit hashes) are summed over all chunks, and each chunk gets
its own words' counts back.

Defined results. A null text counts as empty: no bytes, one token (the end). A null
id counts as the empty string and is held out. Without training documents all
counts are 0, the model is uniform, and the base is log10(0.1 / 0.1) = 0 a token.
Repeated ids give a row each; other columns are not read. No rows, no result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import relax, thrifted, thrifty, written

#: Bytes of a context; bytes of the contexts whose subtrees are mixed in one task.
DEPTH, TOP = 6, 2
#: Zeros before a text: eight bytes are read together.
PAD = 7
#: Bytes of text in a chunk; bytes looked at together.
CHUNK, STEP = 12 << 20, 1 << 20
#: Keys of a subtree in a row of its results.
PIECE = 1 << 17


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, reached by recurrence."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (low := x < 8).any():
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol counts (n, 256) -> zeros and ones of each of the 255 decisions."""
    a, b = [], []
    for level in range(8):
        split = counts.reshape(len(counts), 1 << level, 2, -1).sum(axis=3)
        a.append(split[:, :, 0])
        b.append(split[:, :, 1])
    return np.concatenate(a, axis=1), np.concatenate(b, axis=1)


def kt_block(counts: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of all bits seen at each decision."""
    a, b = decisions(counts)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - 1.1447298858494002  # log pi


def kt_next(counts: np.ndarray) -> np.ndarray:
    """Probability of a one at each decision."""
    a, b = decisions(counts)
    return (b + 0.5) / (a + b + 1.0)


@dataclass
class Tree:
    """``step[node, byte]``: the next node if not negative, else the leaf ``-1 - step``.
    ``log10[leaf, symbol]``: log10 probability. 1 KB for each inner node and for each
    leaf, so only for small trees; ``logs_of`` gives the same without holding one."""

    step: np.ndarray
    log10: np.ndarray

    def score(self, data: bytes) -> float:
        """log10 probability of a text's bytes, zeros standing before its start."""
        if not data:
            return 0.0
        total = 0.0
        padded = np.frombuffer(bytes(DEPTH) + data, dtype=np.uint8)
        for start in range(0, len(data), STEP):
            n = min(STEP, len(data) - start)
            leaf = np.zeros(n, dtype=np.int32)
            node = np.zeros(n, dtype=np.int32)
            open_ = np.arange(n)
            for k in range(1, DEPTH + 1):
                at = self.step[node, padded[start + DEPTH - k + open_]]
                ends = at < 0
                leaf[open_[ends]] = -1 - at[ends]
                open_, node = open_[~ends], at[~ends]
                if not len(open_):
                    break
            total += float(self.log10[leaf, padded[start + DEPTH : start + DEPTH + n]].sum(dtype=np.float64))
        return total


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """Levels of (contexts, counts) for depths 0 and up -> tree. A context is the
    integer of its bytes, the nearest one lowest; counts are (n, 256)."""
    if not levels or not len(levels[0][0]):
        return Tree(np.full((1, 256), -1, dtype=np.int32), np.full((1, 256), -8 * np.log10(2), dtype=np.float32))
    depth = len(levels) - 1
    order = [np.argsort(c, kind="stable") for c, _ in levels]
    contexts = [c[o] for (c, _), o in zip(levels, order, strict=True)]
    counts = [n[o].astype(np.float64) for (_, n), o in zip(levels, order, strict=True)]
    parent = [None] + [np.searchsorted(contexts[d - 1], contexts[d] & ((1 << (8 * (d - 1))) - 1)) for d in range(1, depth + 1)]
    inner = [np.zeros(len(c), dtype=bool) for c in contexts]
    for d in range(1, depth + 1):
        inner[d - 1][parent[d]] = True
    # upwards: weighted probabilities, and how much a node's own estimate weighs against its children's
    weighted, ratio, rest = [None] * (depth + 1), [None] * (depth + 1), [None] * (depth + 1)
    for d in range(depth, -1, -1):
        own = kt_block(counts[d])
        weighted[d] = own.copy()
        if inner[d].any():
            at = np.flatnonzero(inner[d])
            slot = np.cumsum(inner[d]) - 1
            rest[d] = counts[d][at].copy()
            below = np.zeros((len(at), 255))
            np.subtract.at(rest[d], slot[parent[d + 1]], counts[d + 1])
            np.add.at(below, slot[parent[d + 1]], weighted[d + 1])
            below += kt_block(rest[d])
            weighted[d][at] = np.logaddexp(own[at], below) - np.log(2)
            ratio[d] = np.exp(np.clip(own[at] - below, -700, 700))
    # leaves: nodes without children, and the rest of each node with some
    start, step, rows = {}, [], []
    n_inner = 0
    for d in range(depth + 1):
        start[d] = n_inner
        n_inner += int(inner[d].sum())
    step = np.zeros((max(n_inner, 1), 256), dtype=np.int32)
    n_leaves = 0

    def mixed(p: np.ndarray, d: int, at: np.ndarray) -> np.ndarray:
        """``p`` of nodes below the nodes ``at`` of depth ``d``, mixed up to the root."""
        while True:
            slot = (np.cumsum(inner[d]) - 1)[at]
            r = ratio[d][slot]
            p = (r * kt_next(counts[d][at]) + p) / (1 + r)
            if d == 0:
                return p
            at, d = parent[d][at], d - 1

    def symbols(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), 256))
        codes = np.arange(256)
        for level in range(8):
            one = p[:, (1 << level) - 1 + (codes >> (8 - level))]
            out += np.log10(np.where((codes >> (7 - level)) & 1, one, 1 - one))
        return out.astype(np.float32)

    def add(p_of, d: int, at: np.ndarray) -> np.ndarray:
        nonlocal n_leaves
        ids = n_leaves + np.arange(len(p_of))
        n_leaves += len(p_of)
        for k in range(0, len(p_of), 2048):
            p = kt_next(p_of[k : k + 2048])
            rows.append(symbols(mixed(p, d, at[k : k + 2048]) if d >= 0 else p))
        return ids

    if not inner[0].any():
        add(counts[0], -1, np.zeros(1, dtype=np.int64))
        step[:] = -1
    for d in range(depth + 1):
        at = np.flatnonzero(inner[d])
        if len(at):
            step[start[d] : start[d] + len(at)] = -1 - add(rest[d], d, at)[:, None]
        if d:
            leaf = np.flatnonzero(~inner[d])
            up = start[d - 1] + (np.cumsum(inner[d - 1]) - 1)[parent[d]]
            byte = (contexts[d] >> (8 * (d - 1))) & 255
            value = np.zeros(len(contexts[d]), dtype=np.int32)
            if len(leaf):
                value[leaf] = -1 - add(counts[d][leaf], d - 1, parent[d][leaf])
            value[inner[d]] = start[d] + np.arange(len(at))
            step[up, byte] = value
    return Tree(step, np.concatenate(rows))


def _chunks(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            ids, out, kept, n, rows = part.column(0), part.column(1), [], 0, []

            def close():
                nonlocal number
                index = pa.array([k for k, _ in kept])
                offsets = np.cumsum([0, *(len(d) for _, d in kept)]).tolist()
                rows.append((number, ids.take(index).to_pylist(), out.take(index).to_pylist(), offsets, pack.compress(b"".join(d for _, d in kept))))
                number += 1
                kept.clear()

            for k, x in enumerate(part.column(2)):
                kept.append((k, (x.as_py() or "").encode().lower()))
                n += len(kept[-1][1])
                if n >= size:
                    close()
                    n = 0
            if kept:
                close()
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.list_(ids.type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["chunk", "ids", "held_out", "offsets", "data"])

    return run


def _rows(part: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch as Python's values, one at a time."""
    for k in range(part.num_rows):
        yield part.slice(k, 1).to_pylist()[0]


def _texts(held_out, offsets, data) -> Iterator[tuple[bool, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    for a, b, h in zip(offsets, offsets[1:], held_out, strict=False):
        yield h, data[a:b]


def _vocabulary(texts: list[tuple[bool, bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Words of a chunk in order of appearance, and each text's words by their numbers."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    used = []
    for _, text in texts:
        tokens = text.split()
        used.append(np.fromiter(map(numbers.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
    return list(numbers), used


def _words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for row in _rows(part):
            texts = list(_texts(row["held_out"], row["offsets"], row["data"]))
            words, used = _vocabulary(texts)
            h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)).view(np.int64)
            training = [u for (held, _), u in zip(texts, used, strict=True) if not held]
            n = np.bincount(np.concatenate([np.zeros(0, dtype=np.int32), *training]), minlength=len(words))
            del texts, words, used, training
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row["chunk"])), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h), pa.array(n)], ["chunk", "i", "h", "n"])


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with ``PAD`` zeros before each text, which of them are the texts' own,
    and where each text's zeros start."""
    x = np.frombuffer(b"".join(bytes(PAD) + t for t in texts), dtype=np.uint8)
    starts = np.cumsum([0, *(PAD + len(t) for t in texts)])[:-1]
    own = np.ones(len(x), dtype=bool)
    for at in starts:
        own[at : at + PAD] = False
    return x, own, starts


def _keys_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bytes with the ``DEPTH`` bytes before them, as integers: the nearest of those
    highest, the byte itself lowest."""
    # the eight bytes up to and with one, the last of them highest: one read for each place
    key = np.ndarray(len(x) - 7, dtype="<i8", buffer=x, strides=(1,))[at - 7]
    byte = (key >> 56) & 255
    key &= ((1 << (8 * DEPTH)) - 1) << (8 * (7 - DEPTH))
    key >>= 8 * (6 - DEPTH)
    key |= byte
    return key


def _parts(x: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the texts' own bytes and their keys, by ranges of the two nearest bytes, about
    ``STEP`` of them together: no key is in two of them, and their order is that of keys."""
    slices = [slice(k, min(k + STEP, len(x))) for k in range(PAD, len(x), STEP)]
    nearest = lambda at: x[at.start - 1 : at.stop - 1].astype(np.uint16) << 8 | x[at.start - 2 : at.stop - 2]
    counts = np.zeros(1 << 16, dtype=np.int64)
    for at in slices:
        counts += np.bincount(nearest(at)[own[at]], minlength=len(counts))
    step = np.unique((np.cumsum(counts) - counts) // STEP, return_inverse=True)[1].astype(np.int16)
    part = np.full(len(x), -1, dtype=np.int16)
    for at in slices:
        part[at] = np.where(own[at], step[nearest(at)], -1)
    for k in range(int(step[-1]) + 1):
        at = np.flatnonzero(part == k)
        if len(at):
            yield at, _keys_at(x, at)


def _counted(texts: list[tuple[bool, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk, and how often training documents have them."""
    x, own, _ = _padded([t for _, t in texts])
    training = np.repeat([not held for held, _ in texts], [PAD + len(t) for _, t in texts])
    known, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for at, key in _parts(x, own) if own.any() else ():
        key <<= 1
        key |= training[at]
        key.sort()
        once = key >> 1
        first = np.flatnonzero(np.concatenate([[True], once[1:] != once[:-1]]))
        known.append(once[first])
        counts.append(np.add.reduceat(key & 1, first))
    return np.concatenate(known), np.concatenate(counts)


def _bucket(gram: np.ndarray) -> np.ndarray:
    """One of 512 for each context of ``TOP`` bytes, so that whole subtrees stay together."""
    return ((((gram >> (8 * (DEPTH + 1 - TOP))) * 40503) & 0xFFFF) >> 7).astype(np.int16)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, dtype=np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def _grams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of each chunk by bucket and how often training documents have them."""
    for part in parts:
        for row in _rows(part):
            keys, counts = _counted(list(_texts(row["held_out"], row["offsets"], row["data"])))
            bucket = _bucket(keys)
            order = np.argsort(bucket, kind="stable")
            keys, counts = keys[order], counts[order]
            found, start = np.unique(bucket[order], return_index=True)
            spans = list(zip(start, [*start[1:], len(keys)], strict=True)) if len(keys) else []
            cols = [([row["chunk"]] * len(found), pa.int64()), (found.astype(np.int32), pa.int32()), ([_pack(np.diff(keys[i:j], prepend=0)) for i, j in spans], pa.binary()), ([_pack(counts[i:j]) for i, j in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["chunk", "bucket", "grams", "n"])


#: ``log_gamma`` of the first whole numbers and a half, and of those and one.
_TABLED = 1 << 16
_HALF, _WHOLE = log_gamma(np.arange(_TABLED) + 0.5), log_gamma(np.arange(_TABLED) + 1.0)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of ``a`` zeros and ``b`` ones, whole numbers."""

    def of(n: np.ndarray, add: float, known: np.ndarray) -> np.ndarray:
        out = known[np.minimum(n, _TABLED - 1).astype(np.int64)]
        big = n >= _TABLED
        out[big] = log_gamma(n[big] + add)
        return out

    return of(a, 0.5, _HALF) + of(b, 0.5, _HALF) - of(a + b, 1.0, _WHOLE) - 1.1447298858494002  # log pi


def _summed(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts over all chunks."""
    waiting, size, done = [], 0, 0

    def merge() -> list[tuple[np.ndarray, np.ndarray]]:
        gram, n = (np.concatenate(c) for c in zip(*waiting, strict=True))
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        return [(gram[first], np.add.reduceat(n, first))]

    for pair in pairs:
        waiting.append(pair)
        size += len(pair[0])
        if size > 2 * done + (1 << 20):
            waiting = merge()
            size = done = len(waiting[0][0])
    return merge()[0]


def _mixed(rows: pa.Table) -> pa.Table:
    """Whole subtrees below contexts of ``TOP`` bytes. For each key of a bucket the
    probabilities of its eight bits, mixed from depth ``DEPTH`` up to ``TOP``; for each decision
    of a context of ``TOP`` bytes its counts and weighted probability, under the nearest byte.
    Beside each piece of the keys stands which of them each chunk has, so that their results
    need no second look at the texts."""
    gram, n = _summed((np.cumsum(_unpack(g.as_py())), _unpack(c.as_py())) for g, c in zip(rows.column("grams"), rows.column("n"), strict=True))
    bits = np.empty((len(gram), 8), dtype=np.float32)
    tops = []
    for level in range(8):
        one = ((gram >> (7 - level)) & 1).astype(bool)
        key = gram >> (8 - level)
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        pair, key = np.cumsum(fresh) - 1, key[fresh]
        a, b = np.bincount(pair, np.where(one, 0, n)), np.bincount(pair, np.where(one, n, 0))
        p, weighted, at = (b + 0.5) / (a + b + 1), log_kt(a, b), np.arange(len(key))
        for _ in range(DEPTH - TOP):
            key, up = np.unique((key >> (level + 8) << level) | (key & ((1 << level) - 1)), return_inverse=True)
            a, b, below = np.bincount(up, a), np.bincount(up, b), np.bincount(up, weighted)
            own = log_kt(a, b)
            weighted = np.logaddexp(own, below) - np.log(2)
            at = up[at]
            ratio = np.exp(np.clip(own - below, -700, 700))
            p = ((ratio * (b + 0.5) / (a + b + 1))[at] + p) / (1 + ratio[at])
        bits[:, level] = np.where(one, p[pair], 1 - p[pair])
        nearest = key >> (level + 8 * (TOP - 1))
        tops.append((nearest * 255 + (1 << level) - 1 + (key & ((1 << level) - 1)), a, b, weighted))
    decision, a, b, w = (np.concatenate(c) for c in zip(*tops, strict=True))
    cols = {name: [] for name in ("place", "grams", "bits", "chunks", "asked")}
    edges = range(0, len(gram), PIECE)
    cols["place"] = [(rows.column("bucket")[0].as_py() << 32) + k for k in range(len(edges))]
    cols["grams"] = [_pack(np.diff(gram[e : e + PIECE], prepend=0)) for e in edges]
    cols["bits"] = [bits[e : e + PIECE].tobytes() for e in edges]
    cols["chunks"], cols["asked"] = [[] for _ in edges], [[] for _ in edges]
    for chunk, grams in zip(rows.column("chunk"), rows.column("grams"), strict=True):
        at = np.searchsorted(gram, np.cumsum(_unpack(grams.as_py())))
        ends = np.searchsorted(at, [*edges, len(gram)])
        for k, (e, i, j) in enumerate(zip(edges, ends, ends[1:], strict=False)):
            if i < j:
                cols["chunks"][k].append(chunk.as_py())
                cols["asked"][k].append(_pack(np.diff(at[i:j] - e, prepend=0)))
    types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), *[pa.float64()] * 3)
    pieces = [pa.array(c, t) for c, t in zip(cols.values(), types, strict=False)]
    tops = [pa.array(c, t) for c, t in zip((decision, a, b, w), types[5:], strict=True)]
    return pa.table([pa.chunked_array([p, pa.nulls(len(a), p.type)]) for p in pieces] + [pa.chunked_array([pa.nulls(len(edges), t.type), t]) for t in tops], [*cols, "decision", "a", "b", "w"])


def _above(decision: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How a bit's probability from depth ``TOP`` is mixed with those of one and of no
    byte: ``base[nearest, decision, bit] + slope[nearest, decision] * p``."""
    a, b, below = (np.bincount(decision, c, minlength=256 * 255).reshape(256, 255) for c in (a, b, below))
    own = log_kt(a, b)
    r1 = np.exp(np.clip(own - below, -700, 700))
    p1 = np.stack([a + 0.5, b + 0.5], axis=2) / (a + b + 1)[:, :, None]
    below = (np.logaddexp(own, below) - np.log(2)).sum(axis=0)
    a, b = a.sum(axis=0), b.sum(axis=0)
    r0 = np.exp(np.clip(log_kt(a, b) - below, -700, 700))
    p0 = np.stack([a + 0.5, b + 0.5], axis=1) / (a + b + 1)[:, None]
    slope = 1 / ((1 + r1) * (1 + r0))
    return (r0 / (1 + r0))[:, None] * p0 + (r1 * slope)[:, :, None] * p1, slope


def _logs(sent):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's keys of a piece -> log10 probabilities, as bytes of floats."""
        base, slope = sent.value
        for part in parts:
            for row in _rows(part):
                gram = np.cumsum(_unpack(row["grams"]))
                bits = np.frombuffer(row["bits"], dtype=np.float32).reshape(-1, 8)
                nearest, logs = gram >> (8 * DEPTH), np.zeros(len(gram))
                for level in range(8):
                    decision = (1 << level) - 1 + ((gram & 255) >> (8 - level))
                    logs += np.log10(base[nearest, decision, (gram >> (7 - level)) & 1] + slope[nearest, decision] * bits[:, level])
                logs = logs.astype(np.float32)
                out = [logs[np.cumsum(_unpack(at))].tobytes() for at in row["asked"]]
                yield pa.RecordBatch.from_arrays([pa.array(row["chunks"], pa.int64()), pa.array([row["place"]] * len(out), pa.int64()), pa.array(out, pa.binary())], ["chunk", "place", "s"])

    return run


def logs_of(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``place``, ``s``: of each chunk's distinct keys, in order of places, the log10
    probabilities of the byte after its context under the tree of all training documents."""
    grams = chunks.select("chunk", "held_out", "offsets", "data").mapInArrow(thrifty(_grams), "chunk long, bucket int, grams binary, n binary")
    relax(chunks.sparkSession)
    mixed = written(grams.groupBy("bucket").applyInArrow(lambda rows: thrifted(_mixed(rows)), "place long, grams binary, bits binary, chunks array<long>, asked array<binary>, decision long, a double, b double, w double"))
    top = mixed.filter("decision IS NOT NULL").groupBy("decision").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w")).toArrow()  # 256 * 255 rows at most
    sent = chunks.sparkSession.sparkContext.broadcast(_above(*(top.column(k).to_numpy() for k in range(4))))
    return mixed.filter("place IS NOT NULL").select("place", "grams", "bits", "chunks", "asked").mapInArrow(thrifty(_logs(sent)), "chunk long, place long, s binary")


def _numbered(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and for each byte the number of its own (-1 for padding)."""
    number, known, total = np.full(len(x), -1, dtype=np.int32), [np.zeros(0, dtype=np.int64)], 0
    for at, key in _parts(x, own):
        order = np.argsort(key)
        key = key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        number[at[order]] = total - 1 + np.cumsum(first, dtype=np.int32)
        known.append(key[first])
        total += len(known[-1])
    return np.concatenate(known), number


def _scores(texts: list[bytes], results: list[bytes]) -> list[float]:
    """log10 probability of each text of a chunk, from its keys' results in order of buckets."""
    x, own, starts = _padded(texts)
    if not own.any():
        return [0.0] * len(texts)
    known, number = _numbered(x, own)
    logs = np.empty(len(known), dtype=np.float32)
    logs[np.argsort(_bucket(known), kind="stable")] = np.frombuffer(b"".join(results), dtype=np.float32)
    del known, x, own
    return [float(logs[number[at + PAD : at + PAD + len(t)]].sum(dtype=np.float64)) for at, t in zip(starts, texts, strict=True)]


def _scored(total: int, distinct: int, ends: int, columns: list[str], kind: pa.DataType):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        """The rows of a chunk's texts, from its words' counts and its keys' results."""
        below = float(np.log10(total + 0.1 * (distinct + 1)))
        types = (kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        ids, held, offsets, data = (chunk.column(name)[0].as_py() for name in ("ids", "held_out", "offsets", "data"))
        texts = list(_texts(held, offsets, data))
        of_keys = found.filter(pa.compute.is_valid(found.column("s"))).sort_by("place").column("s").to_pylist()
        scores = _scores([t for _, t in texts], of_keys)  # before the words take memory
        del of_keys, data
        words, used = _vocabulary(texts)
        counts = np.zeros(len(words), dtype=np.int64)
        del words
        of_words = found.filter(pa.compute.is_valid(found.column("c")))
        counts[of_words.column("place").to_numpy()] = of_words.column("c").to_numpy()
        seen, logs = counts > 0, np.log10(counts + 0.1) - below
        end = float(np.log10(ends + 0.1) - below)
        out = []
        for i, (h, text), u, s in zip(ids, texts, used, scores, strict=True):
            out.append((i, h, len(u) + 1, int(np.count_nonzero(seen[u])) + (ends > 0), total, float(logs[u].sum()) + end, s, -s / float(np.log10(2)) / len(text) if text else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte`` (null for no bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    chunks = written(rows.mapInArrow(thrifty(_chunks(chunk)), f"chunk long, ids array<{kind}>, held_out array<boolean>, offsets array<long>, data binary"))
    words = chunks.select("chunk", "held_out", "offsets", "data").mapInArrow(thrifty(_words), "chunk long, i int, h long, n long")
    # a word has one row for each chunk that holds it, so no word is a hot key
    same = Window.partitionBy("h")
    counts = written(words.withColumn("c", F.sum("n").over(same)).withColumn("one", F.row_number().over(same.orderBy("chunk")) == 1).filter("c > 0").select("chunk", "i", "n", "c", "one"))
    n, v = counts.agg(F.sum("n"), F.count_if("one")).first()
    ends = chunks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    total, distinct = (n or 0) + ends, v + (ends > 0)
    out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    # rows of words and of keys side by side, read in Arrow: lists made by the engine fill its heap
    of_words = counts.select("chunk", F.col("i").cast("long").alias("place"), "c", F.lit(None).cast("binary").alias("s"))
    found = of_words.unionByName(logs_of(chunks).withColumn("c", F.lit(None).cast("long")))
    from pyspark.sql.pandas.types import to_arrow_type

    types = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    run = _scored(total, distinct, ends, out, to_arrow_type(docs.schema[id_col].dataType))
    relax(docs.sparkSession)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda chunk, found: thrifted(run(chunk, found)), types)
