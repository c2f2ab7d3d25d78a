"""Substring dedup with a count-min prefilter.

A window is ``window`` consecutive words. Each is counted under its anchor, the
smallest hash of the ``GRAM``-word runs inside it: equal windows have equal
anchors, and neighbouring windows mostly share theirs, so a document has some
twenty times fewer anchors than windows. Every partition makes a count-min sketch
of its documents' anchors; merged, they never count a window too low. The second
pass groups exactly, by a 96-bit hash, only windows whose estimate says that two
documents may have them: first whole runs of windows with one anchor, of which a
copied passage is made, then the single windows of runs that no smaller id has. No repeated window is lost: its anchor is counted once
for each document that holds it.

The sketch is as wide as the input asks for up to ``MAX_WIDTH`` cells, so the bits
that come to the driver and are broadcast are at most ``ROWS * MAX_WIDTH / 8``
bytes (32 MB). Over more input it fills up and lets more windows pass; the result
stays the same.

Defined results. A null text has no words. Windows are judged on the input. A window
counts as repeated only if a smaller id has it, so rows that repeat an id do not
remove each other's words, and rows without an id keep all their words. Other columns
are not read. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.near_dup import _mixed, word_hashes

WINDOW, GRAM = 50, 8
ROWS, MIN_WIDTH, MAX_WIDTH, BYTES_A_CELL = 2, 1 << 16, 1 << 27, 16
#: Bytes of a window's hash; cells that are merged together.
HASH_BYTES, BLOCK = 12, 1 << 16
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Windows:
    """Hashes of all windows and grams of a document's words."""

    def __init__(self, words: np.ndarray, window: int, gram: int = GRAM):
        self.window, self.gram = window, min(gram, window)
        self.words = words

    def runs(self, n: int, seed: np.uint64) -> np.ndarray:
        """Hash of each run of ``n`` words, put together from runs of powers of two."""
        out, done, power, size = None, 0, self.words, 1
        total = len(self.words) - n + 1
        while n:
            if n & size:
                part = power[done : done + total]
                out = part if out is None else _mixed(out * seed + part)
                done += size
                n -= size
            if n:
                power = _mixed(power[:-size] * seed + power[size:])
                size *= 2
        return out[:total]

    def anchors(self) -> np.ndarray:
        """The smallest gram hash inside each window."""
        low = self.runs(self.gram, _SEEDS[0])
        span, size = self.window - self.gram + 1, 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        return np.minimum(low[: len(low) - (span - size)], low[span - size :])


def _cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return (_mixed(anchors + _SEEDS[row]) & np.uint64(width - 1)).astype(np.int64)


def _documents(part: pa.RecordBatch, at: int, known: dict[bytes, int], window: int) -> Iterator[tuple[int, Windows]]:
    for k, x in enumerate(part.column(at)):
        words = (x.as_py() or "").encode().split()
        if len(words) >= window:
            yield k, Windows(word_hashes(words, known), window)


def _sketched(window: int, width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        with np.errstate(over="ignore"):
            for part in parts:
                found = [np.unique(w.anchors()) for _, w in _documents(part, 0, known, window)]
                if not found:
                    continue
                anchors = np.concatenate(found)
                for row in range(ROWS):
                    cells, counts = np.unique(_cells(anchors, row, width), return_counts=True)
                    blocks, starts = np.unique(cells // BLOCK, return_index=True)
                    offsets, counts = (cells % BLOCK).astype(np.uint16), np.minimum(counts, 255).astype(np.uint8)
                    ends = [*starts[1:], len(cells)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array([offsets[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                        ["row", "block", "offsets", "counts"],
                    )

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's sketches, added up; the bits of cells counted at least twice."""
    total = np.zeros(BLOCK, dtype=np.uint8)
    for offsets, counts in zip(pdf["offsets"], pdf["counts"], strict=True):
        at = np.frombuffer(offsets, dtype=np.uint16)
        total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(counts, dtype=np.uint8), 255).astype(np.uint8)
    twice = total >= 2
    return pd.DataFrame({"row": [pdf["row"].iat[0]], "block": [pdf["block"].iat[0]], "bits": [np.packbits(twice, bitorder="little").tobytes()]}) if twice.any() else pd.DataFrame({"row": [], "block": [], "bits": []})


def repeated_cells(texts: DataFrame, window: int, width: int) -> list[bytes]:
    """For each row of the merged sketch, the bits of cells with an estimate of two or more."""
    partial = texts.mapInArrow(_sketched(window, width), "row int, block int, offsets binary, counts binary")
    found = [bytearray(width // 8) for _ in range(ROWS)]
    for r in partial.groupBy("row", "block").applyInPandas(_merged, "row int, block int, bits binary").toLocalIterator():
        found[r.row][r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = r.bits
    return [bytes(b) for b in found]


def _blocks(window: int, width: int, sent):
    """Runs of windows with one anchor that the sketch says may be repeated: a digest of
    the run, and its windows' hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        bits = [np.frombuffer(b, dtype=np.uint8) for b in sent.value]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        with np.errstate(over="ignore"):
            for part in parts:
                ids, tids = part.column(0).to_pylist(), part.column(1).to_pylist()
                out, size = [], 0
                for k, w in _documents(part, 2, known, window):
                    anchors, at = np.unique(w.anchors(), return_inverse=True)
                    twice = np.ones(len(anchors), dtype=bool)
                    for row in range(ROWS):
                        c = _cells(anchors, row, width)
                        twice &= (bits[row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
                    if not twice.any():
                        continue
                    h1, h2 = w.runs(window, _SEEDS[0]), w.runs(window, _SEEDS[1]).astype(np.uint32)
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
                    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                        if twice[at[a]]:
                            data = h1[a:b].tobytes() + h2[a:b].tobytes()
                            out.append((ids[k], tids[k], a, xxhash.xxh3_128_digest(data), data))
                            size += len(data)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _BLOCK)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], _BLOCK)

    return run


_BLOCK = ["doc_id", "tid", "start", "block", "hashes"]


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single windows of blocks."""
    for part in parts:
        if not part.num_rows:
            continue
        found = [x.as_py() for x in part.column(3)]
        sizes = [len(x) // HASH_BYTES for x in found]
        ids, tids, starts = (np.repeat(part.column(c).to_numpy(), sizes) for c in range(3))
        within = np.concatenate([np.arange(n) for n in sizes])
        h1 = np.concatenate([np.frombuffer(x, dtype=np.int64, count=n) for x, n in zip(found, sizes, strict=True)])
        h2 = np.concatenate([np.frombuffer(x, dtype=np.int32, offset=8 * n) for x, n in zip(found, sizes, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tids), pa.array((starts + within).astype(np.int32)), pa.array(h1), pa.array(h2)], ["doc_id", "tid", "pos", "h1", "h2"])


def _kept(window: int, columns: list[str]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n_words, n_removed, kept = [], [], []
            for x, starts in zip(part.column(1), part.column(2), strict=True):
                words = (x.as_py() or "").encode().split()
                gone = 0
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    at, n = (x.to_numpy() for x in starts.values.flatten())
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + n - 1 + window, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(stays.sum())
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("tid"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MAX_WIDTH, max(MIN_WIDTH, 1 << (size // BYTES_A_CELL).bit_length()))
    named = rows.filter("doc_id IS NOT NULL")
    sent = spark.sparkContext.broadcast(repeated_cells(named.select("text"), window, width))
    blocks = named.mapInArrow(_blocks(window, width, sent), "doc_id long, tid long, start int, block binary, hashes binary")
    held = written(blocks.join(blocks.groupBy("block").agg(F.min("doc_id").alias("first")), "block").withColumn("n", (F.octet_length("hashes") / HASH_BYTES).cast("int")).withColumn("hashes", F.when(F.col("doc_id") == F.col("first"), F.col("hashes"))).drop("block"))
    # a window's smallest id has it in a block that no smaller id has
    windows = held.filter("hashes IS NOT NULL").select("doc_id", "tid", "start", "hashes").mapInArrow(_windows, "doc_id long, tid long, pos int, h1 long, h2 int")
    # one shuffle: most windows are alone, so grouping them first would move nearly all of them twice
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    single = windows.withColumn("first", first).filter("doc_id > first").select("doc_id", "tid", F.struct(F.col("pos").alias("start"), F.lit(1).alias("n")).alias("x"))
    whole = held.filter("doc_id > first").select("doc_id", "tid", F.struct("start", "n").alias("x"))
    gone = whole.unionByName(single).groupBy("doc_id", "tid").agg(F.collect_list("x").alias("starts"))
    joined = rows.join(gone, ["doc_id", "tid"], "left").select("doc_id", "text", "starts")
    out = ["doc_id", "n_words", "n_removed", "kept"]
    return joined.mapInArrow(_kept(window, out), "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)
), hits AS (
  SELECT doc_id, i FROM windows JOIN (SELECT x, min(doc_id) AS first FROM windows GROUP BY x) USING (x) WHERE doc_id > first
), gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS p FROM hits, range(50) r(k) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
