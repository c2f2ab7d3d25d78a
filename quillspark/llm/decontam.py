"""Benchmark decontamination by SimHash over item-sized windows.

Windows of a document have the length of a benchmark item and begin at every word
from which they can hold enough of its shingles, wherever those stand in the item: a
window of similarity ``THRESHOLD`` has that share of the item's shingles at least, so
those with fewer shared positions are not made.
Each window and item gets a 64-bit SimHash of its shingles, weighted by how often
they occur. The fingerprints are cut into ``BLOCKS`` blocks: two within ``RADIUS`` bits
differ by at most ``FLIPS`` bits in one block at least. So an index of the items' blocks
with up to so many bits flipped, joined on equal blocks (and the item's length), finds
all pairs within the radius, and about one in five of unlike ones. Candidates are decided by the exact
weighted similarity: the sum of the smaller counts over the sum of the larger.

Everything is DataFrame and SQL functions. Words are runs of letters and digits in
lower case; shingles are five words, or the whole item if it has fewer.

Defined results. Null and empty texts, on either side, match nothing. A document
shorter than an item is one window. A null id is an id like any other; rows that
repeat an id are reported once per item. Of equally similar windows the first is
reported. Other columns are not read. Without items or documents the result is empty.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import few, written

WORDS, THRESHOLD, RADIUS = 5, 0.75, 17
BLOCKS = 6
#: Bits that differ in the closest block of two fingerprints within the radius, at most.
FLIPS = RADIUS // BLOCKS
#: Rows up to which a table is broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the fingerprint's blocks, as signed 64-bit integers.
_EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
MASKS = [_signed((1 << b) - (1 << a)) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]


def _flips(block: int) -> list[int]:
    """Every choice of up to ``FLIPS`` bits of a block."""
    bits = range(_EDGES[block], _EDGES[block + 1])
    return [_signed(sum(1 << b for b in some)) for n in range(FLIPS + 1) for some in combinations(bits, n)]


def words_of(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat != "", F.split(flat, " ")).otherwise(F.array().cast("array<string>"))


def shingles_of(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words of the column named, in order."""
    at = ", ".join(f"get({words}, i + {j})" for j in range(k))
    return F.expr(f"if(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({at}, {k})), array())").cast("array<bigint>")


def simhash(shingles: str) -> Column:
    """Bit b is set if more of the shingles (repeats counted) have it than not."""
    votes = f"aggregate({shingles}, 0, (acc, h) -> acc + cast(shiftright(h, b) & 1 AS INT) * 2 - 1)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> if({votes} > 0, f | shiftleft(1L, b), f))")


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard of two arrays, an element's weight being its count."""
    shared = f"aggregate(array_distinct({b}), 0, (acc, s) -> acc + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    return F.expr(f"{shared} / (size({a}) + size({b}) - {shared})")


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _fingerprinted(df: DataFrame) -> DataFrame:
    """A row for each block of each row's fingerprint."""
    masks = F.array(*(F.lit(m).cast("long") for m in MASKS))
    return df.withColumn("fp", simhash("sh")).select("*", F.posexplode(masks).alias("block", "mask")).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item it holds: ``doc_id``, ``item_id``,
    ``similarity``, ``word_start``, ``n_windows``."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = items.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("w")).withColumn("n", F.size("w")).filter("n > 0").withColumn("k", F.least("n", F.lit(WORDS)))
    lengths = sorted(r.k for r in named.select("k").distinct().collect())  # five at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {items.schema[item_col].dataType.simpleString()}, similarity double, word_start int, n_windows long")

    of_length = F.expr("CASE k " + " ".join(f"WHEN {k} THEN s{k}" for k in lengths) + " END")
    for k in lengths:
        named = named.withColumn(f"s{k}", shingles_of("w", k))
    listed = written(named.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", "k", of_length.alias("sh")), 1)
    places = listed.select("item_id", "n", "k", F.explode("sh").alias("h")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def shingled(df: DataFrame) -> DataFrame:
        df = df.withColumn("w", words_of(F.col("text"))).drop("text")
        for k in lengths:
            df = df.withColumn(f"s{k}", shingles_of("w", k))
        return df.withColumn("words", F.size("w")).drop("w")

    every = F.concat(*(F.transform(f"s{k}", lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for k in lengths))
    spread = shingled(texts).select("doc_id", "words", F.explode(every).alias("p")).select("doc_id", "words", "p.pos", "p.h")
    hits = spread.join(_sized(places, places.count()), "h")
    near = hits.groupBy("doc_id", "words", "item_id", "n", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    near = near.withColumn("need", F.expr(f"cast(ceil({THRESHOLD / (1 + THRESHOLD)} * (least(words, n) + n - 2 * k + 2) - 1e-6) AS INT)")).filter("size(at) >= need")
    # every start whose window holds positions i to i + need - 1 for some i
    low, high = "greatest(get(at, i + need - 1) - (n - k), 0)", "least(get(at, i), greatest(words - n, 0))"
    start = F.expr(f"flatten(transform(filter(sequence(0, size(at) - need), i -> {low} <= {high}), i -> sequence({low}, {high})))")
    starts = near.select("doc_id", "n", "k", F.explode(start).alias("start")).distinct()
    starts = written(starts.groupBy("doc_id").agg(F.collect_list(F.struct("n", "k", "start")).alias("windows")))
    held = starts.withColumnRenamed("doc_id", "__id")
    again = shingled(texts.join(_sized(held, held.count()), F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id"))
    part = F.slice(of_length, F.col("start") + 1, F.greatest(F.col("n") - F.col("k") + 1, F.lit(1)))
    windows = again.select("doc_id", "words", *(f"s{k}" for k in lengths), F.explode("windows").alias("v")).select("doc_id", "words", *(f"s{k}" for k in lengths), "v.*").filter("start <= greatest(words - n, 0)")
    windows = _fingerprinted(windows.select("doc_id", "n", "start", part.alias("sh")).filter("size(sh) > 0"))
    values = ", ".join(f"({k}, CAST('{x}' AS BIGINT))" for k in range(BLOCKS) for x in _flips(k))
    flips = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(block, flip)")
    prints = _fingerprinted(listed).withColumnRenamed("fp", "item_fp")
    index = prints.join(F.broadcast(flips), "block").select("item", "n", "block", F.col("bits").bitwiseXOR(F.col("flip")).alias("bits"), "item_fp")
    apart = "(fp ^ item_fp)"
    # found by several blocks, a pair counts for the first
    masks = ", ".join(f"{m}L" if m > -(1 << 63) else "shiftleft(1L, 63)" for m in MASKS)
    first = f"array_position(transform(array({masks}), m -> bit_count({apart} & m) <= {FLIPS}), true) = block + 1"
    near = windows.join(_sized(index, listed.count() * sum(len(_flips(k)) for k in range(BLOCKS))), ["n", "block", "bits"]).filter(f"bit_count({apart}) <= {RADIUS}").filter(first)
    near = near.join(_sized(listed.select("item", "item_id", F.col("sh").alias("item_sh")), listed.count()), "item")
    sure = near.withColumn("similarity", similarity("sh", "item_sh")).filter(F.col("similarity") >= THRESHOLD)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return sure.groupBy("doc_id", "item_id").agg(best, F.count_distinct("start").alias("n_windows")).select("doc_id", "item_id", F.round("best.similarity", 6).alias("similarity"), (-F.col("best.back")).alias("word_start"), "n_windows")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    gone = few(written(contaminated(docs, items, id_col, text_col).select("doc_id").distinct()))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["doc_id"]), "left_anti")
