"""Connected components: of few edges in one task, of more by alternating large-star
and small-star steps. Both give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import release, written

#: Edges up to which one task takes them (16 bytes each); checked by a count.
FEW = 500_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _solved(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition -> each node's smallest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for part in parts:
        for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = [(top, x) for x in root if (top := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Edges (``a``, ``b``) -> ``node``, ``component`` (the smallest node reachable), written.

    Nodes that are their component's smallest are left out, as are nodes without
    edges. A node with many edges never has them gathered in one row: its minimum
    is an ordinary aggregate, joined back.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b"))
    mark = _mark(now)
    if mark[0] <= few:
        last, now, mark = now, written(now.coalesce(1).mapInArrow(_solved, "a long, b long")), (0,)
        release(last)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(joined.select(F.col("m").alias("a"), "b")).filter("a < b").distinct()
        last, now, before = now, written(small), mark
        release(last)
        if (mark := _mark(now)) == before:
            break
    out = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    out.written_at = now.written_at
    return out
