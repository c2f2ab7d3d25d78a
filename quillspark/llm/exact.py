"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters (the frequent-element algorithm behind
``DataFrame.freqItems``) name at most ``1 / support`` digests that can hold that
share of the rows. One exact count confirms them; the confirmed ones, a table
bounded by ``1 / support`` rows, are broadcast and decided on the map side. All
other digests, none of which is frequent, take one ordinary shuffle.

Defined results. A null text counts as empty, and empty texts are equal to one
another. A null id sorts after every other. Rows that repeat both id and text
tie: one of them (the first written) stays. An empty table gives an empty
result. Other columns of the input, whatever they are called, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import SPACE, few, written

#: Share of the rows from which a digest counts as frequent; bounds the broadcast to 1 / SUPPORT rows.
SUPPORT = 1e-4


def text_digest(text: Column) -> Column:
    """Hex SHA-256 of the text with each run of white space made one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    spark = docs.sparkSession
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    )
    total = rows.count()
    candidates = rows.freqItems(["text_sha256"], support).first()[0] if total else []
    named = spark.createDataFrame([(x,) for x in candidates or []], "text_sha256 string")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    heavy = (
        rows.join(F.broadcast(named), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("first"))
        .filter(F.col("group_size") >= max(2.0, support * total))
    )
    heavy = spark.createDataFrame(heavy.collect(), heavy.schema)  # at most 1 / support rows
    out = ("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    on_map_side = rows.join(F.broadcast(heavy), "text_sha256").select(*out)
    group = Window.partitionBy("text_sha256")
    shuffled = (
        rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
        .withColumn("first", F.min(rank).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .select(*out)
    )
    return on_map_side.unionByName(shuffled)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat
    both id and text count as one row, whatever their other columns hold. Whole rows
    are not shuffled: the few that go are named by id and digest."""
    found = exact_dedup(docs, id_col, text_col, support).filter("NOT kept")
    gone = written(found.select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")).distinct())
    digest = text_digest(docs[text_col])

    def named(these: DataFrame) -> Column:
        # the digest is made of rows with such an id alone
        return docs[id_col].eqNullSafe(these["doc_id"]) & (digest == these["text_sha256"])

    others = gone.filter("NOT again")
    out = docs.join(few(others), named(others), "left_anti")
    again = gone.filter("again")
    if again.isEmpty():
        return out
    twice = out.join(few(again), named(again), "left_semi")
    held = [F.col(f"`{c}`") for c in docs.columns]
    key = F.struct(F.col(f"`{id_col}`"), text_digest(F.col(f"`{text_col}`")))
    one = twice.select(key.alias("k"), F.struct(*held).alias("v")).groupBy("k").agg(F.first("v").alias("v")).select("v.*")
    return out.join(few(again), named(again), "left_anti").unionByName(one)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
