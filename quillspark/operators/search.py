"""Staged search over stored entities, and vector and word search.

The stages are declared as one plan each; which one answers is decided by asking
whether the one before is empty, so later stages never run when an earlier one hits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import kernels as K
from quillspark.functions import text as X
from quillspark.functions import vocabulary as V
from quillspark.operators import intervals

#: Least spelling similarity; least cosine for encoders without one of their own; candidates kept (fixed values).
SPELLING, MEANING, CANDIDATES = 0.72, 0.60, 10
#: Least cosine by encoder (fixed values).
FLOORS = {"e5-small": 0.82, "e5-base": 0.80, "minilm": 0.45, "mpnet": 0.57, "bge-m3": 0.53}


@dataclass
class Found:
    """``mode``: exact, partial, similar, type_fallback or empty."""

    query: str
    mode: str
    hits: DataFrame
    suggestions: list[str]


def hits(entities: DataFrame, mode: str) -> DataFrame:
    names = ("doc_id", "filename", "entity_id", "type", "value", "text", "start", "end", "confidence", "source")
    return entities.select(*(c for c in names if c in entities.columns), F.lit(mode).alias("match"))


def by_document(found: DataFrame, documents: DataFrame, text_col: str = "ocr_text") -> DataFrame:
    """Hits regrouped: a row for each document with its ``hits`` by entity id, and its
    text with them marked. Only documents with hits are read beyond their id."""
    columns = [c for c in found.columns if c not in ("doc_id", "filename")]
    hit = F.struct("entity_id", *(c for c in columns if c != "entity_id"))
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    text = documents.select(F.col("id").alias("doc_id"), "filename", F.col(text_col).alias("__text"))
    return grouped.join(text, "doc_id").withColumn("marked", intervals.apply_spans(F.col("__text"), F.col("hits"))).drop("__text")


def exact(entities: DataFrame, query: str) -> DataFrame:
    return entities.filter(F.col("value_norm") == K.key(query))


def partial(entities: DataFrame, query: str) -> DataFrame:
    """Values whose key holds the query's; a query without letters and digits is held by all."""
    return entities.filter(F.col("value_norm").contains(K.key(query)))


def distinct_values(entities: DataFrame) -> DataFrame:
    return entities.filter("value IS NOT NULL").select("type", "value").distinct()


def spelled_alike(entities: DataFrame, query: str, least: float = 0.0) -> DataFrame:
    """Distinct values with their ``lexical`` score, each scored once however often it is stored."""
    scored = distinct_values(entities).withColumn("lexical", K.partial_similarity_udf.asNondeterministic()(F.lit(query), F.col("value")))
    return scored.filter(F.col("lexical") >= least)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_top(vectors: DataFrame, query: DataFrame, limit: int, least: float = -1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``limit`` nearest unit vectors to one query vector (one row, column
    ``query``); vectors of another length are left out. A top-k, never a full sort."""
    near = vectors.join(F.broadcast(query.limit(1))).filter(F.size(vec_col) == F.size("query")).withColumn("score", dot(vec_col, "query"))
    return near.orderBy(F.desc("score"), id_col).limit(limit).filter(F.col("score") >= least).drop("query")


def nearest_without(vectors: DataFrame, query: DataFrame, key: str, limit: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", text_col: str = "text") -> DataFrame:
    """What a query finds among texts that do not hold its key."""
    return cosine_top(vectors.filter(~X.normalize_key(F.col(text_col)).contains(key)), query, limit, -1.0, id_col, vec_col)


Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a sentence encoder: signed hashes of character
    trigrams, to unit length. It knows spelling and no meaning."""

    def encode(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            padded = f"  {K.key(text)} "
            for k in range(len(padded) - 2):
                h = zlib.crc32(padded[k : k + 3].encode())
                row[h % dim] += 1.0 if h >> 31 else -1.0
            row /= np.linalg.norm(row) or 1.0
        return out

    return encode


def embed(entities: DataFrame, encoder: Encoder, everything: bool = False) -> DataFrame:
    """Semantic entities without a vector get one (all of them, with ``everything``)."""
    wanted = F.col("type").isin(*V.SEMANTIC_TYPES) & F.col("value").isNotNull()
    old = entities if "embedding" in entities.columns else entities.withColumn("embedding", F.lit(None).cast("array<float>"))
    old = old.withColumn("embedding", F.when(F.lit(everything), None).otherwise(F.col("embedding")))
    todo, done = old.filter(wanted & F.col("embedding").isNull()), old.filter(~(wanted & F.col("embedding").isNull()))
    names = [c for c in old.columns if c != "embedding"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = encoder(part.column("value").to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(vectors), pa.list_(pa.float32()))], [*names, "embedding"])

    schema = T.StructType([*(old.schema[c] for c in names), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return done.select(*names, "embedding").unionByName(todo.select(*names).mapInArrow(run, schema))


def search(entities: DataFrame, query: str | None, kind: str | None = None, limit: int = 50, encoder: Encoder | None = None, floor: float = MEANING) -> Found:
    """The first stage with an answer: exact, partial, similar, type_fallback, empty.

    ``entities``: doc_id, entity_id, type, value, value_norm and more; with an encoder
    also ``embedding``. Rows come by entity id where nothing else orders them.
    """
    q = (query or "").strip()
    nothing = hits(entities.limit(0), "empty")
    if not q:
        return Found(query or "", "empty", nothing, [])
    some = entities.filter(F.col("type") == kind) if kind else entities
    for mode, stage in (("exact", exact), ("partial", partial)):
        found = stage(some, q).orderBy("entity_id").limit(limit)
        if not found.isEmpty():
            return Found(q, mode, hits(found, mode), [])
    scored = spelled_alike(some, q).persist()
    lexical = scored.filter(F.col("lexical") >= SPELLING).withColumn("lexical", F.round("lexical", 3))
    if encoder is None:
        merged = lexical.withColumn("semantic", F.lit(None).cast("double"))
    else:
        vector = entities.sparkSession.createDataFrame([([float(x) for x in encoder([q])[0]],)], "query array<float>")
        near = cosine_top(some.filter("value IS NOT NULL AND embedding IS NOT NULL"), vector, CANDIDATES, floor, "entity_id")
        semantic = near.groupBy("type", "value").agg(F.round(F.max("score"), 3).alias("semantic"))
        merged = lexical.join(semantic, ["type", "value"], "full_outer")
    rank = F.greatest(F.coalesce("lexical", F.lit(0.0)), F.coalesce("semantic", F.lit(0.0)))
    by = F.when((F.coalesce("lexical", F.lit(0.0)) > 0) & (F.coalesce("semantic", F.lit(0.0)) > 0), "both").when(F.coalesce("semantic", F.lit(0.0)) > 0, "semantic").otherwise("lexical")
    best = merged.withColumn("similarity", rank).withColumn("matched_by", by).orderBy(F.desc("similarity"), "type", "value").limit(CANDIDATES)
    top = best.collect()  # CANDIDATES rows
    if top:
        chosen = F.broadcast(entities.sparkSession.createDataFrame(top, best.schema))
        rows = hits(some.join(chosen.select("type", "value"), ["type", "value"], "left_semi"), "similar").join(chosen, ["type", "value"])
        rows = rows.withColumnsRenamed({"lexical": "lexical_score", "semantic": "semantic_score"}).orderBy(F.desc("similarity"), "type", "value", "entity_id").limit(limit)
        return Found(q, "similar", rows, [r.value for r in top])
    place = any(p in K.key(q) or K.key(q) in p for p in V.PLACES)
    if place or kind in V.LOCATION_TYPES:
        kinds = [kind] if kind else V.LOCATION_TYPES
        rows = entities.filter(F.col("type").isin(*kinds) & F.col("value").isNotNull()).orderBy(F.when(F.col("type") == "ADDRESS", 0).otherwise(1), F.desc("confidence"), "entity_id").limit(limit)
        if not rows.isEmpty():
            return Found(q, "type_fallback", hits(rows, "type_fallback"), sorted({r.value for r in rows.select("value").collect()})[:10])
    near = scored.orderBy(F.desc("lexical"), "type", "value").limit(5).collect()
    return Found(q, "empty", nothing, [r.value for r in near])


def word_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inverted index: ``token``, document id."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(X.strip_accents(F.coalesce(F.col(text_col), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return docs.select(id_col, F.explode(words).alias("token"))


def search_documents(docs: DataFrame, query: str, limit: int | None = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents that hold all words of the query; a query without words is
    looked for as a pattern, with ``%`` and ``_`` as wildcards."""
    words = sorted(set("".join(c if c.isalnum() else " " for c in K.strip_accents(query.lower())).split()))
    if words:
        found = word_index(docs, id_col, text_col).filter(F.col("token").isin(*words)).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(words)).select(id_col)
    else:
        found = docs.filter(F.col(text_col).ilike(f"%{query}%")).select(id_col) if query.strip() else docs.limit(0).select(id_col)
    return found.orderBy(id_col).limit(limit) if limit else found
