"""Readers and writers of images, labels, literals, JSON and HTML."""

from __future__ import annotations

import ast
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of images (fixed values).
IMAGES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def scan_images(spark: SparkSession, folder: str, limit: int = 0) -> DataFrame:
    """Images of a folder by path: ``path``, ``filename``, ``content``. 0: all."""
    found = spark.read.format("binaryFile").load(folder).filter(F.lower("path").rlike(rf"\.({'|'.join(IMAGES)})$"))
    found = found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content").orderBy("path")
    return found.limit(limit) if limit else found


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from JSON ({file: fields}), CSV or TSV: ``filename``, company, date, address, total."""
    names = ("company", "date", "address", "total")
    if path.lower().endswith(".json"):
        kinds = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in names]))
        whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kinds)).alias("filename", "x"))
        return whole.select("filename", *(F.nullif(F.col(f"x.{n}"), F.lit("")).alias(n) for n in names))
    rows = spark.read.csv(path, header=True, sep="\t" if path.lower().endswith(".tsv") else ",", multiLine=True, escape='"')
    alias = [F.nullif(F.col(c), F.lit("")) for c in ("filename", "file", "image") if c in rows.columns]
    value = lambda n: F.nullif(F.col(n), F.lit("")) if n in rows.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(*alias).alias("filename"), *(value(n).alias(n) for n in names))


def with_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with the label of their name, else of their name without its suffix; both may be missing."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    fields = [c for c in labels.columns if c != "filename"]
    side = lambda tag: labels.select(F.col("filename").alias(f"__{tag}"), F.struct(*fields).alias(f"__{tag}_x"))
    both = files.join(side("name"), F.col("filename") == F.col("__name"), "left").join(side("stem"), stem == F.col("__stem"), "left")
    return both.withColumn("__x", F.coalesce("__name_x", "__stem_x")).select(*files.columns, *(F.col(f"__x.{c}").alias(c) for c in fields))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_literal(text: pd.Series) -> pd.Series:
    """A Python dict literal, else JSON, else an empty map."""

    def one(s):
        for read in (ast.literal_eval, json.loads):
            try:
                found = read(s)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            if isinstance(found, dict):
                return {str(k): None if v is None else str(v) for k, v in found.items()}
        return {}

    return text.map(one)


def read_dataset(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """A labelled dataset in Parquet (``image``, ``suffix`` holding a literal)."""
    rows = spark.read.parquet(path)
    rows = rows.limit(limit) if limit else rows
    return rows.withColumn("truth", parse_literal("suffix"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def as_json(documents: DataFrame) -> DataFrame:
    return documents.select(F.to_json(F.struct(*documents.columns)).alias("value"))


def write_html(pages: DataFrame, html: str, path: str) -> None:
    pages.select(F.col(html).alias("value")).write.mode("overwrite").text(path)


def export_labels(labels: DataFrame, path: str) -> None:
    """One JSON object of file name -> fields for each part."""
    fields = [c for c in labels.columns if c != "filename"]
    labels.select(F.to_json(F.create_map("filename", F.struct(*fields))).alias("value")).write.mode("overwrite").text(path)


# -- vectors as bytes, caches by content


@F.pandas_udf(T.BinaryType())
def vector_to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else struct.pack(f"<{len(x)}f", *x))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else list(struct.unpack(f"<{len(x) // 4}f", x)))


def checked_dim(v: Column, dim: int) -> Column:
    return F.when(v.isNull() | (F.size(v) == dim), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def cache_key(*parts: Column) -> Column:
    """Key of a cached reply: a digest of everything that it depends on."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256)


def not_cached(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return inputs.join(cache.select(key), key, "left_anti")
