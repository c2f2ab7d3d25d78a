"""Documents, entities and settings as Parquet tables with keyed writes.

A write is a new version of a table, committed by switching one small pointer file;
readers see the old version or the new one. Old versions stay until ``vacuum``.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as X

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TOKEN = T.StructType([T.StructField("text", _S), T.StructField("conf", _D), T.StructField("line", _I), T.StructField("char_start", _I), T.StructField("char_end", _I)])
SCHEMAS = {
    "documents": T.StructType([T.StructField(n, t) for n, t in (("id", _L), ("filename", _S), ("path", _S), ("ocr_text", _S), ("ocr_conf", _D), ("ocr_variant", _S), ("language", _S), ("warnings", T.ArrayType(_S)), ("tokens", T.ArrayType(_TOKEN)), ("created_at", T.TimestampType()))]),
    "entities": T.StructType([T.StructField(n, t) for n, t in (("id", _L), ("doc_id", _L), ("type", _S), ("value", _S), ("value_norm", _S), ("text", _S), ("start", _I), ("end", _I), ("confidence", _D), ("source", _S), ("meta", T.MapType(_S, _S)), ("embedding", T.ArrayType(T.FloatType())))]),
    "settings": T.StructType([T.StructField("key", _S), T.StructField("value", _S)]),
}


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of the schema, in its order and types; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, and the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade(documents: DataFrame, entities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents in ``ids`` (column ``doc_id``)."""
    return documents.join(ids, documents["id"] == ids["doc_id"], "left_anti"), entities.join(ids, "doc_id", "left_anti")


def newest(documents: DataFrame, limit: int = 100, id_col: str = "id") -> DataFrame:
    return documents.orderBy(F.desc(id_col)).limit(limit)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, newest first; one counts once its name is whole."""
        if not self._fs.exists(self._path("")):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path("")))
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)\.json", n))), reverse=True)

    def _current(self) -> dict[str, str]:
        for number in self._pointers()[:1]:
            return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/current-{number}.json", wholetext=True).collect()))
        return {}

    def table(self, name: str) -> DataFrame:
        version = self._current().get(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return migrated(self.spark.read.parquet(f"{self.root}/{name}-{version}"), SCHEMAS[name])

    def replace(self, **tables: DataFrame) -> None:
        """All given tables at once: readers see every new version or none. The new
        pointer gets the next number by one rename; older ones go with ``vacuum``, so
        there is no moment without one."""
        number = next(iter(self._pointers()), 0) + 1
        versions = self._current()
        for name, df in tables.items():
            versions[name] = uuid.uuid4().hex
            migrated(df, SCHEMAS[name]).write.parquet(f"{self.root}/{name}-{versions[name]}")
        waiting = f"next-{uuid.uuid4().hex}.json"
        stream = self._fs.create(self._path(waiting), True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.close()
        if not self._fs.rename(self._path(waiting), self._path(f"current-{number}.json")):
            raise RuntimeError(f"another writer has replaced version {number - 1} of {self.root}")

    def vacuum(self) -> None:
        kept = {f"{n}-{v}" for n, v in self._current().items()}
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if status.isDirectory() and name not in kept:
                self._fs.delete(status.getPath(), True)
        for number in self._pointers()[1:]:
            self._fs.delete(self._path(f"current-{number}.json"), False)

    # -- documents

    def add(self, documents: DataFrame, entities: DataFrame) -> None:
        """Documents with a path already stored replace it, entities included; an empty
        path is stored as null, so such documents never replace each other. ``documents``
        need ``ref``, ``entities`` refer to it as ``doc_ref``; ids are never reused."""
        old, parts = self.table("documents"), self.table("entities")
        top = max(int(self.setting("last_doc_id") or 0), old.agg(F.max("id")).first()[0] or 0)
        last = max(int(self.setting("last_entity_id") or 0), parts.agg(F.max("id")).first()[0] or 0)
        new = numbered(documents.withColumn("path", F.nullif("path", F.lit(""))), "ref", top).persist()
        ids = new.select("id", "ref")
        rows = numbered(entities.join(ids.withColumnsRenamed({"id": "doc_id", "ref": "doc_ref"}), "doc_ref"), "doc_id", last)
        rows = rows.withColumn("value_norm", F.when(F.col("value").isNotNull(), X.normalize_key(F.col("value")))).persist()
        gone = old.join(new.select("path").filter("path IS NOT NULL").distinct(), "path").select(F.col("id").alias("doc_id"))
        kept, kept_parts = cascade(old, parts, gone)
        settings = upsert(self.table("settings"), self.spark.createDataFrame([("last_doc_id", str(new.agg(F.max("id")).first()[0] or top)), ("last_entity_id", str(rows.agg(F.max("id")).first()[0] or last))], SCHEMAS["settings"]), ["key"])
        self.replace(documents=kept.unionByName(migrated(new, SCHEMAS["documents"])), entities=kept_parts.unionByName(migrated(rows, SCHEMAS["entities"])), settings=settings)
        new.unpersist(), rows.unpersist()

    def delete(self, *ids: int) -> None:
        gone = self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        documents, entities = cascade(self.table("documents"), self.table("entities"), gone)
        self.replace(documents=documents, entities=entities)

    def get(self, doc_id: int) -> DataFrame:
        """The document and its entities as an array, found ones first, by place."""
        rank = F.struct(F.col("value").isNull().alias("absent"), "start", "id")
        mine = self.table("entities").filter(F.col("doc_id") == doc_id).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.struct("id", "type", "value", "text", "start", "end", "confidence", "source", "meta").alias("e"))), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)).alias("all"))
        found = self.table("documents").filter(F.col("id") == doc_id)
        return found.join(mine, found["id"] == mine["doc_id"], "left").withColumn("entities", F.transform(F.coalesce("all", F.array().cast(mine.schema["all"].dataType)), lambda x: x["e"])).drop("all", "doc_id")

    def entities_of(self, doc_id: int) -> DataFrame:
        return self.table("entities").filter(F.col("doc_id") == doc_id).orderBy(F.col("value").isNull(), "start", "id")

    def list_documents(self, limit: int = 100) -> DataFrame:
        return newest(self.table("documents"), limit)

    # -- settings and figures

    def setting(self, key: str) -> str | None:
        row = self.table("settings").filter(F.col("key") == key).select("value").first()
        return row and row[0]

    def set(self, key: str, value: str) -> None:
        self.replace(settings=upsert(self.table("settings"), self.spark.createDataFrame([(key, value)], SCHEMAS["settings"]), ["key"]))

    def stats(self) -> dict[str, int]:
        row = entity_totals(self.table("entities")).first()
        return {"documents": self.table("documents").count(), **row.asDict()}


def numbered(df: DataFrame, order: str, after: int) -> DataFrame:
    """``id`` from ``after`` + 1 on, by ``order``, without gathering all rows in one
    task: rows are sorted by range, and each partition starts where the one before ends."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()).persist()
    sizes = sorted(placed.groupBy("__part").agg(F.count(F.lit(1)), F.min("__row")).collect())  # a row per partition
    starts, n = [], after
    for part, size, first in sizes:
        starts.append((part, n + 1 - first))
        n += size
    starts = df.sparkSession.createDataFrame(starts, "__part int, __shift long")
    return placed.join(F.broadcast(starts), "__part").withColumn("id", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def entity_totals(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count_if(F.col("value").isNotNull()).alias("found"), F.count_if(F.col("value").isNull()).alias("absent"))


def embedded_total(entities: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: ``embedded``, the entities that have a vector."""
    return entities.agg(F.count_if(F.col(vector).isNotNull()).alias("embedded"))


def entities_by_type(entities: DataFrame) -> DataFrame:
    """Found and absent of each type in one pass, most found first."""
    return entities.groupBy("type").agg(F.count_if(F.col("value").isNotNull()).alias("found"), F.count_if(F.col("value").isNull()).alias("absent")).orderBy(F.desc("found"), "type")
