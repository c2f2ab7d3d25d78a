"""The engine's calls: process texts or images, store, search, show, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions import vocabulary as V
from quillspark.operators import intervals, models, search
from quillspark.operators.reconcile import WAYS, compared, reconcile
from quillspark.sources.store import Store, embedded_total, upsert


def process(docs: DataFrame, extractor: models.Extractor | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Extracted documents: ``entities`` (absent types included), ``fields``, ``items``, ``warnings``, ``language``."""
    asked = models.replies(docs, extractor, text_col) if extractor else docs.withColumn("reply", F.lit(None).cast("string"))
    done = asked.withColumn("r", reconcile(F.col(text_col), F.col("reply")))
    value = lambda kind: F.try_element_at(F.filter("r.entities", lambda e: e["type"] == kind), F.lit(1))["value"]
    items = F.transform(F.filter("r.entities", lambda e: e["type"] == "ITEM"), lambda e: F.struct(e["value"].alias("name"), e["qty"].alias("qty"), e["unit_price"].alias("unit_price"), e["amount"].alias("amount")))
    return done.select(
        *docs.columns, F.col("r.entities").alias("entities"), F.struct(*(value(k).alias(n) for k, n in V.FIELDS.items())).alias("fields"), items.alias("items"),
        F.col("r.warnings").alias("warnings"), X.detect_language(F.col(text_col)).alias("language"),
    )


def process_images(images: DataFrame, reader: models.Reader, extractor: models.Extractor | None = None) -> DataFrame:
    """Images (``path``, ``filename``, ``content``) -> extracted documents with their ``text``."""
    read = models.read_images(images, reader).withColumn("text", F.array_join(intervals.group_into_lines(F.col("boxes")), "\n"))
    return process(read, extractor, "path")


def ingest(store: Store, processed: DataFrame, ref: str = "doc_id", text_col: str = "text") -> None:
    """Processed documents into the store; a path stored before is replaced."""
    columns = {c: F.col(c) for c in processed.columns}
    name = columns.get("filename", F.col(ref).cast("string"))
    docs = processed.select(F.col(ref).alias("ref"), name.alias("filename"), columns.get("path", name).alias("path"), F.col(text_col).alias("ocr_text"), "language", "warnings")
    rows = processed.select(F.col(ref).alias("doc_ref"), F.explode("entities").alias("e"))
    meta = F.map_filter(
        F.create_map(*(x for n in ("note", "alternative", "alternative_source", "qty", "unit_price", "amount") for x in (F.lit(n), F.col(f"e.{n}").cast("string")))), lambda k, v: v.isNotNull()
    )
    store.add(docs, rows.select("doc_ref", *(F.col(f"e.{n}").alias(n) for n in ("type", "value", "text", "start", "end", "confidence", "source")), meta.alias("meta")))


def reindex(store: Store, encoder: search.Encoder, name: str, everything: bool = True) -> int:
    """Encodes the stored entities again (without ``everything`` only those that have no
    vector) and records the encoder's name and length. Returns how many have a vector."""
    dim = len(encoder(["a"])[0])
    old = store.table("settings")
    said = store.spark.createDataFrame([("encoder", name), ("encoder_dim", str(dim))], old.schema)
    store.replace(entities=search.embed(store.table("entities"), encoder, everything), settings=upsert(old, said, ["key"]))
    return embedded_total(store.table("entities")).first()[0]


def dataset(store: Store, rows: DataFrame, reader: models.Reader, extractor: models.Extractor | None = None, source: str = "dataset") -> DataFrame:
    """Labelled images (``filename``, ``content``, ``truth``) processed into the store under
    paths of ``source``. Returns each document's ``truth`` beside its ``fields``."""
    images = rows.withColumn("path", F.concat(F.lit(f"{source}/"), "filename"))
    done = process_images(images, reader, extractor)
    ingest(store, done, "path")
    return done.select("path", "filename", "truth", "fields")


def show(store: Store, doc_id: int, html: bool = False) -> str | None:
    """A stored text with its entities marked."""
    one = store.get(doc_id)
    marked = (intervals.highlight_html if html else intervals.apply_spans)(F.col("ocr_text"), F.filter("entities", lambda e: e["value"].isNotNull()))
    row = one.select(marked.alias("marked")).first()
    return row and row.marked


def compare(docs: DataFrame, extractor: models.Extractor, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fields by rules, by the model's reply alone and by both merged (``rules``, ``model``,
    ``hybrid``), one row for each field that any found; the model is asked once a text."""
    return side_by_side(models.replies(docs, extractor, text_col), id_col, text_col)


def side_by_side(asked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``compare`` of documents whose ``reply`` is there."""
    long = asked.select(id_col, F.explode(compared(F.col(text_col), F.col("reply"))).alias("e")).select(id_col, "e.*")
    wide = long.groupBy(id_col, "type").agg(*(F.first(n, ignorenulls=True).alias(n) for n in WAYS))
    return wide.withColumn("differs", ~(F.col("rules").eqNullSafe(F.col("hybrid")) & F.col("rules").eqNullSafe(F.col("model"))))
