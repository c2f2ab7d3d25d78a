"""Models behind contracts: prompts, replies, encoders and readers of images.

No weights come with this package. A model is a plain function given by the caller
(or registered here by name), run once for each batch on the executors; what it
returns goes through the same checks as ever. The stand-ins are deterministic and
know nothing: no accuracy is claimed for them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import vocabulary as V
from quillspark.operators.reconcile import SHARED
from quillspark.operators.search import Encoder, hashing_encoder

#: Texts -> replies, in order.
Extractor = Callable[[list[str]], list[str | None]]
#: Image bytes -> boxes (x, y, height, text, conf).
Reader = Callable[[list[bytes]], list[list[dict]]]

EXTRACTORS: dict[str, Extractor] = {}
ENCODERS: dict[str, Callable[[], Encoder]] = {"hashing": hashing_encoder}
READERS: dict[str, Reader] = {}

SYSTEM = "You read receipts in Malay and English from damaged scans and answer with one JSON object and nothing else."
ASK = "Fill in this object from the receipt. Copy what is printed, mend damaged digits, give amounts as plain numbers, and put null where the receipt says nothing."


def resolve(registry: dict, name: str, aliases: dict[str, str] | None = None):
    """The registered model of a name or of its alias (case and outer spaces aside). A name
    that is in neither stands for itself: it is passed through as it is."""
    known = (aliases or {}).get(name.strip().lower(), name)
    return registry.get(known, known)


def schema_of_reply(items: bool = True) -> str:
    shape = {V.FIELDS[k]: "num|null" if k in V.MONEY_TYPES else "str|null" for k in SHARED}
    if items:
        shape["items"] = [{"name": "str", "qty": "num|null", "unit_price": "num|null", "amount": "num|null"}]
    return json.dumps(shape)


def messages(text: Column, examples: list[tuple[str, str]] = (), items: bool = True) -> Column:
    """Chat messages for a receipt as a JSON array: system, example pairs, the receipt.
    Without ``items``, they are left out of the asked object and of the examples' answers."""
    ask = f"{ASK}\n{schema_of_reply(items)}\n\nRECEIPT:\n"
    said = [("system", F.lit(SYSTEM))]
    for shown, answer in examples:
        reply = json.loads(answer)
        if not items:
            reply.pop("items", None)
        said += [("user", F.lit(ask + shown)), ("assistant", F.lit(json.dumps(reply)))]
    said.append(("user", F.concat(F.lit(ask), F.coalesce(text, F.lit("")))))
    return F.to_json(F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said)))


def replies(docs: DataFrame, extractor: Extractor, text_col: str = "text", reply_col: str = "reply") -> DataFrame:
    """``docs`` with a model's raw reply; blank texts are not asked about, and a batch
    that fails gives nulls, so that rules alone decide."""
    names = [c for c in docs.columns if c != reply_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(names.index(text_col)).to_pylist()
            asked = [k for k, t in enumerate(texts) if t and t.strip()]
            out: list[str | None] = [None] * len(texts)
            try:
                for k, r in zip(asked, extractor([texts[k] for k in asked]), strict=True):
                    out[k] = r
            except Exception as e:  # noqa: BLE001  a model may fail in any way
                print(f"the model failed on {len(asked)} texts: {e}")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, reply_col])

    return docs.select(*names).mapInArrow(run, T.StructType([*docs.select(*names).schema, T.StructField(reply_col, T.StringType())]))


def read_images(images: DataFrame, reader: Reader, content: str = "content") -> DataFrame:
    """Images with the ``boxes`` that a reader finds."""
    names = [c for c in images.columns if c != content]
    box = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("conf", T.DoubleType())])
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("height", pa.float64()), ("text", pa.string()), ("conf", pa.float64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            boxes = reader(part.column(content).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(boxes, kind)], [*names, "boxes"])

    return images.mapInArrow(run, T.StructType([*(images.schema[n] for n in names), T.StructField("boxes", T.ArrayType(box))]))


def mean_confidence(boxes: Column, least: float = 0.30) -> Column:
    """Mean confidence of the accepted boxes, 0 if there is none."""
    kept = F.filter(boxes, lambda b: b["conf"] >= least)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, b: acc + b["conf"])
    return F.coalesce(F.try_divide(total, F.size(kept)), F.lit(0.0))


def best_variant(variants: DataFrame, keys: list[str], boxes: str = "boxes", order: str = "variant_order", least: float = 0.30) -> DataFrame:
    """Of several readings of an image, the one whose accepted boxes have the largest
    sum of confidences; the first of equals. Adds ``score``."""
    score = F.aggregate(F.filter(boxes, lambda b: b["conf"] >= least), F.lit(0.0), lambda acc, b: acc + b["conf"])
    rest = [c for c in variants.columns if c not in keys]
    best = variants.withColumn("score", score).groupBy(*keys).agg(F.max_by(F.struct(*rest, "score"), F.struct("score", -F.col(order))).alias("b"))
    return best.select(*keys, "b.*")
