"""Typed entities with offsets from the lines of a receipt.

``entities`` is one Arrow pass over a text column that gives an array of entities a
document; everything after it (choosing, merging, checking) is Columns. Order: amounts
in order of their types' first appearance, then header fields, ids, currency, items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import kernels as K
from quillspark.functions import vocabulary as V

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()
ENTITY = T.StructType([T.StructField(n, t) for n, t in (("type", _S), ("value", _S), ("text", _S), ("start", _I), ("end", _I), ("confidence", _D), ("source", _S), ("label", _S), ("amount", _D), ("qty", _D), ("unit_price", _D))])


@dataclass
class Entity:
    type: str
    value: str
    text: str
    start: int
    end: int
    confidence: float
    source: str = "rule"
    label: str | None = None
    amount: float | None = None
    qty: float | None = None
    unit_price: float | None = None


def _longest_first(labels: list[str]) -> list[str]:
    return sorted(labels, key=len, reverse=True)


_KIND = {label: kind for kind, labels in V.MONEY_LABELS.items() for label in labels}
_MONEY = _longest_first(list(_KIND))
_POSTCODE = re.compile(r"\b\d{5}\b")
_COUNTED = re.compile(r"\b(?:barang|items?|qty|kuantiti|unit|pcs|keping|helai)\b", re.IGNORECASE)
_CORPORATE_START = re.compile(r"\s*[(\[]?\s*(?:co|sdn|bhd|berhad|s/b|m)\b", re.IGNORECASE)
_NUMBER_AFTER_NAME = re.compile(r"\s*[(\[{]\s*\d{4,}\s*[-\s]?\s*[A-Za-z]?\s*[)\]}]?\s*$")
_NUMBER_BEFORE_STREET = re.compile(r"^\s*(?:co\.?\s*reg\.?\s*(?:no\.?)?\s*|reg\.?\s*no\.?\s*)?[(\[]?\d{5,}\s*-\s*[A-Za-z][)\]]?\s*[,.]?\s*", re.IGNORECASE)
_ANY_PHONE = re.compile(r"\b(?:\+?60|0)\d{1,2}[-\s]?\d{3,4}[-\s]?\d{3,4}\b")
_STRICT_CLOCK = re.compile(r"\b(?:[01]?\d|2[0-3])\s?[:;]\s?[0-5]\d")
_DAY_PART = re.compile(r"\b(?:pagi|petang|malam|am|pm)\b")
_PRICED = re.compile(r"(\d+(?:[.,]\d+)?)\s*[xX×*]\s*([\d.,\-–]+)")
_CURRENCY = re.compile(r"\b(?:RM|MYR)\b", re.IGNORECASE)
_ID = r"((?=[A-Za-z0-9\-/]*\d)[A-Za-z0-9][A-Za-z0-9\-/]{3,24})"


def first_alone(low: str, needles: list[str]) -> tuple[str, int] | None:
    """The first needle whose first occurrence has no letter or digit beside it."""
    for n in needles:
        at = low.find(n)
        if at >= 0 and not (at and low[at - 1].isalnum()) and not low[at + len(n) : at + len(n) + 1].isalnum():
            return n, at
    return None


#: Digits that no label holds: lines that differ in them only have the same labels.
_ALIKE = [d for d in "0123456789" if not any(d in n for x in vars(V).values() if isinstance(x, list | dict) for some in (x.values() if isinstance(x, dict) else [x]) if isinstance(some, list) for n in some)]
_TO_ALIKE = str.maketrans(dict.fromkeys(_ALIKE, _ALIKE[0]))
#: Lines up to this length are remembered by their shape.
_REMEMBERED = 160


class Shape:
    """What a line says whatever its digits are: all that follows is the same for lines
    that differ in digits ``_ALIKE`` only."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self._first: dict[int, tuple[str, int] | None] = {}
        self._labelled: dict[str, tuple[str, int, int] | None] = {}

    def first(self, needles: list[str]) -> tuple[str, int] | None:
        """``first_alone`` of a constant list."""
        if id(needles) not in self._first:
            self._first[id(needles)] = first_alone(self.low, needles)
        return self._first[id(needles)]

    def labelled(self, kind: str) -> tuple[str, int, int] | None:
        """A label of the type and the place of the value behind it."""
        if kind not in self._labelled:
            self._labelled[kind] = self._behind(*_VALUES[kind])
        return self._labelled[kind]

    def _behind(self, labels: list[str], pattern: re.Pattern) -> tuple[str, int, int] | None:
        for label in labels:
            if hit := first_alone(self.low, [label]):
                tail = hit[1] + len(label)
                m = pattern.search(self.text[tail:])
                if m and len(m[1].strip(" .:-/")) >= 3:
                    return label, tail + m.start(1), tail + m.end(1)
        return None

    @cached_property
    def noise(self) -> bool:
        return any(p in self.low for p in V.NOISE_PHRASES)

    @cached_property
    def numeric(self) -> bool:
        return any(c.isdigit() for c in self.text)

    @cached_property
    def dated(self) -> bool:
        """Whether it can hold a date."""
        return self.numeric and K.like_date(self.text)

    @cached_property
    def date_label(self) -> bool:
        return bool(self.first(V.DATE_LABELS) or self.first(V.DAY_NAMES))

    @cached_property
    def clock(self) -> bool:
        """Whether it can hold a clock time of hours and minutes with a colon."""
        return self.numeric and (":" in self.text or ";" in self.text)

    @cached_property
    def time_label(self) -> bool:
        return bool(self.first(V.TIME_LABELS) or _DAY_PART.search(self.low))

    @cached_property
    def phone(self) -> bool:
        """Whether it has digits enough for a phone number."""
        return sum(map(str.isdecimal, self.text)) >= 8

    @cached_property
    def postcode(self) -> bool:
        return bool(_POSTCODE.search(self.text))

    @cached_property
    def counted(self) -> bool:
        return bool(_COUNTED.search(self.low))

    @cached_property
    def priced(self) -> bool:
        return bool(_PRICED.search(self.text))

    @cached_property
    def currency(self) -> tuple[int, int] | None:
        m = _CURRENCY.search(self.text)
        return m and m.span()

    @cached_property
    def payment(self) -> tuple[str, int, int] | None:
        for method, forms in V.PAYMENT_METHODS.items():
            if hit := first_alone(self.low, forms):
                return method, hit[1], hit[1] + len(hit[0])
        return None


_remembered = lru_cache(maxsize=1 << 14)(Shape)

#: Types whose value stands behind a label: the labels, longest first, and what may follow.
_VALUES = {
    kind: (_longest_first(labels), re.compile(r"^\s*(?:no\.?|id|reg\.?|#)?\s*[:;\-.]?\s*" + value))
    for kind, labels, value in (
        ("TAX_ID", V.TAX_ID_LABELS, _ID), ("INVOICE_NO", V.INVOICE_LABELS, _ID), ("CASHIER", V.CASHIER_LABELS, r"([A-Za-z][A-Za-z0-9 .'-]{1,24})"), ("PHONE", V.PHONE_LABELS, r"([\d][\d\-\s()]{6,16})"),
    )
}


class Line:
    def __init__(self, text: str, at: int, shape: str):
        self.text, self.at = text, at
        self.shape = _remembered(shape) if len(shape) <= _REMEMBERED else Shape(shape)

    @property
    def bare(self) -> str:
        return self.text.strip()

    @property
    def left(self) -> int:
        return self.at + len(self.text) - len(self.text.lstrip())

    @property
    def right(self) -> int:
        return self.left + len(self.bare)


class Receipt:
    def __init__(self, text: str):
        self.text, self.lines, at = text, [], 0
        for x, shape in zip(text.split("\n"), text.translate(_TO_ALIKE).split("\n"), strict=True):
            self.lines.append(Line(x, at, shape))
            at += len(x) + 1

    def entities(self) -> list[Entity]:
        found = [*self.amounts()]
        merchant = self.merchant()
        found += [merchant, self.address(merchant.end if merchant else 0), self.date(), self.time(), self.phone(), self.payment()]
        found += [self.labelled("TAX_ID", 0.85), self.labelled("INVOICE_NO", 0.8), self.labelled("CASHIER", 0.7)]
        if line := next((x for x in self.lines if x.shape.currency), None):
            s, e = line.shape.currency
            found.append(Entity("CURRENCY", "MYR", line.text[s:e], line.at + s, line.at + e, 0.9))
        return [e for e in found if e] + [*self.items()]

    def values(self, kinds: frozenset[str]) -> dict[str, str]:
        """The value of each of some scalar types that ``entities`` finds, without looking for the others."""
        found = {e.type: e.value for e in self.amounts(kinds)}
        merchant = self.merchant() if kinds & {"MERCHANT", "ADDRESS"} else None
        if merchant:
            found["MERCHANT"] = merchant.value
        ways = {
            "ADDRESS": lambda: self.address(merchant.end if merchant else 0), "DATE": self.date, "TIME": self.time, "PHONE": self.phone, "PAYMENT_METHOD": self.payment,
            "TAX_ID": lambda: self.labelled("TAX_ID", 0.85), "INVOICE_NO": lambda: self.labelled("INVOICE_NO", 0.8), "CASHIER": lambda: self.labelled("CASHIER", 0.7),
        }
        for kind in kinds & ways.keys():
            if e := ways[kind]():
                found[kind] = e.value
        if "CURRENCY" in kinds and any(x.shape.currency for x in self.lines):
            found["CURRENCY"] = "MYR"
        return found

    # -- amounts

    def candidates(self, kinds: frozenset[str] | None = None) -> Iterator[tuple[str, str, float, int, int]]:
        """(type, label, value, start, end), at most one a line; of some types if they are named."""
        summary = False
        for k, line in enumerate(self.lines):
            summary = summary or line.shape.first(V.SUMMARY_HEADERS) is not None
            hit = line.shape.first(_MONEY)
            if hit is None:
                continue
            label, at = hit
            kind = _KIND[label]
            if kinds is not None and kind not in kinds:
                continue
            # rows of a summary table and counts of goods are no totals
            if kind == "TOTAL" and (summary or (label not in V.FINAL_TOTALS and line.shape.counted)):
                continue
            right = [a for a in K.amounts(line.text) if a[1] >= at + len(label)]
            if right:
                value, s, e = right[-1]
                yield kind, label, value, line.at + s, line.at + e
            elif k + 1 < len(self.lines) and len((below := self.lines[k + 1]).bare) <= 24 and (alone := K.amounts(below.text)):
                value, s, e = alone[0]
                yield kind, label, value, below.at + s, below.at + e

    def amounts(self, kinds: frozenset[str] | None = None) -> Iterator[Entity]:
        groups: dict[str, list] = {}
        for c in self.candidates(kinds):
            groups.setdefault(c[0], []).append(c)
        for kind, group in groups.items():
            if kind == "TOTAL":
                some = [c for c in group if c[2] > 0] or group
                pick = ([c for c in some if c[1] in V.FINAL_TOTALS] or some)[-1]
            else:
                pick = group[-1 if kind in ("PAID", "CHANGE") else 0]
            _, label, value, s, e = pick
            yield Entity(kind, f"{value:.2f}", K.spaces(self.text[s:e]), s, e, 0.85, label=label, amount=value)

    # -- header

    def merchant(self) -> Entity | None:
        head = self.lines[:7]
        named = next((k for k, x in enumerate(head) if len(x.bare) >= 3 and not x.shape.noise and x.shape.first(V.COMPANY_MARKERS)), None)
        if named is None:
            named = next((k for k, x in enumerate(head) if sum(map(str.isalpha, x.bare)) >= 4 and not x.shape.noise and not x.shape.postcode), None)
        if named is None:
            return None
        line = self.lines[named]
        name, start, end = line.bare, line.left, line.right
        after = self.lines[named + 1] if named + 1 < len(self.lines) else None
        if after and 0 < len(after.bare) <= 18 and after.shape.first(V.COMPANY_MARKERS):
            name, end = f"{name} {after.bare}", after.right
        elif named and _CORPORATE_START.match(name):
            above = self.lines[named - 1]
            letters, numbers = (sum(map(f, above.bare)) for f in (str.isalpha, str.isdigit))
            brand = len(above.bare) >= 3 and not above.shape.noise and not above.shape.postcode and letters >= 3 and numbers <= letters
            if brand and not any(above.shape.first(m) for m in (V.ADDRESS_MARKERS, V.COMPANY_MARKERS)) and len(above.bare) + len(name) <= 60:
                name, start = f"{above.bare} {name}", above.left
        clean = K.without_graphics(_NUMBER_AFTER_NAME.sub("", K.spaces(name)).strip(" ,.-"))
        return Entity("MERCHANT", clean or K.spaces(name), K.spaces(name), start, end, 0.72)

    def address(self, after: int) -> Entity | None:
        block: list[Line] = []
        for line in self.lines[:12]:
            if line.at < after or not line.bare or line.shape.noise:
                continue
            if line.shape.first(V.ADDRESS_MARKERS) or line.shape.first(V.PLACES) or line.shape.postcode:
                block.append(line)
            elif block:
                break
        if not block:
            return None
        text = ", ".join(x.bare for x in block)
        clean = K.without_graphics(_NUMBER_BEFORE_STREET.sub("", K.spaces(text)).strip(" ,.-"))
        return Entity("ADDRESS", clean or K.spaces(text), K.spaces(text), block[0].left, block[-1].right, 0.7)

    # -- dates, times, numbers

    def _anchored(self, found: Iterator[tuple[bool, Entity]]) -> Entity | None:
        """The first anchored one, else the first."""
        spare = None
        for anchored, e in found:
            if anchored:
                return e
            spare = spare or e
        return spare

    def _at(self, kind: str, line: Line, found: tuple[str, int, int], confidence: float) -> Entity:
        value, s, e = found
        return Entity(kind, value, K.spaces(line.text[s:e]), line.at + s, line.at + e, confidence)

    def date(self) -> Entity | None:
        def found():
            for line in self.lines:
                if line.shape.dated and (d := K.date(line.text)):
                    anchored = line.shape.date_label
                    yield anchored, self._at("DATE", line, d, 0.9 if anchored else 0.75)

        return self._anchored(found())

    def time(self) -> Entity | None:
        def found():
            for line in self.lines:
                if not line.shape.numeric:
                    continue
                anchored = line.shape.time_label
                if line.shape.clock and (m := _STRICT_CLOCK.search(line.text)):
                    if c := K.clock(line.text, m.start()):
                        yield anchored, self._at("TIME", line, c, 0.9 if anchored else 0.8)
                elif anchored and (c := K.clock(line.text)):
                    yield False, self._at("TIME", line, c, 0.7)

        return self._anchored(found())

    def labelled(self, kind: str, confidence: float) -> Entity | None:
        for line in self.lines:
            if hit := line.shape.labelled(kind):
                label, s, e = hit
                found = line.text[s:e].strip(" .:-/")
                return Entity(kind, found, K.spaces(found), line.at + s, line.at + e, confidence, label=label)
        return None

    def phone(self) -> Entity | None:
        if e := self.labelled("PHONE", 0.85):
            e.value = K.spaces(e.value)
            return e
        for line in self.lines[:12]:
            if line.shape.phone and (m := _ANY_PHONE.search(line.text)):
                return self._at("PHONE", line, (K.spaces(m[0]), *m.span()), 0.7)
        return None

    def payment(self) -> Entity | None:
        for line in self.lines:
            if line.shape.payment:
                return self._at("PAYMENT_METHOD", line, line.shape.payment, 0.8)
        return None

    def items(self) -> Iterator[Entity]:
        for line in self.lines:
            m = line.shape.priced and _PRICED.search(line.text)
            if not m or line.shape.first(_MONEY):
                continue
            name = K.spaces(re.sub(r"[\d.,]+$", "", line.text[: m.start()])).strip(" -|:")
            if len(name) < 2:
                continue
            all_, unit = K.amounts(line.text), K.amounts(m[2])
            qty = K.digits(m[1]).replace(",", ".")
            at = line.text.find(name)
            start = line.at + at if at >= 0 else line.left
            yield Entity("ITEM", name, name, start, start + len(name), 0.6, amount=all_[-1][0] if all_ else None, qty=float(qty) if qty.replace(".", "").isdigit() else None, unit_price=unit[0][0] if unit else None)


def extract(text: str | None) -> list[Entity]:
    return Receipt(text).entities() if text and text.strip() else []


_ENTITIES = to_arrow_type(T.ArrayType(ENTITY))


@F.arrow_udf(T.ArrayType(ENTITY))
def entities(text: pa.Array) -> pa.Array:
    return pa.array([[vars(e) for e in extract(t)] for t in text.to_pylist()], _ENTITIES)


#: Marked so that a filter or a second use of its result does not run it again.
entities = entities.asNondeterministic()


def entity_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each entity found: the id, its place among them and its fields."""
    return docs.select(F.col(id_col), F.posexplode(entities(F.col(text_col))).alias("place", "e")).select(id_col, "place", "e.*")


def fields(found: Column) -> Column:
    """The first value of each scalar type of an entity array, as a struct."""
    of = lambda x, kind: F.try_element_at(F.filter(x, lambda e: e["type"] == kind), F.lit(1))["value"]
    # bound once: an extraction written out for each field would run for each field
    return F.transform(F.array(found), lambda x: F.struct(*(of(x, kind).alias(name) for kind, name in V.FIELDS.items())))[0]


def values(text: Column, *names: str) -> Column:
    """Some of ``fields``, as a struct of those names, from one pass that looks for them only."""
    kinds = [next(kind for kind, name in V.FIELDS.items() if name == n) for n in names]
    wanted = frozenset(kinds)

    def some_entities(text: pa.Array) -> pa.Array:
        found = [Receipt(t).values(wanted) if t and t.strip() else {} for t in text.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x.get(k) for x in found], pa.string()) for k in kinds], list(names))

    # marked as ``entities`` is
    return F.arrow_udf(some_entities, T.StructType([T.StructField(n, _S) for n in names])).asNondeterministic()(text)
