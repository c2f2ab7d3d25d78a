"""Secret scans by assignment-aware lexing.

Three base patterns are matched as stated (``BASE``). Beyond them, the text is
lexed around its assignment operators (``=``, ``:``, ``:=``, ``=>``) as source code
or configuration: a target name on the left (bare, quoted, subscripted, or with a
type annotation between), and on the right a sum of string literals (prefixed, triple,
in parentheses or continued on the next line too), references
and bare values; a bare value ends where the next assignment's operator stands. References
are resolved by propagating constants, also from later lines and over any number of
steps; a constant used twice in a sum counts once, and one that refers to itself has
what else it is made of. A literal that reaches a sensitive name is
scored by the name's words and its own shape; those from ``THRESHOLD`` up are
reported as kind ``literal``.

Defined results. A null text counts as empty and has no spans. Offsets are code
points, ends exclusive. A span found twice is reported once for each kind.
Repeated ids give a row each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import pieces

#: Kinds in the order in which spans of equal starts are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Greedy runs: the same matches as one or more characters with the short ones dropped.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weight of each word of a target name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authorization": 0.7, "bearer": 0.7, "auth": 0.6, "signature": 0.5,
    "key": 0.4, "pass": 0.6, "salt": 0.5, "pin": 0.4,
}
#: Words that raise ``key`` to a full weight, and words by which a name tells of something else.
KEY_OF, HARMLESS = {"api", "private", "access", "secret", "encryption", "signing", "master"}, {"id", "name", "type", "length", "count", "max", "min", "url", "path", "field", "label", "hint", "policy", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|changeme|example.*|placeholder|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|todo|test|undefined)$")
THRESHOLD = 0.75

_OPERATOR = re.compile(r":=|=>|[=:]")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*", re.ASCII)
#: ``:`` and ``=`` belong to a bare value only at its end or, ``:``, before a slash.
_BARE = re.compile(r"(?:[^\s,;\"'`(){}\[\]<>:=]|:(?=/)|[:=]++(?![^\s,;\"'`(){}\[\]<>]))+")
_QUOTED = re.compile(r"[rbufRBUF]{0,2}(?:\"{3}((?:[^\"\\]|\\.|\"{1,2}(?!\"))*+)\"{3}|'{3}((?:[^'\\]|\\.|'{1,2}(?!'))*+)'{3}|\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)", re.DOTALL)
_GAP = re.compile(r"(?:[ \t]|\\\n|\(\s*)*+")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _name_before(text: str, at: int) -> tuple[str, int]:
    """The name that ends at ``at``, blanks, quotes and subscripts aside, and its start."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] == "]":
        at -= 1
    quote = text[at - 1] if at and text[at - 1] in "\"'`" else ""
    end = at = at - len(quote)
    while at and text[at - 1] in _NAME_CHARS:
        at -= 1
    if quote and not (at and text[at - 1] == quote):
        return "", at
    return text[at:end].lstrip("-.0123456789"), at - len(quote)


def _target(text: str, at: int, operator: str) -> str:
    """The target of the operator at ``at``; of ``name: type =`` that is ``name``."""
    name, start = _name_before(text, at)
    if name and operator == "=":
        k = start
        while k and text[k - 1] in " \t":
            k -= 1
        if k and text[k - 1] == ":" and (annotated := _name_before(text, k - 1)[0]):
            return annotated
    return name


def _terms(text: str, at: int) -> list[tuple[str, str, int, int]]:
    """What is added up right of an operator: ('quoted' | 'bare' | 'name', content, start, end)."""
    found = []
    while True:
        at = _GAP.match(text, at).end()
        if m := _QUOTED.match(text, at):
            k = m.lastindex
            found.append(("quoted", m[k], *m.span(k)))
        elif m := _BARE.match(text, at):
            word = m[0].rstrip(".:")
            kind = "name" if _NAME.fullmatch(word) else "bare"
            found.append((kind, word, m.start(), m.start() + len(word)))
        else:
            return found
        at = _GAP.match(text, m.end()).end()
        if not (at < len(text) and text[at] == "+"):
            return found
        at += 1


def _sensitivity(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    best = max((SENSITIVE.get(w, 0.0) for w in {*words, *joined}), default=0.0)
    return 1.0 if "key" in words and KEY_OF & {*words} else best


def _shape(literal: str, quoted: bool) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    n = len(literal)
    if n < (6 if quoted else 8) or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(any(map(f, literal)) for f in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    if not quoted and classes < 2:
        return 0.0
    return min(1.0, 0.2 + entropy / 6 + 0.1 * classes)


def lexed_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """Literals that reach sensitive names: (kind, start, end, name, score)."""
    assigned: list[tuple[str, list]] = []
    for m in _OPERATOR.finditer(text):
        if (m[0] == "=" and text[m.end() : m.end() + 1] == "=") or (m[0] == ":" and text[m.end() : m.end() + 1] in (":", "/")):
            continue
        if (name := _target(text, m.start(), m[0])) and (terms := _terms(text, m.end())):
            assigned.append((name, terms))
    by_name: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(assigned):
        by_name.setdefault(name, []).append(k)

    def constant(k: int) -> list[tuple[str, int, int, bool]]:
        """The literals that the k-th assignment comes to, each once, in order."""
        out, seen, todo = [], {k}, [(k, iter(assigned[k][1]))]
        while todo:
            k, terms = todo[-1]
            term = next(terms, None)
            if term is None:
                todo.pop()
                continue
            kind, content, start, end = term
            if kind == "name" and content in by_name and content != assigned[k][0]:
                own = by_name[content]
                at = own[max(0, bisect_left(own, k) - 1)]  # the last one before, else the first
                if at not in seen:
                    seen.add(at)
                    todo.append((at, iter(assigned[at][1])))
                continue
            out.append((content, start, end, kind == "quoted"))
        return out

    found = []
    for k, (name, _) in enumerate(assigned):
        weight = _sensitivity(name)
        if weight <= 0:
            continue
        parts = constant(k)
        score = weight * 0.6 + 0.5 * _shape("".join(p[0] for p in parts), any(p[3] for p in parts)) if parts else 0.0
        if score >= THRESHOLD + 0.1 * (weight < 0.9):
            found += [("literal", start, end, name, round(score, 4)) for content, start, end, _ in parts if content]
    return found


def secrets(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """All spans by start, then kind; base ones have score 1 and no name."""
    spans = {(s, KINDS.index(k), e): (k, s, e, None, 1.0) for k, s, e in base_spans(text)}
    for x in lexed_spans(text):
        spans.setdefault((x[1], KINDS.index(x[0]), x[2]), x)
    return [spans[k] for k in sorted(spans)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(parts, 1):
        rows = [[dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in secrets(x.as_py() or "")] for x in part.column(1)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and its ``spans`` (kind, start, end, name, score)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_batches, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,name:string,score:double>>")


def digests(found: DataFrame) -> DataFrame:
    """The counts and digest of the base spans, and all spans as one string."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
