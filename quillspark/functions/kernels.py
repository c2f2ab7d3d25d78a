"""Functions that need offsets, edit alignment or repair loops: plain Python, and
Arrow UDFs over them for use in DataFrames. Offsets are code points."""

from __future__ import annotations

import ast
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import vocabulary as V

#: Patterns that define results (fixed values), from here to ``_CLOCK``.
_AMOUNT = re.compile(rf"\d{{1,3}}(?:[,\s]?\d{{3}})*\s?[{V.POINT}]\s?\d{{2}}(?!\d)")
#: Dates, clock times, phone numbers and long numbers: not amounts. In this order.
_OTHER_NUMBERS = [
    re.compile(p)
    for p in (r"\b\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4}\b", r"\b\d{1,2}\s?[:;]\s?\d{2}(?:\s?[:;]\s?\d{2})?\b", r"\b0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}\b", r"\b\d{9,}\b")
]
_NUMERIC_DATE = re.compile(r"\b(\d{1,4})\s?[/\-.]\s?(\d{1,2})\s?[/\-.]\s?(\d{2,4})\b")
_WORD_DATE = re.compile(r"\b(?:(?P<d>\d{1,2})[\s\-./]+(?P<m>[A-Za-z]{3,12})\.?[\s\-./]+(?P<y>\d{2,4})|(?P<m2>[A-Za-z]{3,12})\.?[\s\-./]+(?P<d2>\d{1,2}),?[\s\-./]+(?P<y2>\d{4}))\b")
_CLOCK = re.compile(r"\b(?P<h>[01]?\d|2[0-3])\s?[:;.]\s?(?P<m>[0-5]\d)(?:\s?[:;.]\s?[0-5]\d)?\s*(?P<part>pagi|tengahari|petang|malam|am|pm|a\.m\.|p\.m\.)?", re.IGNORECASE)
_TO_DIGITS = str.maketrans(V.GLYPHS, V.DIGITS)
_GRAPHIC = frozenset(V.GRAPHIC)

Span = tuple[int, int]


def spaces(text: str | None) -> str:
    return " ".join((text or "").split())


def strip_accents(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def key(text: str | None) -> str:
    return spaces(re.sub(r"[^a-z0-9\s]", " ", strip_accents((text or "").lower())))


def without_graphics(text: str) -> str:
    """Tokens of graphic marks alone, and punctuation on their tails, are dropped."""

    def graphic(token: str) -> bool:
        core = token.rstrip(",.;:")
        return bool(core) and core[0] in V.GRAPHIC and set(core) <= _GRAPHIC

    return " ".join(t for t in text.split() if not graphic(t)).strip(" ,.-’'\"") if text else text


def digits(token: str) -> str:
    """A mostly numeric token with confused glyphs made digits; others unchanged."""
    core = token.strip()
    if not any(c.isdigit() for c in core) or sum(c.isalpha() for c in core) > 0.6 * len(core):
        return token
    fixed = core.translate(_TO_DIGITS)
    return fixed if re.fullmatch(rf"[\d{V.POINT}\s]+", fixed) else token


def money(raw) -> float | None:
    """The amount that a value stands for; its sign is not kept in strings."""
    if raw is None or isinstance(raw, bool):
        return None
    if isinstance(raw, int | float):
        return float(raw)
    return _printed_money(str(raw))


#: Amounts as they are mostly printed, without anything to mend.
_PLAIN = re.compile(r"[0-9]+\.[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+\.[0-9]{1,2}")


@lru_cache(maxsize=4096)
def _printed_money(raw: str) -> float | None:
    if _PLAIN.fullmatch(raw):
        return float(raw.replace(",", ""))
    s = re.sub(r"(?i)\b(?:rm|myr)\b", " ", digits(raw.strip()))
    s = re.sub(rf"[^\d{V.POINT}]", "", s)
    if re.fullmatch(r"\d+\.\d+", s):
        return float(s)
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+\.\d{1,2}", s):
        return float(s.replace(",", ""))
    whole = re.sub(r"\D", "", s)
    if len(s) > 2 and s[-3] in ".,-–—=" and s[-2:].isdigit():
        return float(f"{whole[:-2] or '0'}.{whole[-2:]}")
    return float(whole) if whole else None


def amounts(line: str) -> list[tuple[float, int, int]]:
    """Amounts of a line as (value, start, end)."""
    return list(_amounts(line))


@lru_cache(maxsize=4096)
def _amounts(line: str) -> tuple[tuple[float, int, int], ...]:
    """Extraction and checking ask for the same lines."""
    shape = line.translate(_TO_ONES)
    found = ((money(line[s:e]), s, e) for s, e in (_remembered_spans if len(shape) <= 160 else _amount_spans)(shape))
    return tuple(x for x in found if x[0] is not None)


#: Where amounts stand does not depend on the digits, but for zeros (phone numbers).
_TO_ONES = str.maketrans("23456789", "11111111")


def _amount_spans(line: str) -> tuple[Span, ...]:
    if not _AMOUNT.search(line):  # masking takes digits away: it makes no amount
        return ()
    masked = line
    for p in _OTHER_NUMBERS:
        masked = p.sub(lambda m: "#" * len(m[0]), masked)
    return tuple(m.span() for m in _AMOUNT.finditer(masked))


_remembered_spans = lru_cache(maxsize=1 << 14)(_amount_spans)


def _iso(y: int, m: int, d: int) -> str | None:
    y += 0 if y >= 100 else 2000 if y <= 69 else 1900
    return f"{y:04d}-{m:02d}-{d:02d}" if 1 <= m <= 12 and 1 <= d <= 31 else None


def like_date(text: str) -> bool:
    """Whether ``date`` has anything to look at, whatever the digits are."""
    return bool(_NUMERIC_DATE.search(text) or _WORD_DATE.search(text))


def date(text: str) -> tuple[str, int, int] | None:
    if not any(c.isdigit() for c in text):
        return None
    if m := _NUMERIC_DATE.search(text):
        a, b, c = map(int, m.groups())
        if len(m[1]) == 4:
            found = f"{a:04d}-{b:02d}-{c:02d}" if 1 <= b <= 12 and 1 <= c <= 31 else None
        else:
            found = _iso(c, a, b) if b > 12 >= a else _iso(c, b, a)
        if found:
            return found, *m.span()
    if (m := _WORD_DATE.search(text)) and (month := V.MONTHS.get((m["m"] or m["m2"]).lower())):
        if found := _iso(int(m["y"] or m["y2"]), month, int(m["d"] or m["d2"])):
            return found, *m.span()
    return None


def clock(text: str, at: int = 0) -> tuple[str, int, int] | None:
    m = _CLOCK.search(text[at:])
    if not m:
        return None
    hour, part = int(m["h"]), (m["part"] or "").lower().replace(".", "")
    hour += 12 * (part in ("pm", "petang", "malam") and hour < 12) - 12 * (part in ("am", "pagi") and hour == 12)
    return f"{hour:02d}:{m['m']}", at + m.start(), at + m.end()


# -- similarity and alignment: Ratcliff-Obershelp, which no built-in computes


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def similarity(a: str | None, b: str | None) -> float:
    x, y = key(a), key(b)
    return 0.0 if not x or not y else 1.0 if x == y else _ratio(x, y)


def partial_similarity(query: str | None, value: str | None) -> float:
    """The best of the whole value and all its windows of about as many words as the query."""
    best, q, words = similarity(query, value), key(query), key(value).split()
    n = len(q.split())
    if not n:
        return best
    for size in sorted({max(1, n - 1), n, n + 1}):
        for k in range(len(words) - size + 1):
            window = " ".join(words[k : k + size])
            # twice the shorter over both lengths bounds the ratio from above
            if 2 * min(len(q), len(window)) > best * (len(q) + len(window)):
                best = max(best, _ratio(q, window))
    return best


_TO_SPACE = {k: " " for k in (*range(9, 14), *range(28, 32))}


@lru_cache(maxsize=4)
def _folded(text: str) -> tuple[str, Sequence[int]]:
    """Lower case with single spaces, and where each character came from."""
    if text.isascii() and "  " not in (flat := text.translate(_TO_SPACE).lower()) and not flat.startswith(" "):
        return flat, range(len(flat))
    kept = [k for k, c in enumerate(text) if not c.isspace() or (k and not text[k - 1].isspace())]
    out = [(c, k) for k in kept for c in (" " if text[k].isspace() else text[k].lower())]
    return "".join(c for c, _ in out), [k for _, k in out]


def _shared(hay: str, needle: str, step: int) -> np.ndarray:
    """How many characters each window of the needle's length shares with it, in any order."""
    codes = np.frombuffer(hay.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, total = len(needle), 0
    for c, times in Counter(needle).items():
        seen = np.concatenate([[0], np.cumsum(codes == ord(c), dtype=np.int32)])
        total = total + np.minimum(seen[n::step] - seen[: len(seen) - n : step], times)
    return total


def locate(text: str | None, value: str | None, least: float = 0.72) -> Span | None:
    """Where a value stands in a text: exactly but for case and spaces, else the most
    similar window of its length (the first of equals), tried in strides of a sixth of it."""
    hay, at = _folded(text or "")
    needle = _folded(value or "")[0]
    if not hay or not needle:
        return None
    n, found = len(needle), hay.find(needle)
    if found < 0:
        if not 3 <= n <= len(hay):
            return None
        matcher, best, step = SequenceMatcher(autojunk=False), least, max(1, n // 6)
        matcher.set_seq2(needle)
        # the shared characters bound the ratio from above: those with most of them come first
        shared = _shared(hay, needle, step)
        likely = np.flatnonzero(2.0 * shared / (2 * n) >= least)
        for x in likely[np.argsort(-shared[likely], kind="stable")].tolist():
            if 2.0 * int(shared[x]) / (2 * n) < best:
                break
            matcher.set_seq1(hay[x * step : x * step + n])
            r = matcher.ratio()
            if r > best or (r == best and (found < 0 or x * step < found)):
                best, found = r, x * step
        if found < 0:
            return None
    return at[found], at[found + n - 1] + 1


# -- damaged JSON


#: A value that is a sum, difference, product or quotient of two numbers; a member with a plain value (fixed values).
_SUM = re.compile(r":\s*(-?\d+(?:\.\d+)?)\s*([+\-*/])\s*(-?\d+(?:\.\d+)?)\s*(?=[,}\]])")
_MEMBER = re.compile(r'"([A-Za-z_][A-Za-z0-9_]*)"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|true|false|null)')
_OPERATIONS = {"+": float.__add__, "-": float.__sub__, "*": float.__mul__, "/": float.__truediv__}


def _computed(text: str) -> str:
    """Sums in value position replaced by their result; a division by zero is null."""

    def solved(m: re.Match) -> str:
        a, b = float(m[1]), float(m[3])
        return ": null" if m[2] == "/" and b == 0 else f": {round(_OPERATIONS[m[2]](a, b), 2)}"

    return _SUM.sub(solved, text)


def _read(read, text: str) -> dict | None:
    try:
        found = read(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    return found if isinstance(found, dict) else None


def parse_json(reply: str | None) -> dict | None:
    """The object in a reply: as it is, with sums computed, without trailing commas, with
    Python's null, or with the first two together; else as a Python literal; else its
    plain members, the first of each name (then with ``_partial``). Null if there is none."""
    text = re.sub(r"^```(?:json)?|```$", "", (reply or "").strip(), flags=re.MULTILINE).strip()
    start, end = text.find("{"), text.rfind("}")
    body = text[start : end + 1] if 0 <= start and end >= 0 else text
    tidy = re.sub(r",\s*([}\]])", r"\1", body)
    for candidate in (body, _computed(body), tidy, re.sub(r"\bNone\b", "null", body), _computed(tidy)):
        if (found := _read(json.loads, candidate)) is not None:
            return found
    if (found := _read(ast.literal_eval, body)) is not None:
        return found
    members: dict = {}
    for name, value in _MEMBER.findall(_computed(text)):
        if name not in members:
            try:
                members[name] = json.loads(value)
            except ValueError:  # an escape that JSON does not know
                continue
    return members | {"_partial": True} if members else None


# -- the same over columns


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def partial_similarity_udf(query: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([partial_similarity(x, y) for x, y in zip(query, value, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def locate_udf(text: pd.Series, value: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(x, y) or (None, None) for x, y in zip(text, value, strict=True)], columns=["start", "end"])


@F.pandas_udf(T.StringType())
def strip_accents_udf(text: pd.Series) -> pd.Series:
    return text.map(strip_accents, na_action="ignore")


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def parse_json_udf(reply: pd.Series) -> pd.Series:
    """Members as JSON texts (strings as they are); null without an object."""

    def members(text):
        found = parse_json(text)
        return None if found is None else {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in found.items()}

    return reply.map(members)
