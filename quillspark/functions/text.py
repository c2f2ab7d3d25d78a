"""Text, amount, date and language functions as Column expressions.

Everything here stays inside the JVM. Patterns are written for Java with ``(?U)``
where white space, digits or word boundaries must be Unicode's. Functions whose
result needs offsets into the text are in :mod:`quillspark.functions.kernels`.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import vocabulary as V

SEP = r"[.,\-–—=]"
#: An amount of at most three leading digits with thousands groups and exactly two decimals.
AMOUNT = rf"(?U)\d{{1,3}}(?:[,\s]?\d{{3}})*\s?{SEP}\s?\d{{2}}(?!\d)"


def normalize_spaces(c: Column) -> Column:
    """Runs of white space made one space, ends stripped; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def strip_graphic_noise(c: Column) -> Column:
    """Without tokens made of graphic marks alone (and punctuation stuck to them)."""
    marks = re.escape(V.GRAPHIC)
    bare = F.regexp_replace(c, rf"(?U)(?<!\S)[{marks}]+[,.;:]*(?!\S)", " ")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.btrim(normalize_spaces(bare), F.lit(" ,.-’'\"")))


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one character and marks -> that character."""
    found = []
    for k in range(0xA0, 0x10000):
        c = chr(k)
        if 0xAC00 <= k <= 0xD7A3 or 0xD800 <= k <= 0xDFFF:
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c:
            found.append((c, d))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks. Characters that
    decompose into several (ligatures, fractions) need ``kernels.strip_accents``."""
    old, new = _plain_letters()
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(F.regexp_replace(F.translate(c, old, new), r"\p{M}+", ""))


def normalize_key(c: Column) -> Column:
    """Form for comparison: lower case letters and digits, single spaces."""
    return normalize_spaces(F.regexp_replace(strip_accents(F.lower(F.coalesce(c, F.lit("")))), r"(?U)[^a-z0-9\s]", " "))


def repair_digits(c: Column) -> Column:
    """A mostly numeric token with confused glyphs made digits; others unchanged."""
    core = F.trim(c)
    digits = F.length(F.regexp_replace(core, r"(?U)\D", ""))
    letters = F.length(F.regexp_replace(core, r"\P{L}", ""))
    fixed = F.translate(core, V.GLYPHS, V.DIGITS)
    numeric = fixed.rlike(rf"(?U)^[\d{V.POINT}\s]+$")
    return F.when((digits > 0) & (letters <= 0.6 * F.length(core)) & numeric, fixed).otherwise(c)


def parse_money(c: Column) -> Column:
    """Amount of a damaged or well-formed string as a double, null if there is none.

    Tried in order: a plain decimal, thousands groups with decimals, two digits
    behind a damaged point, bare digits. A sign is not kept.
    """
    s = F.regexp_replace(repair_digits(F.btrim(c.cast("string"), F.lit(" \t\n\r\x0b\x0c"))), r"(?i)\b(rm|myr)\b", " ")
    s = F.regexp_replace(s, rf"(?U)[^\d{V.POINT}]", "")
    tail = rf"^(.*?){SEP}(\d{{2}})$"
    head = F.regexp_replace(F.regexp_extract(s, tail, 1), r"(?U)\D", "")
    bare = F.regexp_replace(s, r"(?U)\D", "")
    text = (
        F.when(s.rlike(r"^\d+\.\d+$"), s)
        .when(s.rlike(r"^\d{1,3}(,\d{3})+\.\d{1,2}$"), F.regexp_replace(s, ",", ""))
        .when(s.rlike(tail), F.concat(F.when(head == "", "0").otherwise(head), F.lit("."), F.regexp_extract(s, tail, 2)))
        .when(bare != "", bare)
    )
    return text.try_cast("double")


def money_values(line: Column) -> Column:
    """All amounts of a line, in order, dates, times, phones and long numbers set aside."""
    masked = line
    for pattern in (r"\b\d{1,4}[/\-.]\d{1,2}[/\-.]\d{2,4}\b", r"\b\d{1,2}\s?[:;]\s?\d{2}(?:\s?[:;]\s?\d{2})?\b", r"\b0\d{1,2}[-\s]?\d{3,4}[-\s]?\d{4}\b", r"\b\d{9,}\b"):
        masked = F.regexp_replace(masked, "(?U)" + pattern, "#")
    return F.transform(F.regexp_extract_all(masked, F.lit(f"({AMOUNT})"), 1), parse_money)


def format_money(c: Column) -> Column:
    """Two decimals, rounded as a decimal; null stays null."""
    return c.cast("decimal(38,2)").cast("string")


def full_year(c: Column) -> Column:
    return F.when(c >= 100, c).when(c <= 69, c + 2000).otherwise(c + 1900)


def _iso(year: Column, month: Column, day: Column) -> Column:
    fine = month.between(1, 12) & day.between(1, 31)
    return F.when(fine, F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def normalize_date(c: Column) -> Column:
    """First numeric date (day first, unless that cannot be), else first date with a
    month's name, as ``yyyy-mm-dd``. Days are only held to 1 to 31."""
    numeric = r"(?U)\b(\d{1,4})\s?[/\-.]\s?(\d{1,2})\s?[/\-.]\s?(\d{2,4})\b"
    a, b, y = (F.regexp_extract(c, numeric, k).try_cast("int") for k in (1, 2, 3))
    swap = (b > 12) & (a <= 12)
    plain = F.when(F.length(F.regexp_extract(c, numeric, 1)) == 4, _iso(a, b, y)).otherwise(_iso(full_year(y), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a)))
    worded = r"(?U)\b(?:(\d{1,2})[\s\-./]+([A-Za-z]{3,12})\.?[\s\-./]+(\d{2,4})|([A-Za-z]{3,12})\.?[\s\-./]+(\d{1,2}),?[\s\-./]+(\d{4}))\b"
    part = lambda k: F.regexp_extract(c, worded, k)
    first = part(1) != ""
    name = F.lower(F.when(first, part(2)).otherwise(part(4)))
    month = F.create_map(*(F.lit(x) for kv in V.MONTHS.items() for x in kv))
    day, year = (F.when(first, part(i)).otherwise(part(j)).try_cast("int") for i, j in ((1, 5), (3, 6)))
    return F.coalesce(plain, _iso(full_year(year), F.try_element_at(month, name), day))


def normalize_time(c: Column) -> Column:
    """First clock time as ``HH:MM`` of 24 hours."""
    pattern = r"(?iU)\b([01]?\d|2[0-3])\s?[:;.]\s?([0-5]\d)(?:\s?[:;.]\s?([0-5]\d))?\s*(pagi|tengahari|petang|malam|am|pm|a\.m\.|p\.m\.)?"
    hour, minute = (F.regexp_extract(c, pattern, k).try_cast("int") for k in (1, 2))
    period = F.replace(F.lower(F.regexp_extract(c, pattern, 4)), F.lit("."), F.lit(""))
    hour = F.when(period.isin("pm", "petang", "malam") & (hour < 12), hour + 12).when(period.isin("am", "pagi") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNotNull(), F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")))


def detect_language(c: Column) -> Column:
    """``ms``, ``en``, ``mixed`` or ``unknown`` by distinct marker words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), 1))
    count = lambda marks: F.size(F.array_intersect(words, F.array(*map(F.lit, marks))))
    ms, en = count(V.MALAY_WORDS), count(V.ENGLISH_WORDS)
    low, high = F.least(ms, en), F.greatest(ms, en)
    return F.when(high == 0, "unknown").when((low > 0) & (low / high >= 0.4), "mixed").when(ms > en, "ms").otherwise("en")


def contains_any(c: Column, needles: list[str]) -> Column:
    """The first needle, in list order, whose first occurrence stands alone; else null.

    Only the first occurrence counts, so this is no search for ``\\bneedle\\b``.
    """
    def alone(n: Column) -> Column:
        at = F.position(n, c)
        before, after = F.substring(c, at - 1, F.lit(1)), F.substring(c, at + F.length(n), F.lit(1))
        return (at > 0) & ((at == 1) | ~before.rlike(r"[\p{L}\p{N}]")) & ~after.rlike(r"[\p{L}\p{N}]")

    return F.try_element_at(F.filter(F.array(*map(F.lit, needles)), alone), F.lit(1))


def is_noise(c: Column) -> Column:
    """Whether any of the noise phrases is in it, words or not."""
    return F.exists(F.array(*map(F.lit, V.NOISE_PHRASES)), lambda n: F.contains(c, n))


def is_tax_inclusive(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, V.TAX_INCLUSIVE_MARKERS)), lambda n: F.contains(low, n))


def looks_like_address(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.size(F.regexp_extract_all(low, F.lit("([a-z]{3,})"), 1))
    hit = contains_any(low, V.ADDRESS_MARKERS).isNotNull() | contains_any(low, V.PLACES).isNotNull() | low.rlike(r"(?U)\b\d{5}\b")
    return (words >= 2) & hit


def looks_like_place(key: Column) -> Column:
    """Whether a place's key equals, holds or is held by this one (empty: yes)."""
    return F.exists(F.array(*map(F.lit, V.PLACES)), lambda p: F.contains(key, p) | F.contains(p, key))


def lines_of(c: Column) -> Column:
    """Array of (line, offset); trailing empty lines are kept."""
    parts = F.split(c, "\n", -1)
    start = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x) + 1)
    return F.transform(parts, lambda x, i: F.struct(x.alias("line"), start(i).alias("offset")))


def values_agree(kind: Column, a: Column, b: Column, alike: Column) -> Column:
    """Whether two values of a type mean the same; ``alike``: their similarity."""
    money = F.abs(parse_money(a) - parse_money(b)) < 0.005
    exact = F.lower(F.trim(a)) == F.lower(F.trim(b))
    same = F.when(kind.isin(*V.MONEY_TYPES), money).when(kind.isin("DATE", "TIME", "TAX_ID", "INVOICE_NO", "CURRENCY", "PAYMENT_METHOD"), exact).otherwise(alike >= 0.85)
    return F.coalesce(a.isNotNull() & b.isNotNull() & same, F.lit(False))




def coarse_type(kind: Column) -> Column:
    classes = F.create_map(*(F.lit(x) for kv in V.COARSE.items() for x in kv))
    return F.coalesce(F.try_element_at(classes, kind), F.lit("MISC"))
