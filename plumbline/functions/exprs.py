"""Column expressions: null tokens, number and date tests, significant digits, words, characters, equal-width bins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "nan", "none", "null", " +", "-+", "_+")
NUMBER = r"[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?"
SPECIAL = r"[+-]?(?:inf|infinity|nan)"


def null_pattern(tokens: tuple[str, ...] = NULL_TOKENS) -> str:
    return r"(?i)\A(?:" + "|".join(tokens) + r")\z"


def is_null_token(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """A missing value: SQL's null, or a text that is one of the tokens as a whole, in any case."""
    return c.isNull() | c.rlike(null_pattern(tokens))


def to_double(c: Column) -> Column:
    """The number a text spells in the usual notation (blanks around, digits grouped by _, inf and nan allowed); else null."""
    plain = F.regexp_replace(F.regexp_replace(c, "_", ""), r"\s", "")
    special = F.lower(F.regexp_replace(F.trim(c), r"^[+-]", ""))
    sign = F.when(F.trim(c).startswith("-"), -1.0).otherwise(1.0)
    inf = F.when(special == "nan", F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(c.rlike(rf"\A\s*{NUMBER}\s*\z"), plain.try_cast("double")).when(c.rlike(rf"(?i)\A\s*{SPECIAL}\s*\z"), inf)


def is_int(d: Column) -> Column:
    """Whether a number, as to_double gives it, is whole."""
    return F.coalesce((d == F.floor(d).cast("double")) & ~d.isNaN() & (F.abs(d) != float("inf")), F.lit(False)) | F.coalesce(F.abs(d) > 9e15, F.lit(False)) & (F.abs(d) != float("inf")) & ~d.isNaN()


def finite(d: Column) -> Column:
    return F.when(~d.isNaN() & (F.abs(d) != float("inf")), d)


def significant_digits(c: Column) -> Column:
    """How many digits of a number's text count: neither leading nor trailing zeros, nor those of the exponent."""
    plain = F.translate(c, "+-_ ", "")
    plain = F.when(plain.rlike("[^0-9.]"), F.regexp_replace(F.regexp_replace(plain, r"[eE].*$", ""), r"[^\d.]", "")).otherwise(plain)
    return F.length(F.ltrim(F.translate(F.rtrim(plain, F.lit("0")), ".", ""), F.lit("0")))


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FORMATS = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%dt%H:%M:%S.%fz", "%m/%d/%y %H:%M", "%m/%d/%Y %H:%M", "%Y%m%dT%H%M%S", "%Y-%m-%d",
    "%m/%d/%Y", "%m/%d/%y", "%b %d, %Y", "%B %d, %Y", "%d%b%y", "%b-%d-%y", "%m%d%Y", "%H:%M:%S.%f",
)
_DIRECTIVES = {
    "Y": r"(\d\d\d\d)", "y": r"(\d\d)", "m": r"(1[0-2]|0[1-9]|[1-9])", "d": r"(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])", "H": r"(2[0-3]|[0-1]\d|\d)", "M": r"([0-5]\d|\d)",
    "S": r"(6[0-1]|[0-5]\d|\d)", "f": r"([0-9]{1,6})", "b": "(" + "|".join(m[:3] for m in MONTHS) + ")", "B": "(" + "|".join(MONTHS) + ")",
}


def format_pattern(fmt: str) -> tuple[str, list[str]]:
    """A date format as a regular expression, and the directive of each group."""
    out, names = "", []
    for part in re.split(r"(%[a-zA-Z]|\s+)", fmt):
        if part.startswith("%") and len(part) == 2:
            out += _DIRECTIVES[part[1]]
            names.append(part[1])
        elif part.isspace():
            out += r"\s+"
        else:
            out += re.escape(part)
    return rf"(?i)\A{out}\z", names


def without_day_suffix(c: Column) -> Column:
    """Texts without such a suffix, the most, are told without a regular expression."""
    return F.when(either([F.contains(c, F.lit(s)) for s in ("st", "nd", "rd", "th")]), F.regexp_replace(c, r"(\d{1,2})(?:st|nd|rd|th)", "$1")).otherwise(c)


def parse_date(c: Column, fmt: str) -> Column:
    """The time that a text gives in this format, else null; missing parts are those of 1900-01-01 00:00:00."""
    return F.when(c.rlike(format_pattern(fmt)[0]), made_date(c, fmt))


def made_date(c: Column, fmt: str) -> Column:
    """The time of a text that fits the format; null if its parts make none."""
    pattern, names = format_pattern(fmt)
    part = {n: F.regexp_extract(c, pattern, i + 1) for i, n in enumerate(names)}
    number = {n: F.trim(p).try_cast("int") for n, p in part.items()}
    year = number.get("Y", F.lit(1900))
    if "y" in number:
        year = number["y"] + F.when(number["y"] <= 68, 2000).otherwise(1900)
    month = number.get("m", F.lit(1))
    for n in "bB":
        if n in part:
            names_ = F.array(*[F.lit(m[:3] if n == "b" else m) for m in MONTHS])
            month = F.array_position(names_, F.lower(part[n])).cast("int")
    second = number.get("S", F.lit(0)).cast("decimal(16,6)")
    if "f" in part:
        second = second + F.rpad(part["f"], 6, "0").cast("decimal(16,6)") / F.lit(1_000_000).cast("decimal(16,6)")
    day, hour, minute = number.get("d", F.lit(1)), number.get("H", F.lit(0)), number.get("M", F.lit(0))
    made = F.try_make_timestamp_ntz(year, month, day, hour, minute, second.cast("decimal(16,6)"))
    return F.when(number["S"] <= 59, made) if "S" in number else made


def date_ladder(c: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """(time, format) of the first format that fits, null if none does.

    The signs in a format, which a text in it must have, tell which formats are tried; none for texts that are too long
    or too short, or have no digit. The first whose pattern fits counts: if its parts make no time (a 30th of February),
    no other pattern fits that would make one.
    """
    clean = without_day_suffix(c)

    def first(own: list[str]) -> Column:
        out = F.lit(None)
        for f in reversed(own):
            out = F.when(clean.rlike(format_pattern(f)[0]), F.struct(made_date(clean, f).alias("time"), F.lit(f).alias("format"))).otherwise(out)
        return out

    signs = {s: [f for f in formats if s in re.sub(r"%[A-Za-z]", "", f)] for s in "/-,"}
    rest = [f for f in formats if not any(f in own for own in signs.values())]
    found = F.when(F.contains(clean, F.lit("/")), first(signs["/"])).when(F.contains(clean, F.lit("-")), first(signs["-"])).when(F.contains(clean, F.lit(",")), first(signs[","])).otherwise(first(rest))
    found = F.when(F.length(clean).between(5, 100) & clean.rlike("[0-9]"), found)
    return F.get(F.filter(F.array(found), lambda x: x["time"].isNotNull()), F.lit(0))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def split_words(c: Column) -> Column:
    """What white space separates, without punctuation at either end; empty rests are dropped."""
    parts = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.filter(parts, lambda w: w != "")


def bin_index(x: Column, low: Column, high: Column, bins: Column) -> Column:
    """The equal-width bin of x, the last bin closed; 0 where there is but one value."""
    place = F.floor((x - low) / (high - low) * bins)
    return F.when(high > low, F.least(place, (bins - 1).cast("bigint"))).otherwise(F.lit(0)).cast("int")


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
