"""Small kernels on texts, lists and nested values that readers and reports share; all on the driver."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np

DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|(?:\d{1,2} )?[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?|\d{1,2}:\d{2}(?::\d{2})?")


def cell_type(cell: str) -> str:
    """none, date, int, float, str, or upstr for texts in capitals."""
    if not cell:
        return "none"
    if cell.isupper():
        return "upstr"
    try:
        number = float(cell)
    except ValueError:
        return "date" if DATE.fullmatch(cell.strip()) else "str"
    return "int" if number.is_integer() else "float"


def split_pattern(delimiter: str | None, quote: str | None = '"') -> re.Pattern | None:
    """A delimiter that has an even number of quotes after it, so that quoted ones don't cut."""
    if delimiter is None:
        return None
    q = re.escape(quote or '"')
    return re.compile(f"{re.escape(delimiter)}(?=(?:[^{q}]*{q}[^{q}]*{q})*[^{q}]*$)")


def nth_place(text: str | None, part: str | None, n: int, runs_count_once: bool = True) -> tuple[int, int]:
    """Where the n-th occurrence begins, and n; with fewer, the text's length and how many there are; (-1, 0) for nothing."""
    if not text or not part or n <= 0:
        return -1, 0
    places = [m.start() for m in re.finditer(re.escape(part) + "+" * runs_count_once, text)]
    return (places[n - 1], n) if len(places) >= n else (len(text), len(places))


def int_text(x: object) -> str:
    """A whole number as text without a decimal point; raises ValueError for anything else."""
    number = float(str(x))
    if not number.is_integer():
        raise ValueError(f"no whole number: {x}")
    return str(int(number))


def utf8(data: object, leave_dicts: bool = False) -> object:
    """Bytes in nested values as text, and characters that UTF-8 can't hold replaced."""
    if isinstance(data, bytes):
        return data.decode("utf-8", "replace")
    if isinstance(data, str):
        return data.encode("utf-8", "replace").decode("utf-8")
    if isinstance(data, (list, tuple)):
        return [utf8(x, leave_dicts) for x in data]
    if isinstance(data, dict) and not leave_dicts:
        return {utf8(k): utf8(v) for k, v in data.items()}
    return data


def node_id(text: str) -> int | str:
    return int(text) if text.isdigit() else text


def chunks(items: list, size: int) -> Iterator[list]:
    for lo in range(0, len(items), size):
        yield items[lo : lo + size]


def spread(low: float | None, high: float | None) -> float:
    """high - low; 0 where there is neither."""
    return 0.0 if low is None or high is None else high - low


def plain(x: object) -> object:
    """A NumPy number or array as Python's own."""
    return x.tolist() if isinstance(x, (np.generic, np.ndarray)) else x


def union(a: Iterable | None, b: Iterable | None) -> list | None:
    """All different items of both, in order of appearance; None only where both are."""
    return None if a is None and b is None else list(dict.fromkeys([*(a or ()), *(b or ())]))


def updated(a: dict, b: dict) -> dict:
    """a with b's values, dictionaries within dictionaries alike."""
    return a | {k: updated(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def added(a: dict, b: dict) -> dict:
    """Sums of the values of both, level by level."""
    out = dict(a)
    for k, v in b.items():
        out[k] = v if k not in out else added(out[k], v) if isinstance(v, dict) else out[k] + v
    return out


def overlap(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two closed ranges share a place."""
    return a[0] <= b[1] and b[0] <= a[1]


def nested(flat: dict[str, object], separator: str = ".") -> dict[str, object]:
    """Dotted keys as dictionaries in dictionaries; a value in the way of one gives place."""
    out: dict[str, object] = {}
    for key, value in flat.items():
        at = out
        *path, last = key.split(separator) if isinstance(key, str) else [key]
        for p in path:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[last] = value
    return out


def significant(x: float, digits: int) -> float:
    """x rounded to so many significant digits."""
    return x if not x or math.isnan(x) or math.isinf(x) else round(x, digits - 1 - math.floor(math.log10(abs(x))))
