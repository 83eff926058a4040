"""What the head of a file tells: encoding, format, delimiter, quote, header. Only the head is read, wherever the file is.

Files are opened through Hadoop's file systems, so local folders, clusters' stores and object stores are read alike.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter

from pyspark.sql import SparkSession

from plumbline.functions.texts import cell_type, split_pattern

HEAD_BYTES, HEAD_LINES = 65_536, 1000
DELIMITERS = (",", "\t", ";", "|", "@", ":", " ", "^", "~", "#")
PREFERRED = (",", "\t")
QUOTES = ('"', "'")
SOURCE_WORDS, TARGET_WORDS, GRAPH_WORDS = ("src", "source", "from"), ("dst", "target", "to", "dest"), ("node", "vertex")


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of a folder's first file by name."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(place).isDirectory():
        files = fs.listFiles(place, True)
        names = []
        while files.hasNext():
            f = files.next().getPath()
            if not f.getName().startswith(("_", ".")):
                names.append(f.toString())
        if not names:
            return b""
        place = jvm.org.apache.hadoop.fs.Path(min(names))
    size = min(n, fs.getFileStatus(place).getLen())
    stream = fs.open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def encoding(data: bytes) -> str:
    """From the byte order mark, or from the zeros of a UTF-16 or UTF-32 text without one; else UTF-8 where it decodes (a
    character cut off at the end aside); else Windows-1252 where its further characters are used, or Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    if len(data) >= 8 and data.count(0) >= len(data) // 4:
        for name, zeros in (("utf-32-le", data[3::4]), ("utf-32-be", data[0::4]), ("utf-16-le", data[1::2]), ("utf-16-be", data[0::2])):
            if zeros.count(0) >= 0.9 * len(zeros):
                return name
    try:
        data.decode("utf-8")
    except UnicodeDecodeError as e:
        if not (len(data) >= HEAD_BYTES and e.start >= len(data) - 4):
            return "windows-1252" if re.search(rb"[\x80\x82-\x8c\x8e\x91-\x9c\x9e\x9f]", data) else "latin-1"
    return "utf-8"


def java_name(encoding: str) -> str:
    """The name by which Spark's readers know it."""
    names = {"utf-8-sig": "UTF-8", "ascii": "US-ASCII", "latin-1": "ISO-8859-1", "windows-1252": "ISO-8859-1", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}
    return names.get(encoding.lower(), encoding.upper())


#: What Latin-1 has as control characters, and what they are in Windows-1252.
CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore"))
SIGNS = CONTROLS.encode("latin-1").decode("cp1252")


def text(data: bytes) -> str:
    return data.decode(encoding(data), "replace").removeprefix("﻿")


def lines(data: bytes) -> list[str]:
    """The head's lines that aren't blank; the last is left out where it may be cut off."""
    own = text(data).splitlines()
    return [x for x in (own[:-1] if len(data) >= HEAD_BYTES else own) if x.strip()][:HEAD_LINES]


def logical(rows: list[str], quoted_by: str) -> list[str]:
    """Lines that are parts of one quoted field put together."""
    out: list[str] = []
    for x in rows:
        if out and out[-1].count(quoted_by) % 2:
            out[-1] += "\n" + x
        else:
            out.append(x)
    return out if not out or not out[-1].count(quoted_by) % 2 or len(out) > len(rows) // 2 else rows


def quote(rows: list[str]) -> str:
    """The quote that opens or closes most fields."""
    counts = {q: sum(len(re.findall(rf"(?:^|[,;\t|@ ]){q}|{q}(?:$|[,;\t|@ ])", x)) for x in rows) for q in QUOTES}
    return max(QUOTES, key=lambda q: (counts[q] if not counts[q] % 2 or q == '"' else 0, q == '"'))


def delimiter(rows: list[str], quoted_by: str | None = None) -> str | None:
    """The delimiter that cuts most of the last lines into one number of fields, two or more; the preferred ones win ties.

    Lines above a table (a title, say) don't count: widths are compared from the bottom up.
    """
    quoted_by = quoted_by or quote(rows)
    rows = logical(rows, quoted_by)
    best, found = None, None
    for place, d in enumerate(DELIMITERS):
        pattern = split_pattern(d, quoted_by)
        widths = [len(pattern.split(x)) for x in rows[-100:]]
        if not widths:
            continue
        width, n = Counter(widths).most_common(1)[0]
        share = n / len(widths)
        if width > 1 and share >= 0.8:
            score = (round(share, 1), d in PREFERRED, width if d not in (" ", ":") else 0, -place)
            if best is None or score > best:
                best, found = score, d
    return found


def trailing_only(rows: list[str], d: str | None) -> bool:
    """Whether the delimiter occurs once in each line, at its end: then there is but one column."""
    return bool(d and rows) and all(x.count(d) == 1 and x.rstrip()[-1:] == d.strip()[-1:] and x.rstrip().endswith(d.strip() or d) for x in rows)


def header_row(rows: list[list[str]], differs: float = 0.1, empty: float = 0.5, words: float = 0.9) -> int | None:
    """The number of the row that names the columns; None if there is none.

    The first row as wide as the table whose cells are mostly words and filled, and unlike those below: other kinds of
    cells, or all different and never seen again.
    """
    if not rows:
        return None
    width = Counter(map(len, rows[-100:])).most_common(1)[0][0]
    for k, row in enumerate(rows[:25]):
        if len(row) != width:
            continue
        kinds = [cell_type(c.strip()) for c in row]
        if kinds.count("none") > empty * width or sum(x in ("str", "upstr") for x in kinds) < words * (width - kinds.count("none")):
            return None
        below = [r for r in rows[k + 1 :] if len(r) == width]
        if not below:
            return None
        share = [sum(cell_type(r[i].strip()) in ("int", "float", "date") for r in below) / len(below) for i in range(width)]
        if sum(s >= 0.5 for s in share) >= differs * width:
            return k
        unlike = len(set(row)) == width and not any(r[i] == row[i] for r in below for i in range(width))
        return k if unlike and max(len(c.split()) for c in row) <= 4 else None
    return None


def open_quote(rows: list[str], quoted_by: str = '"') -> bool:
    """Whether some line ends within a quoted field, so that fields go over lines."""
    return any(x.count(quoted_by) % 2 for x in rows)


def _column(names: list[str], words: tuple[str, ...]) -> str | None:
    return next((n for n in names for p in re.split(r"[-_.]", n.lower().replace(" ", "")) if p in words), None)


def graph_columns(names: list[str]) -> tuple[str, str] | None:
    """The columns of an edge's ends, if the header speaks of nodes with a source and a target."""
    nodes = [n for n in names if _column([n], GRAPH_WORDS)]
    source, target = _column(nodes, SOURCE_WORDS), _column(nodes, TARGET_WORDS)
    return (source, target) if source and target else None


def is_json(rows: list[str]) -> bool:
    def parses(x: str) -> bool:
        try:
            return isinstance(json.loads(x), (dict, list))
        except ValueError:
            return False

    return bool(rows) and (parses("\n".join(rows)) or rows[0].lstrip()[:1] in "{[" and _opens("\n".join(rows)) or sum(map(parses, rows)) * 2 >= len(rows))


def _opens(x: str) -> bool:
    """Whether a text that is cut off begins as one JSON value over several lines."""
    try:
        json.loads(x)
    except json.JSONDecodeError as e:
        return e.pos >= len(x.rstrip()) - 1
    return True


def is_csv(rows: list[str]) -> bool:
    """At least two lines, cut into as many fields by one delimiter that isn't a blank."""
    d = delimiter(rows) if len(rows) >= 2 else None
    return d is not None and d != " "


def kind(data: bytes) -> str:
    """parquet, avro, json, graph, csv or text."""
    if data.startswith(b"PAR1"):
        return "parquet"
    if data.startswith(b"Obj\x01"):
        return "avro"
    rows = lines(data)
    if is_json(rows):
        return "json"
    if not is_csv(rows):
        return "text"
    d, q = delimiter(rows), quote(rows)
    own = [*csv.reader(io.StringIO("\n".join(rows)), delimiter=d, quotechar=q)]
    k = header_row(own)
    return "graph" if k is not None and graph_columns(own[k]) else "csv"
