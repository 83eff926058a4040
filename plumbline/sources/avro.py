"""Avro container files without any package: decoded in Python, file by file, over Arrow batches.

A file is one task's work, as its blocks are of unknown places; tables of many files are read in parallel. Null, deflate
and (where zstandard is there) zstandard blocks are known.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.sources.jsons import text, walk

MAGIC = b"Obj\x01"
META = {"type": "map", "values": "bytes"}


def _long(f: io.BytesIO) -> int:
    shift = value = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        value |= (b[0] & 0x7F) << shift
        shift += 7
        if not b[0] & 0x80:
            return (value >> 1) ^ -(value & 1)


def _blocks(f: io.BytesIO, item: object) -> Iterator:
    while n := _long(f):
        if n < 0:
            n = -n
            _long(f)
        for _ in range(n):
            yield item()


def decode(f: io.BytesIO, schema: object, names: dict[str, object]) -> object:
    """One value of a schema; named types are looked up, and learned, in `names`."""
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)) and isinstance(schema, dict):
        return decode(f, kind, names)
    if isinstance(schema, list):
        return decode(f, schema[_long(f)], names)
    if isinstance(schema, dict) and "name" in schema:
        names[schema["name"]] = names[f"{schema.get('namespace', '')}.{schema['name']}"] = schema
    if kind == "null":
        return None
    if kind == "boolean":
        return f.read(1) == b"\x01"
    if kind in ("int", "long"):
        return _long(f)
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", f.read(4 if kind == "float" else 8))[0]
    if kind in ("bytes", "string"):
        data = f.read(_long(f))
        return data.decode("utf-8", "replace") if kind == "string" else data
    if kind == "fixed":
        return f.read(schema["size"])
    if kind == "enum":
        return schema["symbols"][_long(f)]
    if kind == "array":
        return list(_blocks(f, lambda: decode(f, schema["items"], names)))
    if kind == "map":
        return dict(_blocks(f, lambda: (f.read(_long(f)).decode(), decode(f, schema["values"], names))))
    if kind == "record":
        return {x["name"]: decode(f, x["type"], names) for x in schema["fields"]}
    return decode(f, names[kind], names)


def header(f: io.BytesIO) -> tuple[object, str, bytes]:
    """Schema, codec and marker of a container file."""
    if f.read(4) != MAGIC:
        raise ValueError("no Avro file")
    meta = decode(f, META, {})
    return json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null").decode(), f.read(16)


def rows(data: bytes) -> Iterator[object]:
    """All values of a container file."""
    f = io.BytesIO(data)
    schema, codec, marker = header(f)
    names: dict[str, object] = {}
    while f.tell() < len(data):
        n, block = _long(f), f.read(_long(f))
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec == "zstandard":
            import zstandard

            block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
        elif codec != "null":
            raise ValueError(f"blocks of codec {codec} can't be read")
        own = io.BytesIO(block)
        for _ in range(n):
            yield decode(own, schema, names)
        if f.read(16) != marker:
            raise ValueError("a block doesn't end with the file's marker")


def _leaf(x: object) -> object:
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, dict):
        return {k: _leaf(v) for k, v in x.items()}
    return [_leaf(v) for v in x] if isinstance(x, list) else x


def nested_keys(dicts: Iterator[dict]) -> dict[str, object]:
    """The keys of all dictionaries as a tree; leaves are None."""
    out: dict[str, object] = {}
    for d in dicts:
        for k, v in d.items():
            if isinstance(v, dict):
                out[k] = _merged(out.get(k), nested_keys([v]))
            else:
                out.setdefault(k, None)
    return out


def _merged(a: dict | None, b: dict) -> dict:
    out = dict(a or {})
    for k, v in b.items():
        out[k] = _merged(out.get(k), v) if isinstance(v, dict) else out.get(k)
    return out


def text_schema(keys: dict[str, object], name: str = "root") -> dict[str, object]:
    """An Avro schema of nullable texts for a tree of keys."""
    fields = [{"name": k, "type": ["null", text_schema(v, f"{name}_{k}") if isinstance(v, dict) else "string"]} for k, v in keys.items()]
    return {"type": "record", "name": name, "fields": fields}


def paths(schema: object, names: dict[str, object] | None = None, path: str = "", separator: str = ".") -> list[str]:
    """The dotted paths of a schema's leaves, records within records (and unions with null) walked."""
    names = {} if names is None else names
    if isinstance(schema, list):
        real = [s for s in schema if s != "null"]
        return paths(real[0], names, path, separator) if len(real) == 1 else [path]
    if isinstance(schema, dict) and isinstance(schema["type"], (dict, list)):
        return paths(schema["type"], names, path, separator)
    if isinstance(schema, str) and schema in names:
        schema = names[schema]
    if isinstance(schema, dict) and schema["type"] == "record":
        if schema["name"] in path.split(separator)[:-1]:
            return [path]
        names[schema["name"]] = schema
        return [p for f in schema["fields"] for p in paths(f["type"], names, f"{path}{separator}{f['name']}" if path else f["name"], separator)]
    return [path]


def read(spark: SparkSession, path: str, head: bytes, separator: str = ".") -> DataFrame:
    """The files as text columns, named by the first file's schema."""
    schema, _, _ = header(io.BytesIO(head))
    names = paths(schema, None, "", separator)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                part: list[dict] = []
                for value in rows(data.as_py()):
                    part.append({k: v for leaf in walk(_leaf(value), "", separator) for k, v in leaf.items()})
                    if len(part) == 5000:
                        yield _batch(part, names)
                        part = []
                yield _batch(part, names)

    out = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, out)


def _batch(part: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([text(r.get(n)) for r in part], pa.string()) for n in names], names=names)


def _number(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def _encoded(x: object, schema: object) -> bytes:
    """A value of a schema that text_schema() made."""
    if isinstance(schema, list):
        return _number(0) if x is None else _number(1) + _encoded(x, schema[1])
    if schema == "string":
        data = str(x).encode()
        return _number(len(data)) + data
    return b"".join(_encoded(x.get(f["name"]), f["type"]) for f in schema["fields"])


def packed(dicts: list[dict], codec: str = "deflate") -> bytes:
    """A container file of nested dictionaries, all leaves as texts."""
    schema = text_schema(nested_keys(dicts))
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    marker = struct.pack("<QQ", 0x706C756D626C696E, len(dicts))
    out = MAGIC + _number(len(meta)) + b"".join(_number(len(k)) + k.encode() + _number(len(v)) + v for k, v in meta.items()) + _number(0) + marker
    block = b"".join(_encoded(d, schema) for d in dicts)
    if codec == "deflate":
        block = zlib.compress(block, 6)[2:-4]
    return out + _number(len(dicts)) + _number(len(block)) + block + marker if dicts else out
