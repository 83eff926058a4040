"""Readers: formats, encodings, headers, payloads, what can't be read; round trips of records."""

from __future__ import annotations

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import texts
from plumbline.sources import avro, files, heads, jsons, remote


def put(path, data: bytes | str) -> str:
    path.write_bytes(data.encode() if isinstance(data, str) else data)
    return f"file://{path}"


def test_encodings(spark, tmp_path) -> None:
    for name in ("utf-8", "utf-8-sig", "utf-16", "utf-32", "latin-1", "windows-1252"):
        body = "name;size\nété;1\nnaïve;2\n" + ("“x”;3\n" if name == "windows-1252" else "")
        path = put(tmp_path / name, body.encode(name))
        assert heads.encoding(heads.head(spark, path)) == name
        got = {tuple(r) for r in files.read(spark, path).collect()}
        assert {("été", "1"), ("naïve", "2")} <= got and len(got) == body.count("\n") - 1, name
        lines = put(tmp_path / f"{name}.txt", "Été comme hiver, toujours là\nligne deux\n".encode(name) if name != "windows-1252" else "“Été” toujours là\nligne deux\n".encode(name))
        assert files.read(spark, lines, "text").collect()[-1]["value"] == "ligne deux"
        assert "Été" in files.read(spark, lines, "text").collect()[0]["value"]


def test_csv_shapes(spark, tmp_path) -> None:
    over = put(tmp_path / "q.csv", 'a,b\n"x\ny",1\nz,2\n')
    assert {tuple(r) for r in files.read(spark, over).collect()} == {("x\ny", "1"), ("z", "2")}
    title = put(tmp_path / "t.csv", "Some report of ours\n\nTime@Activity@Notes\n10:00@run@\n11:00@swim@cold\n12:00@rest@long\n13:00@run@hot\n")
    got = files.read(spark, title)
    assert got.columns == ["Time", "Activity", "Notes"] and got.count() == 4
    assert heads.header_row([["1", "2"], ["3", "4"], ["5", "6"]]) is None
    single = put(tmp_path / "s.csv", "10,\n20,\n30,\n")
    assert files.read(spark, single, "csv").columns == ["_c0"] and [r[0] for r in files.read(spark, single, "csv").collect()] == ["10", "20", "30"]
    other = put(tmp_path / "o.csv", "a|b\n'x|y'|1\n'p|q'|2\n'r'|3\n")
    assert heads.quote(heads.lines(heads.head(spark, other))) == "'" and files.read(spark, other).collect()[0]["a"] == "x|y"
    sampled = files.read(spark, over, options=files.ReadOptions(sample_rows=1))
    assert sampled.count() == 1
    for bad in ({"delimiter": "ab"}, {"header": -2}, {"kind": "x"}, {"sample_rows": 0}):
        with pytest.raises(ValueError):
            files.ReadOptions(**bad).check()
    assert files.read(spark, over, columns=["b"]).columns == ["b"]


def test_json_lines_keep_all(spark, tmp_path) -> None:
    path = put(tmp_path / "l.json", '{"a": {"b": 1}}\n{"a": {"b": 2}, "c": [1, 2]}\nbroken {\n{"a": {"b": 3}}\n')
    s = files.Source(spark, path)
    assert s.kind == "json" and sorted(r["a.b"] for r in s.data.collect()) == ["1", "2", "3"]
    assert [r["value"] for r in s.bad_lines.collect()] == ["broken {"]
    assert {json.dumps(json.loads(r["value"]), sort_keys=True) for r in s.records().collect()} == {'{"a": {"b": "1"}}', '{"a": {"b": "2"}, "c": "[\\"1\\",\\"2\\"]"}', '{"a": {"b": "3"}}'}


def test_json_payload(spark, tmp_path) -> None:
    tree = {"meta": {"version": 2, "tags": ["x", "y"]}, "data": [{"id": 1, "p": {"q": "a"}}, {"id": 2}, {"id": 3, "p": {"q": "b"}}], "payload": {"z": [{"k": 1}, {"k": 2}]}}
    path = put(tmp_path / "d.json", json.dumps(tree, indent=1))
    s = files.Source(spark, path)
    assert s.kind == "json" and s.data.columns == ["data.id", "data.p.q"] and s.data.count() == 3
    assert s.metadata.collect()[0]["meta.version"] == "2" and s.metadata.collect()[0]["meta.tags"] == '["x", "y"]'
    assert s.data_and_metadata.count() == 3 and set(s.data.columns) < set(s.data_and_metadata.columns)
    assert jsons.coalesced([{"a": 1}, {"a": 2}, {"b": 3}]) == [{"a": 1, "b": 3}, {"a": 2}]
    assert texts.nested({"a.b": 1, "a.c.d": 2, "e": 3}) == {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert files.from_dicts(spark, [{"a": {"b": 1}}, {"c": None}]).columns == ["a.b", "c"]


def test_avro(spark, tmp_path) -> None:
    dicts = [{"id": k, "at": {"x": k * 2, "y": None if k % 2 else "t"}} for k in range(300)]
    for codec in ("null", "deflate"):
        path = put(tmp_path / f"{codec}.avro", avro.packed(dicts, codec))
        s = files.Source(spark, path)
        assert s.kind == "avro" and s.encoding is None and s.data.columns == ["id", "at.x", "at.y"]
        assert {tuple(r) for r in s.data.collect()} == {(str(k), str(2 * k), None if k % 2 else "t") for k in range(300)}
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": {"type": "array", "items": "int"}}, {"name": "c", "type": {"type": "enum", "name": "e", "symbols": ["P", "Q"]}}, {"name": "d", "type": {"type": "map", "values": "double"}}]}
    data = b"\x03" + b"\x04\x02\x04\x00" + b"\x02" + b"\x02\x02k" + b"\x00\x00\x00\x00\x00\x00\xf0\x3f" + b"\x00"
    assert avro.decode(io.BytesIO(data), schema, {}) == {"a": -2, "b": [1, 2], "c": "Q", "d": {"k": 1.0}}
    assert avro.nested_keys([{"a": 1}, {"b": {"c": 2}}]) == {"a": None, "b": {"c": None}}
    assert avro.text_schema({"a": None})["fields"] == [{"name": "a", "type": ["null", "string"]}]


def test_source(spark, sf_dir, tmp_path) -> None:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = files.Source(spark, f"{sf_dir}/nation.parquet")
    assert s.kind == "parquet" and len(s) == nation.count() and s.columns == nation.columns
    assert json.loads(s.records().first()["value"]).keys() <= set(nation.columns)
    parts = [b.count() for b in s.batches(10, 3)]
    assert sum(parts) == len(s) and len(parts) == -(-len(s) // 10)
    assert sum(map(len, s.lines(7))) == len(s)
    own = files.Source(spark, None, nation.select(*[F.col(c).cast("string") for c in nation.columns]))
    lines = [r["value"] for r in own.records().collect()]
    assert sorted(map(tuple, csv.reader(lines[1:]))) == sorted(tuple(map(str, r)) for r in nation.collect()) and lines[0] == ",".join(nation.columns)
    with pytest.raises(ValueError):
        files.Source(spark)
    with pytest.raises(NotImplementedError):
        own.tokenize()
    assert files.from_buffer(spark, io.StringIO("a,b\n1,2\n3,4\n"), f"file://{tmp_path}").data.columns == ["a", "b"]
    assert own.reload(frame=nation.limit(2)).data.count() == 2
    cut = files.Source(spark, None, spark.createDataFrame([("abcdefg",), ("",)], "value string"), files.ReadOptions(samples_per_line=3))
    assert [r[0] for r in cut.text().collect()] == ["abc", "def", "g", ""]
    graph = files.Source(spark, put(tmp_path / "g.csv", "node_id_dst,node_id_src,weight\n1,2,0.5\n2,3,1.5\n2,1,2.5\n"))
    assert graph.kind == "graph" and {tuple(r) for r in graph.edges().collect()} == {("1", "2", 2.5), ("2", "3", 1.5)}
    s.options = files.ReadOptions()
    own.encoding = "utf-16"
    assert own.options.encoding == "utf-16"
    with pytest.raises(ValueError):
        own.encoding = "ebcdic"
    assert [r[0] for r in files.from_lines(spark, ["a\n", "b"]).collect()] == ["a", "b"]


def test_remote(spark, tmp_path) -> None:
    import threading
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    assert remote.is_url("https://example.org/a.csv") and not remote.is_url("/a.csv") and not remote.is_url(3)
    assert remote.is_s3("s3://bucket/key") and not remote.is_s3("s3://bucket") and remote.s3_path(spark, "s3n://b/k", "id", "key") == "s3a://b/k"
    put(tmp_path / "w.csv", "a,b\n1,2\n3,4\n")
    handler = type("H", (SimpleHTTPRequestHandler,), {"__init__": lambda self, *a, **k: SimpleHTTPRequestHandler.__init__(self, *a, directory=str(tmp_path), **k), "log_message": lambda *a: None})
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = files.from_url(spark, f"http://127.0.0.1:{server.server_port}/w.csv", f"file://{tmp_path}")
        assert {tuple(r) for r in got.data.collect()} == {("1", "2"), ("3", "4")}
        with pytest.raises(ValueError):
            remote.fetched(spark, f"http://127.0.0.1:{server.server_port}/w.csv", f"file://{tmp_path}", most=3)
    finally:
        server.shutdown()


def test_kernels() -> None:
    assert [texts.cell_type(x) for x in ("", "12", "1.5", "2020-01-31", "Word", "WORD", "10:30")] == ["none", "int", "float", "date", "str", "upstr", "date"]
    assert texts.split_pattern(",").split('a,"b,c",d') == ["a", '"b,c"', "d"] and texts.split_pattern(None) is None
    assert texts.nth_place("a,,b,c", ",", 2) == (4, 2) and texts.nth_place("a,b", ",", 5) == (3, 1) and texts.nth_place("", ",", 1) == (-1, 0)
    assert texts.int_text("7.0") == "7" and texts.utf8([b"a", {"k": b"b"}]) == ["a", {"k": "b"}] and texts.node_id("12") == 12 and texts.node_id("x1") == "x1"
    assert [*texts.chunks([1, 2, 3], 2)] == [[1, 2], [3]] and texts.spread(None, 1) == 0 and texts.spread(1, 3) == 2
    assert texts.union([1, 2], None) == [1, 2] and texts.union(None, None) is None and texts.updated({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert texts.added({"a": {"x": 1}, "b": 2}, {"a": {"x": 2, "y": 1}}) == {"a": {"x": 3, "y": 1}, "b": 2}
    assert texts.overlap((0, 5), (5, 9)) and not texts.overlap((0, 4), (5, 9)) and texts.significant(0.012345, 2) == 0.012
    with pytest.raises(ValueError):
        texts.int_text("7.5")
