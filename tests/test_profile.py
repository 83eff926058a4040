"""Profiles, their sums and differences, streams, files and labels."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline import runtime
from plumbline.operators import graph, labels, rows
from plumbline.plans import factory, graphs, options, profile, text
from plumbline.plans.options import Options, Structured
from plumbline.reports import plots
from plumbline.sources import files
from plumbline.streaming import incremental

COLUMNS = ("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*COLUMNS)


def test_profile_adds_up(orders) -> None:
    whole = profile.of(orders)
    even, odd = profile.of(orders.filter("o_orderkey % 2 = 0")), profile.of(orders.filter("o_orderkey % 2 = 1"))
    both = profile.merged([even, odd])
    for c in COLUMNS:
        x, y = whole.columns[c], both.columns[c]
        a, b = x.report()["statistics"], y.report()["statistics"]
        assert x.data_type == y.data_type and a["sample_size"] == b["sample_size"] and a["null_types_count"] == b["null_types_count"]
        for k in ("mean", "variance", "skewness", "kurtosis", "min", "max", "num_zeros"):
            if k in a:
                assert a[k] == b[k] or a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6)
        if "median" in a:
            assert b["median"] == pytest.approx(a["median"], rel=0.01)
    assert whole.columns["o_orderstatus"].values == both.columns["o_orderstatus"].values
    assert whole.columns["o_orderstatus"].characters == both.columns["o_orderstatus"].characters == ["F", "O", "P"]
    assert whole.columns["o_orderdate"].dates == both.columns["o_orderdate"].dates
    assert whole.columns["o_totalprice"].precision.report()["sample_size"] == both.columns["o_totalprice"].precision.report()["sample_size"]
    assert [whole.columns[c].data_type for c in COLUMNS] == ["int", "float", "string", "datetime"]
    assert even.update(orders.filter("o_orderkey % 2 = 1")).rows["n_rows"] == whole.rows["n_rows"]
    with pytest.raises(ValueError):
        whole + profile.of(orders.select("o_orderkey"))


def test_texts_as_read_from_files(spark) -> None:
    """All columns are texts: types, dates as written, nulls by token, precision, order as numbers."""
    rows = [(str(k), f"{k}.{k % 7}50", f"May {k % 28 + 1}, 2020", ["", "nan", " -- ".strip(), "x"][k % 4], f"2020-01-{k % 28 + 1:02d}" if k else "none") for k in range(8, 108)]
    df = spark.createDataFrame(rows, "i string, f string, may string, gap string, day string").coalesce(1)
    p = profile.of(df, Options.preset("complete"))
    kinds = {c: s.data_type for c, s in p.columns.items()}
    assert kinds == {"i": "int", "f": "float", "may": "datetime", "gap": "string", "day": "datetime"}
    assert p.columns["i"].order.order == "ascending" and p.columns["day"].order.order == "random"
    assert p.columns["may"].dates.formats == ["%B %d, %Y"] and p.columns["may"].dates.low[1] == "May 1, 2020"
    assert p.columns["gap"].null_types == {"": 25, "nan": 25, "--": 25}
    assert p.columns["f"].precision.report()["max"] == 5 and p.rows["row_has_null_ratio"] == 0.75
    assert p.correlation["i", "f"] == pytest.approx(1.0, abs=1e-4)
    assert p.report()["data_stats"]["may"]["statistics"]["format"] == ["%B %d, %Y"]


def test_many_values_stay_in_spark(spark) -> None:
    df = spark.range(5000).selectExpr("cast(id as string) a", "cast(id % 3 as string) b", "if(id % 2 = 0, 'same', cast(id as string)) c")
    p = profile.of(df, Structured().set({"category.most_values": 100}))
    assert p.columns["a"].counts.unique == 5000 and p.columns["a"].values is None and not p.columns["a"].counts.categorical
    assert p.columns["b"].values == {"0": 1667, "1": 1667, "2": 1666}
    c = p.columns["c"].counts
    assert c.unique == 2501 and c.gini == pytest.approx(1 - (2500 * 2500 + 2500) / 5000**2)
    stopped = profile.of(df, Structured().set({"category.stop_at": 1000, "category.stop_ratio": 0.5})).columns["a"].counts
    assert stopped.estimated and stopped.unique == pytest.approx(5000, rel=0.1)


def test_replication_adds_up(spark) -> None:
    df = spark.createDataFrame([(float(k), None if k % 3 else float(k * k), None if k % 5 == 0 else 1.0 * k) for k in range(60)], "a double, b double, c double")
    o = Structured().set({"null_replication.enabled": True})
    whole, parts = profile.of(df, o), [profile.of(df.filter(f"a % 2 = {r}"), o) for r in (0, 1)]
    both = profile.merged(parts)
    assert whole.replication.keys() == both.replication.keys() and ("b", "a") in whole.replication
    for key, figures in whole.replication.items():
        assert {k: both.replication[key][k] for k in figures} == pytest.approx(figures)


def test_save_diff_formats(orders, spark, tmp_path) -> None:
    p = profile.of(orders, Options.preset("complete"))
    p.save(f"file://{tmp_path}/p.json", spark)
    back = profile.Profile.load(f"file://{tmp_path}/p.json", spark)
    assert back.report() == p.report() and back.options == p.options
    same = p.diff(back)
    assert set(same["global_stats"].values()) == {"unchanged"} and same["data_stats"]["o_totalprice"]["statistics"]["mean"] == "unchanged"
    assert same["data_stats"]["o_totalprice"]["statistics"]["psi"] == 0 and same["data_stats"]["o_totalprice"]["statistics"]["precision"] == "unchanged"
    assert same["data_stats"]["o_orderdate"]["statistics"]["min"] == "unchanged" and same["data_stats"]["o_orderstatus"]["statistics"]["vocab"] == "unchanged"
    later = p.diff(profile.of(orders.filter("o_orderkey > 100")))["data_stats"]["o_orderdate"]["statistics"]
    assert later["format"] == "unchanged" and (later["min"] == "unchanged" or later["min"][0] in "+-")
    assert "histogram" not in p.report("compact")["data_stats"]["o_totalprice"]["statistics"]
    assert all(not isinstance(v, dict) or not v for v in p.report("flat").values())
    assert "mean" not in p.report(omit_keys=("data_stats.*.statistics.mean",))["data_stats"]["o_totalprice"]["statistics"]
    assert len(p.report(quantile_groups=10)["data_stats"]["o_totalprice"]["statistics"]["quantiles"]) == 9
    assert json.dumps(p.report("pretty"))
    with pytest.raises(ValueError):
        p.report("other")


def test_options(orders) -> None:
    o = Options().set({"structured.numeric.min": False, "*.histogram.enabled": False, "category.top_k": 2})
    got = profile.of(orders, o).report()["data_stats"]
    assert "min" not in got["o_totalprice"]["statistics"] and "histogram" not in got["o_totalprice"]["statistics"]
    assert len(got["o_orderstatus"]["statistics"]["categorical_count"]) == 2
    assert Options.of(o.to_dict()) == o and "category" in o.structured.enabled()
    for wrong in ({"numeric.sum": False}, {"histogram.method": "x"}, {"rows.unique": "y"}, {"category.stop_ratio": 2.0}, {"mode.top_k": 0}, {"category.enabled": False}):
        with pytest.raises(ValueError):
            Options().set(wrong)
    with pytest.raises(ValueError):
        Options().set({"labeler.enabled": True})  # a table's or a text's?
    with pytest.raises(AttributeError):
        Options().set({"structured.nothing": 1})
    with pytest.raises(ValueError):
        Options.preset("none")

    @options.plugin("preset", "only_types")
    def only(o: Options) -> None:
        o.structured.set({"numeric.enabled": False})

    assert "mean" not in profile.of(orders, Options.preset("only_types")).report()["data_stats"]["o_totalprice"]["statistics"]
    assert "only_types" in options.plugins("preset") and options.load_plugins() == []


def test_custom_statistic_and_merged_options(orders) -> None:
    @options.plugin("column", "letters")
    class Letters(options.ColumnStatistic):
        def aggregate(self, column):
            return F.sum(F.length(column))

        def merge(self, a, b):
            return a + b

        def finish(self, x):
            return {"total": x}

    o = Structured(custom=("letters",))
    even, odd = (profile.of(orders.filter(f"o_orderkey % 2 = {k}"), o) for k in (0, 1))
    whole = profile.of(orders, o)
    assert (even + odd).columns["o_orderstatus"].custom == whole.columns["o_orderstatus"].custom == {"letters": orders.count()}
    assert profile.Profile.from_json(whole.to_json()).report()["data_stats"]["o_orderstatus"]["statistics"]["letters"] == {"total": orders.count()}
    with pytest.warns(RuntimeWarning):
        both = even + profile.of(orders.filter("o_orderkey % 2 = 1"), Structured(custom=("letters",)).set({"numeric.min": False}))
    assert "min" not in both.report()["data_stats"]["o_totalprice"]["statistics"]
    with pytest.raises(ValueError):
        even + profile.of(orders, Structured().set({"labeler.cells": 5}))
    with pytest.raises(ValueError):
        Structured(custom=("none",)).check()


def test_samples(spark) -> None:
    assert rows.sample_size(100) == 100 and rows.sample_size(10_000) == 5000 and rows.sample_size(100_000) == 20_000
    df = spark.range(20_000)
    assert 4000 < rows.sampled(df).count() < 6000 and rows.sampled(df.limit(10)).count() == 10
    assert [r[0] for r in rows.shuffled(spark.range(50), 1).collect()] != list(range(50))


def test_factory(spark, sf_dir, tmp_path) -> None:
    assert factory.profiler(files.Source(spark, f"{sf_dir}/nation.parquet")).file_type == "parquet"
    assert factory.profiler([{"a": 1}, {"a": 2}], spark=spark).columns["a"].data_type == "int"
    t = factory.profiler(["one two two", "", None], spark=spark)
    assert t.top_words() == {"two": 2, "one": 1} or t.top_words() == {}
    assert factory.profiler("some words here", spark=spark).n_lines == 1
    (tmp_path / "g.csv").write_text("node_id_dst,node_id_src,w\n1,2,0.5\n2,3,1.5\n5,6,1.25\n")
    g = factory.profiler(files.Source(spark, f"file://{tmp_path}/g.csv"))
    assert (g.num_nodes, g.num_edges, g.global_max_component_size) == (5, 3, 2)
    with pytest.raises(TypeError):
        factory.profiler(3, spark=spark)
    with pytest.raises(ValueError):
        factory.profiler("x", kind="y", spark=spark)


def test_text_profile(spark, tmp_path) -> None:
    df = spark.createDataFrame([("Blue sky, blue sea. Mail me: a@b.org",), ("  ",), ("Sea and sky",)], "value string")
    o = Options().set({"unstructured.text.case_sensitive": False, "unstructured.labeler.enabled": True})
    p = text.of(df, None, o)
    assert (p.n_lines, p.empty_lines) == (3, 1) and p.top_words(2) == {"blue": 2, "sea": 2}
    assert p.entities["word_count"]["EMAIL_ADDRESS"] == 1 and p.entities["true_char_count"]["EMAIL_ADDRESS"] == 7 and sum(p.percentages("word_count").values()) == pytest.approx(1)
    p.save(spark, f"file://{tmp_path}/t")
    back = text.TextProfile.load(spark, f"file://{tmp_path}/t")
    assert back.report() == p.report()
    both = p + back
    assert both.n_lines == 6 and both.top_words(1) == {"blue": 4} and both.vocab_count["S"] == 2 and both.entities["word_count"]["EMAIL_ADDRESS"] == 2
    assert set(p.diff(back)["global_stats"].values()) == {"unchanged"} and p.diff(back)["data_stats"]["text"]["statistics"]["words"] == "unchanged"
    assert p.diff(both)["data_stats"]["text"]["statistics"]["word_count"][1]["blue"] == -2
    assert p.update(df).n_lines == 6
    with pytest.raises(ValueError):
        text.of(df.selectExpr("value", "1 x"))


def test_graph_profile(spark, tmp_path) -> None:
    rows = [(1, 2, 1.0, 2.5), (2, 3, 2.0, 1.7), (3, 4, 3.0, 1.8), (4, 1, 4.0, 4.1), (1, 3, 5.0, 2.1)]
    e = graph.edges(spark.createDataFrame(rows, "s int, t int, id double, weight double"), "s", "t", ["id", "weight"], "id")
    p = graphs.of(e)
    assert (p.num_nodes, p.num_edges, p.avg_node_degree, p.global_max_component_size) == (4, 5, 2.5, 5)
    assert p.categorical_attributes == ["id"] and p.continuous_attributes == ["weight"]
    assert p.categorical_distribution["id"]["bin_counts"] == [1, 1, 1, 2] and p.continuous_distribution["weight"]["properties"][0] == pytest.approx(2.44)
    p.save(spark, f"file://{tmp_path}/g.json")
    assert graphs.GraphProfile.load(spark, f"file://{tmp_path}/g.json") == p
    assert set(map(str, p.diff(p).values())) == {"unchanged"} and p.report("flat")
    assert graphs.attributes(e) == ["id", "weight"] and graphs.attribute_values(e, "id").count() == 5
    with pytest.raises(NotImplementedError):
        p + p
    assert p.update(e.limit(1)).num_edges == 1


def test_plots(orders) -> None:
    p = profile.of(orders)
    assert plots.histograms(p).count("<g ") == 2 and plots.column_histogram(p.columns["o_totalprice"], "a<b").startswith("<svg")
    with pytest.raises(ValueError):
        plots.column_histogram(p.columns["o_orderstatus"])
    gaps = orders.selectExpr("o_orderkey", "if(o_orderkey % 10 < 3, null, 1) x")
    assert plots.missing_matrix(gaps, ["x"], "o_orderkey").count("<rect") > 1


def test_runtime(monkeypatch) -> None:
    runtime.set_seed(5)
    assert runtime.random().integers(1000) == runtime.random().integers(1000) and runtime.seed() == 5
    runtime.set_seed(None)
    monkeypatch.setenv(runtime.SEED_VARIABLE, "7")
    assert runtime.seed() == 7
    times: dict[str, float] = {}
    assert runtime.timed(times, "f")(lambda x: x)(3) == 3 and times["f"] >= 0
    with pytest.raises(ImportError):
        runtime.require("no_such_module_at_all")(lambda: 1)()
    with pytest.raises(ValueError):
        runtime.warned("x", ValueError("y"))
    with pytest.warns(RuntimeWarning):
        runtime.warned("x", TypeError("y"))
    runtime.set_verbosity(30)
    assert runtime.logger("x").getEffectiveLevel() == 30
    with pytest.raises(ValueError):
        runtime.set_seed(-1)


def test_empty_table(orders) -> None:
    got = profile.of(orders.limit(0))
    assert all(c.n_rows == 0 and c.data_type is None for c in got.columns.values())
    assert got.report() and (got + profile.of(orders)).rows["n_rows"] == orders.count()


def test_stream(spark, orders, tmp_path) -> None:
    src = f"{tmp_path}/in"
    orders.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(src)
    o = Structured().set({"histogram.enabled": False})
    q = incremental.start(stream, f"{tmp_path}/states", f"{tmp_path}/checkpoint", o, available_now=True)
    q.awaitTermination(120)
    assert q.exception() is None
    got, want = incremental.current(spark, f"{tmp_path}/states"), profile.of(orders, o)
    assert got.columns["o_orderkey"].n_rows == want.columns["o_orderkey"].n_rows
    assert got.columns["o_totalprice"].moments.mean == pytest.approx(want.columns["o_totalprice"].moments.mean)


def test_entities(spark, sf_dir) -> None:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        for label, pattern in labels.PATTERNS.items():
            rule = re.compile(labels.bounded(pattern), re.ASCII)
            want += [(i, label, m) for m in rule.findall(t)]
            t = rule.sub("\u0001", t)
    assert sorted(tuple(r) for r in labels.entities(docs, "doc_id", "text").collect()) == sorted(want) and want
    df = spark.createDataFrame([("a@b.org", "x"), (None, "10.0.0.1"), ("c@d.com", "hi")], "m string, x string")
    got = {(r["column_name"], r["label"], r["n"]) for r in labels.column_labels(df, ["m", "x"]).collect()}
    assert got == {("m", "EMAIL_ADDRESS", 2), ("x", "UNKNOWN", 2), ("x", "IPV4", 1)}
    names = labels.name_labels(["E-Mail", "email_address", "SSN", "file_name", "quux"])
    assert names["email_address"] == ("EMAIL_ADDRESS", 100.0) and names["SSN"][0] == "SSN" and not {"file_name", "quux"} & set(names)


def test_cells_counted_first(spark) -> None:
    """What follows is worked out once for each different cell: figures are those of all cells, whole numbers' means exact."""
    big = [2**53 + k for k in (1, 3, 3, 3, 5)] * 20
    df = spark.createDataFrame([(b, i % 4 / 2, ["x", "-", "1st May, 2020", None, "ab"][i % 5]) for i, b in enumerate(big)], "b bigint, f double, s string").repartition(3)
    cells = profile._cells(df, df.columns, profile._kinds(df, df.columns, Structured()), Structured())
    assert sorted((r["text"], r["n"]) for r in cells.filter("i = 1").collect()) == [(t, 25) for t in ("0.0", "0.5", "1.0", "1.5")]
    p = profile.of(df)
    b, f, s = (p.columns[c] for c in "bfs")
    assert (b.n_rows, b.counts.unique, b.counts.values[str(2**53 + 3)], b.numbers.moments.mean) == (100, 3, 60, float(sum(big)) / 100)
    assert f.numbers.moments.mean == 0.75 and f.numbers.zeros == 25 and abs(f.numbers.moments.variance(False) - 0.3125) < 1e-12 and f.precision.moments.n == 100
    assert s.null_types == {"-": 20, "NULL": 20} and s.counts.values == {"x": 20, "1st May, 2020": 20, "ab": 20} and s.characters == sorted(set("x1st May, 2020ab"))
    assert (s.lengths.low, s.lengths.high, round(s.lengths.moments.mean, 6)) == (1.0, 13.0, round(16 / 3, 6))


def test_stream_batches_have_many_files(spark, sf_dir) -> None:
    """Each of a stream's three batches is read by all cores."""
    from pathlib import Path

    from plumbline import queries

    shared = Path(runtime.shared_folder(spark).removeprefix("file://"))
    before = set(shared.glob("stream-*"))
    assert queries.queries()["profile_stream"](spark, sf_dir).count() == 6
    folder = (set(shared.glob("stream-*")) - before).pop()
    assert len(list(folder.glob("in/*.parquet"))) == 3 * spark.sparkContext.defaultParallelism and len(list(folder.glob("states/batch=*"))) == 3


def test_graph_edges_worked_out_once(spark) -> None:
    worked = spark.sparkContext.accumulator(0)

    def work(batches):  # noqa: ANN001, ANN202
        for b in batches:
            worked.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(1, 2, 1.0, 2.5), (2, 3, 2.0, 1.7), (5, 6, 3.0, 1.8)], "u bigint, v bigint, id double, weight double")
    p = graphs.of(e.mapInArrow(work, e.schema))
    assert (p.num_nodes, p.num_edges, p.global_max_component_size, worked.value) == (5, 3, 2, 3)


def test_edges_contracted(spark, monkeypatch) -> None:
    """A partition's edges become one edge from each node to the least it is connected with, chunk by chunk."""
    path = [(k + 1, k) for k in range(500)] + [(901, 900), (902, 901), (902, 900)]
    e = spark.createDataFrame(path, "u bigint, v bigint").coalesce(1)
    assert sorted(map(tuple, graph.contracted(e).collect())) == [(k, 0) for k in range(1, 501)] + [(901, 900), (902, 900)]
    named = e.selectExpr("concat('n', u) AS u", "concat('n', v) AS v")
    assert {r["v"] for r in graph.contracted(named).collect()} == {"n0", "n900"}
    monkeypatch.setattr(graph, "CHUNK", 7)
    for x, least in ((e, {0, 900}), (named, {"n0", "n900"}), (e.selectExpr("v AS u", "u AS v").union(e).repartition(3), {0, 900})):
        assert {r["component"] for r in graph.components(x).collect()} == least
