"""Token files, sharding, fingerprints, LM scoring, license scans: round trips, brute force, odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from plumbline.llm import bpe, common, fingerprints, licenses, lm_score, sharding, token_files


def stripped(uri: str) -> str:
    return uri.removeprefix("file://")


def test_token_files_round_trip(documents, tmp_path) -> None:
    index = token_files.write(documents, f"file://{tmp_path}/t", length=64).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    tok = bpe.ByteBPE(bpe.vocabulary(bpe.VOCABULARY))
    assert sorted(r["doc_id"] for r in index) == sorted(texts)
    opened = {}
    used = Counter()
    for r in index:
        s = opened.setdefault(r["file"], token_files.Sequences(r["file"]))
        ids = s.tokens(r["first_row"], r["first_pos"], r["n_tokens"])
        assert ids[-1] == 50256 and tok.decode(ids[:-1].astype(np.int64)) == texts[r["doc_id"]].encode()
        used[r["file"]] += r["n_tokens"]
    for name, s in opened.items():
        assert sum(sum(s[i][1].to_pylist()) for i in range(len(s))) == used[name]
        ids, _ = s[0]
        assert not ids.flags.owndata and len(ids) == 64


def test_token_files_odd(odd, empty, tmp_path) -> None:
    got = token_files.write(odd, f"file://{tmp_path}/t", length=16).collect()
    assert len(got) == odd.count()
    tok = bpe.ByteBPE(bpe.vocabulary(bpe.VOCABULARY))
    back, opened = [], {}
    for r in got:
        assert (r["file"] is None) == (r["n_tokens"] == 0)
        if r["file"] is None:
            back.append((r["doc_id"], None))
            continue
        ids = opened.setdefault(r["file"], token_files.Sequences(r["file"])).tokens(r["first_row"], r["first_pos"], r["n_tokens"])
        assert ids[-1] == 50256
        back.append((r["doc_id"], tok.decode(ids[:-1].astype(np.int64)).decode()))
    assert Counter(back) == Counter((r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect())
    assert token_files.write(empty, f"file://{tmp_path}/e").collect() == []


def test_lookup_is_even_and_stable() -> None:
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup(names, 1009)
    sizes = Counter(table.tolist())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    less = sharding.lookup(names[:-1], 1009)
    assert ((table != less) & (table != 6)).mean() < 0.1
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup(names, 1000)


def test_shard_odd(odd, empty) -> None:
    got = sharding.shard(odd, ["a", "b", "c"], slots=101)
    assert got.count() == odd.count()
    assert len({(r["doc_id"], r["shard"]) for r in got.collect()}) == len({r["doc_id"] for r in odd.collect()})
    assert sharding.shard(empty, ["a"], slots=101).collect() == []


def test_write_shards(odd, empty, spark, tmp_path) -> None:
    names = ["a", "b", "c"]
    table = odd.drop("shard")
    for rows in (1_000_000, 2):
        sharding.write_shards(table, f"file://{tmp_path}/s{rows}", names, slots=101, rows=rows)
        got = spark.read.schema(table.select("*").withColumn("shard", table["text"]).schema).parquet(f"file://{tmp_path}/s{rows}")
        assert Counter(map(tuple, got.select(*table.columns).collect())) == Counter(map(tuple, table.collect()))
        want = Counter((r["doc_id"], r["shard"]) for r in sharding.shard(table, names, slots=101).collect())
        assert Counter((r["doc_id"], r["shard"]) for r in got.select("doc_id", "shard").collect()) == want
    sharding.write_shards(empty.drop("shard"), f"file://{tmp_path}/e", names, slots=101)
    with pytest.raises(ValueError):
        sharding.write_shards(odd, f"file://{tmp_path}/n", names, slots=101)


def common_length(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def brute_families(rows: list[tuple], anchor: int) -> list[tuple]:
    out, families = [], {}
    for i, t in rows:
        if t is not None:
            families.setdefault(t[:anchor], []).append((i is None, i, t))
    for members in families.values():
        head = min(members, key=lambda m: (m[0], m[1] or 0))
        out += [(i, len(t), head[1], common_length(t, head[2])) for _, i, t in members]
    return out + [(i, None, None, None) for i, t in rows if t is None]


def test_fingerprints_brute(documents, odd, empty) -> None:
    for df in (documents, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = fingerprints.fingerprints(df).collect()
        assert sorted(map(str, [(r["doc_id"], r["length"], r["head"], r["shared"]) for r in got])) == sorted(map(str, brute_families(rows, fingerprints.ANCHOR)))
    prints = {(r["doc_id"]): r["fingerprint"] for r in fingerprints.fingerprints(documents).collect()}
    texts = dict(documents.select("doc_id", "text").collect())
    assert len(set(prints.values())) == len(set(texts.values()))
    assert fingerprints.fingerprints(empty).collect() == []


def test_spans() -> None:
    text = "abracadabra abracadabra"
    h = fingerprints.Prefixes(np.array([ord(c) for c in text], np.uint32))
    for a in range(0, len(text), 3):
        for c in range(0, len(text), 2):
            assert h.extension(a, h, c) == common_length(text[a:], text[c:])
            assert h.equal(a, min(a + 4, h.n), h, c, min(c + 4, h.n)) == (text[a : a + 4] == text[c : c + 4])


def test_fingerprints_passages(spark) -> None:
    rng = np.random.default_rng(1)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    least, shared, longer = fingerprints.ANCHOR + fingerprints.WINDOW - 1, [text(fingerprints.ANCHOR + fingerprints.WINDOW - 1) for _ in range(20)], text(900)
    rows = [(2 * k, text(k * 7) + "A" + s + "B" + text(50)) for k, s in enumerate(shared)] + [(2 * k + 1, text(400) + "C" + s + "D") for k, s in enumerate(shared)]
    base = text(300)
    rows += [(100, "x" + base + text(200)), (101, "y" + base + "E" + longer), (102, "z" + base + "F" + longer), (103, text(3000)), (104, None)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for k in range(20):
        a, b = got[2 * k], got[2 * k + 1]
        assert (a["other"], a["start"], a["other_start"], a["passage"]) == (2 * k + 1, 7 * k + 1, 401, least)
        assert (b["other"], b["start"], b["other_start"], b["passage"]) == (2 * k, 401, 7 * k + 1, least)
    assert (got[101]["other"], got[101]["start"], got[101]["passage"]) == (102, 302, 900) and got[102]["other"] == 101
    assert got[100]["passage"] == 300 and got[103]["passage"] is None and got[104]["passage"] is None


def test_fingerprints_catch_shared_passages(documents) -> None:
    """Every text that shares enough characters in a row with a different one has a match, which is real and can't grow."""
    least = fingerprints.ANCHOR + fingerprints.WINDOW - 1
    texts = dict(documents.select("doc_id", "text").collect())
    where: dict[str, set[str]] = {}
    for t in texts.values():
        for k in range(len(t or "") - least + 1):
            where.setdefault(t[k : k + least], set()).add(t)
    shared = {t for ts in where.values() if len(ts) > 1 for t in ts}
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents).collect()}
    assert shared and all(got[i]["passage"] is not None for i, t in texts.items() if t in shared)
    for i, r in got.items():
        if r["passage"] is not None:
            x, y, a, b, n = texts[i], texts[r["other"]], r["start"], r["other_start"], r["passage"]
            assert x != y and x[a : a + n] == y[b : b + n] and n >= fingerprints.ANCHOR
            assert x[a + n : a + n + 1] != y[b + n : b + n + 1] or a + n == len(x) or b + n == len(y)
            assert not a or not b or x[a - 1] != y[b - 1]


def brute_longest(texts: list[str], least: int) -> dict[str, int]:
    """Of each text the length of the longest match with any different one, where that has `least` characters."""
    out: dict[str, int] = {}
    for n in range(least, max(map(len, texts)) + 1):
        where: dict[str, set[str]] = {}
        for t in set(texts):
            if n == least or out.get(t) == n - 1:
                for k in range(len(t) - n + 1):
                    where.setdefault(t[k : k + n], set()).add(t)
        found = {t for ts in where.values() if len(ts) > 1 for t in ts}
        if not found:
            break
        out |= dict.fromkeys(found, n)
    return out


def crowd(rng: np.random.Generator) -> list[str]:
    """Texts with a notice that all share, which most share more of with one than with the first or last of them."""
    text = lambda n, a=97, b=101: "".join(map(chr, rng.integers(a, b, n)))
    notice, lefts, rights = text(300), [text(120) for _ in range(4)], [text(500) for _ in range(4)]
    out = []
    for k in range(40):  # opening and end are cut from the same few, so that all have partners of their own
        left, right = lefts[rng.integers(4)], rights[rng.integers(4)]
        out.append(text(30, 65, 91) + left[rng.integers(len(left)) :] + notice + right[: rng.integers(len(right))] + text(30 * (k % 3), 65, 91))
    out += [text(50) + notice + text(90) + notice + rights[0] + "!", out[0], out[3] + "?"]  # twice in one text; copies
    for unit in ("-", "=*", text(20), text(50)):  # runs of a period, cut at any phase
        out += [text(n) + unit * (rng.integers(300, 900) // len(unit)) + unit[:n] + rights[n % 4][:60] for n in range(0, 18, 3)]
    return out


def test_fingerprints_longest_of_many(spark, documents) -> None:
    """The longest match with any different text, whatever the number of texts that share a span."""
    least = fingerprints.ANCHOR + fingerprints.WINDOW - 1
    tables = [crowd(np.random.default_rng(k)) for k in range(2)] + [[r["text"] for r in documents.select("text").collect()]]
    for texts in tables:
        got = fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)).collect()
        want = brute_longest(texts, least)
        assert want and {r["doc_id"]: r["passage"] for r in got if (r["passage"] or 0) >= least} == {i: want[t] for i, t in enumerate(texts) if t in want}
        for r in got:
            if r["passage"] is not None:
                x, y, a, b, n = texts[r["doc_id"]], texts[r["other"]], r["start"], r["other_start"], r["passage"]
                assert x != y and x[a : a + n] == y[b : b + n] and len(x[a : a + n]) == n


def brute_dictionary(counts: Counter, size: int) -> bytes:
    parts, left = [], size
    saved = {w: n * len(w.encode()) for w, n in counts.items() if n > 1 and len(w.encode()) > 1}
    for w in sorted(saved, key=lambda w: (-saved[w], w.encode())):
        entry = b" " + w.encode()
        if len(entry) > left:
            break
        parts.append(entry)
        left -= len(entry)
    return b"".join(reversed(parts))


def test_lm_score_brute(documents, spark, sf_dir) -> None:
    domain = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    inside_ids = {r["doc_id"] for r in domain.collect()}
    texts = dict(documents.select("doc_id", "text").collect())
    cut = lambda t: [w[k : k + 40] for w in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for k in range(0, len(w), 40)]
    every, own = Counter(), Counter()
    for i, t in texts.items():
        every.update(cut(t))
        if i in inside_ids:
            own.update(cut(t))
    books = [brute_dictionary(c, lm_score.DICTIONARY) for c in (own, every)]
    coders = [zstandard.ZstdCompressor(level=lm_score.LEVEL, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for b in books]
    for r in lm_score.score(documents, domain).collect():
        data = texts[r["doc_id"]].encode()
        a, b = (sum(len(c.compress(data[k : k + lm_score.BLOCK])) for k in range(0, len(data), lm_score.BLOCK)) for c in coders)
        assert r["n_bytes"] == len(data) and r["score"] == pytest.approx((b - a) * 8 / len(data))


def test_lm_counts_of_many_ids(documents, odd, spark, sf_dir) -> None:
    """Ids that aren't broadcast give the same counts."""
    domain = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    for df, ids in ((documents, domain), (odd, odd.filter("doc_id is null or doc_id < 3"))):
        one, two = (Counter(map(tuple, lm_score.word_counts(df, ids, most=most).collect())) for most in (1 << 20, 1))
        assert one == two and one


def test_lm_long_words_and_texts(spark) -> None:
    """Words without blanks count by parts, and a long text costs as much as its blocks."""
    long = "".join(f"{k:x}," for k in range(100_000, 101_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, "other words of no use")], "doc_id bigint, text string")
    counts = {r["word"]: (r["n_all"], r["n_in"]) for r in lm_score.word_counts(df, df.filter("doc_id = 1")).collect()}
    assert all(counts[long[k : k + 40]] == (2, 1) for k in range(0, len(long), 40))
    once = lm_score.costs([long[: lm_score.BLOCK].ljust(lm_score.BLOCK)], b"", b"")
    assert lm_score.costs([long[: lm_score.BLOCK].ljust(lm_score.BLOCK) * 5], b"", b"").tolist() == (5 * once).tolist()


def test_large_parts_are_files(spark) -> None:
    """Workers get the same parts whichever way they are handed out."""
    parts = (b"abc" * 1000, b"", b"x")
    for most in (10_000, 10):
        get = common.handed_out(spark, parts, "parts", most)
        own = spark.range(4, numPartitions=2).mapInPandas(lambda frames, get=get: (f.assign(id=sum(map(len, get()))) for f in frames), "id bigint")
        assert get() == parts and {r["id"] for r in own.collect()} == {3001}


def test_lm_dictionaries_follow_the_vocabulary(spark) -> None:
    base, sizes = lm_score.DICTIONARY // 8, []
    for n in (base, 4 * base):
        counts = spark.range(n).selectExpr("concat('word', lpad(hex(id), 8, '0')) word", "2L n_all", "if(id % 2 = 0, 2L, 0L) n_in")
        inside, general = lm_score.dictionaries(counts)
        assert len(general) >= max(lm_score.DICTIONARY, lm_score.SHARE * 13 * n) and len(inside) >= lm_score.SHARE * 13 * n / 2
        sizes.append(len(general))
    assert sizes[1] > 3.9 * sizes[0]
    rare = general[:130]
    assert len(lm_score.coder(general).compress(rare)) < len(lm_score.coder(general[-lm_score.DICTIONARY :]).compress(rare))


def test_lm_score_odd(odd, empty, spark) -> None:
    got = lm_score.score(odd, odd.filter("doc_id = 1 or doc_id is null"))
    assert got.count() == odd.count()
    for r in got.collect():
        assert (r["score"] is None) == (r["n_bytes"] == 0)
    assert lm_score.score(odd, empty).count() == odd.count()
    assert lm_score.score(empty, odd).collect() == []


def brute_blocks(rows: list[tuple], templates: dict[str, str], threshold: float) -> list[tuple]:
    """Every block of every text with every template."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    out = []
    for i, text in rows:
        own = cut(text or "")
        for name, t in templates.items():
            words, stretch = set(cut(t)), math.ceil(len(cut(t)) / threshold - 1e-9)
            for b in range(-(-len(own) // stretch) if words else 0):
                n = len(words & set(own[b * stretch : (b + 2) * stretch]))
                if n >= threshold * len(words) - 1e-9:
                    out.append((str(i), b, name, n))
    return sorted(out)


def test_licenses_brute(documents, odd) -> None:
    for df, templates, threshold in ((documents, licenses.TEMPLATES, 0.8), (odd, licenses.TEMPLATES, 0.6), (documents, {"a": "the of and in", "b": "of of of a"}, 0.7)):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = sorted((str(r["doc_id"]), r["block"], r["template"], r["shared"]) for r in licenses.scan(df, templates, threshold).collect())
        assert got == brute_blocks(rows, templates, threshold) and got


def test_licenses_odd(odd, empty) -> None:
    got = sorted((str(r["doc_id"]), r["block"], r["template"], r["containment"]) for r in licenses.scan(odd).collect())
    assert got == sorted((i, 0, "apache-short", 1.0) for i in ("1", "2", "2", "None"))
    assert licenses.scan(empty).collect() == [] and licenses.scan(odd, {"none": "..."}).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(odd, threshold=0.0)


def test_licenses_wrapped(spark) -> None:
    headers = {
        "apache-basis": "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
        "bsd-grant": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
        "gpl-free": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation",
    }
    rows = [(k, f"first line\n\n{x}\n\nlast") for k, x in enumerate(headers.values())]
    rows += [(10, "Permission is hereby granted, free of charge, to any\n\nperson obtaining a copy of this software and associated documentation files"), (11, "all the\nother lines here are about their own rights and have nothing\nreserved"), (12, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(k, name) for k, name in enumerate(headers)} <= {(r["doc_id"], r["template"]) for r in got if r["containment"] == 1}
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 10}
    whole = licenses.TEMPLATES["mit-whole"]
    wrapped = "\n".join(f"// {whole[k : k + 70]}" for k in range(0, len(whole), 70)).replace("MERCHANTABILITY", "")
    found = licenses.scan(spark.createDataFrame([(1, "x " * 5000 + wrapped + " y" * 3000)], "doc_id bigint, text string")).collect()
    assert {"mit-whole", "mit-grant", "mit-warranty"} <= {r["template"] for r in found}
