"""License scans by an exact set-similarity join.

A template of so many tokens is looked for in blocks of a text: windows twice as long as the stretch of tokens over which
a notice that meets the threshold may spread, beginning at every multiple of that length, whatever lines they go over. So
every such stretch lies in a block. All pairs of block and template are found in which the block has at least
`threshold` of the template's words. Words are put in one order, by how many documents have them, the rarest first. A
template of n words, of which k have to be there, has a prefix of n - k + 1: a text without any word of that prefix can't
reach k. Texts are joined with templates on the words of the prefix, once for the first that they share; what passes is
tested by position (from that word on, the template must have k words left) and by length (the text has k of them), and
then counted exactly, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_checked

THRESHOLD = 0.8
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-short": "Released under the MIT License",
    "mit-grant": _MIT_GRANT,
    "mit-warranty": _AS_IS,
    "mit-whole": f'{_MIT_GRANT} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    f"{_AS_IS}, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": _BSD_GRANT,
    "bsd-2-clause": f"{_BSD_GRANT} provided that the following conditions are met: {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}",
    "bsd-3-clause": f"{_BSD_GRANT} provided that the following conditions are met: {_BSD_SOURCE} {_BSD_BINARY} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "gpl-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-zero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache": "SPDX-License-Identifier: Apache-2.0",
    "reserved": "All rights reserved",
}
SPLIT = r"[^\p{L}\p{N}]+"
#: Templates are the caller's and of a bounded number; their words are broadcast.
MOST_TEMPLATES = 10_000


def tokens(text: Column) -> Column:
    """A text's lower-case runs of letters and numbers, in order."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def needed(n: int, threshold: float) -> int:
    """How many of n words make up the threshold."""
    return math.ceil(threshold * n - 1e-9)


def template_sets(df: DataFrame, templates: dict[str, str], threshold: float) -> dict[str, tuple[list[str], int, int]]:
    """Of each template with a word: its words, how many have to be there, and the tokens of a stretch."""
    rows = df.sparkSession.createDataFrame(list(templates.items()), "template string, text string").select("template", tokens(F.col("text")))
    return {name: (sorted(set(t)), needed(len(set(t)), threshold), math.ceil(len(t) / threshold - 1e-9)) for name, t in rows.collect() if t}


def scan(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, block, template, shared, containment): every block and template that meet the threshold.

    Block b of a template whose stretch is L tokens has the text's tokens from b * L on, 2 L of them; so a notice may lie
    in two blocks, each of which is given. shared counts the template's words that are in it. Null and empty texts have
    no block that meets anything, nor does a template without words. Very long texts are scanned whole. Repeated rows are
    found each by itself, null ids are kept, ties (blocks that meet several templates) give a row each, an empty table
    gives no rows; other columns are left out, whatever their names. threshold has to be above 0.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    texts = TEMPLATES if templates is None else templates
    if len(texts) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates are scanned for at once")
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    sets = template_sets(df, texts, threshold)
    known = sorted(set().union(*(t for t, _, _ in sets.values())))
    if not known:
        return spark.createDataFrame([], f"`{id_col}` {kind}, block int, template string, shared int, containment double")
    vocabulary = F.array(*map(F.lit, known))
    common = df.select(F.explode(F.array_intersect(tokens(F.col(f"`{text_col}`")), vocabulary)).alias("w")).groupBy("w").count()
    count = dict(common.collect())  # at most one row for each word of the templates
    place = {w: i for i, w in enumerate(sorted(known, key=lambda w: (count.get(w, 0), w)))}
    rows, prefixes = [], []
    for name, (own, need, _) in sets.items():
        ordered = sorted(own, key=place.get)
        rows.append((name, ordered, need))
        prefixes += [(w, name, ordered, i, need) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    openers = F.array(*map(F.lit, sorted({p[0] for p in prefixes})))
    table = spark.createDataFrame(prefixes, "w string, template string, t array<string>, at int, need int")
    here = df.select(F.col(f"`{id_col}`").alias("id"), tokens(F.col(f"`{text_col}`")).alias("tokens"))
    here = here.withColumn("own", F.array_intersect("tokens", vocabulary)).filter(F.arrays_overlap("own", openers))
    words = here.withColumn("w", F.explode(F.array_intersect("own", openers)))
    pairs = words.join(broadcast_checked(table, len(prefixes), 1 << 20), "w")
    first = F.get(F.array_intersect("t", "own"), F.lit(0)) == F.col("w")  # a pair joins on several words, and counts for the first
    enough = (F.size("t") - F.col("at") >= F.col("need")) & (F.size(F.array_intersect("t", "own")) >= F.col("need"))
    hits = F.filter(F.transform("tokens", lambda w, i: F.struct(i.alias("i"), F.array_position("t", w).cast("int").alias("k"))), lambda s: s["k"] > 0)
    hits = pairs.filter(first & enough).select("id", "template", hits.alias("hits"))
    stretch = {name: (need, long, len(own)) for name, (own, need, long) in sets.items()}

    def count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values
            at, word = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            found = []
            for k, name in enumerate(batch.column(1).to_pylist()):
                need, long, n = stretch[name]
                i, w = at[ends[k] : ends[k + 1]], word[ends[k] : ends[k + 1]]
                block = np.concatenate([i // long, i // long - 1])
                both = np.unique((block * (n + 1) + np.tile(w, 2))[block >= 0])
                blocks, shared = np.unique(both // (n + 1), return_counts=True)
                good = shared >= need
                found += [(k, int(b), name, int(s), round(int(s) / n, 6)) for b, s in zip(blocks[good], shared[good], strict=True)]
            columns = [pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=["id", "block", "template", "shared", "containment"])

    found = hits.mapInArrow(count_blocks, f"id {kind}, block int, template string, shared int, containment double")
    return found.withColumnRenamed("id", id_col)


def scan_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same by comparing every block with every template."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    cut = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT template, {cut("text")} AS words FROM (VALUES {rows}) v(template, text)),
n AS (SELECT template, len(list_distinct(words)) AS n, ceil(len(words) / {threshold!r} - 1e-9)::BIGINT AS long FROM t WHERE len(words) > 0),
w AS (SELECT DISTINCT template, unnest(words) AS w FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {cut("text")} AS words FROM documents),
p AS (SELECT r, doc_id, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
h AS (SELECT r, doc_id, template, w, n, i // long AS b FROM p JOIN w USING (w) JOIN n USING (template)),
b AS (SELECT r, doc_id, template, w, n, unnest([b, b - 1]) AS block FROM h)
SELECT doc_id, block::INT AS block, template, count(DISTINCT w)::INT AS shared, round(count(DISTINCT w) / any_value(n), 6) AS containment
FROM b WHERE block >= 0 GROUP BY r, doc_id, template, block HAVING count(DISTINCT w) >= ceil({threshold!r} * any_value(n) - 1e-9)"""
