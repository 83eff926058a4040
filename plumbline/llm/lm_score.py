"""LM scoring by compression.

What a text costs under zstandard with a dictionary of in-domain words, against what it costs with one of the words of
everything, tells how much it is like the domain: score = (general - in-domain) / bytes, in bits a byte. The words are
counted over all documents, both ways in one aggregation; each dictionary is a raw one that holds the words which save
most (count times length), the best last, where they are nearest. A dictionary grows with the vocabulary: it holds a
fixed share of all that repeated words save; beyond 128 MB workers read dictionaries from the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import broadcast_checked, filter_of, handed_out, maybe_in, resident, settled, slices

#: Each dictionary has all repeated words up to so many bytes; beyond that, the best that make up SHARE of the savings.
DICTIONARY = 112_640
SHARE = 0.95
LEVEL = 3
#: zstandard's own tables at this level have places for dictionaries of 2 to the power of so many bytes.
LEVEL_BITS = 17
#: A dictionary entry has at most so many characters; a longer word is counted as entries in a row.
ENTRY = 40
#: Texts are costed in blocks of so many bytes, each of which starts from the dictionary, so that scores of long texts
#: compare with those of short ones. Up to this size zstandard refers to a dictionary's tables; for more it copies them.
BLOCK = 1 << 14


def word_counts(df: DataFrame, domain: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1 << 20) -> DataFrame:
    """(word, n_all, n_in): how often each word occurs in all documents and in those of the domain's ids.

    The ids are counted first: up to `most` of them are broadcast, so that texts stay where they are read. Beyond that a
    membership filter of fixed size tells which texts may be in the domain; only those are shuffled, to be told apart.
    """
    cut = F.explode(F.regexp_extract_all("t", F.lit(f"[^ \\t\\r\\n]{{1,{ENTRY}}}"), F.lit(0))).alias("word")
    own = df.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"))
    ids = domain.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("i")).distinct()
    n = ids.count()
    if n <= most:
        marked = own.join(broadcast_checked(ids.withColumn("in", F.lit(1)), n, most), "i", "left")
        words = marked.select(cut, F.lit(1).alias("all"), F.coalesce("in", F.lit(0)).alias("in"))
    else:
        hashed = F.xxhash64("i")
        inside = maybe_in(own.withColumn("h", hashed), "h", filter_of(ids.select(hashed.alias("h")), "h")).join(ids, "i", "left_semi")
        words = own.select(cut, F.lit(1).alias("all"), F.lit(0).alias("in")).unionByName(inside.select(cut, F.lit(0).alias("all"), F.lit(1).alias("in")))
    return words.groupBy("word").agg(F.sum("all").alias("n_all"), F.sum("in").alias("n_in"))


def dictionaries(counts: DataFrame, size: int = DICTIONARY, share: float = SHARE) -> tuple[bytes, bytes]:
    """The in-domain and the general dictionary.

    What a word saves is its count times its bytes. The best words are taken until they fill `size` and make up `share`
    of what all repeated words save, so a dictionary follows the vocabulary. A histogram of the savings over all words
    gives the least saving that can matter, so that little more than a dictionary's words reaches the driver.
    """
    out = []
    for n in ("n_in", "n_all"):
        saved = counts.filter((F.col(n) > 1) & (F.octet_length("word") > 1)).select("word", (F.col(n) * F.octet_length("word")).alias("saved"))
        sums = F.sum(F.octet_length("word") + 1).alias("bytes"), F.sum("saved").alias("saved")
        steps = sorted(saved.groupBy(F.floor(F.log2("saved") * 8).alias("step")).agg(*sums).collect(), reverse=True)
        whole = sum(r["saved"] for r in steps)
        n_bytes, of_whole, least = 0, 0, 0
        for step, own_bytes, own_saved in steps:
            n_bytes, of_whole, least = n_bytes + own_bytes, of_whole + own_saved, step
            if n_bytes >= size and of_whole >= share * whole:
                break
        parts, used, of_whole = [], 0, 0
        for batch in saved.filter(F.floor(F.log2("saved") * 8) >= least).orderBy(F.desc("saved"), "word").toArrow().to_batches(max_chunksize=10_000):
            for word, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = b" " + word.encode()
                if used + len(entry) > size and of_whole >= share * whole:
                    break
                parts.append(entry)
                used, of_whole = used + len(entry), of_whole + value
        out.append(b"".join(reversed(parts)))
    return out[0], out[1]


def coder(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """A compressor that starts from the dictionary; its tables have room for all of a large one's places."""
    flags = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not content:
        return zstandard.ZstdCompressor(level=level, **flags)
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bits = (len(content) - 1).bit_length()
    if bits <= LEVEL_BITS:
        book.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=book, **flags)
    params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), hash_log=min(bits, 28), chain_log=min(bits - 1, 28), **flags)
    book.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=params)


def costs(texts: list[str | None], inside: bytes, general: bytes, level: int = LEVEL) -> np.ndarray:
    """Rows of (bytes, in-domain size, general size), zeros for null and empty texts; sizes are sums over blocks."""
    coders = resident(("lm", level, inside, general), lambda: [coder(content, level) for content in (inside, general)])
    out = np.zeros((len(texts), 3), np.int64)
    for i, text in enumerate(texts):
        if text:
            data = text.encode()
            blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
            out[i] = len(data), *(sum(len(c.compress(b)) for b in blocks) for c in coders)
    return out


def score(df: DataFrame, domain: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DICTIONARY, level: int = LEVEL, share: float = SHARE) -> DataFrame:
    """(id_col, n_bytes, in_bits, general_bits, score) of each row, in bits a byte; a higher score is more in-domain.

    Null and empty texts have 0 bytes and null figures. Very long texts are costed whole, block by block; long words
    count by parts. Rows correspond one to one, repeated ones and null ids included (a null id is never in the domain);
    words that save as much go in their own order; an empty domain makes an empty dictionary, for which zstandard works
    without one; an empty table has no rows. Other columns, of df and of domain, are left out, whatever their names.
    """
    counts = settled(word_counts(df, domain, id_col, text_col).filter("n_all > 1"), "lm-words")
    inside, general = dictionaries(counts, size, share)
    shared = handed_out(df.sparkSession, (inside, general), "lm-dictionaries")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                n, a, b = costs(batch.column(1).to_pylist(), *shared(), level).T
                none = n == 0
                d = np.maximum(n, 1) / 8
                figures = [pa.array(x, mask=none) for x in (a / d, b / d, (b - a) / d)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *figures], names=[id_col, "n_bytes", "in_bits", "general_bits", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_bytes bigint, in_bits double, general_bits double, score double")
