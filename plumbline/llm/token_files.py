"""Token ids as Arrow files of fixed-size lists.

Documents are encoded, closed with an end token and laid end to end into sequences of one length; what is left at the
end of a partition is padded, and the mask is false there. Each file is in Arrow's file form of the stream format: its
record batches hold a fixed-size list of ids and one of mask bits, so that a memory-mapped file gives any sequence as a
slice of one buffer, without a copy. Files carry names of their own for each attempt of a task; only those of attempts
that were committed appear in the index, which is what the operator returns.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import VOCABULARY, encoded_batch, tokenizer, vocabulary
from plumbline.llm.common import new_path, slices

LENGTH = 2048
BATCH_ROWS = 512
INDEX = "file string, first_row bigint, first_pos int, n_tokens int"


def schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


class _File:
    """Fills sequences and writes them batch by batch."""

    def __init__(self, folder: str, length: int, ids: pa.DataType, pad: int) -> None:
        self.length, self.ids, self.pad, self.at = length, ids, pad, 0
        self.name = f"part-{uuid.uuid4().hex}.arrow"
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        self.sink = fs.open_output_stream(f"{path}/{self.name}")
        self.writer = pa.ipc.new_file(self.sink, schema(length, ids))
        self.parts: list[np.ndarray] = []
        self.have = 0

    def add(self, tokens: np.ndarray) -> None:
        self.parts.append(tokens)
        self.have += len(tokens)
        if self.have >= self.length * BATCH_ROWS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        tokens = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        batch = self.length * BATCH_ROWS
        end = len(tokens) if last else len(tokens) // batch * batch
        for lo in range(0, end, batch):
            part = tokens[lo : min(lo + batch, end)]
            full = np.ones(len(part), bool)
            if short := -len(part) % self.length:
                part = np.concatenate([part, np.full(short, self.pad, part.dtype)])
                full = np.concatenate([full, np.zeros(short, bool)])
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((part.astype(self.ids.to_pandas_dtype()), self.ids), (full, pa.bool_()))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=schema(self.length, self.ids)))
        self.parts, self.have = [tokens[end:]], len(tokens) - end

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


def write(df: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, length: int = LENGTH, end: int = 50256) -> DataFrame:
    """Writes every row's tokens; returns where each lies: (id_col, file, first_row, first_pos, n_tokens).

    A row's tokens begin in sequence first_row of its file at first_pos and go on over as many sequences as it takes;
    n_tokens counts the end token too, so an empty text has 1. A null text is not written and has null places and 0
    tokens; a very long text goes on over as many sequences as it takes. Repeated rows are written each time they occur;
    null ids are kept; no ties arise; other columns are left out, whatever their names; an empty table has an empty index.
    Ids take 16 bits where the vocabulary allows it. Without `folder` the files lie in the shared folder and are removed,
    like all that the operators write there, when the driver's program ends: name a folder to keep them.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "token-files")
    data = vocabulary(path)
    shared = spark.sparkContext.broadcast(data)
    ids = pa.uint16() if max(end, data.count(b"\n")) < 1 << 16 else pa.int32()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, out = tokenizer(shared.value), None
        for whole in batches:
            for batch in slices(whole, whole.column(1)):
                out = out or _File(folder, length, ids, end)
                texts = batch.column(1).to_pylist()
                flat, done, _ = encoded_batch(bpe, texts)
                null = np.array([t is None for t in texts], bool)
                n = np.diff(done) + ~null
                first = out.at + np.concatenate([[0], np.cumsum(n)])
                tokens = np.insert(flat, done[1:][~null], end)
                out.add(tokens)
                out.at = int(first[-1])
                places = [pa.array(x, t, mask=null) for x, t in ((first[:-1] // length, pa.int64()), (first[:-1] % length, pa.int32()))]
                name = pa.array(np.where(null, None, out.name), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), name, *places, pa.array(n, pa.int32())], names=[id_col, "file", "first_row", "first_pos", "n_tokens"])
        if out:
            out.close()

    kind = df.schema[id_col].dataType.simpleString()
    index = df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, {INDEX}")
    index.write.parquet(f"{folder}/_index")
    return spark.read.schema(index.schema).parquet(f"{folder}/_index").withColumn("file", F.concat(F.lit(folder + "/"), "file"))


class Sequences:
    """Random access to one file: a memory map, of which each sequence is a view."""

    def __init__(self, path: str) -> None:
        self.reader = pa.ipc.open_file(pa.memory_map(path.removeprefix("file://")))
        self.batches = [self.reader.get_batch(i) for i in range(self.reader.num_record_batches)]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the mapped file) and mask of a sequence; every batch but the last has BATCH_ROWS."""
        batch = self.batches[row // BATCH_ROWS]
        ids, mask = batch.column(0), batch.column(1)
        n, at = ids.type.list_size, row % BATCH_ROWS
        return ids.values.slice(at * n, n).to_numpy(zero_copy_only=True), mask.values.slice(at * n, n)

    def tokens(self, first_row: int, first_pos: int, n: int) -> np.ndarray:
        """A document's tokens by its place in the index."""
        length = len(self[first_row][0])
        rows = range(first_row, first_row + (first_pos + n - 1) // length + 1)
        return np.concatenate([self[r][0] for r in rows])[first_pos : first_pos + n]
