"""Token ids in Arrow stream files of fixed-size lists (operator 1).

Layout of a data set: one `.arrows` stream file for each range of documents, whose batches all hold ROWS sequences
(the last batch fewer) of two columns, `ids` fixed_size_list<uint16 or uint32>[length] and `mask`
fixed_size_list<bool>[length]; and an index of (shard, path, doc_id, local_start, n_tokens), Parquet. Sequence i of a
shard is row i % ROWS of batch i // ROWS, so a memory-mapped file is read at random without copying. The last
sequence of a shard is padded with the end id and masked out.

Defined results: null texts are empty; an empty text has the end id alone; null doc_ids come first; rows of one doc_id
are ordered by a hash of the text, then the text; an empty table gives no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, new_folder, text_or_empty
from tidemill.llm.tokens import encode_in_blocks, encoder

ROWS = 64
INDEX = "shard int, path string, doc_id long, local_start long, n_tokens long"


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes one stream file; ids come in as they are made and leave as whole batches."""

    def __init__(self, folder: str, shard: int, length: int, vocabulary: int) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrows"  # a task that runs twice writes two files; the index names one
        self.path, self.length, self.schema = f"{folder}/{name}", length, sequence_schema(length, vocabulary)
        self.sink = fs.open_output_stream(f"{path}/{name}")
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def _put(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        full = ROWS * self.length
        if self.n_held >= full:
            ids = np.concatenate(self.held)
            whole = len(ids) // full * full
            for at in range(0, whole, full):
                self._put(ids[at : at + full], np.ones(full, dtype=bool))
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self, pad: int) -> None:
        if self.n_held:
            ids = np.concatenate(self.held)
            missing = -len(ids) % self.length
            mask = np.arange(len(ids) + missing) < len(ids)
            self._put(np.concatenate([ids, np.full(missing, pad, dtype=self.kind)]), mask)
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Random access to the ids of one stream file, memory-mapped where the file is local.

    All batches but the last have ROWS full sequences and no nulls, so their messages have one size: batch i starts at a
    place that follows from the first one, and a remote file, too, is read batch by batch, a few of them held at a time.
    """

    def __init__(self, uri: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.first = self.source.tell()
        pa.ipc.read_message(self.source)
        self.stride = self.source.tell() - self.first
        self.length = self.schema.field("ids").type.list_size
        self.held: dict[int, pa.RecordBatch] = {}

    def batch(self, i: int) -> pa.RecordBatch:
        if i not in self.held:
            if len(self.held) >= 4:
                self.held.pop(next(iter(self.held)))
            self.source.seek(self.first + i * self.stride)
            self.held[i] = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        return self.held[i]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Sequence i and its mask, without copying."""
        batch, row = self.batch(i // ROWS), i % ROWS
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).values.to_numpy()[part], batch.column(1).values[part.start : part.stop]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the shard on; they may lie in many sequences."""
        out, full = [], ROWS * self.length
        while n > 0:
            batch, at = self.batch(start // full), start % full
            part = batch.column(0).values.to_numpy()[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, length: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Write the ids of all texts in ascending order of key to folder; return the index, itself written as Parquet.

    One range shuffle of the texts; each task holds one block of texts and one batch of ids at a time.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, start, shard = None, 0, TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            rows = []
            for first, made in encode_in_blocks(tokenizer, texts):
                for i, ids in enumerate(made, first):
                    if writer is None:
                        writer = ShardWriter(folder, shard, length, encoder(tokenizer).tokenizer.get_vocab_size())
                    ids = np.frombuffer(ids + end, dtype="<u4")
                    writer.add(ids)
                    rows.append((shard, writer.path, keys[i], start, len(ids)))
                    start += len(ids)
            if rows:
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if writer is not None:
            writer.close(end_id)

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    mark = F.xxhash64("text")  # splits the rows of a key that very many rows share
    ordered = rows.repartitionByRange("key", mark).sortWithinPartitions("key", mark, "text")
    return cut(ordered.mapInArrow(write, INDEX), "token-index")


def locate(index: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before each. The window sees one row for each shard, as many as partitions."""
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.col("local_start"))


def read_documents(index: DataFrame) -> DataFrame:
    """Read the files that an index names: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, shard = "", None
        for batch in batches:
            path, at, n = (batch.column(c).to_pylist() for c in ("path", "local_start", "n_tokens"))
            crc = []
            for p, a, k in zip(path, at, n):
                if p != opened:
                    opened, shard = p, ShardReader(p)
                crc.append(zlib.crc32(shard.ids(a, k).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = locate(index).repartitionByRange("shard", "local_start").sortWithinPartitions("shard", "local_start")
    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Write all documents to a fresh data set in the shared folder and describe each as the files hold it."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, folder, tokenizer, length, end_id))
