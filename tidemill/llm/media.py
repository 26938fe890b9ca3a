"""Content-defined payload chunking for media columns (operator 7).

A rolling gear hash over the last 32 bytes cuts payloads where its upper bits are 0, between LEAST and MOST bytes.
Each task appends the chunks that it has not stored yet, zstd-compressed, to one pack file in the shared folder and
notes the digest and place of each. Spark joins then choose one place for each digest, whichever task stored it, and
each payload becomes an ordered list of chunks, from which it is read back and verified against the digests.
Chunks that another pack already holds are left unreferenced; rewriting packs without them is a job of its own.

The stored form of a payload is the sequence of its compressed chunks; media_bytes and media_sha256 describe it.

Defined results: a null text is empty; the payload of an empty text is 64 zero bytes; rows that repeat are described
once each; null doc_ids stay null. Other columns are ignored. A pack file of a task that ran twice is not referenced.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut, new_folder, shuffle_partitions, text_or_empty

UNIT = 64
LEAST, MEAN_BITS, MOST = 256, 11, 16_384
LEVEL = 3
STORED_FOR_TASK = 400_000
#: Payload bytes that a task reads back.
READ_BACK = 32 << 20
INDEX = "row long, doc_id long, n_bytes long, n_chunks int, seq int, digest binary, path string, at long, size long"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def gear_table() -> np.ndarray:
    """256 fixed 32-bit numbers, one for each byte value."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], dtype=np.uint32)


def gear_hashes(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of gear[b] << age over the last 32 bytes, modulo 2**32, by doubling."""
    h = gear[data]
    for span in (1, 2, 4, 8, 16):
        older = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += older
    return h


def cut_points(candidates: list[int], size: int) -> list[int]:
    """Ends of chunks of a payload: candidates that leave LEAST to MOST bytes, then its end."""
    ends, last = [], 0
    for c in [*candidates, size]:
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and c < size:
            ends.append(c)
            last = c
    if last < size:
        ends.append(size)
    return ends


def chunk_payloads(payloads: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each payload. LEAST exceeds the window, so no hash at a cut reaches into the payload before."""
    gear = gear_table()
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    marks = np.flatnonzero(gear_hashes(data, gear) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    starts = np.cumsum([0, *map(len, payloads)])
    edges = np.searchsorted(marks, starts)
    for k, p in enumerate(payloads):
        own = (marks[edges[k] : edges[k + 1]] - starts[k]).tolist()
        ends = cut_points([c for c in own if c >= LEAST], len(p))
        yield [p[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw.ljust(size, b"\0"), len(raw)


def blocks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= most or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def store_media(docs: DataFrame, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the chunks of all payloads into packs below folder; return one row for each chunk of each document."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        row = TaskContext.get().partitionId() << 40
        sink, path, at, held = None, "", 0, {}
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, some in blocks(texts):
                made = [padded(x) for x in some]
                rows = []
                for i, parts in enumerate(chunk_payloads([p for p, _ in made])):
                    for seq, part in enumerate(parts):
                        name = digest(part)
                        if name not in held:
                            if sink is None:
                                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                                fs.create_dir(root, recursive=True)
                                file = f"pack-{uuid.uuid4().hex}.bin"
                                path, sink = f"{folder}/{file}", fs.open_output_stream(f"{root}/{file}")
                            if len(held) >= STORED_FOR_TASK:  # only costs space: the joins still find one place for each digest
                                held = {}
                            small = squeeze(part)
                            sink.write(small)
                            held[name] = (at, len(small))
                            at += len(small)
                        rows.append((row, keys[first + i], made[i][1], len(parts), seq, name, path, *held[name]))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        if sink is not None:
            sink.close()

    rows = docs.select(F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text"))
    return cut(rows.mapInArrow(store, INDEX), "media-index")


def chunk_lists(index: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the ordered chunks of each document, each chunk at the one place chosen for its digest.

    Lists are short and the payloads that they name are not, so they are dealt out by the bytes to be read back.
    """
    held = index.where("seq = 0").agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(shuffle_partitions(index.sparkSession), -(-held // READ_BACK))
    # written, so that the join has a shuffle of its own on both sides and a digest that very many documents share is split
    chosen = cut(index.groupBy("digest").agg(F.min(F.struct("path", "at", "size")).alias("place")), "media-places")
    placed = index.select("row", "doc_id", "n_bytes", "seq", "digest").join(chosen, "digest")
    chunk = F.struct("seq", "digest", "place.path", "place.at", "place.size")
    return placed.repartition(tasks, "row").groupBy("row", "doc_id", "n_bytes").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))


@functools.lru_cache(maxsize=64)
def opened(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)


def load(chunks: list[dict]) -> tuple[bytes, bytes]:
    """The payload of an ordered list of chunks, verified, and its stored form; neighbours are read at once."""
    stored, k = [], 0
    while k < len(chunks):
        j, end = k, chunks[k]["at"]
        while j < len(chunks) and chunks[j]["path"] == chunks[k]["path"] and chunks[j]["at"] == end:
            end += chunks[j]["size"]
            j += 1
        raw = opened(chunks[k]["path"]).read_at(end - chunks[k]["at"], chunks[k]["at"])
        stored += [raw[c["at"] - chunks[k]["at"] : c["at"] - chunks[k]["at"] + c["size"]] for c in chunks[k:j]]
        k = j
    spread = zstandard.ZstdDecompressor().decompress
    parts = [spread(x) for x in stored]
    for c, part in zip(chunks, parts):
        if digest(part) != c["digest"]:
            raise ValueError(f"chunk {c['seq']} at {c['path']}:{c['at']} does not have its digest")
    return b"".join(parts), b"".join(stored)


def sample_features(payload: bytes) -> str:
    """Mean, deviation, entropy and crossings of the middle of the payload as 8-bit samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    n = len(x)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    crossings = int(np.count_nonzero(np.diff(x > 100)))
    return f"mean={mean:.4f};deviation={spread:.4f};entropy={entropy:.4f};crossings={crossings}"


def read_media(lists: DataFrame) -> DataFrame:
    """Read each payload back from its chunks and describe it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "chunks"))):
                payload, stored = load(chunks)
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), sample_features(payload)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return lists.mapInArrow(read, READ)


def media_documents(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "media")
    return read_media(chunk_lists(store_media(docs, folder)))
