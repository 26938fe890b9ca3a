"""Packing of token sequences by swap-based local search (operator 5).

Documents become pieces of at most `capacity` tokens, and pieces go to sequences. A full piece is a sequence of its own.
The others, at most one a document, are dealt into groups of GROUP documents that follow each other in the input, so
an order of training is kept from group to group and no key, however frequent, fills a group. The order is that in which
the input was written: by file, and by row within it, since Spark reads files in an order of its own; an input that is
not read from files directly has the order of its partitions. Each group is packed on
its own, so the loss against one packing of all is below one sequence in a group. A group starts from best fit in
decreasing size; then pieces are moved, exchanged one for one or two for one between underfull sequences, each step
raising the sum of squared fills, so that free places gather and sequences empty, until the lower bound is met or no
such step is left.

Defined results: null texts are empty; an empty text is one piece, the end id; rows that repeat are packed as often as
they come; null doc_ids are packed like others; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, text_or_empty
from tidemill.llm.tokens import encode_in_blocks

CAPACITY = 1024
GROUP = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, file string, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def with_place(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, file and place: the file that a row stands in and its number there, or its partition and a null."""
    columns = [F.col(key).cast("long").alias("key"), text_or_empty(text).alias("text")]
    try:
        return docs.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # only a plain scan of files has these
        return docs.select(*columns, F.spark_partition_id().cast("string").alias("file"), F.lit(None).cast("long").alias("place"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each piece; only a document longer than capacity is cut, and its first piece takes the remainder.

    file and place order the documents. They only choose where a piece is packed: were partitions of an input without files dealt
    otherwise when a lost task is run again, groups would be of other sizes and no piece would be lost.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            keys, texts, files, places = (batch.column(c).to_pylist() for c in ("key", "text", "file", "place"))
            for first, made in encode_in_blocks(tokenizer, texts):
                rows = []
                for i, ids in enumerate(made, first):
                    place = seen if places[i] is None else places[i]
                    seen += 1
                    ids = memoryview(ids + end)
                    n, at, k = len(ids) // 4, 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        rows.append((keys[i], k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), files[i], place))
                        at, k, size = at + size, k + 1, capacity
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return with_place(docs, key, text).mapInArrow(split, PIECES)


def grouped(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """The pieces with pack, the number of the group of `group` documents in a row that each is of. One window has a row for each file."""
    files = pieces.groupBy("file").agg((F.max("place") + 1).alias("rows"))
    # names of files end in the number of their partition, which grows longer
    order = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("base"))
    return pieces.join(files, "file").withColumn("pack", F.floor((F.col("base") + F.col("place")) / group).cast("long"))


class Bins:
    """Sequences under local search. Fills only move towards larger sums of squares, so the search ends."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = {"move": 0, "one": 0, "two": 0}

    def best_fit(self, order: list[int]) -> None:
        """Each item goes to the fullest bin that takes it; a bit mask of free places finds it."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for i in order:
            size = self.sizes[i]
            fits = mask >> size
            if fits:
                free = size + (fits & -fits).bit_length() - 1
                b = by_free[free].pop()
                if not by_free[free]:
                    mask ^= 1 << free
            else:
                b, free = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += size
            left = free - size
            if left:
                by_free[left].append(b)
                mask |= 1 << left

    def bound(self) -> int:
        return -(-sum(self.sizes) // self.capacity)

    def _give(self, b: int, out: list[int], a: int, back: list[int]) -> None:
        """Bin b gives items out to bin a and takes items back."""
        for x in (a, b):
            self.held.pop(x, None)
        for i in out:
            self.items[b].remove(i)
        for i in back:
            self.items[a].remove(i)
        self.items[a] += out
        self.items[b] += back
        moved = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self.fill[a] += moved
        self.fill[b] -= moved

    def _offers(self, under: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows (size, bin, item, second item or -1): the single items and the pairs of items of underfull bins.

        Items of one size are alike, so one item stands for its size and two for a pair of equal ones. Different sizes
        in a bin add up to its capacity at most, so there are less than sqrt(2 * capacity) of them, however many items.
        """
        for b in under:
            if b not in self.held:
                alike: dict[int, list[int]] = {}
                for i in self.items[b]:
                    alike.setdefault(self.sizes[i], []).append(i)
                sizes = list(alike)
                one = [(x, b, alike[x][0], -1) for x in sizes]
                two = [(x + y, b, alike[x][0], alike[y][0]) for k, x in enumerate(sizes) for y in sizes[k + 1 :]]
                two += [(2 * x, b, own[0], own[1]) for x, own in alike.items() if len(own) > 1]
                self.held[b] = tuple(np.array(x, dtype=np.int64).reshape(-1, 4) for x in (one, two))
        none = np.zeros((0, 4), dtype=np.int64)
        return tuple(np.concatenate([none, *(self.held[b][k] for b in under)]) for k in (0, 1))

    def _exchanges(self, under: list[int]) -> np.ndarray:
        """Rows (free places left, gain, giving bin, its items, taking bin, its items) of steps that raise the sum of
        squares: for each thing that a bin could give back, the largest offers of other bins that then fit."""
        one, two = self._offers(under)
        none = np.array([(0, b, -1, -1) for b in under], dtype=np.int64).reshape(-1, 4)
        fill = np.array(self.fill, dtype=np.int64)
        searched = []
        for offers, wants in ((np.concatenate([one, two]), np.concatenate([none, one])), (one, two)):
            offers = offers[np.lexsort((-fill[offers[:, 1]], offers[:, 0]))]
            free = self.capacity - fill[wants[:, 1]]
            searched.append((offers, wants, free, np.searchsorted(offers[:, 0], wants[:, 0] + free, side="right") - 1))
        found, open_ = [], True
        while open_ and not found:  # smaller offers are looked at only if no larger one of any bin will do
            open_ = False
            for n, (offers, wants, free, at) in enumerate(searched):
                for _ in range(3):
                    left = np.flatnonzero(at >= 0)
                    give = offers[at[left]]
                    moved = give[:, 0] - wants[left, 0]
                    left, give, moved = left[moved > 0], give[moved > 0], moved[moved > 0]
                    offers, wants, free, at = offers, wants[left], free[left], at[left]
                    gain = moved * (fill[wants[:, 1]] - fill[give[:, 1]] + moved)
                    ok = (gain > 0) & (give[:, 1] != wants[:, 1])
                    if ok.any():
                        found.append(np.column_stack([(free - moved)[ok], gain[ok], give[ok, 1:], wants[ok, 1:]]))
                    at = at - 1
                searched[n] = (offers, wants, free, at)
                open_ |= len(at) > 0
        return np.concatenate(found) if found else np.zeros((0, 8), dtype=np.int64)

    def search(self) -> None:
        """Exchange between all underfull bins until the lower bound is met or no step raises the sum of squares.

        Each round takes the steps that fill a bin first, then those of most gain, and each bin once.
        """
        used, bound = sum(map(bool, self.items)), self.bound()
        under = [b for b, x in enumerate(self.items) if x and self.fill[b] < self.capacity]
        while used > bound:
            steps = self._exchanges(under)
            if not len(steps):
                break
            touched: set[int] = set()
            for _, _, b, i, j, a, t, u in steps[np.lexsort((-steps[:, 1], steps[:, 0] > 0))].tolist():
                if a in touched or b in touched:
                    continue
                touched |= {a, b}
                self._give(b, [x for x in (i, j) if x >= 0], a, [x for x in (t, u) if x >= 0])
                self.steps["move" if t < 0 else "one" if j < 0 and u < 0 else "two"] += 1
                used -= not self.items[b]
            under = [b for b in under if self.items[b] and self.fill[b] < self.capacity]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """The (bin, offset) of each item."""
    bins = Bins(sizes, capacity)
    bins.best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)))
    bins.search()
    places: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for n, items in enumerate(x for x in bins.items if x):
        at = 0
        for i in items:
            places[i] = (n, at)
            at += sizes[i]
    return places


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with the sequence and offset that hold each.

    Only lengths of pieces are shuffled, not ids, and full pieces are not shuffled at all: their sequences have negative
    numbers. Those of the others grow with their group.
    """
    names = [x.split()[0] for x in PACKED.split(", ")]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "file", "place"], ascending=[False, True, True], kind="stable")
        spots = np.array(pack(frame["length"].tolist(), capacity), dtype=np.int64).reshape(-1, 2)
        frame["sequence_id"] = (frame["pack"].to_numpy(dtype=np.int64) << 32) + spots[:, 0]
        frame["offset"] = spots[:, 1]
        return frame[names]

    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return grouped(pieces, group).where(F.col("length") < capacity).groupBy("pack").applyInPandas(place, PACKED).unionByName(full.select(*names))
