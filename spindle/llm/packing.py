"""Harmonic packing of token ids into sequences.

A piece of class k is as long as a k-th of the capacity, and a bin of that class holds k pieces. Documents are
cut so that each piece has the length of a class exactly: what a bin leaves free is less than k
tokens, and places follow from counts. Tasks fill their bins on their own. The few pieces of bins that
a task can't fill are handed to one of fewer tasks, until a single one is left, whose last bins,
fewer than there are classes, take pieces of several classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import checkpointed, text_slices
from spindle.llm.encoding import worker_encoder

CAPACITY = 4096
FAN_IN = 32  #: tasks whose open bins meet in one task

_FIELDS = [pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("doc_tokens", pa.int64()), pa.field("ids", pa.large_binary())]
_PIECES = pa.schema(_FIELDS)
_PLACED = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def class_lengths(capacity: int) -> np.ndarray:
    """Lengths of pieces, ascending: the capacity divided by 1, 2, 3 and so on."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def cut_lengths(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per piece its document's place in sizes, and its length: full ones first, then each time the largest class that fits."""
    lengths = class_lengths(capacity)
    full = sizes // capacity
    owner, length = [np.repeat(np.arange(len(sizes)), full)], [np.full(int(full.sum()), capacity, np.int64)]
    at, left = np.flatnonzero(sizes % capacity), (sizes % capacity)[sizes % capacity > 0]
    while len(at):
        taken = lengths[np.searchsorted(lengths, left, "right") - 1]
        owner.append(at)
        length.append(taken)
        at, left = at[left > taken], (left - taken)[left > taken]
    owner, length = np.concatenate(owner), np.concatenate(length)
    order = np.argsort(owner, kind="stable")
    return owner[order], length[order]


class _Bins:
    """Bins of one task; number: the first sequence_id, ids go up from there."""

    def __init__(self, capacity: int, number: int):
        self.capacity, self.number, self.lengths = capacity, number, class_lengths(capacity)
        self.open = _PIECES.empty_table()

    def _out(self, rows: pa.Table, sequence: np.ndarray | None, offset: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        placed = [pa.nulls(len(rows), pa.int64())] * 2 if sequence is None else [pa.array(sequence), pa.array(offset)]
        for name, column in zip(("sequence_id", "offset"), placed, strict=True):
            rows = rows.append_column(name, column)
        at = rows.schema.get_field_index("ids")
        for batch in rows.set_column(at, "ids", rows["ids"].cast(pa.binary())).combine_chunks().to_batches(max_chunksize=20_000):
            yield batch

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pieces of bins that are full now; the others stay open, fewer than a bin's count of each class."""
        rows = pa.concat_tables([self.open, rows])
        length = np.asarray(rows["length"])
        kind = np.searchsorted(self.lengths, length)
        order, many = np.argsort(kind, kind="stable"), np.bincount(kind, minlength=len(self.lengths))
        rank = np.empty(len(kind), np.int64)
        rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(many) - many, many)
        each = self.capacity // self.lengths
        bins = many // each
        base = self.number + np.cumsum(bins) - bins
        done = rank < (bins * each)[kind]
        self.number += int(bins.sum())
        sequence, offset = base[kind] + rank // each[kind], rank % each[kind] * length
        self.open = rows.filter(pa.array(~done)).combine_chunks()
        yield from self._out(rows.filter(pa.array(done)), sequence[done], offset[done])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The open bins' pieces without a place."""
        yield from self._out(self.open, None, None)

    def finish(self) -> Iterator[pa.RecordBatch]:
        """The open bins' pieces, which have a bound, in bins of several classes, longest first."""
        order = np.argsort(-np.asarray(self.open["length"]), kind="stable")
        rows = self.open.take(pa.array(order))
        length = np.asarray(rows["length"])
        kinds, begin, left = np.unique(-length, return_index=True, return_counts=True)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        while left.any():
            used = 0
            for i, size in enumerate((-kinds).tolist()):
                n = min(int(left[i]), (self.capacity - used) // size)
                at = slice(begin[i], begin[i] + n)
                sequence[at], offset[at] = self.number, used + np.arange(n) * size
                begin[i], left[i], used = begin[i] + n, left[i] - n, used + n * size
            self.number += 1
        yield from self._out(rows, sequence, offset)


def _first_number(level: int) -> int:
    """Sequence ids of each level and task have a range of their own."""
    from pyspark import TaskContext

    return level << 58 | TaskContext.get().partitionId() << 33


def _cutter(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = worker_encoder(tokenizer), _Bins(capacity, _first_number(0))
        for batch in text_slices(batches, most=4 << 20):
            ids, first = encoder.ids(batch["text"])
            ids, first = np.insert(ids, first[1:], end_id).astype("<u4"), first + np.arange(len(first))
            sizes = np.diff(first)
            owner, length = cut_lengths(sizes, capacity)
            ends = np.cumsum(length)  # pieces stand in the order of the ids
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int64)), pa.py_buffer(ids)])
            columns = [batch["doc_id"].take(pa.array(owner)), pa.array(ends - length - first[owner]), pa.array(length), pa.array(sizes[owner]), body]
            yield from bins.add(pa.Table.from_arrays(columns, schema=_PIECES))
        yield from bins.rest()

    return run


def _filler(capacity: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(capacity, _first_number(level))
        for batch in batches:
            yield from bins.add(pa.Table.from_batches([batch]).cast(_PIECES))
        yield from bins.finish() if last else bins.rest()

    return run


def packed_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 2, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of all docs (doc_id, text) and their places: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ids: the piece's token ids as little-endian unsigned 32-bit numbers. start: ids of the document before it;
    doc_tokens: its ids with end_id, which is appended. A null or empty text is the end id alone. Repeated
    rows and rows without doc_id are packed each. Pieces of a sequence lie without gaps from 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    level, done = 0, []
    now = checkpointed(docs.mapInArrow(_cutter(tokenizer, capacity, end_id), _PLACED))
    tasks = now.rdd.getNumPartitions()
    while True:
        done.append(now.where("sequence_id is not null"))
        if level and tasks == 1:
            break
        level, tasks = level + 1, -(-max(tasks, 1) // fan_in)
        left = now.where("sequence_id is null").drop("sequence_id", "offset").repartition(tasks)
        now = checkpointed(left.mapInArrow(_filler(capacity, level, tasks == 1), _PLACED))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (as in pieces) of whole sequences; a sequence is no longer than the capacity."""
    own = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    found = pieces.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return found.select("sequence_id", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"))
