"""What the operators share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.session import ship

#: Above so many ids a semi-join shuffles; below, the ids (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000
#: Text bytes that a Python worker handles at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in local mode, one of our own where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def gathered(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df, of narrow rows, checkpointed, and read in as many partitions as there are times rows in it.

    Small tables in many partitions would make every later shuffle write a file for each of them.
    """
    out = checkpointed(df)
    return out.coalesce(out.count() // rows + 1)


def _sized(ids: DataFrame) -> DataFrame:
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return F.broadcast(ids) if few else ids


def semi_join(df: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of df whose key is in ids (distinct); ids are broadcast only when few."""
    return df.join(_sized(ids), on, "left_semi")


def anti_join(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose key isn't in ids (distinct), null keys included; ids are broadcast only when few."""
    return df.join(_sized(ids), on, "left_anti")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches with null texts empty, cut so that a slice holds most bytes of text or one row."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate([*sizes, most + 1]):
            if i > start and (held + n > most or i == len(sizes)):
                part = batch.slice(start, i - start)
                yield part.set_column(at, column, part.column(at).cast(pa.large_string()).fill_null(""))
                start, held = i, 0
            held += n


def _places(hashes: np.ndarray, log_bits: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - log_bits)
    yield hashes >> shift
    yield (hashes * np.uint64(0x9E3779B97F4A7C15)) >> shift


class HashFilter:
    """A fixed number of bits that tells most hashes that aren't in it."""

    def __init__(self, log_bits: int):
        self.log_bits = log_bits
        self.bits = np.zeros(1 << (log_bits - 3), np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in _places(hashes, self.log_bits):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


_PARTS = 6  #: a filter is built in so many parts, as a power of two, of a byte at least


def hash_filter(hashes: DataFrame, column: str, log_bits: int) -> HashFilter:
    """A filter of the hashes, built by the executors in parts; the driver gets its bytes, whose number is fixed."""
    bits = np.uint64(log_bits - min(_PARTS, log_bits - 3))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            at = np.unique(np.concatenate(list(_places(code, log_bits))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> bits).astype(np.int64)), pa.array((at & np.uint64((1 << int(bits)) - 1)).astype(np.int64))], ["part", "at"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            part, at = np.asarray(batch["part"]), np.asarray(batch["at"])
            for p in np.unique(part).tolist():
                here = at[part == p]
                np.bitwise_or.at(found.setdefault(p, np.zeros(1 << int(bits) - 3, np.uint8)), here >> 3, (1 << (here & 7)).astype(np.uint8))
        for p, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["part", "bits"])

    out = HashFilter(log_bits)
    spread = hashes.select(column).mapInArrow(places, "part long, at long").repartition("part")
    for row in spread.mapInArrow(build, "part long, bits binary").collect():
        size = len(row.bits)
        out.bits[row.part * size : (row.part + 1) * size] |= np.frombuffer(row.bits, np.uint8)
    return out
