"""What the text operators share: columns that cannot clash, hash splits, stored frames, byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.session import stage

#: Bytes of text that one numpy step looks at; longer texts make a step of their own.
SLICE_BYTES = 512 << 10
#: Rows that one step of a Python operator takes at most.
ROWS = 2000


def documents(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key written as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def filled(column: str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def drawn(wanted: int, rows: int, *columns: str) -> Column:
    """Whether a row belongs to a sample of about `wanted` of `rows` rows, by a 64-bit hash of `columns`.

    The same rows in every layout; equal rows go together, so collapse them before a bounded fit.
    """
    if rows <= wanted:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(int((1 << 64) * wanted // rows) - (1 << 63))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts, counted over the whole table."""
    return df.agg(F.coalesce(F.sum(F.octet_length(filled(text))), F.lit(0))).first()[0]


def released() -> None:
    """Gives a worker's free memory back: the worker stays for later stages, its free memory need not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # numpy's arrays; other C libraries do it by themselves
    if trim is not None:
        trim(0)


def with_python(df: DataFrame, inputs: dict[str, Column], schema: str, step: Callable) -> DataFrame:
    """`df` with the columns `step` makes of `inputs`; columns of `df` with the same names give way.

    `step(batch)` gets a record batch of the inputs and returns one array per column of `schema`.  All
    other columns travel in one struct, so their names never clash with the inputs.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    keep = [c for c in df.columns if c not in names]
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("none"))
    packed = df.select(kept.alias("_row"), *[column.alias(name) for name, column in inputs.items()])
    row_type = packed.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = batch.column(batch.schema.get_field_index("_row"))
            made = step(batch)
            yield pa.RecordBatch.from_arrays([rows, *made], names=["_row", *names])
        released()

    out = packed.mapInArrow(run, f"_row {row_type}, {schema}")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], *names)


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls, as numpy views."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, np.int64)
    bounds = bounds[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(bounds) == 0:
        bounds = np.zeros(1, np.int64)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# fixed values: ASCII letters to lower case; blanks of the shingle words; characters of the plain words
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, *range(9, 14)]] = False
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, row, first byte and end of every word: a maximal run of lower-cased `inside` bytes in a row.

    A word's hash is a polynomial in its bytes modulo 2**64, scrambled.
    """
    low = LOWER[raw]
    mask = inside[low]
    start, stop = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    stop[:-1] &= ~mask[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    start[edges] = mask[edges]
    stop[edges - 1] = mask[edges - 1]
    first = np.flatnonzero(start)
    end = np.flatnonzero(stop) + 1
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    length = end - first
    powers = np.full(int(length.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw)))) if first[0] == 0 else None
    if place is None:
        place = np.zeros(len(raw), np.int64)
        place[first[0] :] = np.arange(first[0], len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    terms = np.where(mask, (low.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)], np.uint64(0))
    sums = np.add.reduceat(terms, first)
    row = np.searchsorted(bounds, first, side="right") - 1
    return mixed(sums + length.astype(np.uint64)), row, first, end


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: later steps do not compute it again, and a lost
    executor costs nothing."""
    return stage(df, f"llm-{name}")
