"""What several operators need: folds by checksum, and byte arrays of whole text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the mixing and scoring contracts.
WORDS = r"[^\x20\x09-\x0D]+"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def in_bytes(df: DataFrame, rows: int, row_bytes: int, most: int) -> DataFrame:
    """Hint to send a counted table to all tasks if its rows, of ``row_bytes`` at most each, hold at most ``most`` bytes."""
    return F.broadcast(df) if rows * row_bytes <= most else df


def handing_back(step: Callable) -> Callable:
    """A step of mapInArrow whose worker gives Arrow's free memory back behind each task; it would keep it while it waits for the next."""

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        pa.default_memory_pool().release_unused()

    return stepped


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and the n + 1 places where texts begin; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0]:starts[-1]], starts - starts[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly: xor-shift and multiply, twice."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A fixed random value per byte, for hashes of words.
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0xD1342543DE82EF95)
STEP_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
REACH = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def cut_words(flat: np.ndarray, starts: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end; a word ends at a blank byte or with its text."""
    solid = np.zeros(len(flat) + 2, bool)
    solid[1:-1] = ~blank[flat]
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    # texts stand next to each other without anything between them
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    begins[inner] |= solid[1:-1][inner]
    ends[inner - 1] |= solid[1:-1][inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_words(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, by running sums over stretches of text."""
    out = np.empty(len(begins), np.uint64)
    low = 0
    forth, back = powers(STEP, REACH), powers(STEP_BACK, REACH)
    while low < len(begins):
        first = begins[low]
        high = max(low + 1, int(np.searchsorted(ends, first + REACH, "right")))
        size = int(ends[high - 1] - first)
        if size > len(forth):
            forth, back = powers(STEP, size), powers(STEP_BACK, size)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(BYTE_VALUES[flat[first:first + size]] * forth[:size], out=run[1:])
        s, e = begins[low:high] - first, ends[low:high] - first
        out[low:high] = (run[e] - run[s]) * back[s] + (e - s).astype(np.uint64)
        low = high
    return mixed(out)


def per_text(begins: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words begin in each text."""
    return np.diff(np.searchsorted(begins, starts))
