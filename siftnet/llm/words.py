"""Vectorised words and word hashes over Arrow batches of texts.

Everything works on the UTF-8 bytes of many texts at once. Hashes are polynomials modulo 2**64 read off prefix sums, so the
hash of any run of bytes or words costs two lookups; a final mix spreads them. Equal runs have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text worked on at once. Arrays of eight bytes a position are made, so this bounds a task's memory.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Odd multipliers of the two polynomial families.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            for name, value in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, value, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


_POWERS = tuple(_Powers(base) for base in BASES)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of values[start:end] for every pair; the length takes part through the mix of the values themselves."""
    up, down = _POWERS[family].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASES[1 - family]))


class RunHasher:
    """The hashes of :func:`run_hashes` for many calls over the same values."""

    def __init__(self, values: np.ndarray, family: int = 0):
        up, self.down = _POWERS[family].get(len(values) + 1)
        self.salt = np.uint64(BASES[1 - family])
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * up[: len(values)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * self.salt)


@dataclass
class Words:
    """The words of a run of texts: byte places, and for each text the number of its first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # one more than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def hashes(self, family: int = 0) -> np.ndarray:
        return run_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, family)

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)

    def texts(self, i: int) -> list[bytes]:
        lo, hi = self.firsts[i], self.firsts[i + 1]
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[lo:hi], self.ends[lo:hi])]


def split(data: np.ndarray, bounds: np.ndarray, lower: bool = False, separator: np.ndarray = SPACE) -> Words:
    """Words of the texts data[bounds[i]:bounds[i+1]]: longest runs of bytes that are no separators."""
    if lower:
        data = LOWER[data]
    word = ~separator[data]
    inner_start, inner_end = np.zeros(len(word), bool), np.zeros(len(word), bool)
    inner_start[1:] = word[:-1]
    inner_end[:-1] = word[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(word))]
    inner_start[cuts] = False
    inner_end[cuts - 1] = False
    starts = np.flatnonzero(word & ~inner_start)
    ends = np.flatnonzero(word & ~inner_end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def word_array(words: Words, separator: np.ndarray = SPACE) -> pa.Array:
    """The words as an Arrow array of their bytes. All bytes that are no separators belong to words."""
    offsets = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=offsets[1:])
    content = words.data[~separator[words.data]]
    return pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(offsets), pa.py_buffer(content)])


def word_ids(words: Words, separator: np.ndarray = SPACE) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return word_array(words, separator).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def window_hashes(words: Words, values: np.ndarray, length: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of ``length`` words that lies inside one text."""
    owner_end = np.repeat(words.firsts[1:], words.counts)
    starts = np.arange(len(values))
    starts = starts[starts + length <= owner_end]
    return starts, run_hashes(values, starts, starts + length, family)


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about CHUNK_BYTES of text (one row at least): first row, end, bytes, bounds. Null counts as empty."""
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_chunk(
    df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], column: str = "text"
) -> DataFrame:
    """mapInArrow with bounded chunks: fn(rows, bytes, bounds) gives the output rows of a chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in chunks(batch, column):
                out = fn(batch.slice(lo, hi - lo), data, bounds)
                if out.num_rows:
                    yield out

    return small_batches(df).mapInArrow(run, schema)


def small_batches(df: DataFrame) -> DataFrame:
    """Few rows go to Python at once: a row may be long, and the default of ten thousand rows has no bound in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return df


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The rows without columns of these names: an operator's own columns win over input columns of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def long_ids(df: DataFrame) -> DataFrame:
    """``df`` with doc_id as a long; untouched if it is one, as a needless alias keeps equal shuffles from being shared."""
    return df if dict(df.dtypes)["doc_id"] == "bigint" else df.withColumn("doc_id", F.col("doc_id").cast("long"))
