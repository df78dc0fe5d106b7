"""Big-endian reads from BINARY columns. Offsets count from 0 and may be columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _int(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def cut(data: Column, offset: int | Column, length: int | Column) -> Column:
    """``length`` bytes from ``offset``; shorter where the data end."""
    return F.substring(data, _int(offset) + 1, _int(length))


def unsigned(data: Column) -> Column:
    """1 to 8 bytes as BIGINT; null for other lengths and for values of 2^63 and above."""
    value = F.conv(F.hex(data), 16, 10).try_cast("bigint")
    return F.when(F.length(data).between(1, 8), value)


def uint(data: Column, offset: int | Column, width: int) -> Column:
    """Fixed-width read, null past the end."""
    part = cut(data, offset, width)
    return F.when(F.length(part) == width, F.conv(F.hex(part), 16, 10).try_cast("bigint"))


def low_bits(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def to_bytes(value: Column, width: int) -> Column:
    """The opposite of :func:`uint`: a non-negative BIGINT as ``width`` bytes."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


# ------------------------------------------------------------------------------------------------------------ octets
#
# Reading many fields of one value through substring, hex and conv costs a text conversion per field. Where a decoder
# reads dozens of fields it asks for the bytes as an array once; Arrow makes that a change of type, not a loop.


@F.arrow_udf(T.ArrayType(T.ShortType()))
def octets(data: pa.Array) -> pa.Array:
    """Bytes of a BINARY as an array of 0..255."""
    width = np.int64 if pa.types.is_large_binary(data.type) else np.int32
    _, offsets, values = data.buffers()
    if offsets is None or len(data) == 0:
        return pa.array([None] * len(data), pa.list_(pa.int16()))
    bounds = np.frombuffer(offsets, dtype=width)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(values, dtype=np.uint8) if values is not None else np.empty(0, np.uint8)
    content = pa.array(raw[bounds[0] : bounds[-1]].astype(np.int16))
    lists = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), content)
    if data.null_count == 0:
        return lists
    return pc.if_else(pc.is_valid(data), lists, pa.scalar(None, lists.type))


def octet(array: Column, offset: int | Column) -> Column:
    """One byte, null past the end."""
    return F.get(array, _int(offset)).cast("bigint")


def number(array: Column, offset: int | Column, width: int) -> Column:
    """Big-endian unsigned of up to 8 bytes, null past the end and from 2^63 on."""
    value = octet(array, offset)
    if width == 8:
        value = F.when(value < 128, value)
    for i in range(1, width):
        value = F.shiftleft(value, 8) + octet(array, _int(offset) + i)
    return value
